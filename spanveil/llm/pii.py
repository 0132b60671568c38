"""Personal data: base patterns, and a character BiLSTM with CRF transitions that adds to them.

The network is trained in numpy on labelled spans: windows of a bounded sample of documents
(``SAMPLE`` documents that hold a digit or ``@``, at most ``PER_DOC`` windows of each), labelled
by the base patterns, together with altered copies (a phone number without its country code, an
address with a letter outside ASCII) which carry the same labels.  Characters enter by class:
letter cases, digit, each mark, white space.

A text is covered by windows of ``WIDTH`` characters at every ``STRIDE``.  Every kind needs a
digit or ``@``, so windows without one can hold no span and are passed over.  Each window is
decoded with the CRF; a span cut by a window's edge is left to the next window.  The spans of
all windows of a text are then reconciled at once: equal spans are put together, and the
non-overlapping set of the largest total confidence is kept.  What passes the form check of
its kind and touches no base span is added; base spans always stay.

Defined cases: a null text counts as empty and has no spans.  Offsets count code points.
Where the sample has no base span, nothing is added.  Repeated rows give repeated rows; an empty
table gives an empty result; other columns are not read.  All patterns are linear in the text.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held, mapped, per_batch

KINDS = ("email", "ip", "card", "phone")
SAMPLE, PER_DOC = 1500, 8
WIDTH, STRIDE = 96, 48
HIDDEN, STEPS, BATCH, RATE = 12, 150, 96, 0.03
SURE = 0.6

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_HINT = re.compile("[0-9@]")


def _digits(text: str) -> str:
    return re.sub("[^0-9]", "", text)


def _luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(map(int, reversed(digits))):
        total += d if k % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _is_ip(text: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 and not p[:-3].strip("0") for p in text.split("."))


def _is_card(text: str) -> bool:
    digits = _digits(text)
    return 13 <= len(digits) <= 19 and _luhn(digits)


def _emails(text: str) -> list[tuple[int, int]]:
    """Addresses from each ``@``: the run before it, and the domain after it."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            done = domain.end()
            out.append((start, done))
        at = text.find("@", max(at + 1, done))
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(kind, start, end)`` by kind and start."""
    if not _HINT.search(text):
        return []
    out = [(0, s, e) for s, e in _emails(text)]
    out += [(1, *m.span()) for m in _IP.finditer(text) if _is_ip(m.group())]
    out += [(2, *m.span()) for m in _CARD.finditer(text) if _is_card(m.group())]
    out += [(3, *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m.group())) <= 15]
    return out


# Character classes: 0 outside the text, then letters and digits by kind, each ASCII mark, the rest.
_PAD, _LOWER, _UPPER, _DIGIT, _OTHER = range(5)
_CLASS = np.full(129, _OTHER, np.uint8)
for _k, _c in enumerate(c for c in range(128) if not chr(c).isalnum()):
    _CLASS[_c] = 5 + min(_k, 60)
_CLASS[ord("a") : ord("z") + 1] = _LOWER
_CLASS[ord("A") : ord("Z") + 1] = _UPPER
_CLASS[ord("0") : ord("9") + 1] = _DIGIT
CLASSES = int(_CLASS.max()) + 1
_AT = _CLASS[ord("@")]
TAGS = 1 + 2 * len(KINDS)
#: Transitions that no tagging may have: into the inside of a kind from anything but that kind.
_BARRED = np.zeros((TAGS, TAGS), np.float32)
for _k in range(len(KINDS)):
    _inside = 2 + 2 * _k
    _BARRED[[t for t in range(TAGS) if t not in (_inside - 1, _inside)], _inside] = -1e4


def classes(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return _CLASS[np.minimum(points, 128)]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


class Tagger:
    """A bidirectional LSTM over character classes with linear-chain CRF transitions."""

    def __init__(self, parameters: dict[str, np.ndarray] | None = None, seed: int = 5):
        rng = np.random.default_rng(seed)
        h = HIDDEN
        self.p: dict[str, np.ndarray] = dict(parameters or {})
        for d in "fb" if parameters is None else "":
            self.p["x" + d] = rng.normal(0, 0.3, (CLASSES, 4 * h)).astype(np.float32)
            self.p["h" + d] = rng.normal(0, h**-0.5, (h, 4 * h)).astype(np.float32)
            self.p["c" + d] = np.repeat(np.array([0, 1, 0, 0], np.float32), h)
        if parameters is None:
            self.p["out"] = rng.normal(0, (2 * h) ** -0.5, (2 * h, TAGS)).astype(np.float32)
            self.p["bias"] = np.zeros(TAGS, np.float32)
            self.p["move"] = np.zeros((TAGS, TAGS), np.float32)

    def _run(self, x: np.ndarray, d: str, keep: bool) -> tuple[np.ndarray, list]:
        """States over time (n, time, hidden); gates in the order input, forget, output, new."""
        n, width = x.shape
        hh, cc, states, tape = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32), np.empty((n, width, HIDDEN), np.float32), []
        table = self.p["x" + d] + self.p["c" + d]
        for t in range(width) if d == "f" else range(width - 1, -1, -1):
            z = table[x[:, t]] + hh @ self.p["h" + d]
            s, g = _sigmoid(z[:, : 3 * HIDDEN]), np.tanh(z[:, 3 * HIDDEN :])
            i, f, o = s[:, :HIDDEN], s[:, HIDDEN : 2 * HIDDEN], s[:, 2 * HIDDEN :]
            before, last = cc, hh
            cc = f * cc + i * g
            tc = np.tanh(cc)
            hh = o * tc
            states[:, t] = hh
            if keep:
                tape.append((t, i, f, o, g, before, tc, last))
        return states, tape

    def emissions(self, x: np.ndarray) -> np.ndarray:
        both = np.concatenate([self._run(x, d, False)[0] for d in "fb"], axis=2)
        return self._masked(x, both @ self.p["out"] + self.p["bias"])

    @staticmethod
    def _masked(x: np.ndarray, e: np.ndarray) -> np.ndarray:
        e[..., 1:] = np.where((x == _PAD)[..., None], -1e4, e[..., 1:])
        return e

    def decode(self, e: np.ndarray) -> np.ndarray:
        """The best tags of each window (Viterbi)."""
        move = self.p["move"] + _BARRED
        n, width, _ = e.shape
        back = np.empty((n, width, TAGS), np.int8)
        best = e[:, 0] + _BARRED[0]
        for t in range(1, width):
            paths = best[:, :, None] + move
            back[:, t] = paths.argmax(axis=1)
            best = paths.max(axis=1) + e[:, t]
        tags = np.empty((n, width), np.int8)
        tags[:, -1] = best.argmax(axis=1)
        for t in range(width - 1, 0, -1):
            tags[:, t - 1] = back[np.arange(n), t, tags[:, t]]
        return tags

    def _sums(self, e: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Log sums over all taggings: up to each tag, after each tag, and in all."""
        n, width, _ = e.shape
        move = self.p["move"] + _BARRED
        ahead = np.empty((n, width, TAGS))
        ahead[:, 0] = e[:, 0] + _BARRED[0]
        for t in range(1, width):
            s = ahead[:, t - 1, :, None] + move
            top = s.max(axis=1)
            ahead[:, t] = e[:, t] + top + np.log(np.exp(s - top[:, None]).sum(axis=1))
        behind = np.zeros((n, width, TAGS))
        for t in range(width - 2, -1, -1):
            s = move + (e[:, t + 1] + behind[:, t + 1])[:, None, :]
            top = s.max(axis=2)
            behind[:, t] = top + np.log(np.exp(s - top[:, :, None]).sum(axis=2))
        top = ahead[:, -1].max(axis=1)
        whole = top + np.log(np.exp(ahead[:, -1] - top[:, None]).sum(axis=1))
        return ahead, behind, whole

    def marginals(self, e: np.ndarray) -> np.ndarray:
        """The probability of each tag at each place."""
        ahead, behind, whole = self._sums(e)
        return np.exp(ahead + behind - whole[:, None, None])

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log likelihood of the tags, and its gradients."""
        n, width = x.shape
        runs = {d: self._run(x, d, True) for d in "fb"}
        both = np.concatenate([runs[d][0] for d in "fb"], axis=2)
        e = self._masked(x, both @ self.p["out"] + self.p["bias"])
        ahead, behind, whole = self._sums(e)
        move = self.p["move"] + _BARRED
        rows, times = np.arange(n)[:, None], np.arange(width)[None]
        told = e[rows, times, y].sum(axis=1) + move[y[:, :-1], y[:, 1:]].sum(axis=1)
        de = np.exp(ahead + behind - whole[:, None, None])
        de[rows, times, y] -= 1
        de = (de / n).astype(np.float32)
        de[..., 1:] *= (x != _PAD)[..., None]
        dmove = np.zeros((TAGS, TAGS))
        for t in range(1, width):
            dmove += np.exp(ahead[:, t - 1, :, None] + move + (e[:, t] + behind[:, t])[:, None, :] - whole[:, None, None]).sum(axis=0)
        np.add.at(dmove, (y[:, :-1].ravel(), y[:, 1:].ravel()), -1)
        grads = {"out": both.reshape(-1, 2 * HIDDEN).T @ de.reshape(-1, TAGS), "bias": de.sum(axis=(0, 1)), "move": (dmove / n).astype(np.float32)}
        dboth, one_hot = de @ self.p["out"].T, np.eye(CLASSES, dtype=np.float32)[x]
        for k, d in enumerate("fb"):
            dstate = dboth[:, :, k * HIDDEN : (k + 1) * HIDDEN]
            dx, dh, dbias = np.zeros((CLASSES, 4 * HIDDEN), np.float32), np.zeros((HIDDEN, 4 * HIDDEN), np.float32), np.zeros(4 * HIDDEN, np.float32)
            hh, cc = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
            for t, i, f, o, g, before, tc, last in reversed(runs[d][1]):
                hh = hh + dstate[:, t]
                cc = cc + hh * o * (1 - tc * tc)
                dz = np.concatenate([cc * g * i * (1 - i), cc * before * f * (1 - f), hh * tc * o * (1 - o), cc * i * (1 - g * g)], axis=1)
                dx += one_hot[:, t].T @ dz
                dh += last.T @ dz
                dbias += dz.sum(axis=0)
                hh, cc = dz @ self.p["h" + d].T, cc * f
            grads |= {"x" + d: dx, "h" + d: dh, "c" + d: dbias}
        return float((whole - told).mean()), grads

    def fit(self, x: np.ndarray, y: np.ndarray, steps: int = STEPS, seed: int = 11) -> float:
        """Adam on batches of windows; gives the loss of the last batch."""
        rng = np.random.default_rng(seed)
        first = {k: np.zeros_like(v) for k, v in self.p.items()}
        second = {k: np.zeros_like(v) for k, v in self.p.items()}
        loss = 0.0
        for step in range(1, steps + 1):
            part = rng.integers(0, len(x), min(BATCH, len(x)))
            loss, grads = self.gradients(x[part], y[part])
            rate = RATE * (1 - 0.9 * step / steps) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            for k, g in grads.items():
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                self.p[k] = self.p[k] - rate * first[k] / (np.sqrt(second[k]) + 1e-8)
        return loss


def windows(codes: np.ndarray) -> list[int]:
    """Starts of the windows that hold a digit or ``@``.

    Places further apart than a window are groups of their own, and a group's windows are laid out
    from its first place: what stands far before it moves no window.
    """
    hits = np.flatnonzero((codes == _DIGIT) | (codes == _AT))
    if not len(hits):
        return []
    new = np.append(True, np.diff(hits) > WIDTH)
    first = hits[np.maximum.accumulate(np.where(new, np.arange(len(hits)), 0))] - STRIDE
    grid = first + (hits - first) // STRIDE * STRIDE
    starts = np.concatenate([grid - k * STRIDE for k in range(WIDTH // STRIDE)])
    return np.unique(np.clip(starts, 0, max(0, len(codes) - WIDTH))).tolist()


def reconciled(found: dict[tuple[int, int, int], list[float]]) -> list[tuple[int, int, int]]:
    """Of the windows' spans, the non-overlapping set with the largest total confidence."""
    spans = sorted((e, s, k, sum(c)) for (k, s, e), c in found.items() if sum(c) / len(c) >= SURE)
    ends, best = [s[0] for s in spans], [(0.0, None)]
    for j, (_, start, _, weight) in enumerate(spans):
        before = bisect_right(ends, start, 0, j)
        best.append(max(best[-1], (best[before][0] + weight, j), key=lambda x: x[0]))
    out, j = [], len(spans)
    while j:
        if best[j][1] == j - 1 and best[j][0] > best[j - 1][0]:
            e, s, k, _ = spans[j - 1]
            out.append((k, s, e))
            j = bisect_right(ends, s, 0, j - 1)
        else:
            j -= 1
    return sorted(out)


_FORMS = {
    0: re.compile(r"[^\s@]+@[^\s@]+\.[^\s@]*\w"),
    1: re.compile(r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}"),
    2: re.compile(r"[0-9][0-9 .-]+[0-9]"),
    3: re.compile(r"[+(]?[0-9][0-9]*(?:[ ().-]+[0-9]+)+"),
}


def well_formed(kind: int, text: str) -> bool:
    """The form check of a span that the network adds."""
    if not _FORMS[kind].fullmatch(text):
        return False
    return {1: _is_ip, 2: _is_card, 3: lambda t: 9 <= len(_digits(t)) <= 15}.get(kind, lambda t: True)(text)


def _spans(tag: np.ndarray, share: np.ndarray, n: int) -> list[tuple[int, int, int, float]]:
    """``(kind, start, end, mean probability)`` of the spans in one window's tags."""
    out = []
    for s in np.flatnonzero(tag[:n] % 2 == 1):
        e = int(s) + 1
        while e < n and tag[e] == tag[s] + 1:
            e += 1
        out.append((int(tag[s]) // 2, int(s), e, float(share[np.arange(s, e), tag[s:e]].mean())))
    return out


def _decoded_whole(tagger: Tagger, codes: np.ndarray, cut: list[tuple[int, int]]) -> dict[tuple[int, int, int], list[float]]:
    """The spans of the stretches ``cut``, which touch edges of their windows, decoded in windows that hold them.

    Stretches that overlap are one.  Its window is centred on it and widened until no span in the
    stretch touches an edge, at last to the whole text; so neither length nor place decides.
    """
    found: dict[tuple[int, int, int], list[float]] = {}
    todo, margin = sorted(cut), WIDTH
    while todo:
        joined: list[list[int]] = []
        for s, e in todo:
            if joined and s <= joined[-1][1]:
                joined[-1][1] = max(joined[-1][1], e)
            else:
                joined.append([s, e])
        todo = []
        for s, e in joined:
            lo, hi = max(0, s - margin), min(len(codes), e + margin)
            emitted = tagger.emissions(codes[None, lo:hi])
            spans = [(k, lo + a, lo + b, sure) for k, a, b, sure in _spans(tagger.decode(emitted)[0], tagger.marginals(emitted)[0], hi - lo) if lo + a < e and lo + b > s]
            at_edge = [(a, b) for _, a, b, _ in spans if (a == lo and lo) or (b == hi and hi < len(codes))]
            if at_edge:
                todo.append((min(s, *(a for a, _ in at_edge)), max(e, *(b for _, b in at_edge))))
            else:
                for k, a, b, sure in spans:
                    found.setdefault((k, a, b), []).append(sure)
        margin *= 2
    return found


def added_spans(tagger: Tagger, texts: list[str], base: list[list[tuple[int, int, int]]]) -> list[list[tuple[int, int, int]]]:
    """For each text the spans that the network adds to the base spans."""
    out: list[list] = [[] for _ in texts]
    found: list[dict] = [{} for _ in texts]
    cut: list[list] = [[] for _ in texts]
    jobs = [(k, c, s) for k, t in enumerate(texts) if _HINT.search(t) for c in [classes(t)] for s in windows(c)]
    for at in range(0, len(jobs), 1024):
        part = jobs[at : at + 1024]
        x = np.zeros((len(part), WIDTH), np.uint8)
        for row, (_, codes, start) in enumerate(part):
            piece = codes[start : start + WIDTH]
            x[row, : len(piece)] = piece
        e = tagger.emissions(x)
        tags = tagger.decode(e)
        share = tagger.marginals(e)
        for row, (k, codes, start) in enumerate(part):
            for kind, s, e_, sure in _spans(tags[row], share[row], min(WIDTH, len(codes) - start)):
                if (s == 0 and start) or (e_ == WIDTH and start + WIDTH < len(codes)):
                    cut[k].append((start + s, start + e_))
                else:
                    found[k].setdefault((kind, start + s, start + e_), []).append(sure)
    for k, text in enumerate(texts):
        # A span that is whole in another window needs no wider one.
        whole = sorted((s, e) for _, s, e in found[k])
        reach = list(np.maximum.accumulate([e for _, e in whole])) if whole else []
        inside = lambda s, e: (at := bisect_right(whole, (s, len(text) + 1))) and reach[at - 1] >= e  # noqa: B023, E731
        if left := [(s, e) for s, e in cut[k] if not inside(s, e)]:
            for span, sure in _decoded_whole(tagger, classes(text), left).items():
                found[k].setdefault(span, []).extend(sure)
        if found[k]:
            taken = sorted((s, e) for _, s, e in base[k])
            starts, longest = [s for s, _ in taken], list(np.maximum.accumulate([e for _, e in taken])) if taken else []
            for kind, s, e in reconciled(found[k]):
                before = bisect_right(starts, e - 1)
                if well_formed(kind, text[s:e]) and not (before and longest[before - 1] > s):
                    out[k].append((kind, s, e))
    return out


def listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in sorted(spans))


def _windows_to_learn(texts: list[bytes]) -> list[pa.Array]:
    """Of each text, up to ``PER_DOC`` windows around base spans and other digits, as ``start of the window, spans`` lines."""
    made = []
    for raw in texts:
        text = raw.decode("utf-8", "replace")
        spans = base_spans(text)
        rng = np.random.default_rng(zlib.crc32(raw))
        others = [m.start() for m in re.finditer("[0-9@]+", text) if not any(s <= m.start() < e for _, s, e in spans[:1000])]
        rng.shuffle(others)
        chosen = []
        for at in [s for _, s, _ in spans][: PER_DOC - 2] + others[:PER_DOC]:
            start = max(0, at - int(rng.integers(0, WIDTH - 40)))
            inside = [(k, max(s - start, 0), e - start) for k, s, e in spans if s >= start and e <= start + WIDTH]
            chosen.append(text[start : start + WIDTH].replace("\x00", " ") + "\x00" + listed(inside))
        made.append(chosen[:PER_DOC])
    return [pa.array(made, pa.list_(pa.string()))]


def _altered(text: str, spans: list[tuple[int, int, int]]) -> tuple[str, list[tuple[int, int, int]]] | None:
    """A copy in which a phone number has no country code, or an address a letter outside ASCII."""
    for k, s, e in spans:
        span = text[s:e]
        if k == 3:
            new = re.sub(r"^\+[0-9]+[ -]?", "", span)
            if 9 <= len(_digits(new)) and new != span and not new.isdigit():
                moved = [(a, b - (b > s) * (len(span) - len(new)), c - (c > s) * (len(span) - len(new))) for a, b, c in spans]
                return text[:s] + new + text[e:], moved
        if k == 0:
            return text[:s] + "é" + text[s + 1 :], spans
    return None


def learned(docs: DataFrame) -> Tagger | None:
    """A tagger fitted on the bounded sample; None where the sample holds no base span."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where(F.col("text").rlike("[0-9@]"))
    ids = rows.select("doc_id", F.xxhash64("doc_id").alias("h")).orderBy("h", "doc_id").limit(SAMPLE).where("doc_id IS NOT NULL").distinct()
    bounded = docs.sparkSession.createDataFrame([(r.doc_id,) for r in ids.collect()], "doc_id long")
    snippets = (
        rows.join(F.broadcast(bounded), "doc_id").mapInArrow(per_batch(_windows_to_learn, ["windows"]), "doc_id long, windows array<string>")
        .select(F.explode("windows").alias("w")).orderBy(F.xxhash64("w"), "w").limit(SAMPLE * PER_DOC)
    )
    xs, ys = [], []
    for row in snippets.toLocalIterator():
        text, _, spans = row.w.partition("\x00")
        spans = [(KINDS.index(k), int(s), int(e)) for k, s, e in (x.split(":") for x in spans.split(",") if x)]
        for t, marks in filter(None, [(text, spans), _altered(text, spans)]):
            x, y = np.zeros(WIDTH, np.uint8), np.zeros(WIDTH, np.int64)
            codes = classes(t)[:WIDTH]
            x[: len(codes)] = codes
            for k, s, e in marks:
                y[s:e] = 2 + 2 * k
                y[s] = 1 + 2 * k
            xs.append(x)
            ys.append(y)
    if not any(y.any() for y in ys):
        return None
    tagger = Tagger()
    tagger.fit(np.array(xs), np.array(ys))
    return tagger


def personal_data(docs: DataFrame) -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans`` of each row; ``spans`` holds base and added ones."""
    tagger = learned(docs)
    shared, key = docs.sparkSession.sparkContext.broadcast(tagger.p if tagger else None), uuid.uuid4().hex

    def build(raw: list[bytes]) -> list[pa.Array]:
        tagger = shared.value and held(key, lambda: Tagger(shared.value))
        texts = [r.decode("utf-8", "replace") for r in raw]
        base = [base_spans(t) for t in texts]
        added = added_spans(tagger, texts, base) if tagger else [[] for _ in texts]
        counts = [pa.array([sum(k == kind for k, _, _ in b) for b in base], pa.int64()) for kind in range(len(KINDS))]
        digests = pa.array([hashlib.sha256(listed(b).encode()).hexdigest() for b in base], pa.string())
        return [*counts, digests, pa.array([listed(b + a) for b, a in zip(base, added, strict=True)], pa.string())]

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    names = [*(f"n_{k}" for k in KINDS), "base_sha256", "spans"]
    return mapped(
        rows, per_batch(build, names), "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string", "pii"
    )
