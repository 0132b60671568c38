"""BPE encoding and decoding with a tokenization automaton.

The states of the automaton are the tokens (what was read last); an arc x -> y says that token y
may follow token x.  It is compiled by one gadget per merge, in the order of the merges.  For the
merge of u and v to w the gadget

* adds the state w, whose arcs are a copy of those that v has at that moment,
* takes the arc u -> v away,
* adds an arc x -> w for each x that then has an arc to u.

Written out, the arcs of 49,000 tokens would be some billions, yet few numbers hold them all.
Tokens are numbered depth first by their left part, later ones first.  What a gadget takes away
from u is then one range of numbers: v, and all that is made later with v at its left end, as the
third step gives those no arc from u either.  So a state owns one range for each merge that
begins with it, and a copied state owns those ranges of its original that are older than the copy.
``Automaton`` keeps the ranges, the originals and the times of the copies in flat integer arrays,
with the transitions of the symbols (a goto table with failure links over all tokens, the last
symbol of a word being a symbol of its own).  The driver compiles them once, and they are broadcast.

A word is encoded in one pass over its symbols.  The goto table tells the tokens that end at a
place, and exactly one of them has an arc from the state at the place where it begins: that is the
state here.  No place is looked at again.  Many words are stepped through at once, one symbol of
each at a time.  Decoding emits the labels of the arcs.

Splitting into words (normalisation, the pattern, special strings) is done by the tokenizer
file's own steps; for ASCII and Latin letters they are one pattern.  They never cross white space, so a worker keeps
the result of each distinct piece in a bounded cache, and steps through the new ones of many texts together.

Defined cases: a null text counts as empty; an empty text has no tokens and decodes to an empty
text.  Repeated rows give repeated rows; an empty table gives an empty result; other columns are
not read.  A tokenizer file of another kind (no word ends, a decoder, a prompt for unknown
symbols) is refused with ``ValueError``.
"""

from __future__ import annotations

import json
import re
import uuid
from hashlib import sha256
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held, mapped, per_batch, returned, word_end_file

#: New pieces of texts that a worker keeps at a time; longer ones than ``KEPT`` bytes are not kept.
CACHE, KEPT = 80_000, 256
#: Places of the tables of transitions and arcs that were looked up, as a power of two.
SEEN = 19
#: Words that are stepped through together, and the longest of them in symbols; others go alone.
TOGETHER, LONGEST = 1 << 14, 48

#: The bytes of a text as the base symbols of the vocabulary: visible ones stand for themselves,
#: the others follow from code point 256 on.
VISIBLE = [*range(ord("!"), ord("~") + 1), *range(ord("\xa1"), ord("\xac") + 1), *range(ord("\xae"), ord("\xff") + 1)]
SYMBOLS = {b: chr(b) for b in VISIBLE} | {b: chr(256 + k) for k, b in enumerate(sorted({*range(256)} - {*VISIBLE}))}
BYTES = {ord(c): b for b, c in SYMBOLS.items()}
#: Symbols of the automaton: 256 bytes, and the same as the last of a word.
ALPHABET = 512


def symbols_of(token: str, end: str) -> list[int]:
    last = token.endswith(end) and token != end
    numbers = [BYTES[ord(c)] for c in (token.removesuffix(end) if last else token)]
    return numbers[:-1] + [numbers[-1] + 256] if last else numbers


class Seen:
    """A table of fixed size with what was looked up last: of keys with one place, the later one stays."""

    def __init__(self, kind, bits: int = SEEN):
        self.kind, self.bits, self.keys = kind, bits, None

    def __getstate__(self) -> dict:
        return {"kind": self.kind, "bits": self.bits, "keys": None}

    def of(self, key: np.ndarray, make) -> np.ndarray:
        """The value of each key; ``make(keys)`` gives those that are not in the table."""
        if self.keys is None:
            self.keys, self.values = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits, self.kind)
        place = (key * 0x9E3779B1 >> 16) & ((1 << self.bits) - 1)
        out = self.values[place]
        new = np.flatnonzero(self.keys[place] != key)
        if len(new):
            keys = key[new]
            out[new] = made = make(keys)
            # One assignment of both: an index that comes twice must not get the key of one and the value of another.
            at, last = np.unique(place[new][::-1], return_index=True)
            self.keys[at], self.values[at] = keys[::-1][last], made[::-1][last]
        return out


class Automaton:
    """Transitions of a merge list as flat arrays; ``tokens`` are lists of symbols, ``merges`` pairs of token numbers."""

    def __init__(self, tokens: dict[int, list[int]], merges: list[tuple[int, int, int]]):
        self.size = max(tokens) + 1
        self._gadgets(merges)
        self._goto(tokens)
        self.steps, self.arcs = Seen(np.int32), Seen(np.bool_)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"steps": Seen(np.int32), "arcs": Seen(np.bool_)}

    def _gadgets(self, merges: list[tuple[int, int, int]]) -> None:
        """``merges`` are ``(u, v, w)`` in their order; what each gadget does depends only on later ones for its range's end."""
        n = len(merges)
        size, inner, offset = [1] * self.size, [0] * self.size, [0] * self.size
        self.copied_from, self.copied_at = np.full(self.size, -1, np.int32), np.full(self.size, n + 1, np.int32)
        left, ends = np.full(self.size, -1, np.int64), [0] * n
        for step in range(n - 1, -1, -1):
            u, v, w = merges[step]
            offset[w] = 1 + inner[u]
            inner[u] += size[w]
            size[u] += size[w]
            ends[step] = 1 + inner[v]
            left[w], self.copied_from[w], self.copied_at[w] = u, v, step
        number, free = np.zeros(self.size, np.int64), 0
        for token in np.flatnonzero(left < 0):
            number[token], free = free, free + size[token]
        for u, _, w in merges:
            number[w] = number[u] + offset[w]
        u, v = (np.array([m[k] for m in merges], np.int64) for k in (0, 1))
        order = np.argsort(u * self.size + number[v])
        self.number = number.astype(np.int32)
        self.range_from = (u * self.size + number[v])[order]
        self.range_to = (u * self.size + number[v] + np.array(ends, np.int64))[order]
        self.range_at = np.arange(n, dtype=np.int32)[order]

    def _goto(self, tokens: dict[int, list[int]]) -> None:
        """The trie of all tokens with failure links; of each node the longest token that ends there."""
        children: list[dict[int, int]] = [{}]
        ends = {}
        for token, symbols in tokens.items():
            node = 0
            for s in symbols:
                if s not in children[node]:
                    children[node][s] = len(children)
                    children.append({})
                node = children[node][s]
            ends[node] = token
        n = len(children)
        fail, token_at = [0] * n, [-1] * n
        queue = list(children[0].values())
        for node in queue:
            token_at[node] = ends.get(node, token_at[fail[node]])
            for s, child in children[node].items():
                back = fail[node]
                while back and s not in children[back]:
                    back = fail[back]
                fail[child] = children[back].get(s, 0)
                queue.append(child)
        self.first = np.zeros(ALPHABET, np.int32)
        for s, child in children[0].items():
            self.first[s] = child
        edges = sorted((node * ALPHABET + s, child) for node in range(1, n) for s, child in children[node].items())
        self.edge = np.array([e for e, _ in edges] + [np.iinfo(np.int64).max], np.int64)
        self.to = np.array([c for _, c in edges] + [0], np.int32)
        self.fail, self.token_at = np.array(fail, np.int32), np.array(token_at, np.int32)
        self.length, self.shorter = np.zeros(self.size, np.int32), np.full(self.size, -1, np.int32)
        for node, token in ends.items():
            self.length[token], self.shorter[token] = len(tokens[token]), token_at[fail[node]]

    def step(self, node: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """The goto table: the longest suffix of what was read that begins a token."""
        return self.steps.of(node.astype(np.int64) * ALPHABET + symbol, lambda key: self._step(key // ALPHABET, key % ALPHABET))

    def follows(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Whether there is an arc x -> y, for arrays of states; state -1 begins a word and has every arc."""
        return self.arcs.of((x.astype(np.int64) + 1) * self.size + y, lambda key: self._follows(key // self.size - 1, key % self.size))

    def _step(self, node: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        out = self.first[symbol]
        todo = np.flatnonzero(node)
        node = node[todo].astype(np.int64)
        while len(todo):
            key = node * ALPHABET + symbol[todo]
            at = np.searchsorted(self.edge, key)
            hit = self.edge[at] == key
            out[todo[hit]] = self.to[at[hit]]
            node, todo = self.fail[node[~hit]].astype(np.int64), todo[~hit]
            node, todo = node[node > 0], todo[node > 0]
        return out

    def _follows(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        out = np.ones(len(x), bool)
        todo = np.flatnonzero(x >= 0)
        state, number = x[todo].astype(np.int64), self.number[y[todo]].astype(np.int64)
        before = np.full(len(todo), len(self.range_at) + 1, np.int32)
        while len(todo):
            key = state * self.size + number
            at = np.searchsorted(self.range_from, key, "right") - 1
            taken = (at >= 0) & (key < self.range_to[at]) & (self.range_from[at] >= state * self.size) & (self.range_at[at] < before)
            out[todo[taken]] = False
            go = ~taken & (self.copied_from[state] >= 0)
            todo, number, before, state = todo[go], number[go], self.copied_at[state[go]], self.copied_from[state[go]].astype(np.int64)
        return out

    def encode(self, words: list[bytes]) -> list[list[int]]:
        """The tokens of each word (bytes, not empty)."""
        out: list = [None] * len(words)
        order = sorted(range(len(words)), key=lambda k: -len(words[k]))
        alone = sum(len(words[k]) > LONGEST for k in order)
        for k in order[:alone]:
            out[k] = self.encode_one(words[k])
        for at in range(alone, len(order), TOGETHER):
            part = order[at : at + TOGETHER]
            for k, ids in zip(part, self._encode([words[k] for k in part]), strict=True):
                out[k] = ids
        return out

    def _encode(self, words: list[bytes]) -> list[list[int]]:
        """Words from the longest to the shortest, one symbol of each at a time."""
        lengths = np.array([len(w) for w in words])
        most, n = int(lengths[0]), len(words)
        symbols = np.zeros((most, n), np.int64)
        flat = np.frombuffer(b"".join(words), np.uint8)
        rows = np.repeat(np.arange(n), lengths)
        symbols[np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths), rows] = flat
        symbols[lengths - 1, np.arange(n)] += 256
        states = np.full((most + 1, n), -1, np.int32)
        node = np.zeros(n, np.int32)
        for place in range(1, most + 1):
            active = int(np.searchsorted(-lengths, -place, "right"))
            node = self.step(node[:active], symbols[place - 1, :active])
            todo, token = np.arange(active), self.token_at[node]
            while len(todo):
                if (token < 0).any():
                    raise ValueError(f"no path through the automaton for {words[todo[int((token < 0).argmax())]][:40]!r}")
                good = self.follows(states[place - self.length[token], todo], token)
                states[place, todo[good]] = token[good]
                todo, token = todo[~good], self.shorter[token[~good]]
        path: list[list[int]] = [[] for _ in words]
        place, todo = lengths.copy(), np.arange(n)
        while len(todo):
            token = states[place[todo], todo]
            for k, t in zip(todo.tolist(), token.tolist(), strict=True):
                path[k].append(t)
            place[todo] -= self.length[token]
            todo = todo[place[todo] > 0]
        return [p[::-1] for p in path]

    def encode_one(self, word: bytes) -> list[int]:
        """The same steps for one long word, on plain numbers."""
        first, edge, to, fail, token_at, length, shorter = map(memoryview, (self.first, self.edge, self.to, self.fail, self.token_at, self.length, self.shorter))
        number, begins, ends, ages, origin, copied = map(memoryview, (self.number, self.range_from, self.range_to, self.range_at, self.copied_from, self.copied_at))
        from bisect import bisect_left, bisect_right

        size, latest, states, node, known = self.size, len(ages) + 1, [-1], 0, {}
        for place, symbol in enumerate(word, 1):
            symbol += 256 * (place == len(word))
            while node:
                key = node * ALPHABET + symbol
                at = bisect_left(edge, key)
                if edge[at] == key:
                    node = to[at]
                    break
                node = fail[node]
            else:
                node = first[symbol]
            token = token_at[node]
            while token >= 0:
                state = states[place - length[token]]
                arc = known.get((state, token))
                if arc is None:
                    arc, x, before = True, state, latest
                    while x >= 0:
                        key = x * size + number[token]
                        at = bisect_right(begins, key) - 1
                        if at >= 0 and key < ends[at] and begins[at] >= x * size and ages[at] < before:
                            arc = False
                            break
                        x, before = origin[x], copied[x]
                    if len(known) < CACHE:
                        known[state, token] = arc
                if arc:
                    break
                token = shorter[token]
            if token < 0:
                raise ValueError(f"no path through the automaton for {word[:40]!r}")
            states.append(token)
        path, place = [], len(word)
        while place:
            path.append(states[place])
            place -= length[states[place]]
        return path[::-1]


def compiled(path: str) -> dict:
    """What workers need of a tokenizer file: the automaton, the arc labels, the splitting steps, the special strings."""
    spec = word_end_file(path)
    model, end = spec["model"], spec["model"]["end_of_word_suffix"]
    ids: dict[str, int] = model["vocab"]
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    made = {u + v for u, v in pairs}
    tokens = {i: symbols_of(t, end) for t, i in ids.items() if t in made or len(t.removesuffix(end)) == 1}
    labels = [""] * (max([*ids.values(), *special.values()]) + 1)
    for token, i in [*ids.items(), *special.items()]:
        labels[i] = token
    steps = spec | {"model": {"type": "BPE", "vocab": {}, "merges": []}, "added_tokens": [], "post_processor": None}
    return {
        "automaton": Automaton(tokens, [(ids[u], ids[v], ids[u + v]) for u, v in pairs]),
        "labels": "\n".join(labels).encode(), "steps": json.dumps(steps), "special": special,
    }


class Generations:
    """A bounded cache that is filled many keys at a time; it keeps those of the last two generations."""

    def __init__(self, make, size: int):
        self.make, self.size, self.young, self.old = make, size, {}, {}

    def of(self, keys: set) -> dict:
        """A dict that has at least ``keys``."""
        if len(self.young) >= self.size:
            self.young, self.old = {}, self.young
        young, old = self.young, self.old
        new = []
        for key in keys.difference(young):
            if key in old:
                young[key] = old[key]
            else:
                new.append(key)
        made = dict(zip(new, self.make(new), strict=True))
        long = {k: v for k, v in made.items() if len(k) > KEPT}
        young.update(made)
        if not long:
            return young
        whole = dict(young)
        for key in long:
            del young[key]
        return whole


#: What is neither ASCII nor a plain Latin letter: of U+00C0 to U+024F all are letters that the normaliser only
#: lower-cases, but for two signs and U+0130.  Bytes of a text without these are ASCII or parts of letters.
_OTHER = re.compile(rb"[\xC2\xCA-\xFF]|\xC3[\x97\xB7]|\xC4\xB0|\xC9[\x90-\xBF]")
#: White space ends a string.  Such texts are split as the tokenizer file does; of others a string beyond ASCII is one match.
_WORDS = rb"'[sStTmMdD]|'[rR][eE]|'[vV][eE]|'[lL][lL]|[A-Za-z\x80-\xFF]+|[0-9]|[^\x20\x09-\x0DA-Za-z0-9\x80-\xFF]+"
LATIN_PIECES = re.compile(_WORDS)
PIECES = re.compile(rb"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D\x80-\xFF]*+[\x80-\xFF][^\x20\x09-\x0D]*|" + _WORDS)
_ONE_WORD = re.compile(rb"[A-Za-z\x80-\xFF]+").fullmatch


_SPACE = re.compile(r"\s").search


class Encoder:
    """Texts to ``(ids as little-endian 32-bit integers, decoded text)``.

    Every label is followed by the space that the decoded text has before the next one.
    """

    def __init__(self, parts: dict):
        from tokenizers import Tokenizer

        self.automaton, self.special = parts["automaton"], {k.encode(): v for k, v in parts["special"].items()}
        self.labels = [t + b" " for t in parts["labels"].split(b"\n")]
        self.packed = [i.to_bytes(4, "little") for i in range(len(self.labels))]
        steps = Tokenizer.from_str(parts["steps"])
        self.normalise, self.split = steps.normalizer.normalize_str, steps.pre_tokenizer.pre_tokenize_str
        names = sorted(self.special, key=len, reverse=True)
        self.specials = re.compile(b"(" + b"|".join(map(re.escape, names)) + b")") if names else None
        self.known = Generations(self.encoded, CACHE)

    def made(self, ids: list[int]) -> tuple[bytes, bytes]:
        labels, packed = self.labels, self.packed
        return b"".join([packed[i] for i in ids]), b"".join([labels[i] for i in ids])

    def pieces(self, raw: bytes) -> list[bytes]:
        """What a text is looked up by: words, strings with characters beyond Latin letters, special strings."""
        if self.specials is None or not self.specials.search(raw):
            return (PIECES if _OTHER.search(raw) else LATIN_PIECES).findall(raw)
        out: list[bytes] = []
        for k, part in enumerate(self.specials.split(raw)):
            out += [part] if k % 2 else PIECES.findall(part)
        return out

    def words(self, pieces: list[bytes]) -> list[list[bytes]]:
        """The pre-split words of some strings that are not ASCII, as the bytes of the normalised text.

        They are normalised and split together, a new line apart, which joins nothing across; unless
        one holds white space of its own.
        """
        texts = [p.decode("utf-8", "replace") for p in pieces]
        normal = self.normalise("\n".join(texts)).split(" ")
        if len(normal) != len(texts) or any(map(_SPACE, texts)):
            return [[w.translate(BYTES).encode("latin-1") for w, _ in self.split(self.normalise(t))] for t in texts]
        out: list[list[bytes]] = [[] for _ in texts]
        ends = list(accumulate(len(t) + 1 for t in normal))
        k = 0
        for word, (start, _) in self.split(" ".join(normal)):
            while start >= ends[k]:
                k += 1
            out[k].append(word.translate(BYTES).encode("latin-1"))
        return out

    def encoded(self, pieces: list[bytes]) -> list[tuple[bytes, bytes]]:
        split: list = [
            [p.lower()] if p.isascii() else [p.decode().lower().encode()] if _ONE_WORD(p) and not _OTHER.search(p) else None for p in pieces
        ]
        for k, piece in enumerate(pieces):
            if piece in self.special:
                split[k] = []
        others = [k for k, words in enumerate(split) if words is None]
        for at in range(0, len(others), 1024):
            part = others[at : at + 1024]
            for k, words in zip(part, self.words([pieces[k] for k in part]), strict=True):
                split[k] = words
        distinct = list({w for words in split for w in words})
        made = dict(zip(distinct, map(self.made, self.automaton.encode(distinct)), strict=True))
        out = []
        for piece, words in zip(pieces, split, strict=True):
            if len(words) == 1:
                out.append(made[words[0]])
            elif piece in self.special:
                out.append(self.made([self.special[piece]]))
            else:
                parts = [made[w] for w in words]
                out.append((b"".join([p[0] for p in parts]), b"".join([p[1] for p in parts])))
        return out

    def texts(self, raws: list[bytes]):
        """One pair per text, in order; the pieces of all texts are looked up together."""
        split = [self.pieces(raw) for raw in raws]
        known = self.known.of(set().union(*split))
        for pieces in split:
            parts = [known[w] for w in pieces]
            yield b"".join([p[0] for p in parts]), b"".join([p[1] for p in parts])[:-1]

    def text(self, raw: bytes) -> tuple[bytes, bytes]:
        return next(self.texts([raw]))


def encoder(path: str) -> Encoder:
    """For use without Spark: one per process and tokenizer file."""
    return held(f"bpe:{path}", lambda: Encoder(compiled(path)))


def _mapped(docs: DataFrame, path: str, made, columns: str) -> DataFrame:
    """``doc_id`` and ``columns``, which ``made`` builds from the pairs of some texts."""
    shared, key = docs.sparkSession.sparkContext.broadcast(compiled(path)), f"bpe:{uuid.uuid4().hex}"
    returned()

    def build(texts: list[bytes]) -> list[pa.Array]:
        return made(held(key, lambda: Encoder(shared.value)).texts(texts))

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    names = [c.split()[0] for c in columns.split(", ")]
    return mapped(rows, per_batch(build, names), f"doc_id long, {columns}", "bpe")


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id, ids, decoded``: token ids as little-endian 32-bit integers, and the text decoded from them."""

    def made(pairs) -> list[pa.Array]:
        pairs = list(pairs)
        return [pa.array([p[0] for p in pairs], pa.binary()), pa.array([p[1] for p in pairs], pa.binary()).cast(pa.string())]

    return _mapped(docs, path, made, "ids binary, decoded string")


def digested(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of each row; texts and ids stay in the worker."""

    def made(pairs) -> list[pa.Array]:
        rows = [(len(ids) // 4, sha256(ids).hexdigest(), sha256(text).hexdigest()) for ids, text in pairs]
        return [pa.array([r[0] for r in rows], pa.int64()), *(pa.array([r[k] for r in rows], pa.string()) for k in (1, 2))]

    return _mapped(docs, path, made, "n_tokens long, ids_sha256 string, decoded_sha256 string")
