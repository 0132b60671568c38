"""Toxicity with a convolutional text classifier, trained and run in numpy.

A word is the sum of hashed embeddings: one of the word, and one of each of its first few byte
prefixes, so that inflected forms share what they have in common.  Filters of several widths
run over the word vectors; a document keeps, of each filter, the largest and the second largest
response that are not at the same place, and a logistic layer weighs them.

The model is fitted on all labelled rows but the held-out quarter, each with its whole text.  Rows
are dealt by a hash of doc_id to shards of about ``SHARD`` rows.  One shard is fitted on the driver.
Of more, each is learned from by one task at a time, all beginning from the same state; after each
epoch what they learned is averaged (an embedding over the shards that have its feature) in
fixed-point numbers, so that the order of the sums is of no matter.  The driver holds one model.
Training rows in the calibration fold do not enter the fit: they set the scale of the score, so that
0.3 is the best cut over all languages, and the best cut for each language (``threshold``), which
only the column ``rejected`` uses.  ``lang``, ``source``, ``doc_id`` and labels are no input of a score.

Scoring is one pass on the map side over whole texts.  Filters are applied to the embedding
table once, so a word costs one row of a table of the worker; a very long text is worked on in
stretches that overlap by the widest filter.

Defined cases: a null text counts as empty; an empty text is scored as one padding word.  Rows
without a doc_id are neither learned from nor held out; labels other than 0 and 1, and contradicting
ones, are ignored.  Of several texts under one doc_id the one with the smallest hash is learned from.
Without labels of both classes every score is 0.  Repeated rows give repeated rows; an empty
table gives an empty result.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.storagelevel import StorageLevel

from .common import held, mapped, per_batch, small_batches, texts_of

#: Labelled rows, and bytes of their texts, that are learned from between two exchanges of what was learned.
SHARD, SHARD_BYTES = 4096, 32 << 20
#: Slices in which what shards learned is added up, and the steps of one in its fixed-point numbers.
SLICES, ONE = 64, 1 << 32
HELD_OUT = 2
CUT = 0.3

BUCKETS = 1 << 15
PREFIXES = (4, 5, 6, 7, 8)
DIM, WIDTHS, FILTERS = 12, (1, 2, 3), 8
EPOCHS, DOCS_A_STEP, RATE, DECAY = 4, 32, 0.05, 1e-4
#: Steps that a fit takes at least, by more epochs where the sample is small.
LEAST_STEPS = 300
#: A feature found in fewer sample documents is left out of the embedding.
LEAST_DOCS = 3
#: Words of a text that are worked on at a time, and word vectors that a worker keeps.
STRETCH, ROWS = 1 << 14, 1 << 16

#: ASCII characters other than letters and digits end a word.
_LETTERS = bytes(c if chr(c).isalnum() or c >= 128 else 32 for c in range(128)) + bytes(range(128, 256))


def words_of(text: bytes) -> list[bytes]:
    return text.lower().translate(_LETTERS).split()


def features(word: bytes) -> list[int]:
    """Buckets of a word and its prefixes, 0 where the word is shorter."""
    of = zlib.crc32
    return [of(b"=" + word) % (BUCKETS - 1) + 1] + [of(word[:k]) % (BUCKETS - 1) + 1 if len(word) >= k else 0 for k in PREFIXES]


def features_of(words: list[bytes]) -> np.ndarray:
    """``features`` of many words, a row each."""
    lengths, of = np.fromiter(map(len, words), np.int64, len(words)), zlib.crc32
    columns = [np.fromiter((of(b"=" + w) for w in words), np.int64, len(words)) % (BUCKETS - 1) + 1]
    for k in PREFIXES:
        columns.append(np.where(lengths >= k, np.fromiter((of(w[:k]) for w in words), np.int64, len(words)) % (BUCKETS - 1) + 1, 0))
    return np.stack(columns, axis=1).astype(np.uint16)


@dataclass
class Model:
    embedding: np.ndarray
    filters: dict[int, np.ndarray]
    biases: dict[int, np.ndarray]
    weights: np.ndarray
    bias: float = 0.0
    scale: tuple[float, float] = (1.0, 0.0)
    thresholds: dict[str, float] = field(default_factory=dict)

    def table(self) -> np.ndarray:
        """Each bucket's part of every filter response: columns by width, place in the window, filter."""
        parts = [self.embedding @ self.filters[w][k] for w in WIDTHS for k in range(w)]
        return np.concatenate(parts, axis=1).astype(np.float32)

    def score(self, logits: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale[0] * logits + self.scale[1], -30, 30)))


def _new_model(rng: np.random.Generator) -> Model:
    embedding = rng.normal(0, 0.05, (BUCKETS, DIM)).astype(np.float32)
    embedding[0] = 0
    filters = {w: rng.normal(0, (w * DIM) ** -0.5, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS}
    biases = {w: np.zeros(FILTERS, np.float32) for w in WIDTHS}
    return Model(embedding, filters, biases, rng.normal(0, 0.2, 2 * len(WIDTHS) * FILTERS).astype(np.float32))


def _two_largest(response: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per column: the values of the largest and the second largest row (or the first again), and their places."""
    first = response.argmax(axis=0)
    columns = np.arange(response.shape[1])
    best = response[first, columns]
    if len(response) == 1:
        return np.stack([best, best]), np.stack([first, first])
    response[first, columns] = -np.inf
    second = response.argmax(axis=0)
    return np.stack([best, response[second, columns]]), np.stack([first, second])


@dataclass
class State:
    """What is learned: the embedding, the filters side by side as in ``Model.table``, their biases, weights and bias,
    each with the sums of squares that Adagrad divides by."""

    values: list[np.ndarray]
    squares: list[np.ndarray]

    @staticmethod
    def of(model: Model, known: np.ndarray) -> State:
        embedding = np.where(known[:, None], model.embedding, 0).astype(np.float32)
        values = [embedding, np.concatenate([model.filters[w][k] for w in WIDTHS for k in range(w)], axis=1)]
        values += [np.concatenate([model.biases[w] for w in WIDTHS]), model.weights, np.array([model.bias])]
        return State(values, [np.full((BUCKETS, 1), 1e-3, np.float32), *(np.full(v.shape, 1e-2, np.float64) for v in values[1:])])

    def copy(self) -> State:
        return State([v.copy() for v in self.values], [q.copy() for q in self.squares])

    def model(self) -> Model:
        embedding, joined, biases, weights, bias = self.values
        filters, column = {}, 0
        for w in WIDTHS:
            filters[w] = joined[:, column : column + w * FILTERS].reshape(DIM, w, FILTERS).transpose(1, 0, 2).copy()
            column += w * FILTERS
        of = {w: biases[j * FILTERS : (j + 1) * FILTERS] for j, w in enumerate(WIDTHS)}
        return Model(embedding, filters, of, weights, float(bias[0]))

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in (*self.values, *self.squares)]).astype(np.float64)

    def moved(self, sums: np.ndarray) -> State:
        """The state after shards whose ``learned`` arrays add up to ``sums``."""
        shares, sums = sums[: BUCKETS + 1] / ONE, sums[BUCKETS + 1 :] / ONE
        of_bucket, shards = np.maximum(shares[:BUCKETS, None], 1), max(shares[BUCKETS], 1)
        out, at = self.copy(), 0
        for array in (*out.values, *out.squares):
            change = sums[at : at + array.size].reshape(array.shape)
            array += (change / (of_bucket if len(array) == BUCKETS else shards)).astype(array.dtype)
            at += array.size
        return out

    def learned(self, before: State) -> np.ndarray:
        """Fixed-point numbers to add up: which features this shard has, one for itself, and its changes."""
        touched = (self.squares[0] != before.squares[0]).ravel()
        return np.rint(np.concatenate([touched, [1.0], self.flat() - before.flat()]) * ONE).astype(np.int64)


def docs_with(features: np.ndarray, docs: list[np.ndarray]) -> np.ndarray:
    """For each bucket the number of documents (arrays of word numbers) that have it."""
    seen = np.zeros(BUCKETS, np.int64)
    for d in docs:
        seen[np.unique(features[d])] += 1
    return seen


def class_weights(share: float) -> np.ndarray:
    share = max(share, 1e-3)
    return np.array([0.5 / max(1 - share, 1e-3), 0.5 / share])


def learn(state: State, features: np.ndarray, docs: list[np.ndarray], labels: np.ndarray, weight: np.ndarray, rate: float, order: np.ndarray) -> None:
    """One epoch of Adagrad on the logistic loss, in place.

    ``docs`` are arrays of word numbers, ``features`` the buckets of each word (those of word 0 are 0).
    """
    embedding, joined, biases, weights, bias = state.values
    wide = np.repeat(WIDTHS, FILTERS)
    #: Column in ``joined`` of the first place of each filter; the next place is FILTERS further.
    column = np.concatenate([np.arange(FILTERS) + FILTERS * sum(WIDTHS[:j]) for j in range(len(WIDTHS))])
    filters, number = np.arange(len(wide)), np.zeros(len(features), np.int64)
    for at in range(0, len(order), DOCS_A_STEP):
        step = order[at : at + DOCS_A_STEP]
        m = len(step)
        words = np.concatenate([x for i in step for x in (docs[i] if len(docs[i]) else [0], [0, 0])])
        number[words] = 1
        used = np.flatnonzero(number)
        number[used] = np.arange(len(used))
        place = number[words]
        number[used] = 0
        x = embedding[features[used]].sum(axis=1)
        parts = joined.T @ x[place].T
        n = len(place) - 2
        response = np.repeat(biases[:, None], n, axis=1)
        for j, w in enumerate(WIDTHS):
            for k in range(w):
                response[j * FILTERS : (j + 1) * FILTERS] += parts[column[j * FILTERS] + k * FILTERS :][:FILTERS, k : n + k]
        pooled, places, first = np.empty((m, 2, len(wide)), np.float32), np.empty((m, 2, len(wide)), np.int64), 0
        for j, i in enumerate(step):
            of = response[:, first : first + max(len(docs[i]), 1)]
            for r in (0, 1):
                where = of.argmax(axis=1)
                pooled[j, r], places[j, r] = of[filters, where], where + first
                if of.shape[1] > 1:
                    of[filters, where] = -np.inf
            first += max(len(docs[i]), 1) + 2
        active = np.maximum(pooled, 0).reshape(m, -1)
        p = 1 / (1 + np.exp(-np.clip(active @ weights + bias[0], -30, 30)))
        d = weight[labels[step]] * (p - labels[step])
        back = (d[:, None] * weights).reshape(pooled.shape) * (pooled > 0)
        # Of each used word and column of ``joined`` the gradient of the responses it has a part in.
        cells = np.concatenate([(place[places[:, :, wide > k] + k] * joined.shape[1] + column[wide > k] + k * FILTERS).ravel() for k in range(max(WIDTHS))])
        pulls = np.concatenate([back[:, :, wide > k].ravel() for k in range(max(WIDTHS))])
        pull = np.bincount(cells, pulls, len(used) * joined.shape[1]).reshape(len(used), -1)
        touched = np.flatnonzero(pull.any(axis=1))
        pull = pull[touched]
        to_words = pull @ joined.T / m
        grads = [x[touched].T @ pull, back.sum(axis=(0, 1)), d @ active, np.array([d.sum()])]
        for value, squares, g, decay in zip(state.values[1:], state.squares[1:], grads, (DECAY, DECAY, DECAY, 0), strict=True):
            g = g / m + decay * value
            squares += g * g
            value -= rate * g / np.sqrt(squares)
        buckets = features[used[touched]]
        which, of_word = buckets.ravel(), np.repeat(np.arange(len(touched)), buckets.shape[1])
        by_bucket = np.argsort(which, kind="stable")
        which, of_word = which[by_bucket], of_word[by_bucket]
        starts = np.flatnonzero(np.diff(which, prepend=0))
        if len(starts):
            g = np.add.reduceat(to_words[of_word], starts, axis=0)
            which = which[starts]
            state.squares[0][which] += (g * g).mean(axis=1, keepdims=True)
            embedding[which] -= (rate * g / np.sqrt(state.squares[0][which])).astype(np.float32)


def rates(rows: int) -> list[float]:
    """The rate of each epoch over so many rows."""
    epochs = max(EPOCHS, -(-LEAST_STEPS * DOCS_A_STEP // max(1, rows)))
    return [RATE / (1 + 2 * epoch / epochs) for epoch in range(epochs)]


def only_known(features: np.ndarray, known: np.ndarray) -> np.ndarray:
    return np.where(known[features], features, 0)


def fit(docs: list[np.ndarray], labels: np.ndarray, seed: int = 7) -> Model:
    """A model of one shard; ``docs`` are bucket arrays of shape (words, features)."""
    rng = np.random.default_rng(seed)
    model = _new_model(rng)
    rows = np.concatenate([np.zeros((1, 1 + len(PREFIXES))), *docs]).astype(np.uint16)
    order = np.lexsort(rows.T)  # that of no word comes first
    new = np.any(np.diff(rows[order], axis=0, prepend=rows[order[:1]]), axis=1)
    features, numbers = rows[order[np.concatenate([[0], np.flatnonzero(new)])]], np.empty(len(rows), np.int32)
    numbers[order] = np.cumsum(new)
    numbered = np.split(numbers[1:], np.cumsum([len(d) for d in docs])[:-1])
    known = docs_with(features, numbered) >= LEAST_DOCS
    known[0] = False
    state = State.of(model, known)
    for rate in rates(len(docs)):
        learn(state, only_known(features, known), numbered, labels, class_weights(labels.mean()), rate, rng.permutation(len(docs)))
    return state.model()


class Scorer:
    """Logits of texts, with one row of filter responses for each word that the worker keeps."""

    def __init__(self, table: np.ndarray, biases: np.ndarray, weights: np.ndarray, bias: float):
        self.table, self.biases, self.weights, self.bias = table, biases, weights, bias
        self.rows = np.zeros((ROWS, table.shape[1]), np.float32)
        self.known: dict[bytes, int] = {}
        self.reset()

    def reset(self) -> None:
        self.known.clear()
        self.known[b""] = 0

    def numbers(self, words: list[bytes]) -> np.ndarray:
        """Row numbers of some words; rows of new words are made together."""
        known, new = self.known, []
        for w in set(words).difference(known):
            known[w] = len(known)
            new.append(w)
        if new:
            first = len(known) - len(new)
            for at in range(0, len(new), 2048):
                part = features_of(new[at : at + 2048])
                self.rows[first + at : first + at + len(part)] = self.table[part].sum(axis=1)
        return np.fromiter(map(known.__getitem__, words), np.int64, len(words))

    def pooled(self, words: list[bytes]) -> np.ndarray:
        """The two largest responses of each filter over a whole text."""
        words = words or [b""]
        best = np.full((2, len(WIDTHS) * FILTERS), -np.inf, np.float32)
        for at in range(0, len(words), STRETCH):
            part = words[at : at + STRETCH + 2]
            n = min(len(part), STRETCH)
            if len(self.known) + len(part) >= ROWS:
                self.reset()
            x = self.rows[np.concatenate([self.numbers(part), [0, 0]])]
            column, responses = 0, []
            for w in WIDTHS:
                response = x[:n, column : column + FILTERS].copy()
                for k in range(1, w):
                    response += x[k : k + n, column + k * FILTERS : column + (k + 1) * FILTERS]
                responses.append(response)
                column += w * FILTERS
            response = np.concatenate(responses, axis=1) + self.biases
            top = np.partition(response, n - 2, axis=0)[-2:] if n > 1 else response
            best = np.sort(np.concatenate([best, top]), axis=0)[-2:]
        best[0] = np.where(np.isinf(best[0]), best[1], best[0])
        return best[::-1]

    def logit(self, text: bytes) -> float:
        return float(np.maximum(self.pooled(words_of(text)), 0).ravel() @ self.weights + self.bias)


def scorer(model: Model) -> Scorer:
    return Scorer(model.table(), np.concatenate([model.biases[w] for w in WIDTHS]), model.weights, model.bias)


def _best_cut(logits: np.ndarray, labels: np.ndarray) -> float:
    """The cut with the largest F1, in the middle of the gap between the two logits beside it."""
    order = np.argsort(-logits)
    hits = np.cumsum(labels[order])
    f1 = 2 * hits / (np.arange(1, len(order) + 1) + labels.sum())
    at = int(f1.argmax())
    lowest = logits[order[at]]
    return float((lowest + logits[order[at + 1]]) / 2 if at + 1 < len(order) else lowest - 1)


def calibrate(model: Model, logits: np.ndarray, labels: np.ndarray, langs: list, least: int = 20) -> None:
    """Sets the score's scale, and a threshold for each language with enough rows of both classes."""
    cut = _best_cut(logits, labels)
    spread = max(float(np.std(logits)), 1e-3)
    model.scale = (2 / spread, float(np.log(CUT / (1 - CUT)) - 2 / spread * cut))
    langs = np.array([str(x) for x in langs])
    for lang in np.unique(langs):
        of = langs == lang
        if min(labels[of].sum(), (1 - labels[of]).sum()) >= least:
            model.thresholds[str(lang)] = float(model.score(np.array([_best_cut(logits[of], labels[of])]))[0])


def fold(doc_id) -> object:
    return F.crc32(doc_id.cast("string").cast("binary"))


def usable(labels: DataFrame) -> DataFrame:
    """``label_id, toxic`` of each labelled id that may be learned from."""
    return labels.select(F.col("doc_id").cast("long").alias("label_id"), F.col("toxic").cast("int").alias("toxic")).where(
        F.col("toxic").isin(0, 1) & (F.pmod(fold(F.col("label_id")), F.lit(4)) != HELD_OUT)
    ).groupBy("label_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("most")).where("toxic = most").drop("most")


#: Bits for each labelled id in the map that tells most other documents apart before texts are moved, and 64-bit cells at most.
BITS, CELLS = 16, 1 << 20


def likely(docs: DataFrame, told: DataFrame) -> DataFrame:
    """``doc_id, lang, text`` of all rows whose id is in ``told``, and a few others: a broadcast map of at most ``CELLS`` cells tells."""
    cells = 1 << min(CELLS.bit_length() - 1, max(4, (told.count() * BITS // 64).bit_length()))
    cell, bit = F.shiftright(F.pmod(F.xxhash64("id"), F.lit(cells * 64)), 6), F.pmod(F.xxhash64("id"), F.lit(64)).cast("int")
    marks = told.select(F.col("label_id").alias("id")).groupBy(cell.alias("cell")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(pmod(xxhash64(id), 64) AS int))")).alias("bits"))
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit("")
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), lang.alias("lang"), F.col("text").cast("string").alias("text")).where("id IS NOT NULL")
    found = rows.join(F.broadcast(marks), cell == F.col("cell")).where(F.expr("shiftright(bits, CAST(pmod(xxhash64(id), 64) AS int)) & 1") == 1)
    return found.select(F.col("id").alias("doc_id"), "lang", "text")


def examples(rows: DataFrame, told: DataFrame) -> DataFrame:
    """``doc_id, lang, toxic, text`` of each labelled document, one row each."""
    best = F.min(F.struct(F.xxhash64("text").alias("h"), F.coalesce("lang", F.lit("")).alias("order"), "lang", "text")).alias("best")
    found = rows.join(told, F.col("doc_id") == F.col("label_id")).groupBy("doc_id", "toxic").agg(best)
    return found.select("doc_id", "best.lang", "toxic", "best.text")


def sample(docs: DataFrame, labels: DataFrame) -> list[tuple]:
    """``(doc_id, lang, toxic, buckets)`` of all labelled rows that may be learned from, whole texts."""
    told = usable(labels)
    return _collected(examples(likely(docs, told), told))


def _collected(rows: DataFrame) -> list[tuple]:
    def build(texts: list[bytes]) -> list[pa.Array]:
        return [pa.array([features_of(words_of(t)).tobytes() for t in texts], pa.binary())]

    made = rows.mapInArrow(per_batch(build, ["buckets"]), "doc_id long, lang string, toxic int, buckets binary")
    found = [(r.doc_id, r.lang, r.toxic, np.frombuffer(bytes(r.buckets), np.uint16).reshape(-1, 1 + len(PREFIXES))) for r in made.toLocalIterator()]
    return sorted(found, key=lambda r: r[0])


def train(docs: DataFrame, labels: DataFrame) -> Model | None:
    told = usable(labels)
    rows = likely(docs, told)
    size = rows.agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()
    shards = max(-(-size.rows // SHARD), -(-size.bytes // SHARD_BYTES))
    return _train_here(_collected(examples(rows, told))) if shards <= 1 else _train_shards(examples(rows, told), shards)


def _train_here(rows: list[tuple]) -> Model | None:
    toxic = np.array([r[2] for r in rows])
    if len(rows) < 2 or toxic.min() == toxic.max():
        return None
    held = np.array([zlib.crc32(f"{r[0]}:calibration".encode()) % 5 == 0 for r in rows])
    if toxic[~held].min() == toxic[~held].max():
        held[:] = False
    learned = np.flatnonzero(~held)
    model = fit([rows[i][3] for i in learned], toxic[learned])
    tested = np.flatnonzero(held) if held.any() and toxic[held].any() else learned
    run = scorer(model)
    logits = np.array([_logit_of_buckets(run, rows[i][3]) for i in tested])
    calibrate(model, logits, toxic[tested], [rows[i][1] for i in tested])
    return model


def _by_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, list[np.ndarray], np.ndarray]]:
    """``shard, buckets of each word, arrays of word numbers, labels`` of each shard of rows that are in its order."""
    last, known, docs, labels = None, {b"": 0}, [], []

    def shard() -> tuple[int, np.ndarray, list[np.ndarray], np.ndarray]:
        features = features_of(list(known))
        features[0] = 0
        return last, features, docs, np.array(labels)

    for batch in batches:
        of, toxic, texts = (batch.column(batch.schema.names.index(n)) for n in ("shard", "toxic", "text"))
        for number, label, text in zip(of.to_pylist(), toxic.to_pylist(), texts_of(texts), strict=True):
            if number != last:
                if docs:
                    yield shard()
                last, known, docs, labels = number, {b"": 0}, [], []
            words = words_of(text)
            for w in set(words).difference(known):
                known[w] = len(known)
            docs.append(np.fromiter(map(known.__getitem__, words), np.int32, len(words)))
            labels.append(label)
    if docs:
        yield shard()


def _summed(rows: DataFrame, made) -> np.ndarray:
    """The sum of the whole-number arrays that ``made`` gives for shards; added up by slices, so no task or driver holds more than a few."""

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for shard in _by_shard(batches):
            total = made(*shard) if total is None else total + made(*shard)
        if total is not None:
            parts = np.array_split(total, SLICES)
            yield pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary())], names=["slice", "sums"])

    def then(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, sums in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                totals[k] = totals.get(k, 0) + np.frombuffer(sums, np.int64)
        if totals:
            yield pa.RecordBatch.from_arrays([pa.array(list(totals), pa.int32()), pa.array([t.tobytes() for t in totals.values()], pa.binary())], names=["slice", "sums"])

    kind = "slice int, sums binary"
    found = rows.select("shard", "toxic", "text").mapInArrow(first, kind).repartition(8, "slice").mapInArrow(then, kind).collect()
    return np.concatenate([np.frombuffer(bytes(r["sums"]), np.int64) for r in sorted(found, key=lambda r: r["slice"])])


def _train_shards(rows: DataFrame, shards: int, seed: int = 7) -> Model | None:
    """A model of more rows than one shard."""
    context = rows.sparkSession.sparkContext
    dealt = rows.select(
        F.pmod(F.xxhash64("doc_id"), F.lit(shards)).cast("int").alias("shard"), "doc_id", "lang", "toxic", "text",
        (F.pmod(F.crc32(F.concat(F.col("doc_id").cast("string"), F.lit(":calibration")).cast("binary")), F.lit(5)) == 0).alias("held"),
    ).repartitionById(shards, "shard").sortWithinPartitions("shard", "doc_id").persist(StorageLevel.DISK_ONLY)
    try:
        with small_batches(rows.sparkSession):
            counts = {(r.held, r.toxic): r["count"] for r in dealt.groupBy("held", "toxic").count().collect()}
            if len({toxic for _, toxic in counts}) < 2:
                return None
            every = len({toxic for held, toxic in counts if not held}) < 2
            learning = dealt if every else dealt.where("NOT held")
            number = [sum(n for (held, t), n in counts.items() if t == toxic and (every or not held)) for toxic in (0, 1)]
            model = _new_model(np.random.default_rng(seed))
            known = _summed(learning, lambda _, features, docs, __: docs_with(features, docs)) >= LEAST_DOCS
            known[0] = False
            state, weight = State.of(model, known), class_weights(number[1] / sum(number))
            for epoch, rate in enumerate(rates(sum(number))):
                shared = context.broadcast((state, known, weight))

                def learned(shard, features, docs, labels, shared=shared, rate=rate, epoch=epoch):
                    before, known, weight = shared.value
                    after = before.copy()
                    order = np.random.default_rng([seed, epoch, shard]).permutation(len(docs))
                    learn(after, only_known(features, known), docs, labels, weight, rate, order)
                    return after.learned(before)

                state = state.moved(_summed(learning, learned))
                shared.unpersist()
            model = state.model()
            tested = dealt.where("held") if not every and counts.get((True, 1)) else learning
            run, key = context.broadcast((model.table(), np.concatenate([model.biases[w] for w in WIDTHS]), model.weights, model.bias)), uuid.uuid4().hex

            def build(texts: list[bytes]) -> list[pa.Array]:
                scorer = held(key, lambda: Scorer(*run.value))
                return [pa.array([scorer.logit(t) for t in texts], pa.float64())]

            # A few numbers of each row in the calibration fold, in an order that does not change.
            logits = tested.select("doc_id", "lang", "toxic", "text").mapInArrow(per_batch(build, ["logit"]), "doc_id long, lang string, toxic int, logit double").toArrow().sort_by("doc_id")
            calibrate(model, logits["logit"].to_numpy(), logits["toxic"].to_numpy(), logits["lang"].to_pylist())
            return model
    finally:
        dealt.unpersist()


def _logit_of_buckets(run: Scorer, buckets: np.ndarray) -> float:
    """The logit of a text of which only the buckets are at hand."""
    x = np.concatenate([run.table[buckets].sum(axis=1) if len(buckets) else run.rows[:1] * 0, np.zeros((2, run.table.shape[1]), np.float32)])
    n, column, responses = len(x) - 2, 0, []
    for w in WIDTHS:
        responses.append(sum(x[k : k + n, column + k * FILTERS : column + (k + 1) * FILTERS] for k in range(w)))
        column += w * FILTERS
    best, _ = _two_largest(np.concatenate(responses, axis=1) + run.biases)
    return float(np.maximum(best, 0).ravel() @ run.weights + run.bias)


def scored(docs: DataFrame, labels: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """The ``columns`` of each row (``doc_id`` by default) with ``held_out, score, predicted, threshold, rejected``."""
    model = train(docs, labels)
    spark = docs.sparkSession
    names = ["doc_id"] if columns is None else columns
    parts = None if model is None else (model.table(), np.concatenate([model.biases[w] for w in WIDTHS]), model.weights, model.bias)
    shared, scale, key = spark.sparkContext.broadcast(parts), None if model is None else model.scale, uuid.uuid4().hex

    def build(texts: list[bytes]) -> list[pa.Array]:
        if shared.value is None:
            return [pa.array([0.0] * len(texts), pa.float64())]
        run = held(key, lambda: Scorer(*shared.value))
        logits = np.array([run.logit(t) for t in texts], np.float64)
        return [pa.array(1 / (1 + np.exp(-np.clip(scale[0] * logits + scale[1], -30, 30))))]

    packed = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col("doc_id").cast("long").alias("id"),
        (F.col("lang").cast("string") if "lang" in docs.columns else F.lit("")).alias("language"),
        *([] if "text" in names else [F.col("text").cast("string").alias("text")]),
    )
    schema = T.StructType([packed.schema["row"], T.StructField("id", T.LongType()), T.StructField("language", T.StringType()), T.StructField("score", T.DoubleType())])
    where = "row.text" if "text" in names else "text"
    out = mapped(packed, per_batch(build, ["score"], where), schema, "toxicity")
    threshold = F.lit(CUT)
    for lang, cut in (model.thresholds if model else {}).items():
        threshold = F.when(F.col("language") == lang, F.lit(cut)).otherwise(threshold)
    return out.select(
        "row.*", F.coalesce(F.pmod(fold(F.col("id")), F.lit(4)) == HELD_OUT, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= CUT).cast("int").alias("predicted"), threshold.alias("threshold"), (F.col("score") >= threshold).alias("rejected"),
    )
