"""Token counts by a two-tier lookup on the map side.

White space always ends a token, so a text's count is the sum over its white-space separated
strings.  The lengths of the frequent ones are put into one table of at most ``FREQUENT``
entries, which is broadcast; a string that is not in it is encoded by the tokenizer library and
kept in a bounded cache of the worker.  Only summaries are shuffled (one bounded set of counters
per partition, merged in groups until a few are left), never strings by key.  The table decides
only how fast a length is found: every length in it comes from the same library.

Defined cases: a null text counts as empty and has no tokens.  Special strings inside a text are
handled as the library does by default.  A tokenizer file of another kind, for which the sum
does not hold, is refused with ``ValueError``.  Repeated rows give repeated rows; an empty table gives
an empty result; other columns are not read.
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Kept, held, mapped, per_batch, plain_pieces, texts_of, word_end_file, written

FREQUENT = 1 << 15
#: Counters of one summary, summaries merged at a time, and new strings that a worker's cache holds.
COUNTERS = 1 << 14
FAN = 32
CACHE = 100_000


def _reduced(counts: Counter, k: int) -> Counter:
    """A Misra-Gries cut to ``k`` counters: what the next one has is taken off all of them."""
    if len(counts) <= k:
        return counts
    cut = int(np.partition(np.fromiter(counts.values(), np.int64, len(counts)), -k - 1)[-k - 1])
    return Counter({w: n - cut for w, n in counts.items() if n > cut})


def _packed(counts: Counter) -> pa.RecordBatch:
    strings, numbers = b" ".join(counts), np.fromiter(counts.values(), np.int64, len(counts)).tobytes()
    return pa.RecordBatch.from_arrays([pa.array([zlib.crc32(strings)], pa.int64()), pa.array([strings], pa.binary()), pa.array([numbers], pa.binary())], names=["part", "strings", "numbers"])


def _unpacked(strings: bytes, numbers: bytes) -> dict:
    return dict(zip(strings.split(b" "), np.frombuffer(numbers, np.int64).tolist(), strict=True)) if strings else {}


def summarised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``mapInArrow``: the counters of one partition's strings, over whole texts."""
    counts: Counter = Counter()
    for batch in batches:
        for text in texts_of(batch.column(0)):
            counts.update(text.split())
            if len(counts) > 16 * COUNTERS:
                counts = _reduced(counts, COUNTERS)
    yield _packed(_reduced(counts, COUNTERS))


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter = Counter()
    for batch in batches:
        for row in batch.to_pylist():
            counts.update(_unpacked(row["strings"], row["numbers"]))
            if len(counts) > 16 * COUNTERS:
                counts = _reduced(counts, COUNTERS)
    yield _packed(_reduced(counts, COUNTERS))


_SUMMARY = "part long, strings binary, numbers binary"


def frequent_strings(docs: DataFrame, n: int = FREQUENT) -> list[bytes]:
    """At most ``n`` strings with the largest counters of a merged summary of all rows."""
    parts = mapped(docs.select(F.col("text").cast("string")), summarised, _SUMMARY, "strings")
    while (left := parts.count()) > FAN:
        parts = written(parts.repartition(-(-left // FAN), "part").mapInArrow(_merged, _SUMMARY), "strings")
    counts: Counter = Counter()
    for row in parts.toLocalIterator():
        counts.update(_unpacked(bytes(row.strings), bytes(row.numbers)))
    return [w for w, _ in counts.most_common(n) if w]


def library(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    word_end_file(path)
    found = Tokenizer.from_file(path)
    found.no_truncation()
    found.no_padding()
    return found


class Lengths(dict):
    """The broadcast tier; what it lacks comes from the worker's caches, and that from the library.

    A plain string is looked up by its pre-split words, which occur far more often than the
    string with its punctuation and capitals; any other is encoded as it is.
    """

    def __init__(self, table: dict, path: str):
        super().__init__(table)
        self.encode = library(path).encode
        self.words = Kept(self.encoded, CACHE)
        self.strings = Kept(self.pieced, CACHE)

    def encoded(self, raw: bytes) -> int:
        return len(self.encode(raw.decode("utf-8", "replace"), add_special_tokens=False).ids)

    def pieced(self, raw: bytes) -> int:
        pieces = plain_pieces(raw)
        return self.encoded(raw) if pieces is None else sum(map(self.words.__getitem__, pieces))

    def __missing__(self, raw: bytes) -> int:
        return self.strings[raw]


def token_counts(docs: DataFrame, path: str, limit: int = 2048, frequent: int = FREQUENT) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of each row."""
    strings = frequent_strings(docs, frequent)
    coded = library(path).encode_batch([w.decode("utf-8", "replace") for w in strings], add_special_tokens=False)
    shared = docs.sparkSession.sparkContext.broadcast({w: len(e.ids) for w, e in zip(strings, coded, strict=True)})

    key = uuid.uuid4().hex

    def build(texts: list[bytes]) -> list[pa.Array]:
        lookup = held(key, lambda: Lengths(shared.value, path)).__getitem__
        return [pa.array([len(t) for t in texts], pa.int64()), pa.array([sum(map(lookup, t.split())) for t in texts], pa.int64())]

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    counted = mapped(rows, per_batch(build, ["n_bytes", "n_tokens"]), "doc_id long, n_bytes long, n_tokens long", "token-counts")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
