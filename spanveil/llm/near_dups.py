"""Near duplicates by SimHash, linked through an inverted index of byte positions.

A fingerprint is eight positional bytes.  Two that differ in at most three bits differ in at
most three bytes, so they share at least five positional bytes: that is the guaranteed minimum
of the count filter.  A list per single byte would hold a 256th of all fingerprints, and the
pairs from it would grow with their square.  The index is therefore kept on joint postings of
five positions (56 of them, 40 bits each): a pair shares one exactly if it shares five bytes or
more, which is the filter itself, and a posting has few members at any corpus size.

Inside a posting the shared bytes of each pair are tallied block by block in numpy, pairs with at
least the guaranteed number are verified by their differing bits, and only a spanning forest of the links leaves the task: never all pairs.  A posting with
more than ``POSTING`` members is indexed again on three of the six half bytes that are left;
such a posting has 12 free bits, so at most 4,096 members, however large the group of copies.
With another number of bits b up to four, all but b bytes and b of the 2 b other half bytes are
taken, and the second level has at most 2 ** (4 b) members, 65,536.

Equal fingerprints are one node.  Defined cases: a null text counts as empty; a text without
words has fingerprint zero and is linked like any other; repeated rows are in one component, and
``without_near_duplicates`` keeps exactly one row of a component (of rows with one doc_id and text, the one with the smallest hash).  An empty table gives an empty result; other columns
are not read.  The smallest doc_id names a component; null doc_ids come last.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import mapped, per_batch, written
from .components import components

BITS = 3
WORDS = 3
#: Members of a posting that are compared in one block; a second-level posting has no more.
POSTING = 4096
MOST_BITS = 4


def fingerprint(text: bytes, words: int = WORDS) -> int:
    """SimHash of a text's shingles, each counted as often as it stands there."""
    tokens = text.lower().split()
    if not tokens:
        return 0
    of = xxhash.xxh64_intdigest
    if len(tokens) <= words:
        return of(b" ".join(tokens), 42)
    runs = zip(*(tokens[k:] for k in range(words)), strict=False)
    hashes = np.fromiter((of(b" ".join(run), 42) for run in runs), np.uint64, len(tokens) - words + 1)
    ones = np.zeros(64, np.int64)
    for part in range(0, len(hashes), 1 << 14):
        rows = hashes[part : part + (1 << 14)].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(rows, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """A written table ``doc_id, text_hash, fp`` of each row."""

    def build(texts: list[bytes]) -> list[pa.Array]:
        prints = np.fromiter((fingerprint(t, words) for t in texts), np.uint64, len(texts))
        return [pa.array(prints.view(np.int64))]

    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), F.col("text").cast("string").alias("text")
    )
    return mapped(rows, per_batch(build, ["fp"]), "doc_id long, text_hash long, fp long", "fingerprints")


def _masks(base: list[int]) -> list[int]:
    """The masks as signed 64-bit integers."""
    return [m - (1 << 64) if m >> 63 else m for m in base]


def index(bits: int) -> tuple[list[int], list[list[int]]]:
    """Masks of the first level, and for each those of its second level: its bytes and half bytes of the others."""
    first = _masks([sum(0xFF << 8 * p for p in kept) for kept in combinations(range(8), 8 - bits)])
    left = [[p for p in range(8) if not (m >> 8 * p) & 0xFF] for m in first]
    return first, [
        _masks([(m & ((1 << 64) - 1)) | sum(0xF << 4 * h for h in kept) for kept in combinations([2 * p + k for p in rest for k in (0, 1)], bits)])
        for m, rest in zip(first, left, strict=True)
    ]


BYTES, HALVES = index(BITS)


def forest(members: np.ndarray, bits: int = BITS) -> list[np.ndarray]:
    """Links ``(node, smallest node of its part)`` of distinct fingerprints, by search from each part's first node."""
    hi, lo = [], []
    rest = np.sort(members)
    while len(rest):
        root, todo, rest = rest[0], [rest[0]], rest[1:]
        while todo and len(rest):
            apart = rest ^ todo.pop()
            # Of each pair the shared positional bytes are tallied; those with too few of them are not verified.
            near = (apart.view(np.uint8).reshape(-1, 8) == 0).sum(axis=1) >= 8 - bits
            near[near] = np.bitwise_count(apart[near]) <= bits
            if near.any():
                found, rest = rest[near], rest[~near]
                todo.extend(found)
                hi.append(found)
                lo.append(np.full(len(found), root, rest.dtype))
    return [np.concatenate(x) if x else np.empty(0, np.uint64) for x in (hi, lo)]


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Sorted rows in stretches that hold whole postings: columns and the starts of the postings."""
    held = [np.empty(0, np.int64)] * 3
    for batch in batches:
        now = [np.concatenate([h, batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64)]) for i, h in enumerate(held)]
        if not len(now[0]):
            continue
        new = np.flatnonzero((np.diff(now[0]) != 0) | (np.diff(now[1]) != 0)) + 1
        if not len(new):
            held = now
            continue
        held = [x[new[-1] :] for x in now]
        yield (*(x[: new[-1]] for x in now), np.concatenate([[0], new[:-1]]))
    if len(held[0]):
        yield (*held, np.zeros(1, np.int64))


def linked(batches: Iterator[pa.RecordBatch], bits: int = BITS, limit: int | None = None) -> Iterator[pa.RecordBatch]:
    """``mapInArrow`` over rows sorted by posting: links, and the members of too large postings.

    A link has ``posting`` -1; a member of a posting above ``limit`` (``POSTING``) has its number.
    """
    limit = POSTING if limit is None else limit

    def rows(posting, hi, lo):
        return pa.RecordBatch.from_arrays([pa.array(posting, pa.int32()), pa.array(hi.view(np.int64)), pa.array(lo.view(np.int64))], names=["posting", "hi", "lo"])

    for posting, _, fps, starts in _runs(batches):
        fps = fps.view(np.uint64)
        sizes = np.diff(np.append(starts, len(fps)))
        twos = starts[sizes == 2]
        a, b = fps[twos], fps[twos + 1]
        near = (np.bitwise_count(a ^ b) <= bits) & (a != b)
        hi, lo = [np.maximum(a, b)[near]], [np.minimum(a, b)[near]]
        for at, size in zip(starts[sizes > 2], sizes[sizes > 2], strict=True):
            members = np.unique(fps[at : at + size])
            if len(members) > limit:
                yield rows(np.full(len(members), posting[at], np.int32), members, members)
            else:
                x, y = forest(members, bits)
                hi.append(x)
                lo.append(y)
        hi, lo = np.concatenate(hi), np.concatenate(lo)
        if len(hi):
            yield rows(np.full(len(hi), -1, np.int32), hi, lo)


def _linked(members: DataFrame, bits: int, limit: int) -> DataFrame:
    """``members(posting, joint, fp)`` to links, each posting in one task in sorted order."""
    placed = members.repartition("posting", "joint").sortWithinPartitions("posting", "joint", "fp")
    run = linked if bits == BITS else partial(linked, bits=bits, limit=limit)
    return placed.mapInArrow(run, "posting int, hi long, lo long")


def links(fps: DataFrame, bits: int = BITS) -> DataFrame:
    """Links ``hi, lo`` of distinct fingerprints whose components are those of all pairs within ``bits``."""
    if not 1 <= bits <= MOST_BITS:
        raise ValueError(f"bits is 1 to {MOST_BITS}: beyond, postings are no longer short")
    masks, parts = index(bits)
    each = len(parts[0])
    first = ", ".join(f"struct({k} AS posting, fp & {m}L AS joint)" for k, m in enumerate(masks))
    one = written(_linked(fps.select("fp", F.explode(F.expr(f"array({first})")).alias("p")).select("p.posting", "p.joint", "fp"), bits, POSTING), "postings")
    halves = "array(" + ", ".join("array(" + ", ".join(f"{m}L" for m in ms) + ")" for ms in parts) + ")"
    again = (
        one.where("posting >= 0")
        .select("posting", F.col("hi").alias("fp"), F.posexplode(F.expr(f"element_at({halves}, posting + 1)")).alias("k", "mask"))
        .select((F.col("posting") * each + F.col("k")).alias("posting"), F.expr("fp & mask").alias("joint"), "fp")
    )
    last = _linked(again, bits, 1 << 4 * bits)
    return one.where("posting < 0").select("hi", "lo").unionByName(last.where("posting < 0").select("hi", "lo"))


def near_duplicates(docs: DataFrame, words: int = WORDS, bits: int = BITS) -> DataFrame:
    """One row per document: ``doc_id, text_hash, fingerprint, component_id, first_hash``.

    ``first_hash`` tells the texts of the component's first doc_id apart, should it stand for several.
    Shingles have ``words`` words; fingerprints within ``bits`` (1 to 4) are linked.
    """
    rows = fingerprints(docs, words)
    best = F.min(F.struct(F.col("doc_id").isNull().alias("z"), F.col("doc_id").alias("i"), F.col("text_hash").alias("t"))).alias("best")
    nodes = written(rows.groupBy("fp").agg(best), "nodes")
    roots = written(components(links(nodes.select("fp"), bits)), "roots")
    placed = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "best", F.coalesce("root", "fp").alias("root"))
    first = written(placed.groupBy("root").agg(F.min("best").alias("best")), "firsts")
    named = written(
        placed.select("fp", "root").join(first, "root").select("fp", F.col("best.i").alias("component_id"), F.col("best.t").alias("first_hash")),
        "named",
    )
    return rows.join(named, "fp").select(
        "doc_id", "text_hash", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "first_hash"
    )


def without_near_duplicates(docs: DataFrame, words: int = WORDS, bits: int = BITS) -> DataFrame:
    """The documents of which one stands for each component, with all their columns."""
    names = docs.columns
    firsts = (
        near_duplicates(docs, words, bits).where(F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("text_hash") == F.col("first_hash")))
        .select(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("k1"), F.col("text_hash").alias("k2")).distinct()
    )
    packed = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("k1"), F.xxhash64("text").alias("k2"),
    )
    once = Window.partitionBy("k1", "k2").orderBy(F.xxhash64("row"))
    return packed.join(written(firsts, "firsts-kept"), ["k1", "k2"], "left_semi").withColumn("nth", F.row_number().over(once)).where("nth = 1").select("row.*")
