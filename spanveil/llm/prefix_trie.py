"""A trie of conversations, built as a z-fast trie: compacted nodes found by handles.

A conversation is a sequence of turns.  Its prefix of depth d has a key, 128 bits that are the
exclusive or of one hash per place, role and text; so keys of all prefixes are running values, and
equal keys mean equal prefixes.  Only distinct sequences go into the trie.  The trie keeps
compacted nodes: a node stands for the depths (s, e] on the way to its extent, the prefix of depth
e, with s the depth of its parent.  It is hashed by its handle, the prefix at the two-fattest depth
of (s, e], the depth there that is divisible by the largest power of two.

Sequences are inserted in batches.  In each round every sequence that is left finds its exit node
by fat binary search: of the depths (a, b] that are open it looks up the key of the two-fattest one
among the handles; a hit moves a to the extent of the node found, a miss moves b below.  Depths come
in the order of their powers of two, so six steps in a row ask for some of 63 depths that are known
beforehand: their keys are joined with the handles at once.  A comparison within the exit
node's depths gives the place where the sequence leaves the trie.  There the node is split, and of all
sequences that leave at one place with one next turn, one, chosen by a hash, is put in as a leaf;
the others go on from there in the next round.  A random leaf takes off a share of the sequences
at each branching, so the number of rounds grows with the logarithm of the number of sequences.

Counts and sums of a subtree are those of the compacted nodes on the sequences' paths, added up
from the ends; then the edges are expanded to one node per depth.

Each step is a join or a sum over written tables; a sequence's keys are rows, not an array, so a
conversation may hold any part of all turns.  Long id lists are joined in stretches and hashed as
a stream.  A node's own list is hashed in order, which is one task's work for each node.

Defined cases: turns without a conv_id belong to no conversation.  Turns of one conversation are
ordered by turn (null first), role and MD5 of the text, null role and text as empty; repeated rows
are turns of their own.  Remainders have the sign of conv_id.  An empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written
from .running import running

GROUP, HEADS = 5, 9
#: Depths that a sequence looks up in one join are fewer than this power of two.
FAN = 64
#: Turns of a conversation that one row of a joined table stands for, and ids in one stretch of a list.
STRETCH, IDS = 4096, 4096


def rebuilt(conversations: DataFrame, group: int = GROUP, heads: int = HEADS) -> tuple[DataFrame, DataFrame]:
    """Conversations ``conv_id, n, h, taken, length`` and their turns ``conv_id, d, role, digest, size``."""
    digest = F.unhex(F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")))
    turns = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        digest.alias("digest"), F.octet_length(F.coalesce(F.col("text").cast("string"), F.lit(""))).cast("long").alias("size"), F.lit(1).cast("long").alias("nth"),
    )
    turns = running(turns, "conv_id", [F.asc_nulls_first("turn"), F.asc("role"), F.asc("digest")], ["nth"], [], "turns").drop("turn")
    counts = written(turns.groupBy("conv_id").agg(F.max("nth").alias("n")), "counts")
    convs = written(
        counts.withColumn("h", F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads).withColumn("base", F.expr(f"conv_id - conv_id % {group}"))
        .join(counts.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n")), "base", "left")
        .withColumn("taken", F.least("h", F.coalesce("base_n", F.lit(0).cast("long"))))
        .withColumn("length", F.expr("taken + greatest(n - h, 0L)")).drop("base_n"),
        "conversations",
    )
    head = (
        turns.where(f"conv_id % {group} = 0 AND nth < {heads}").withColumnRenamed("conv_id", "base")
        .join(convs.select("conv_id", "base", "taken"), "base").where("nth <= taken")
        .select("conv_id", F.col("nth").alias("d"), "role", "digest", "size")
    )
    # A conversation's own row is given once for each stretch of its turns, so no key of the join is long.
    stretches = convs.select("conv_id", "h", "taken", F.explode(F.expr(f"sequence(0L, n div {STRETCH})")).alias("part"))
    own = (
        turns.withColumn("part", F.expr(f"nth div {STRETCH}")).join(stretches, ["conv_id", "part"]).where("nth > h")
        .select("conv_id", F.expr("nth - h + taken").alias("d"), "role", "digest", "size")
    )
    return convs, head.unionByName(own)


def keyed(turns: DataFrame) -> DataFrame:
    """``id, d, k1, k2, bytes, size``: the key of each prefix and the bytes of its texts."""
    rows = turns.select(
        F.col("conv_id").alias("id"), "d", F.xxhash64("d", "role", "digest").alias("k1"), F.xxhash64("digest", "role", F.lit("2"), "d").alias("k2"),
        F.col("size").alias("bytes"), "size",
    )
    return running(rows, "id", [F.asc("d")], ["bytes"], ["k1", "k2"], "prefixes")


#: The depth in (s, e] that is divisible by the largest power of two.
_FAT = "shiftleft(shiftright({e}, cast(length(bin({s} ^ {e})) - 1 AS int)), cast(length(bin({s} ^ {e})) - 1 AS int))"
_NODE_FOUND = "struct<f:bigint,rep:bigint,s:bigint,e:bigint,x1:bigint,x2:bigint>"


def _at(rows: DataFrame, paths: DataFrame, who: str, depth: str, names: tuple[str, str]) -> DataFrame:
    """``rows`` with the key of ``who``'s prefix of a depth; nulls where it has none."""
    keys = paths.select(F.col("id").alias("p_id"), F.col("d").alias("p_d"), F.col("k1").alias(names[0]), F.col("k2").alias(names[1]))
    return rows.join(keys, (F.col(who) == F.col("p_id")) & (F.col(depth) == F.col("p_d")), "left").drop("p_id", "p_d")


NODE = ["rep", "s", "e", "k1", "k2", "f", "f1", "f2", "g1", "g2", "p1", "p2"]


def described(edges: DataFrame, paths: DataFrame) -> DataFrame:
    """Nodes from ``rep, s, e``: their handle ``f``, and the keys of extent, handle, first depth and parent."""
    places = edges.withColumn("f", F.expr(_FAT.format(s="s", e="e"))).select(
        "rep", "s", "e", "f", F.explode(F.expr("array(struct('p' AS w, s AS at), struct('g' AS w, s + 1 AS at), struct('f' AS w, f AS at), struct('k' AS w, e AS at))")).alias("x")
    ).select("rep", "s", "e", "f", "x.w", "x.at")
    found = _at(places, paths, "rep", "at", ("x1", "x2")).groupBy("rep", "s", "e", "f")
    return found.agg(*(F.coalesce(F.max(F.when(F.col("w") == w, F.col(f"x{i}"))), F.lit(0).cast("long")).alias(f"{w}{i}") for w in "kfgp" for i in (1, 2))).select(*NODE)


def searched(rows: DataFrame, nodes: DataFrame, paths: DataFrame, unit: int) -> DataFrame:
    """The steps of the search at depths that are multiples of ``unit``.

    ``rows`` have the open depths (lo, hi] and the last node found, ``b``.  Of the depths that these
    steps can ask for, fewer than ``FAN``, the keys are looked up in one join; the steps themselves
    then run inside the row.
    """
    keys = paths.where(F.col("d") % unit == 0).select(F.col("id").alias("p_id"), F.expr(f"d div {unit * FAN}").alias("p_part"), F.col("d").alias("p_d"), "k1", "k2")
    handles = nodes.where(F.col("f") % unit == 0).select(F.col("f").alias("h_f"), F.col("f1").alias("h1"), F.col("f2").alias("h2"), F.struct("f", "rep", "s", "e", F.col("k1").alias("x1"), F.col("k2").alias("x2")).alias("node"))
    asked = rows.join(keys, F.expr(f"id = p_id AND hi div {unit * FAN} = p_part AND p_d > lo AND p_d <= hi AND hi div {unit} > lo div {unit}"), "left")
    hits = asked.join(handles, F.expr("p_d = h_f AND k1 = h1 AND k2 = h2"), "left").groupBy("id").agg(
        *(F.first(c).alias(c) for c in ("length", "a", "lo", "hi", "b")), F.collect_list("node").alias("hits")
    )
    step = f"""CASE WHEN acc.lo >= acc.hi OR acc.f % {unit} <> 0 THEN acc
        ELSE transform(array(get(filter(hits, h -> h.f = acc.f), 0)), h -> CASE WHEN h IS NOT NULL
            THEN named_struct('lo', h.e, 'hi', acc.hi, 'f', {_FAT.format(s='h.e', e='acc.hi')}, 'b', h)
            ELSE named_struct('lo', acc.lo, 'hi', acc.f - 1, 'f', {_FAT.format(s='acc.lo', e='(acc.f - 1)')}, 'b', acc.b) END)[0] END"""
    start = f"named_struct('lo', lo, 'hi', hi, 'f', {_FAT.format(s='lo', e='hi')}, 'b', b)"
    found = F.expr(f"CASE WHEN hi div {unit} > lo div {unit} THEN aggregate(sequence(1, {FAN.bit_length()}), {start}, (acc, i) -> {step}) ELSE {start} END")
    return hits.select("id", "length", "a", found.alias("x")).select("id", "length", "a", "x.lo", "x.hi", "x.b")


def located(active: DataFrame, nodes: DataFrame, paths: DataFrame, longest: int) -> DataFrame:
    """Where each of ``id, length, a`` leaves the trie: ``exit_rep, exit_s, exit_e`` (null at a node) and ``p``."""
    rows = active.selectExpr("id", "length", "a", "a AS lo", "length AS hi", f"CAST(NULL AS {_NODE_FOUND}) AS b")
    units = [1]
    while units[-1] * FAN <= longest:
        units.append(units[-1] * FAN)
    for unit in reversed(units):
        rows = searched(rows, nodes, paths, unit)
    # The last node found is passed by, if its extent is a prefix too; else it is the exit node.
    rows = _at(rows.withColumn("b_e", F.col("b.e")), paths, "id", "b_e", ("q1", "q2"))
    passed = F.col("b").isNull() | ((F.col("q1") == F.col("b.x1")) & (F.col("q2") == F.col("b.x2")))
    rows = rows.withColumn("passed", F.coalesce(passed, F.lit(False))).withColumn("at", F.when(F.col("passed"), F.coalesce("b.e", "a")).otherwise(F.col("b.s")))
    # Where it is passed by, the exit node is the child with the next turn, if there is one.
    rows = _at(rows.drop("q1", "q2").withColumn("next", F.when(F.col("passed"), F.col("at") + 1)), paths, "id", "next", ("q1", "q2"))
    child = nodes.select(F.col("s").alias("c_s"), F.col("g1").alias("c1"), F.col("g2").alias("c2"), F.col("rep").alias("c_rep"), F.col("e").alias("c_e"))
    rows = rows.join(child, (F.col("at") == F.col("c_s")) & (F.col("q1") == F.col("c1")) & (F.col("q2") == F.col("c2")), "left").selectExpr(
        "id", "length", "at", "CASE WHEN passed THEN c_rep ELSE b.rep END AS exit_rep", "CASE WHEN passed THEN c_s ELSE b.s END AS exit_s",
        "CASE WHEN passed THEN c_e ELSE b.e END AS exit_e", "CASE WHEN passed THEN at + 1 ELSE b.f END AS least",
    ).withColumn("most", F.expr("least(exit_e - 1, length)"))
    rows = written(rows, "exits")
    # The prefixes of both sequences, at the depths of the exit node that are not known to be equal.
    mine = paths.select(F.col("id").alias("m_id"), F.col("d").alias("m_d"), F.col("k1").alias("m1"), F.col("k2").alias("m2"))
    theirs = paths.select(F.col("id").alias("t_id"), F.col("d").alias("t_d"), F.col("k1").alias("t1"), F.col("k2").alias("t2"))
    open_ones = rows.where("exit_rep IS NOT NULL AND least < most")
    shared = (
        open_ones.join(mine, F.expr("id = m_id AND m_d > least AND m_d <= most"))
        .join(theirs, F.expr("exit_rep = t_id AND m_d = t_d AND m1 = t1 AND m2 = t2"), "left")
        .groupBy("id").agg(*(F.first(c).alias(c) for c in ("length", "exit_rep", "exit_s", "exit_e")), F.coalesce(F.max("t_d"), F.first("least")).alias("p"))
    )
    others = rows.where("NOT (exit_rep IS NOT NULL AND least < most)").selectExpr("id", "length", "exit_rep", "exit_s", "exit_e", "CASE WHEN exit_rep IS NULL THEN at ELSE least END AS p")
    return shared.unionByName(others)


def compacted(sequences: DataFrame, paths: DataFrame) -> DataFrame:
    """The compacted nodes (``NODE``) of all sequences ``id, length``, without the root."""
    longest = sequences.agg(F.max("length")).first()[0] or 0
    left = written(sequences.where("length > 0").select("id", "length", F.lit(0).cast("long").alias("p")), "left")
    nodes = described(left.limit(0).selectExpr("id AS rep", "p AS s", "length AS e"), paths)
    pieces = cut = nodes.select("rep", "s", "e")
    while not left.isEmpty():
        # One of those that leave at one place with one next turn becomes a leaf.
        ahead = _at(left.withColumn("next", F.col("p") + 1), paths, "id", "next", ("g1", "g2"))
        chosen = ahead.groupBy("p", "g1", "g2").agg(F.min_by(F.struct("id", "length"), F.struct(F.xxhash64("id"), "id")).alias("one"))
        leaves = written(chosen.select(F.col("one.id").alias("rep"), F.col("p").alias("s"), F.col("one.length").alias("e")), "leaves")
        whole = nodes.join(cut, ["rep", "s", "e"], "left_anti").select(*NODE)
        nodes = written(whole.unionByName(described(pieces.unionByName(leaves), paths)), "nodes")
        active = left.join(leaves.select(F.col("rep").alias("id")), "id", "left_anti").select("id", "length", F.col("p").alias("a"))
        found = written(located(active, nodes, paths, longest), "located")
        # A node is cut where sequences leave it, at any number of places; its last piece ends where it did.
        cuts = found.where("exit_rep IS NOT NULL").select(F.col("exit_rep").alias("rep"), F.col("exit_s").alias("s"), F.col("exit_e").alias("e"), F.col("p").alias("cut")).distinct()
        above = Window.partitionBy("rep", "s", "e").orderBy("cut")
        parts = cuts.select(
            "rep", "s", "e", "cut", F.coalesce(F.lag("cut").over(above), "s").alias("from"), F.lead("cut").over(above).isNull().alias("last")
        ).select("rep", "s", "e", "last", F.explode(F.expr("CASE WHEN last THEN array(struct(from AS a, cut AS b), struct(cut AS a, e AS b)) ELSE array(struct(from AS a, cut AS b)) END")).alias("x"))
        parts = written(parts.select("rep", "s", "e", "x.a", "x.b"), "cuts")
        cut = parts.where("b = e").select("rep", "s", "e")
        pieces = parts.select("rep", F.col("a").alias("s"), F.col("b").alias("e"))
        left = found.where("p < length").select("id", "length", "p")
    # What the last round cut has no more leaves to come.
    whole = nodes.join(cut, ["rep", "s", "e"], "left_anti").select(*NODE)
    return written(whole.unionByName(described(pieces, paths)), "nodes")


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows ``length, k1, k2, id`` to stretches of comma-joined ids."""
    key, ids, out = None, [], []

    def stretch():
        return (*key, ids[0], ",".join(map(str, ids)))

    def packed(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string() if i == 4 else pa.int64()) for i in range(5)], names=["length", "k1", "k2", "first", "ids"])

    for batch in batches:
        for *now, c in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            if ids and (now != key or len(ids) >= IDS):
                out.append(stretch())
                ids = []
                if len(out) >= 256:
                    yield packed(out)
                    out = []
            key = now
            ids.append(c)
    if ids:
        out.append(stretch())
    yield packed(out)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted stretches to one digest per node, as a stream."""
    key, digest = None, None

    def row():
        return pa.RecordBatch.from_arrays([*(pa.array([k], pa.int64()) for k in key), pa.array([digest.hexdigest()])], names=["e", "k1", "k2", "ends_sha256"])

    for batch in batches:
        for *now, _, ids in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
            if now != key:
                if key is not None:
                    yield row()
                key, digest = now, sha256(ids.encode())
            else:
                digest.update(b"," + ids.encode())
    if key is not None:
        yield row()


def end_digests(ends: DataFrame) -> DataFrame:
    """``e, k1, k2, ends_sha256`` from ``length, k1, k2, id``."""
    order = ["length", "k1", "k2", "id"]
    stretches = ends.select(*order).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_joined, "length long, k1 long, k2 long, first long, ids string")
    placed = stretches.repartition("length", "k1", "k2").sortWithinPartitions("length", "k1", "k2", "first")
    return placed.mapInArrow(_hashed, "e long, k1 long, k2 long, ends_sha256 string")


def nodes(conversations: DataFrame, group: int = GROUP, heads: int = HEADS) -> DataFrame:
    """One row per node of the trie: ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256``."""
    convs, turns = rebuilt(conversations, group, heads)
    prefixes = keyed(turns)
    last = prefixes.groupBy("id").agg(F.max_by(F.struct("k1", "k2"), "d").alias("k"))
    ends = written(
        convs.select(F.col("conv_id").alias("id"), "length").join(last, "id", "left")
        .select("id", "length", F.coalesce("k.k1", F.lit(0).cast("long")).alias("k1"), F.coalesce("k.k2", F.lit(0).cast("long")).alias("k2")),
        "ends",
    )
    sequences = written(ends.groupBy("length", "k1", "k2").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n")), "sequences")
    stretches = sequences.select("id", F.col("n"), F.explode(F.expr(f"sequence(0L, length div {STRETCH})")).alias("part"))
    paths = written(prefixes.withColumn("part", F.expr(f"d div {STRETCH}")).join(stretches, ["id", "part"]).drop("part"), "paths")
    trie = compacted(sequences.select("id", "length"), paths)

    # Sequences below each node; the root is on the path of all.
    through = paths.join(trie.select(F.col("e").alias("d"), "k1", "k2", "s", "p1", "p2"), ["d", "k1", "k2"]).select("id", "n", F.col("d").alias("e"), "k1", "k2", "s", "p1", "p2", "bytes")
    none = F.lit(None).cast("long")
    root = sequences.select("id", "n", *(F.lit(0).cast("long").alias(c) for c in ("e", "k1", "k2")), *(none.alias(c) for c in ("s", "p1", "p2")), F.lit(0).cast("long").alias("bytes"))
    through = written(through.unionByName(root), "through")
    at = ["e", "k1", "k2"]
    counted = written(
        through.groupBy(*at, "s", "p1", "p2").agg(F.min("id").alias("conv_id"), F.sum("n").alias("n_convs"), F.max("bytes").alias("bytes")), "counted"
    )
    parent = [F.col("s").alias("e"), F.col("p1").alias("k1"), F.col("p2").alias("k2")]
    children = counted.where("s IS NOT NULL").groupBy(*parent).agg(F.count(F.lit(1)).alias("n_branches"))
    above = counted.select(F.col("e").alias("s"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("bytes").alias("bytes_above"), F.col("conv_id").alias("parent"))
    counted = written(
        counted.join(children, at, "left").join(above, ["s", "p1", "p2"], "left")
        .withColumn("n_branches", F.coalesce("n_branches", F.lit(0).cast("long")))
        .withColumn("saved", F.expr("coalesce((n_convs - 1) * (bytes - bytes_above), 0L)"))
        .withColumn("leaf", (F.col("n_branches") == 0).cast("long")),
        "nodes-counted",
    )
    # A node's sums are put on the path of its smallest member and added up from the ends.
    held = counted.select(F.col("conv_id").alias("id"), "e", "saved", "leaf")
    values = through.select("id", *at).join(held, ["id", "e"], "left").fillna(0, ["saved", "leaf"])
    below = running(values, "id", [F.desc("e")], ["saved", "leaf"], [], "below").groupBy(*at).agg(F.sum("saved").alias("saved_below"), F.sum("leaf").alias("n_leaves"))
    whole = written(counted.join(below, at).join(end_digests(ends), at, "left"), "trie")

    nothing = sha256(b"").hexdigest()
    deeper = (
        whole.where("s IS NOT NULL").select("*", F.explode(F.expr("sequence(s + 1, e)")).alias("d"))
        .join(paths.select(F.col("id").alias("conv_id"), "d", F.col("bytes").alias("bytes_here"), "size"), ["conv_id", "d"])
        .selectExpr(
            "conv_id", "d AS depth", "CASE WHEN d = s + 1 THEN parent ELSE conv_id END AS parent_conv_id", "n_convs",
            "CASE WHEN d < e THEN 1L ELSE n_branches END AS n_children", "n_leaves",
            "saved_below - saved + (n_convs - 1) * (bytes - bytes_here + size) AS saved_tokens",
            f"CASE WHEN d = e THEN coalesce(ends_sha256, '{nothing}') ELSE '{nothing}' END AS ends_sha256",
        )
    )
    top = whole.where("s IS NULL").selectExpr(
        "conv_id", "e AS depth", "CAST(NULL AS long) AS parent_conv_id", "n_convs", "n_branches AS n_children", "n_leaves", "saved_below AS saved_tokens",
        f"coalesce(ends_sha256, '{nothing}') AS ends_sha256",
    )
    return deeper.unionByName(top)


#: CRC-32 is folded over the digits of conv_id with the table of the reversed polynomial.
ORACLE = f"""
WITH RECURSIVE steps(b, k, v) AS (
  SELECT b, 0, b::BIGINT FROM range(256) r(b)
  UNION ALL
  SELECT b, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM steps WHERE k < 8),
crc_table AS (SELECT list(v ORDER BY b) AS crcs FROM steps WHERE k = 8),
turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), md5(coalesce(text, ''))) AS nth
  FROM conversations WHERE conv_id IS NOT NULL),
convs AS (
  SELECT conv_id, conv_id - conv_id % {GROUP} AS base,
         xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(length(conv_id::VARCHAR)), lambda i: ascii(substr(conv_id::VARCHAR, i + 1, 1))::BIGINT)),
             lambda c, x: xor(c >> 8, crcs[(xor(c, x) & 255) + 1])), 4294967295) % {HEADS} AS h
  FROM (SELECT DISTINCT conv_id FROM turns), crc_table),
built AS (
  SELECT c.conv_id, t.nth, role, text FROM convs c JOIN turns t ON t.conv_id = base WHERE t.nth <= h
  UNION ALL SELECT conv_id, nth, role, text FROM convs JOIN turns USING (conv_id) WHERE nth > h),
placed AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY nth) AS d, md5(role) || md5(text) AS part, strlen(text) AS size FROM built),
paths AS (
  SELECT conv_id, d, size, md5(string_agg(part, '' ) OVER (PARTITION BY conv_id ORDER BY d ROWS UNBOUNDED PRECEDING)) AS key FROM placed
  UNION ALL SELECT conv_id, 0, 0, '' FROM convs),
chained AS (
  SELECT *, lag(key) OVER (PARTITION BY conv_id ORDER BY d) AS above, d = max(d) OVER (PARTITION BY conv_id) AS last FROM paths),
nodes AS (
  SELECT d, key, min(conv_id) AS conv_id, any_value(above) AS above, count(*) AS n_convs, any_value(size) AS size,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (last), '')) AS ends_sha256
  FROM chained GROUP BY d, key),
linked AS (
  SELECT n.*, p.conv_id AS parent_conv_id, (SELECT count(*) FROM nodes c WHERE c.d = n.d + 1 AND c.above = n.key) AS n_children
  FROM nodes n LEFT JOIN nodes p ON p.d = n.d - 1 AND p.key = n.above),
below AS (
  SELECT a.d, a.key, sum((n.n_convs - 1) * n.size)::BIGINT AS saved_tokens, sum((n.n_children = 0)::INT)::BIGINT AS n_leaves
  FROM linked n JOIN paths a ON a.conv_id = n.conv_id AND a.d <= n.d GROUP BY a.d, a.key)
SELECT conv_id, d AS depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 FROM linked JOIN below USING (d, key)
"""
