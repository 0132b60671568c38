"""The prefix trie against a plain trie."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import pytest

from spanveil.llm import prefix_trie, running

SCHEMA = "conv_id long, turn long, role string, text string, id string, d int, bytes int, k1 string"


def plain(rows, group=5, heads=9):
    """Nodes of ``(conv_id, turn, role, text)`` rows, by sequences as tuples."""
    conv = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            conv[c].append((t is not None, t or 0, r or "", hashlib.md5((x or "").encode()).hexdigest(), x or ""))
    conv = {c: [(r, x) for _, _, r, _, x in sorted(v)] for c, v in conv.items()}
    built = {}
    for c, v in conv.items():
        h = zlib.crc32(str(c).encode()) % heads
        built[c] = conv.get(c - int(math.fmod(c, group)), [])[:h] + v[h:]
    members, children, leaves, saved = defaultdict(list), defaultdict(list), {}, {}
    for c, v in built.items():
        for d in range(len(v) + 1):
            members[tuple(v[:d])].append(c)
    for k in members:
        if k:
            children[k[:-1]].append(k)
    for k in sorted(members, key=len, reverse=True):
        leaves[k] = sum(leaves[x] for x in children[k]) or 1
        saved[k] = sum(saved[x] for x in children[k]) + ((len(members[k]) - 1) * len(k[-1][1].encode()) if k else 0)
    return [
        (min(m), len(k), min(members[k[:-1]]) if k else None, len(m), len(children[k]), leaves[k], saved[k],
         hashlib.sha256(",".join(map(str, sorted(c for c in m if len(built[c]) == len(k)))).encode()).hexdigest())
        for k, m in members.items()
    ]


def hostile_turns(seed=7):
    rng = random.Random(seed)
    rows = [(c, t, rng.choice(["user", "assistant", None]), rng.choice(["a", "b", "", None, "é中🙂"])) for c in range(-30, 60) for t in range(rng.randint(1, 6))]
    rows += [(c, t, "user", f"turn {t}") for c in range(100, 160) for t in range(rng.choice([3, 3, 5]))]
    rows += [(500, t, "user", f"long {t}") for t in range(700)] + [(501 + k, t, "user", f"long {t}") for k in range(4) for t in range(100 * k + 50)]
    rows += [(700 + k, t, "user", f"fork {t}" if t < 12 + k else f"own {k}") for k in range(20) for t in range(14 + k)]
    rows += [(900, None, None, None), (900, None, "user", "x"), (900, 1, "b", "tie"), (900, 1, "a", "tie"), (900, 1, "a", "tie"), (900, 1, "a", "eit")]
    rows += [(None, 1, "user", "no conversation"), (None, None, None, None), (2**62, 1, "user", "x" * 100_000), (-(2**62), 1, "user", "far")]
    return rows


def test_nodes_of_hostile_turns(spark, monkeypatch):
    rows = hostile_turns()
    df = spark.createDataFrame([(*r, "x", 1, 2, "k") for r in rows], SCHEMA).repartition(5)
    monkeypatch.setattr(prefix_trie, "STRETCH", 16)
    monkeypatch.setattr(prefix_trie, "IDS", 3)
    found = prefix_trie.nodes(df)
    assert found.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert Counter(map(tuple, found.collect())) == Counter(plain(rows))


@pytest.mark.parametrize("rows", [[], [(None, 1, "a", "b")], [(1, 1, "a", "b")], [(0, 0, "a", "b"), (0, 1, "a", "c")], [(7, 1, "user", "t")] * 3])
def test_small_tables(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert Counter(map(tuple, prefix_trie.nodes(df).collect())) == Counter(plain(rows))


def test_conversations_without_turns(spark):
    """Ids whose first turns come from a conversation that is not there, and which have no others."""
    ids = [c for c in range(1, 200) if c % 5 and zlib.crc32(str(c).encode()) % 9 >= 2]
    rows = [(c, t, "user", f"{c}") for c in ids for t in range(2)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    found = prefix_trie.nodes(df).collect()
    assert len(found) == 1 and found[0].n_convs == len(ids) and found[0].n_children == 0 and found[0].n_leaves == 1
    assert Counter(map(tuple, found)) == Counter(plain(rows))


def test_compacted_nodes_have_their_handles(spark):
    rows = [(c, d, 0, 0) for c in range(3) for d in range(1, 14)]
    turns = spark.createDataFrame([(c, d, "user", (b"same" if d <= (5 if c else 13) - (c == 2) * 2 else bytes([c])), 1) for c, d, _, _ in rows], "conv_id long, d long, role string, digest binary, size long")
    paths = prefix_trie.keyed(turns)
    sequences = spark.createDataFrame([(c, 13) for c in range(3)], "id long, length long")
    made = {(r.s, r.e): r for r in prefix_trie.compacted(sequences, paths).collect()}
    assert sorted(made) == [(0, 3), (3, 5), (3, 13), (5, 13), (5, 13)] or sorted(made) == [(0, 3), (3, 5), (3, 13), (5, 13)]
    for (s, e), r in made.items():
        assert r.f == max(range(s + 1, e + 1), key=lambda d: (d & -d, d))


def test_running_values_over_partitions(spark):
    rng = random.Random(2)
    rows = [(rng.choice([1, 1, 1, 2, 3]), k, rng.randint(-5, 5), rng.getrandbits(60)) for k in range(3000)] + [(9, 1, 4, 4)]
    df = spark.createDataFrame(rows, "key long, at long, v long, x long").repartition(6)
    found = running.running(df, "key", ["at"], ["v"], ["x"], "test").collect()
    told, sums, xors = [], Counter(), Counter()
    for key, at, v, x in sorted(rows):
        sums[key] += v
        xors[key] ^= x
        told.append((key, at, sums[key], xors[key]))
    assert sorted(map(tuple, found)) == told
    assert running.running(df.limit(0), "key", ["at"], ["v"], ["x"], "test").count() == 0
