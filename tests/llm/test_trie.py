import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from tidemill.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string"
OUT = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def brute(sequences):
    """The nodes by their definition, from {conv_id: [(role, text), ...]}."""
    members = {}
    for c, turns in sequences.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    children = {}
    for node in members:
        if node:
            children.setdefault(node[:-1], []).append(node)
    below = {}
    for node in sorted(members, key=len, reverse=True):
        saved = (len(members[node]) - 1) * len(node[-1][1].encode()) if node else 0
        leaves, kids = 0, children.get(node, [])
        for k in kids:
            saved, leaves = saved + below[k][0], leaves + below[k][1]
        below[node] = (saved, leaves if kids else 1)
    rows = []
    for node, own in members.items():
        ends = ",".join(map(str, sorted(c for c in own if len(sequences[c]) == len(node))))
        parent = min(members[node[:-1]]) if node else None
        rows.append((min(own), len(node), parent, len(own), len(children.get(node, [])), below[node][1], below[node][0], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(rows, key=repr)


def rows_of(spark, sequences, parts=3):
    rows = [(c, t, role, text) for c, turns in sequences.items() for t, (role, text) in enumerate(turns)]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, SCHEMA).repartition(parts)


def nodes(spark, sequences, **how):
    turns = trie.turns_of(rows_of(spark, sequences))
    return sorted((tuple(r) for r in trie.prefix_trie(turns, trie.lengths_of(turns), **how).select(*OUT).collect()), key=repr)


def drawn(seed, convs, letters, longest):
    r = random.Random(seed)
    ids = r.sample(range(-50, 5000), convs)
    return {c: [(r.choice("ua"), r.choice(letters)) for _ in range(r.randint(1, longest))] for c in ids}


@pytest.mark.parametrize("block", [1, 2, 5, 4096])
def test_equals_brute_force(spark, block):
    sequences = drawn(block, 60, ["x", "é", ""], 5)
    few = dict(list(sequences.items())[: 12 if block == 1 else 60])
    few[7001] = few[7002] = few[7003] = next(iter(few.values()))
    assert nodes(spark, few, block=block) == brute(few)


def test_long_conversations(spark, monkeypatch):
    """Names of pieces, three levels of them."""
    monkeypatch.setattr(trie, "PIECE", 3)
    r = random.Random(4)
    base = [("u", r.choice("ab")) for _ in range(60)]
    sequences = {i: base[: r.randint(1, 60)] + [("a", r.choice("ab")) for _ in range(r.randint(0, 5))] for i in range(25)}
    sequences |= {30: base, 31: base, 32: base + base, 33: base[:27], 34: base[:27] + [("a", "z")]}
    assert nodes(spark, sequences, block=4) == brute(sequences)


def test_hot_starts_and_copies(spark):
    same = [("system", "s"), ("user", "u"), ("assistant", "a")]
    sequences = {c: same for c in range(100)} | {c: [*same[:1], ("user", str(c))] for c in range(100, 220)} | {500: same[:1]}
    assert nodes(spark, sequences, block=16) == brute(sequences)


def test_shared_starts(spark):
    sequences = drawn(9, 80, ["x", "y"], 12)
    sequences = {c: t for c, t in sequences.items() if c >= 0} | {c: [("u", str(k)) for k in range(1 + c % 3)] for c in range(20)}

    def start(c):
        h = zlib.crc32(str(c).encode()) % 9
        return sequences.get(c - c % 5, [])[:h] + sequences[c][h:]

    turns = trie.turns_of(rows_of(spark, sequences))
    got = trie.prefix_trie(*trie.with_shared_starts(turns), block=7).select(*OUT).collect()
    want = {c: start(c) for c in sequences}
    assert any(not t for t in want.values())
    assert sorted((tuple(r) for r in got), key=repr) == brute(want)


def test_awkward_rows(spark):
    rows = [(1, None, None, "first"), (1, 0, "user", None), (1, 0, "user", None), (2, -1, "", "first"), (2, 5, "user", ""), (None, 0, "user", "lost"), (3, 1, "user", "x" * 300_000)]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("clash") for c in ("symbol", "size", "depth", "place", "key", "n")})
    turns = trie.turns_of(df)
    got = sorted((tuple(r) for r in trie.prefix_trie(turns, trie.lengths_of(turns)).select(*OUT).collect()), key=repr)
    assert got == brute({1: [("", "first"), ("user", ""), ("user", "")], 2: [("", "first"), ("user", "")], 3: [("user", "x" * 300_000)]})
    none = trie.turns_of(spark.createDataFrame([], SCHEMA))
    assert trie.prefix_trie(*trie.with_shared_starts(none)).count() == 0


def test_only_turnless(spark):
    turns = trie.turns_of(spark.createDataFrame([], SCHEMA))
    got = trie.prefix_trie(turns, spark.createDataFrame([(4, 0), (9, 0)], "conv_id long, n long")).select(*OUT).collect()
    assert [tuple(r) for r in got] == [(4, 0, None, 2, 0, 1, 0, hashlib.sha256(b"4,9").hexdigest())]


def test_nearest_smaller():
    r = random.Random(2)
    for _ in range(200):
        v = [r.randint(0, 4) for _ in range(r.randint(1, 15))]
        left, right, again = trie.nearest_smaller(v)
        for i, x in enumerate(v):
            assert left[i] == max((j for j in range(i) if v[j] < x), default=-1)
            assert right[i] == min((j for j in range(i + 1, len(v)) if v[j] < x), default=len(v))
            assert again[i] == any(v[j] == x for j in range(left[i] + 1, i))
