"""Trie nodes against prefixes collected in Python, with blocks so small that most nodes lie across borders."""

import hashlib
import random
import zlib

import pytest

from lakeops.llm import prefix_trie as T
from lakeops.llm import queries

TURNS = "conv_id long, turn long, role string, text string, codes string, depth string, points string"


def conversations(rows):
    whole = {}
    for c, n, role, text in rows:
        if c is not None:
            whole.setdefault(c, []).append((n is not None, n or 0, role or "", text or ""))
    return {c: [(r, t) for _, _, r, t in sorted(v)] for c, v in whole.items()}


def with_heads(whole):
    out = {}
    for c, own in whole.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (abs(c) % 100 if c >= 0 else -(abs(c) % 100))
        out[c] = whole.get(base, [])[:h] + own[h:]
    return out


def nodes(whole):
    members = {}
    for c, turns in whole.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    children = {}
    for path in members:
        if path:
            children.setdefault(path[:-1], []).append(path)
    leaves, saved = {}, {}
    for path in sorted(members, key=len, reverse=True):
        kids = children.get(path, [])
        leaves[path] = sum(leaves[k] for k in kids) or 1
        saved[path] = sum(saved[k] for k in kids) + (len(path) and (len(members[path]) - 1) * len(path[-1][1]))
    sha = lambda path: hashlib.sha256(",".join(str(c) for c in sorted(members[path]) if len(whole[c]) == len(path)).encode()).hexdigest()
    return sorted(((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(children.get(p, [])), leaves[p], saved[p], sha(p)) for p, m in members.items()), key=str)


def told(df):
    return sorted((tuple(r) for r in df.drop("code").collect()), key=str)


def random_turns(seed, convs, hot=0):
    rng = random.Random(seed)
    rows = []
    for c in range(convs):
        for n in range(rng.randrange(0, 9)):
            rows.append((c * (1 + seed % 3), n, ("user", "assistant")[n % 2], f"say {'x' * (rng.randrange(3) if n else c % 5)}"))
    for c in range(hot):  # a third of all, word for word
        rows += [(10_000 + c, n, "user", f"always {n}") for n in range(4)]
    rng.shuffle(rows)
    return rows


@pytest.fixture
def many_ranges(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.mark.parametrize("seed,block,chunk", [(0, 1, 1), (1, 7, 2), (2, 40, 3), (3, 1 << 17, 512)])
def test_trie(spark, many_ranges, seed, block, chunk):
    rows = random_turns(seed, 250, 120 if seed % 2 == 0 else 0)
    df = spark.createDataFrame([(*r, "clash", "clash", "clash") for r in rows], TURNS).repartition(5)
    got = T.trie(T.sequences(df), block, chunk)
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256", "code"]
    assert told(got) == nodes(conversations(rows))


def test_rebuilt_and_edges(spark):
    rows = random_turns(5, 420)
    rows += [(-3, 0, "user", "below"), (-100, 1, "user", "base"), (-100, None, None, None), (None, 0, "user", "lost"), (5001, 0, "user", "no base"), (5001, 0, "user", "no base"),
             (5001, 0, "assistant", "tie"), (6000, 0, "user", "é" * 5000), (6001, 3, "user", "ж"), (6002, 0, "", ""), (6003, 0, None, None)]
    rows += [(7000, n, "user", f"turn {n % 50}") for n in range(3000)] + [(7000 + c, 0, "user", "short") for c in range(1, 8)]
    df = spark.createDataFrame([(*r, "clash", "clash", "clash") for r in rows], TURNS).repartition(3)
    whole = conversations(rows)
    assert told(T.trie(T.rebuilt(T.sequences(df)), 500, 4)) == nodes(with_heads(whole))
    assert T.trie(T.rebuilt(T.sequences(df.limit(0)))).count() == 0
    known = {r.code: (r.role, r.text) for r in T.dictionary(df).collect()}
    root = [r for r in T.trie(T.sequences(df)).collect() if r.depth == 1]
    assert sorted(known[r.code.hex()] for r in root) == sorted({v[0] for v in whole.values()})


def test_code_clashes_are_drawn_anew(spark, monkeypatch):
    from pyspark.sql import functions as F
    real = T._code
    monkeypatch.setattr(T, "_code", lambda seed: F.lit("0" * 32) if seed == 0 else real(seed))
    rows = random_turns(1, 30)
    df = spark.createDataFrame([(*r, "", "", "") for r in rows], TURNS)
    assert told(T.trie(T.sequences(df))) == nodes(conversations(rows))


def test_median_insertion_is_balanced():
    tree, order = T.Tree(), list(T._medians(1023))
    assert sorted(order) == list(range(1023))
    for k in order:
        tree.insert([k], [1], [k])
    depth, todo = 0, [(tree.child[0], 1)]
    while todo:
        at, d = todo.pop()
        if at:
            depth = max(depth, d)
            todo += [(tree.small[at], d + 1), (tree.large[at], d + 1)]
    assert depth == 10


def test_registered(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert told(queries.op12_prefix_trie(spark, sf)) == nodes(with_heads(conversations(rows)))
