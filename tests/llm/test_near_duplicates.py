"""HyperMinHash groups against all pairs of full shingle sets."""

import random
import re

import numpy as np
import pytest

from lakeops.llm import hyperminhash as hm
from lakeops.llm import queries
from lakeops.llm.components import components

from tests.llm.fixtures import edge_docs, edge_rows, no_docs, prose


def shingles(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset() if not w else frozenset([tuple(w)]) if len(w) < k else frozenset(tuple(w[i:i + k]) for i in range(len(w) - k + 1))


def groups(rows, k, percent):
    """Smallest reachable id and set size for each row, by all pairs."""
    sets = [shingles(t, k) for _, t, *_ in rows]
    parent = list(range(len(rows)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = {}
    for x, s in enumerate(sets):
        for g in s:
            holders.setdefault(g, []).append(x)
    for pair in {(a, b) for v in holders.values() for a in v for b in v if a < b}:
        a, b = (sets[i] for i in pair)
        if 100 * len(a & b) >= percent * len(a | b):
            parent[top(pair[0])] = top(pair[1])
    least = {}
    for x, (i, *_) in enumerate(rows):
        if i is not None:
            least[top(x)] = min(least.get(top(x), i), i)
    return [(rows[x][0], len(sets[x]), least.get(top(x)), rows[x][0] == least.get(top(x))) for x in range(len(rows))]


def key(t):
    return tuple((v is not None, v) for v in t)


def check(spark, rows, k, percent):
    got = hm.near_duplicates(edge_docs(spark, rows), k, percent).collect()
    want = groups(rows, k, percent)
    assert sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got), key=key) == sorted(want, key=key)
    return got


def copies(seed, base_words, n, edits, chain=False):
    """An original and copies of it with some words replaced, of the original or of the copy before."""
    rng = random.Random(seed)
    first = prose(seed, base_words).split()
    out, last = [" ".join(first)], first
    for _ in range(n):
        new = list(last if chain else first)
        for _ in range(rng.randrange(edits + 1)):
            new[rng.randrange(len(new))] = f"e{rng.randrange(60)}"
        last = new
        out.append(" ".join(new))
    return out


@pytest.mark.parametrize("k, percent", [(3, 85), (5, 80)])
def test_groups(spark, k, percent):
    texts = copies(1, 150, 150, 14) + copies(2, 60, 40, 4, chain=True) + copies(3, 400, 30, 25) + [prose(100 + i, 80) for i in range(60)]
    shared = prose(9, 70)
    texts += [f"{prose(200 + i, 30 + i)} {shared} {prose(300 + i, 10)}" for i in range(40)] + [texts[5]] * 7 + [texts[0].upper()]
    random.Random(4).shuffle(texts)
    got = check(spark, [(i * 3, t, "en", "a", 0) for i, t in enumerate(texts)], k, percent)
    assert sum(r.keep for r in got) == len({r.component_id for r in got})


def test_edges(spark):
    got = check(spark, edge_rows(), 3, 85)
    assert sum(r.keep for r in got) == 13  # 15 rows; one long copy and one repeated row go
    assert hm.near_duplicates(no_docs(spark)).collect() == []


def test_kept_rows(spark):
    docs = edge_docs(spark)
    out = hm.deduplicated(docs)
    assert out.schema == docs.schema
    left = sorted(((r.doc_id, r.text) for r in out.collect()), key=key)
    want = [(i, t) for i, t, *_ in edge_rows() if i != 6]
    want.remove((7, "same row"))
    assert left == sorted(want, key=key)
    assert hm.deduplicated(no_docs(spark)).collect() == []


def test_registered(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert sorted(tuple(r) for r in queries.op4_hyperminhash(spark, sf).collect()) == sorted(groups(rows, 3, 85))


def test_estimate_takes_out_collisions():
    rng = np.random.default_rng(1)
    a, b = (rng.integers(0, 1 << 63, 3000).astype(np.uint64) for _ in range(2))
    both = np.concatenate([a[:2000], b[:1000]])
    sigs = [hm.sketch(np.unique(x), 600)[None, :] for x in (a, both, b)]
    n = np.array([3000])
    assert abs(hm.jaccard(sigs[0], sigs[1], n, n)[0] - 0.5) < 0.09
    assert hm.jaccard(sigs[0], sigs[2], n, n)[0] < 0.02
    one = np.array([2], dtype=np.int64)
    tiny = [hm.sketch(np.array([x, x + 1], dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), 600)[None, :] for x in (5, 500)]
    assert hm.jaccard(tiny[0], tiny[1], one, one)[0] < 0.05


def test_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(200, 260)] + [(rng.randrange(100), rng.randrange(100)) for _ in range(60)] + [(5, 5)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {}

    def top(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = top(a), top(b)
        parent[max(x, y)] = min(x, y)
    assert got == {x: top(x) for x in parent if any(x in e and e[0] != e[1] for e in edges)}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []
