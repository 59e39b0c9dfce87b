"""Exact top-k against all pairs, and collapsed conversations against prefix checks."""

import random

import numpy as np

from lakeops.llm import chat, queries, topk


def all_pairs(rows, asked, k, scale=1024):
    ok = [(i, np.floor(scale * np.array(v, dtype=float))) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for i in asked:
        q = min((v.tolist() for j, v in ok if j == i), default=None)
        if q is not None:
            best = sorted((-int(sum(int(a) * int(b) for a, b in zip(q, v))), j) for j, v in ok if j != i and len(v) == len(q))[:k]
            out += [(i, r, j, -s) for r, (s, j) in enumerate(best, 1)]
    return sorted(out)


def search(spark, rows, asked, **more):
    df = spark.createDataFrame([(i, v, "clash", "clash") for i, v in rows], "vec_id long, embedding array<double>, id string, vec string").repartition(3)
    return sorted(tuple(r) for r in topk.top_k(df.filter(df.vec_id.isin(asked)), df, **more).collect())


def test_top_k(spark):
    rng = np.random.default_rng(2)
    rows = [(i, (rng.standard_normal(40) * 0.2 + (0.6 if i % 9 == 0 else 0)).tolist()) for i in range(700)]
    rows += [(800 + i, rows[3][1]) for i in range(15)] + [(3, rows[4][1]), (900, None), (901, [None] * 40), (902, [float("nan")] * 40), (903, [float("inf")] * 40), (None, rows[1][1]),
             (904, [1.0, 2.0]), (905, [0.5, -1.0]), (906, []), (907, [])]
    asked = [0, 3, 9, 100, 805, 900, 901, 902, 904, 906]
    assert search(spark, rows, asked, k=10, query_block=3, block_rows=64) == all_pairs(rows, asked, 10)
    assert search(spark, rows[:4], [0, 1], k=10) == all_pairs(rows[:4], [0, 1], 10)
    assert search(spark, [], [0]) == []


def test_beyond_doubles(spark):
    rows = [(i, [1e5 + i, 3e4 * (-1) ** i, 12345.678 * i]) for i in range(30)]
    assert search(spark, rows, [0, 7], k=5, scale=1 << 13) == all_pairs(rows, [0, 7], 5, 1 << 13)


def test_bounds_never_drop_a_winner():
    rng = np.random.default_rng(5)
    rows, asked = np.floor(rng.standard_normal((500, 64)) * 200), np.floor(rng.standard_normal((7, 64)) * 200)
    best = [topk._Best(4) for _ in asked]
    for low in range(0, 500, 50):
        topk.search_block(np.arange(low, low + 50), rows[low:low + 50], asked, np.full(7, -1), best, 8)
    for q, b in zip(asked, best):
        full = rows @ q
        assert b.ids.tolist() == sorted(range(500), key=lambda i: (-full[i], i))[:4]


def collapsed(rows):
    turns = {}
    for c, n, role, text in set(rows):
        if c is not None:
            turns.setdefault(c, []).append(((n is not None, n or 0), role or "", text or "", n))
    whole = {c: [(r, t) for _, r, t, _ in sorted(v, key=lambda x: x[:3])] for c, v in turns.items()}
    out = []
    for c, v in whole.items():
        if any(len(o) > len(v) and o[:len(v)] == v for o in whole.values()) or any(o == v and d < c for d, o in whole.items()):
            continue
        out.append((c, len(v), sum(o == v for o in whole.values()), "".join(f"<|im_start|>{r}\n{t}<|im_end|>\n" for r, t in v)))
    return sorted(out)


def test_chat(spark):
    rng = random.Random(1)
    rows = []
    for c in range(60):
        script = c % 7
        for n in range(rng.randrange(1, 8)):
            rows.append((c, n, ("user", "assistant")[n % 2], f"hello {script} {n}" if rng.random() < 0.97 else "other"))
    rows += [(100, None, None, None), (100, 0, "user", ""), (100, 0, "user", ""), (101, 5, "user", "é" * 3000), (101, 5, "assistant", "tie"), (None, 0, "user", "lost"), (102, 0, "user", None)]
    df = spark.createDataFrame([(*r, "clash", "clash") for r in rows], "conv_id long, turn long, role string, text string, place string, h string").repartition(4)
    assert sorted(tuple(r) for r in chat.render(df).collect()) == collapsed(rows)
    assert chat.render(df.limit(0)).collect() == []


def test_registered(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert sorted(tuple(r) for r in queries.op3_snapshot_collapse(spark, sf).collect()) == collapsed(rows)
    vectors = [tuple(r) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()]
    assert sorted(tuple(r) for r in queries.op7_columnar_top_k(spark, sf).collect()) == all_pairs(vectors, [i for i, _ in vectors if i % 100 == 0], 10)
