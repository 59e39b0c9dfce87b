"""Runs, Lyndon words and collapsed texts against definitions spelled out in Python."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from lakeops.llm import periodic as P
from lakeops.llm import queries

from tests.llm.fixtures import edge_docs, edge_rows, no_docs, prose


def slow_runs(w, least=6, repeats=4):
    out = []
    for q in range(1, len(w) // repeats + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            size = j - i + q
            # The root of a run is no power, so a shorter period of the stretch would divide q.
            if size >= max(least, repeats * q) and not any(q % d == 0 and w[i:i + q] == w[i:i + d] * (q // d) for d in range(1, q)):
                out.append((i, size, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def longest_lyndon(w, i):
    return max(j - i for j in range(i + 1, len(w) + 1) if all(w[i:j] < w[k:j] for k in range(i + 1, j)))


def strings(rng):
    out = []
    for _ in range(rng.randrange(1, 5)):
        k = rng.randrange(1, 5)
        s = [rng.randrange(k) for _ in range(rng.randrange(1, 40))]
        if rng.random() < 0.6:
            root = [rng.randrange(k) for _ in range(rng.randrange(1, 7))]
            s = s[:rng.randrange(len(s) + 1)] + (root * 12)[:rng.randrange(1, 50)] + s[:5]
        out.append(s)
    return out, np.array([x for s in out for x in s], np.int64), np.cumsum([0, *map(len, out)])


def test_groups_are_longest_lyndon_words():
    rng = random.Random(1)
    for _ in range(60):
        parts, codes, starts = strings(rng)
        for down in (False, True):
            group, length = P.lyndon_groups(codes, starts, down)
            for s, o in zip(parts, starts):
                w = [-x for x in s] if down else s
                want = [longest_lyndon(w, i) for i in range(len(w))]
                assert length[o:o + len(w)].tolist() == want
                words = [tuple(w[i:i + n]) for i, n in enumerate(want)]
                assert [[a == b for b in words] for a in words] == [[a == b for b in group[o:o + len(w)]] for a in group[o:o + len(w)]]


def test_runs():
    rng = random.Random(2)
    for _ in range(800):
        parts, codes, starts = strings(rng)
        want = [(int(o) + a, n, q) for s, o in zip(parts, starts) for a, n, q in slow_runs(s)]
        assert P.runs(codes, starts) == sorted(want, key=lambda r: (r[0], r[2]))
    assert P.runs(np.zeros(0, np.int64), np.zeros(1, np.int64)) == []
    assert P.runs(np.zeros(200_000, np.int64), np.array([0, 200_000])) == [(0, 200_000, 1)]
    fib = [0], [0, 1]
    for _ in range(10):
        fib = fib[1], fib[1] + fib[0]
    assert P.runs(np.array(fib[1] * 4), np.array([0, 4 * len(fib[1])])) == slow_runs(fib[1] * 4)


def described(doc_id, text, tails=True):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    if tails and doc_id is not None and w:
        h = zlib.crc32(str(doc_id).encode())
        if h % 10 == 0:
            g = h // 10
            a = g % len(w)
            p = 1 + (len(w) - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(len(w))]
    found = slow_runs(w)
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    best = max(found, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=None)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (doc_id, len(found), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
            sha("".join(f"{s},{n},{q}\n" for s, n, q in found)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def key(row):
    return tuple((v is not None, str(v)) for v in row)


def planted():
    rng = random.Random(3)
    rows = []
    for i in range(240):
        words = [rng.choice("a b c d e".split()) if rng.random() < 0.5 else f"w{rng.randrange(60)}" for _ in range(rng.randrange(1, 90))]
        if i % 3 == 0:
            root = [f"é{rng.randrange(3)}" for _ in range(rng.randrange(1, 6))]
            at = rng.randrange(len(words))
            words[at:at] = (root * 9)[:rng.randrange(4, 40)]
        rows.append((i, rng.choice(["", " ", "\n"]) + "".join(w + rng.choice([" ", "  ", "\n", "\t \r"]) for w in words)))
    return rows + [(1000, "ha " * 900), (1001, f"{prose(5, 250)} " * 5), (1002, "no break " * 6), (1003, "a\x1cb " * 8)]


@pytest.mark.parametrize("chars", [50, 6 << 20])
def test_documents(spark, chars):
    rows = planted()
    df = spark.createDataFrame([(i, t) for i, t in rows], "doc_id long, text string").repartition(3)
    want = sorted((described(*r) for r in rows), key=key)
    got = P.periodic_runs(df, repeat_tails=True, collapsed=True, chars=chars)
    assert sorted((tuple(r)[:8] for r in got.collect()), key=key) == want
    for r in got.collect():
        assert hashlib.sha256(r.collapsed.encode()).hexdigest() == r.collapsed_sha256 and len(r.collapsed.split(" ") if r.collapsed else []) == r.n_words - r.n_dropped
    plain = sorted((tuple(r)[:8] for r in P.periodic_runs(df).collect()), key=key)
    assert plain == sorted((described(*r, tails=False) for r in rows), key=key)


def test_edges(spark):
    rows = [(r[0], r[1]) for r in edge_rows() if (r[1] or "").count(" ") < 10_000]
    got = P.periodic_runs(edge_docs(spark, [r for r in edge_rows() if (r[1] or "").count(" ") < 10_000]), repeat_tails=True)
    assert sorted((tuple(r)[:8] for r in got.collect()), key=key) == sorted((described(*r) for r in rows), key=key)
    assert P.periodic_runs(no_docs(spark)).count() == 0
    long = P.periodic_runs(edge_docs(spark)).filter("doc_id = 5").first()
    assert (long.n_words, long.n_runs) == (20_000, 0)
    with pytest.raises(ValueError):
        P.periodic_runs(no_docs(spark), repeats=3)


def test_registered(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    small = {i for i, t in rows if len((t or "").split()) < 1500}
    got = [tuple(r)[:8] for r in queries.op13_periodic_runs(spark, sf).collect()]
    assert len(got) == len(rows)
    assert sorted((r for r in got if r[0] in small), key=key) == sorted((described(i, t) for i, t in rows if i in small), key=key)
