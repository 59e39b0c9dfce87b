"""Exact copies against grouping in Python, also with groups that lie across many ranges."""

import hashlib
import random
import re

import pytest

from lakeops.llm import content_sort, queries

from tests.llm.fixtures import CLASHING, SCHEMA, edge_docs, edge_rows, no_docs, prose


def norm(text):
    return re.sub(r"[\x20\x09-\x0D]", "", text or "")


def expected(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(norm(t), []).append((-len(t or ""), i is None, i))
    out = []
    for text, members in groups.items():
        members.sort(key=lambda m: (m[0], m[1], m[2] or 0))
        out += [(i, members[0][2], len(members), place == 0, hashlib.sha256(text.encode()).hexdigest()) for place, (_, _, i) in enumerate(members)]
    return ordered(out)


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((v is not None, str(v)) for v in r))


@pytest.fixture
def many_ranges(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def planted(seed):
    rng = random.Random(seed)
    spaced = lambda t: "".join(c + (" " * rng.randrange(3) if c == " " else "") for c in t) + "\n" * rng.randrange(2)
    hot, shared = prose(1, 30), prose(2, 40)
    rows = [(i, spaced(hot)) for i in range(200)]  # a third of all rows
    rows += [(300 + i, shared + prose(i, 1)) for i in range(100)]  # one long beginning, different ends
    rows += [(500 + i, spaced(prose(i % 90, 12))) for i in range(200)] + [(None, hot), (None, None), (7, hot), (900, ""), (901, " \n"), (902, " "), (903, hot.upper())]
    rows += [(1000, prose(9, 30_000)), (1001, prose(9, 30_000) + "\t"), (950, None)]
    rng.shuffle(rows)
    return rows


def test_copies(spark, many_ranges):
    rows = planted(4)
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], SCHEMA).repartition(7)
    told = content_sort.copies(df).drop("tkey")
    assert told.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert ordered(tuple(r) for r in told.collect()) == expected(rows)


def test_one_text_in_every_range(spark, many_ranges):
    df = spark.createDataFrame([(i, "a b" if i % 2 else "ab", "en", "s", 0) for i in range(500)] + [(None, "a\tb", "en", "s", 0)] * 40, SCHEMA).repartition(5)
    got = content_sort.copies(df).collect()
    assert {(r.keep_id, r.group_size) for r in got} == {(1, 540)} and [r.doc_id for r in got if r.kept] == [1]


def test_edges(spark):
    rows = [(r[0], r[1]) for r in edge_rows()]
    docs = edge_docs(spark)
    assert ordered(tuple(r) for r in content_sort.copies(docs).drop("tkey").collect()) == expected(rows)
    assert content_sort.copies(no_docs(spark)).count() == 0
    left = content_sort.deduplicated(docs)
    assert left.columns == docs.columns and set(CLASHING) < set(left.columns)
    best = {}
    for i, t in rows:
        key = (-len(t or ""), i is None, i or 0, t or "")
        best[norm(t)] = min(best.get(norm(t), key), key)
    got = left.select("doc_id", "text").collect()
    assert sorted(norm(r.text) for r in got) == sorted(best)
    assert {(r.doc_id is None, r.doc_id or 0, r.text or "") for r in got} == {k[1:] for k in best.values()}
    assert content_sort.deduplicated(no_docs(spark)).count() == 0


def test_registered(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert ordered(tuple(r) for r in queries.op11_content_sort(spark, sf).collect()) == expected(rows)
