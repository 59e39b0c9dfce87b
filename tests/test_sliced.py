"""Sliced windows against the plain windows they replace, on a table whose first key holds most rows."""

import datetime as dt
import random
import re

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from lakeops.operators import sliced
from lakeops.operators.quantiles import exact_percentiles
from tests.conftest import rows

START = dt.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def series(spark):
    rnd = random.Random(7)
    data = []
    for i in range(1500):
        key = 0 if rnd.random() < 0.6 else rnd.choice([None, *range(1, 10)])  # NULL is a group like any other
        at = START + dt.timedelta(seconds=rnd.randint(0, 20 * 86400))
        data.append((i, key, at, None if rnd.random() < 0.2 else round(rnd.uniform(-50, 50), 2)))
    return spark.createDataFrame(data, "id int, k int, ts timestamp, v double").cache()


def by_time():
    return Window.partitionBy("k").orderBy("ts", "id")


@pytest.mark.parametrize("seconds", [3600, 86_400, 40 * 86_400])
def test_neighbours(series, seconds):
    got = sliced.neighbours(series, ["k"], ["ts", "id"], sliced.time_slice("ts", seconds),
                            prev={"p": "v", "pid": "id"}, following={"n": "v"})
    want = series.select("*", F.lag("v").over(by_time()).alias("p"), F.lag("id").over(by_time()).alias("pid"), F.lead("v").over(by_time()).alias("n"))
    assert rows(got) == rows(want)


def test_running(series):
    cents = F.col("v").cast("decimal(10,2)")
    got = sliced.running(series, ["k"], ["ts", "id"], sliced.time_slice("ts"), {
        "s": ("sum", cents), "c": ("count", F.col("v")), "lo": ("min", F.col("v")), "hi": ("max", F.col("v")), "l": ("last", F.col("v"))})
    w = by_time().rowsBetween(Window.unboundedPreceding, 0)
    want = series.select("*", F.sum(cents).over(w).alias("s"), F.count("v").over(w).alias("c"), F.min("v").over(w).alias("lo"),
                         F.max("v").over(w).alias("hi"), F.last("v", True).over(w).alias("l"))
    assert rows(got) == rows(want)


def test_ranks_and_ntile(series):
    banded = series.withColumn("b", F.floor("v"))
    got = sliced.ranks(banded, ["k"], [F.col("b").desc(), "id"], sliced.value_slice("b", 7, descending=True), row_number="rn", size="n")
    got = got.withColumn("t", sliced.ntile(F.col("rn"), F.col("n"), 4))
    w = Window.partitionBy("k").orderBy(F.col("b").desc(), "id")
    want = banded.select("*", F.row_number().over(w).alias("rn"), F.count("*").over(Window.partitionBy("k")).alias("n"), F.ntile(4).over(w).alias("t"))
    assert rows(got) == rows(want)
    ties = sliced.ranks(banded, ["k"], ["b"], sliced.value_slice("b", 7), rank="r", dense_rank="d")
    u = Window.partitionBy("k").orderBy("b")
    assert rows(ties) == rows(banded.select("*", F.rank().over(u).alias("r"), F.dense_rank().over(u).alias("d")))


@pytest.mark.parametrize("seconds,slices", [(900, 3600), (7 * 86_400, 3600), (1, 60)])
def test_rolling(series, seconds, slices):
    cents = F.col("v").cast("decimal(10,2)")
    got = sliced.rolling(series, ["k"], "ts", seconds, {"s": F.sum(cents), "n": F.count("*")}, slices)
    w = Window.partitionBy("k").orderBy(F.unix_micros("ts")).rangeBetween(-seconds * 1_000_000, 0)
    assert rows(got) == rows(series.select("*", F.sum(cents).over(w).alias("s"), F.count("*").over(w).alias("n")))


@pytest.mark.parametrize("seconds", [1800, 86_400])
def test_islands(series, seconds):
    breaks = lambda now, was: F.unix_micros(now["ts"]) - F.unix_micros(was["ts"]) > 7200 * 1_000_000
    got = sliced.islands(series, ["k"], ["ts", "id"], sliced.time_slice("ts", seconds), ["ts"], breaks)
    gap = F.unix_micros("ts") - F.unix_micros(F.lag("ts").over(by_time()))
    flagged = series.withColumn("f", F.when(gap.isNull() | (gap > 7200 * 1_000_000), 1).otherwise(0))
    want = flagged.withColumn("island", F.sum("f").over(by_time())).drop("f")
    assert rows(got) == rows(want)


def test_null_keys_are_kept(spark):
    df = spark.createDataFrame([(None, START, 1), ("a", START, 2)], "k string, ts timestamp, id int")
    got = sliced.running(df, ["k"], ["ts", "id"], sliced.time_slice("ts"), {"c": ("count", F.lit(1))})
    assert got.count() == 2


def test_rolling_keeps_rows_without_a_time(spark):
    df = spark.createDataFrame([("a", START, 1), ("a", None, 2), (None, START, 3)], "k string, ts timestamp, v int")
    got = sliced.rolling(df, ["k"], "ts", 60, {"s": F.sum("v")})
    assert rows(got.select("k", "v", "s")) == [(None, 3, 3), ("a", 1, 1), ("a", 2, 2)]


def test_percentiles_keep_the_null_group(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 3.0), ("a", 5.0)], "k string, v double")
    assert rows(exact_percentiles(df, ["k"], "v", {"m": 0.5})) == [(None, 2.0), ("a", 5.0)]


@pytest.mark.parametrize("bands", [2, 7, 256])
def test_exact_percentiles(series, bands):
    """Whatever the number of bands, the result is exact."""
    probs = {"p0": 0.0, "p25": 0.25, "p50": 0.5, "p95": 0.95, "p100": 1.0}
    got = exact_percentiles(series, ["k"], "v", probs, bands)
    want = series.groupBy("k").agg(*[F.percentile("v", p).alias(n) for n, p in probs.items()])
    g, w = rows(got), rows(want)
    assert len(g) == len(w)
    for a, b in zip(g, w):
        assert a == pytest.approx(b)
    overall = exact_percentiles(series, [], "v", {"m": 0.5}, bands).first()["m"]
    assert overall == pytest.approx(series.agg(F.percentile("v", 0.5)).first()[0])


def test_bands_of_a_hot_key_are_many(spark):
    """A key with most rows, at few and at many values; no values meet on the key alone."""
    df = spark.range(6000).select(F.when(F.col("id") % 3 < 2, "hot").otherwise(F.concat(F.lit("k"), (F.col("id") % 50).cast("string"))).alias("k"),
                                  F.when(F.col("id") % 5 == 0, 1.5).when(F.col("id") % 7 == 0, None).otherwise(F.sin("id") * 1000).alias("v"))
    probs = {"low": 0.01, "mid": 0.5, "high": 0.999}
    got = exact_percentiles(df, ["k"], "v", probs)
    want = df.groupBy("k").agg(*[F.percentile("v", p).alias(n) for n, p in probs.items()])
    for a, b in zip(rows(got), rows(want), strict=True):
        assert a == pytest.approx(b)
    plan = got._jdf.queryExecution().executedPlan().toString().splitlines()
    for line, below in zip(plan, plan[1:]):  # what meets on the key alone has been added up by band
        if re.search(r"hashpartitioning\(k#\d+, \d+\)", line):
            assert "Aggregate" in below, below


def test_tied_ranks_equal_windows_and_spread_a_hot_key(spark):
    """Half of all rows have one key and two values."""
    df = spark.range(8000).select(F.when(F.col("id") % 2 == 0, 1).when(F.col("id") % 97 == 0, None).otherwise(F.col("id") % 40 + 2).cast("int").alias("k"),
                                  F.when(F.col("id") % 2 == 0, F.col("id") % 4).when(F.col("id") % 11 == 0, None).otherwise(F.col("id") % 9).alias("v"), F.xxhash64("id").alias("t"))
    got = sliced.tied_ranks(df, ["k"], ["v"], ["t"], row_number="rn", rank="rk", dense_rank="dr", size="n", slices=16)
    by = Window.partitionBy("k").orderBy("v")
    want = df.select("*", F.row_number().over(Window.partitionBy("k").orderBy("v", "t")).alias("rn"), F.rank().over(by).alias("rk"),
                     F.dense_rank().over(by).alias("dr"), F.count(F.lit(1)).over(Window.partitionBy("k")).alias("n"))
    assert rows(got) == rows(want)
    sizes = [r["count"] for r in sliced.cut(df, ["k"], ["v", "t"], 16).groupBy("k", "_cut").count().collect()]
    assert max(sizes) < 8000 / 16 * 2
    same = df.withColumn("v", F.lit(7))
    got = sliced.tied_ranks(same, [], ["v"], ["t"], row_number="rn", rank="rk", dense_rank="dr", size="n", slices=8)
    assert {(r.rk, r.dr, r.n) for r in got.collect()} == {(1, 1, 8000)}
    assert sliced.tied_ranks(df.limit(0), ["k"], ["v"], ["t"], row_number="rn", rank="rk", dense_rank="dr", size="n").count() == 0
    many = sliced.running(sliced.cut(df, ["k"], ["v", "t"], 16), ["k"], ["v", "t"], F.col("_cut"), {"c": ("count", F.lit(1))})
    assert rows(many.select("k", "v", "t", "c")) == rows(want.select("k", "v", "t", F.col("rn").alias("c")))


def test_small_keys_stay_whole_and_give_the_same(spark, monkeypatch):
    """Neighbours and ranks with keys that stay whole equal those with keys that are cut, NULL keys and ties included."""
    data = [(None if i % 41 == 0 else i % 40, i * 7 % 13, i) for i in range(400)]
    df = spark.createDataFrame(data, "k int, x int, id int")

    def both():
        near = sliced.neighbours(df, ["k"], ["x", "id"], sliced.value_slice("x", 4), prev={"was": "id"}, following={"next": "id"})
        ranked = sliced.ranks(df, ["k"], ["x"], sliced.value_slice("x", 4), rank="r", dense_rank="d", size="n")
        numbered = sliced.ranks(df, ["k"], ["x", "id"], sliced.value_slice("x", 4), row_number="no")
        return [(x.schema, sorted(map(tuple, x.collect()), key=str)) for x in (near, ranked, numbered)]

    cut = both()
    monkeypatch.setattr(sliced, "SMALL_KEYS", 10)
    monkeypatch.setattr(sliced, "TASK_ROWS", 20)  # 20 tasks, more than the session's 8
    whole = both()
    assert [w[1] for w in whole] == [c[1] for c in cut]
    assert [[f.dataType for f in w[0]] for w in whole] == [[f.dataType for f in c[0]] for c in cut]
    assert sliced._whole(df, ["k"]).rdd.getNumPartitions() == 20 and sliced._whole(df.withColumn("k", F.lit(1)), ["k"]) is None
