"""Gates between staging and publishing, batch ledgers, folded slices, statements, and streams with late rows."""

import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from lakeops.operators import cdc, publish, recon, temporal
from lakeops.plans import fleet
from lakeops.streaming import feeds
from tests.conftest import rows

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "id int, day int, v int, ver int"


def files_of(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, fs in os.walk(path) for f in fs if f.endswith(".parquet")}


def test_a_failing_gate_leaves_the_table_alone(spark, tmp_path):
    path = str(tmp_path / "t")
    good = spark.createDataFrame([(1, 1, 10, 1), (2, 1, 20, 1), (3, 2, 30, 1)], SCHEMA)
    publish.publish(good, path, ["day"], {"positive": F.col("v") > 0}, ["id"])
    before = files_of(path)
    bad = spark.createDataFrame([(1, 1, -5, 2), (9, 2, None, 2), (9, 2, 1, 2)], SCHEMA)
    with pytest.raises(publish.GateError, match="positive: 2") as told:
        publish.publish(bad, path, ["day"], {"positive": F.col("v") > 0}, ["id"])
    assert "unique: 1" in str(told.value)
    with pytest.raises(publish.GateError, match="least_rows"):
        publish.publish(good.limit(0), path, ["day"])
    with pytest.raises(publish.GateError, match="unique"):
        publish.upsert_slices(bad.unionByName(bad), path, ["id"], "day", "ver")
    with pytest.raises(publish.GateError, match="positive"):
        publish.upsert_slices(bad.limit(1), path, ["id"], "day", "ver", {"positive": F.col("v") > 0})
    assert files_of(path) == before and rows(spark.read.parquet(path).select(*good.columns)) == rows(good)


def test_upserts_touch_their_slices_only_and_twice_is_once(spark, tmp_path):
    path = str(tmp_path / "t")
    publish.publish(spark.createDataFrame([(1, 1, 10, 5), (2, 1, 20, 5), (3, 2, 30, 5), (4, 3, 40, 5)], SCHEMA), path, ["day"])
    before = files_of(path)
    late = spark.createDataFrame([(1, 1, 11, 6), (2, 1, 99, 4), (5, 2, 50, 1)], SCHEMA)
    want = [(1, 1, 11, 6), (2, 1, 20, 5), (3, 2, 30, 5), (4, 3, 40, 5), (5, 2, 50, 1)]
    for _ in range(2):
        publish.upsert_slices(late, path, ["id"], "day", "ver")
        assert rows(spark.read.parquet(path).select("id", "day", "v", "ver")) == want
    same = {f for f, at in files_of(path).items() if before.get(f) == at}
    assert same == {f for f in before if "day=3" in f}


def change_log(seed):
    rnd = random.Random(seed)
    return [(rnd.choice([1, 1, 1, 2, 3, 4, None]), rnd.randrange(6), rnd.randrange(40), rnd.randrange(1000), rnd.choice("ccuud")) for _ in range(60)]


@pytest.mark.parametrize("options", [{}, {"deleted": None}, {"guard_deletes": True}, {"guard_updates": False}, {"update_cols": ["v"]}])
@pytest.mark.parametrize("seed", [1, 2])
def test_folded_slices_equal_merge_after_merge(spark, seed, options):
    log = spark.createDataFrame([(k, s, n, v, v % 7, op) for k, s, n, v, op in change_log(seed)], "k int, s int, ver int, v int, w int, op string").where("k is not null")
    start = spark.createDataFrame([(1, 20, 5, 5, False), (4, 1, 6, 6, False), (9, 3, 7, 7, False)], "k int, ver int, v int, w int, is_deleted boolean")
    hard = "deleted" in options
    start = start.drop("is_deleted") if hard else start
    for target in (None, start):
        empty = start.limit(0) if target is None else target
        want = cdc.run_slices(empty, range(6), lambda s: log.where(F.col("s") == s).drop("s"), ["k"], ["ver", "v"], version="ver", **options)
        got = cdc.fold_slices(log, ["k"], "s", ["ver", "v"], version="ver", target=target, **options)
        assert rows(got.select(*want.columns)) == rows(want)


def test_null_keys_stay_apart(spark):
    log = spark.createDataFrame([(None, 1, 1, "c"), (None, 2, 2, "u"), (None, 3, 3, "d"), (5, 1, 1, "c")], "k int, s int, ver int, op string")
    empty = log.drop("op", "s").withColumn("is_deleted", F.lit(False)).limit(0)
    want = cdc.run_slices(empty, range(1, 4), lambda s: log.where(F.col("s") == s).drop("s"), ["k"], ["ver"], version="ver")
    assert rows(cdc.fold_slices(log, ["k"], "s", ["ver"], version="ver").select(*want.columns)) == rows(want)


def test_one_scan_of_the_log_however_many_slices(spark, tmp_path):
    path = str(tmp_path / "log")
    spark.range(3000).select((F.col("id") % 50).alias("k"), (F.col("id") % 365).alias("s"), F.col("id").alias("ver"), F.lit("u").alias("op")).write.parquet(path)
    got = cdc.fold_slices(spark.read.parquet(path), ["k"], "s", ["ver"], version="ver")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and plan.count("WindowGroupLimit") == 2 and got.count() == 50


def delivered(spark, *batches):
    return [spark.createDataFrame([(i, k, T0 + dt.timedelta(hours=h), v, op) for i, k, h, v, op in b], "id int, k string, ts timestamp, v int, op string") for b in batches]


def test_a_repeated_batch_changes_nothing(spark, tmp_path):
    path = str(tmp_path / "state")
    names = [f"k{i}" for i in range(40)]
    batches = delivered(spark, [(i, k, 0, i, "u") for i, k in enumerate(names)], [(100, "k3", 2, 0, "d"), (101, "k4", 2, 77, "u"), (102, "new", 2, 9, "u")], [(103, "k5", -1, 1, "u")])
    apply = feeds.upsert_partitions(path, ["k"], ["ts", "id"], "ts", "op", buckets=16)
    feeds.run_deliveries(batches, apply)
    schema = feeds.state_schema(batches[0].schema, "op")
    now = lambda: {r.k: (r.v, r.is_deleted) for r in feeds.read_state(spark, path, schema).collect()}
    want = {k: (i, False) for i, k in enumerate(names)} | {"k3": (3, True), "k4": (77, False), "new": (9, False)}
    assert now() == want and feeds.applied_batches(spark, path).count() == 3
    before = files_of(path)
    for i, b in enumerate(batches):
        apply(b, i)  # in the ledger: not even read
    assert files_of(path) == before
    apply(batches[1], 7)  # swapped in, but lost before it was noted: merged again, to the same rows
    assert now() == want
    changed = {f.split("_bucket=")[1].split("/")[0] for f in set(files_of(path)) - set(before) if "_bucket=" in f}
    hit = {str(r[0]) for r in batches[1].select(F.pmod(F.xxhash64("k"), F.lit(16))).collect()}
    assert changed == hit and len(hit) < 16


def test_late_rows_are_dropped_and_counted(spark):
    batches = delivered(spark, [(1, "a", 0, 1, "u"), (2, "a", 20, 1, "u")], [(3, "a", 30, 1, "u"), (4, "a", 1, 100, "u"), (5, "a", 15, 5, "u")], [(6, "a", 25, 10, "u"), (7, "a", 2, 100, "u"), (8, "a", 3, 100, "u")])
    got, n = feeds.run_arrivals(batches, "ts", lambda s: feeds.tumbling(s, "ts", ["k"], "1 hour", {"s": F.sum("v"), "n": F.count(F.lit(1))}), "late-test")
    told = {int((r.window_start - T0).total_seconds() // 3600): r.s for r in got.collect()}
    assert told == {0: 1, 15: 5, 20: 1, 25: 10, 30: 1}  # hour 30 has been closed by the last call
    assert n == 8 and n - got.agg(F.sum("n")).first()[0] == 3


def test_closed_streams_hold_every_row(spark, tmp_path):
    df = delivered(spark, [(i, "ab"[i % 2], i * 3, i, "u") for i in range(30)])[0]
    df.write.parquet(str(tmp_path / "feed.parquet"))
    stream = feeds.read_table_stream(spark, str(tmp_path), "feed")
    got = feeds.run_closed(stream, "ts", lambda s: feeds.tumbling(s, "ts", ["k"], "1 day", {"n": F.count(F.lit(1))}), "closed-test")
    want = df.groupBy(F.date_trunc("day", "ts").alias("window_start"), "k").agg(F.count(F.lit(1)).alias("n"))
    assert rows(got.select("window_start", "k", "n")) == rows(want)
    ended = feeds.run_closed(feeds.read_table_stream(spark, str(tmp_path), "feed"), "ts", lambda s: feeds.sessions(s, "k", "ts", "4 hours"), "closed-sessions")
    assert ended.agg(F.sum("events")).first()[0] == 30 and ended.count() == 30


def statement_rows(spark, days, bump=0):
    return spark.createDataFrame([(p, dt.date(2024, 2, d), 10, 9, 5.0 + bump * (d == 3), 4.0) for d in days for p in ("x", "y")],
                                 "partner string, day date, total_legs long, matched_legs long, our_charge double, their_charge double").withColumns(
        {c: F.col(c).cast("decimal(18,2)") for c in ("our_charge", "their_charge")}).withColumn("variance", F.col("our_charge") - F.col("their_charge"))


def test_a_partial_month_is_refused(spark):
    got = recon.settlement(statement_rows(spark, range(1, 29)), "partner", "day").collect()  # 2024 is a leap year
    assert [(r.partner, r.status, r.days_present, r.we_billed) for r in got] == [(None, "REFUSED", 28, None)]
    whole = recon.settlement(statement_rows(spark, range(1, 30)), "partner", "day").collect()
    assert [(r.partner, r.status, r.days_present, float(r.net_variance), r.settlement_direction) for r in sorted(whole, key=lambda r: r.partner)] == [
        ("x", "ISSUED", 29, 29.0, "PARTNER_OWES_US"), ("y", "ISSUED", 29, 29.0, "PARTNER_OWES_US")]


def test_statement_digests(spark):
    digests = lambda df: {(r.statement_digest, r.source_digest) for r in recon.settlement(df, "partner", "day").collect()}
    base = statement_rows(spark, range(1, 30))
    assert len(digests(base)) == 1 and digests(base.repartition(7).orderBy(F.desc("day"))) == digests(base)
    (a, b), (c, d) = digests(base).pop(), digests(statement_rows(spark, range(1, 30), bump=1)).pop()
    assert a != c and b != d
    moved = base.withColumn("total_legs", F.col("total_legs") + F.when(F.dayofmonth("day") == 1, 1).when(F.dayofmonth("day") == 2, -1).otherwise(0))
    (e, f) = digests(moved).pop()
    assert e == a and f != b  # the sums agree, the source does not


def test_boxes_of_runs(spark):
    path = [(0, 9.0, 1.0, 5.0), (20, 9.5, -3.0, 7.0), (40, 8.5, 2.0, 6.0), (60, 1.0, 50.0, 50.0), (80, 9.0, 0.0, 0.0), (200, 9.0, 4.0, -4.0)]
    df = spark.createDataFrame([("s", T0 + dt.timedelta(minutes=m), v, a, b) for m, v, a, b in path] + [("s", T0 + dt.timedelta(minutes=30), 9.0, None, None)], "s string, ts timestamp, v double, lat double, lon double")
    got = fleet.breaches(df.withColumns({"lo": F.lit(0.0), "hi": F.lit(5.0)}), "s", "ts", "v", "lo", "hi", box=["lat", "lon"])
    box = got.select("breach_start", "min_value", "max_value", "bbox_lat_min", "bbox_lat_max", "bbox_lon_min", "bbox_lon_max", "readings")
    assert rows(box) == [(T0, 8.5, 9.5, -3.0, 2.0, 5.0, 7.0, 4), (T0 + dt.timedelta(minutes=80), 9.0, 9.0, 0.0, 4.0, -4.0, 0.0, 2)]
    assert sorted(temporal.envelope("lat", prefix="p")) == ["p_lat_max", "p_lat_min"]
