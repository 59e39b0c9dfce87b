import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from lakeops.functions import columns
from lakeops.operators import temporal
from lakeops.plans import fleet
from tests.conftest import rows

START = dt.datetime(2024, 1, 1)


def at(minutes):
    return START + dt.timedelta(minutes=minutes)


def test_sessions_split_after_the_gap(spark):
    df = spark.createDataFrame([("u", at(m)) for m in (0, 30, 60.02, 60.03, 2000)], "u string, ts timestamp")
    got = [r.session_no for r in temporal.sessionize(df, "u", "ts", 1800).orderBy("ts").collect()]
    assert got == [1, 1, 2, 2, 3]


def test_overlap_count_against_pairs(spark):
    rnd = random.Random(11)
    data = []
    for m in range(40):
        x = rnd.randint(0, 20)
        for _ in range(rnd.randint(1, 6)):
            e = x + rnd.randint(1, 30)
            data.append(("g0" if m < 25 else "g1", m, x, e))
            x = e + rnd.randint(0, 15)
    df = spark.createDataFrame(data, "g string, m int, s long, e long")
    got = {(r.m, r.s): r.others for r in temporal.overlap_count(df, "g", "m", "s", "e", width=16).collect()}
    for g, m, s, e in data:
        want = {o for (h, o, a, b) in data if h == g and o != m and a < e and b > s}
        assert got[(m, s)] == len(want)


@pytest.mark.parametrize("end", [8, 9, 1 << 21])
def test_overlap_count_across_powers_of_two(spark, end):
    """Two gaps of one member inside a stretch that runs over a power of two: that member is counted once."""
    data = [("g", 1, 0, 1), ("g", 1, 3, 4), ("g", 1, end - 1, end), ("g", 2, 0, end), ("g", 3, end, end + 2)]
    df = spark.createDataFrame(data, "g string, m int, s long, e long")
    got = {(r.m, r.s): r.others for r in temporal.overlap_count(df, "g", "m", "s", "e").collect()}
    assert got[(2, 0)] == 1 and got[(3, end)] == 0 and got[(1, 0)] == 1
    with pytest.raises(ValueError, match="begin at 0"):
        temporal.overlap_count(spark.createDataFrame([("g", 1, -3, 2)], df.schema), "g", "m", "s", "e")


def test_runs_break_on_a_long_step(spark):
    df = spark.createDataFrame([("k", at(m), m not in (20, 25)) for m in (0, 5, 10, 15, 20, 25, 30, 35, 300, 305)], "k string, ts timestamp, on boolean")
    joined = temporal.runs(df, ["k"], "ts", "on")
    assert joined.select("run_id").distinct().count() == 2
    split = temporal.runs(df, ["k"], "ts", "on", max_step_seconds=3600)
    assert split.select("run_id").distinct().count() == 3


def test_intervals_ignore_noise_and_stay_open(spark):
    df = spark.createDataFrame([("p", at(i), v) for i, v in enumerate([1.0, 1.005, 2.0, 2.0, 1.0])], "p string, ts timestamp, v double")
    got = temporal.derive_intervals(df, "p", "ts", "v", 0.01).orderBy("effective_start").collect()
    assert [(r.v, r.prev_value, r.effective_end) for r in got] == [(1.0, None, at(2)), (2.0, 1.0, at(4)), (1.0, 2.0, None)]


def test_resample_never_carries_past_the_limit(spark):
    df = spark.createDataFrame([("k", at(10), 5.0), ("k", at(50), 7.0), ("k", at(60 * 6 + 1), 9.0)], "k string, ts timestamp, v double")
    got = [(r.source, r.final) for r in temporal.resample(df, ["k"], "ts", "v", 2 * 3600).orderBy("bucket").collect()]
    assert got == [("observed", 6.0), ("carried", 7.0), ("carried", 7.0), ("gap", None), ("gap", None), ("gap", None), ("observed", 9.0)]


def test_despike_needs_both_neighbours(spark):
    df = spark.createDataFrame([("k", at(i), v) for i, v in enumerate([20.0, 5.0, 30.0, 5.5, 5.0, 14.0, 15.0])], "k string, ts timestamp, v double")
    got = temporal.despike(df, ["k"], "ts", "v").orderBy("ts").collect()
    assert [r.is_spike for r in got] == [False, False, True, False, False, False, False]
    assert got[2].v == 5.25 and got[2].v_raw == 30.0


@pytest.mark.parametrize("minutes,count,severity", [(29, 0, None), (35, 1, "MEDIUM"), (61, 1, "HIGH"), (121, 1, "CRITICAL")])
def test_breach_length_and_severity(spark, minutes, count, severity):
    df = spark.createDataFrame([("s", at(m), 9.0 if 10 <= m <= 10 + minutes else 5.0, 2.0, 8.0) for m in range(0, 200)],
                               "s string, ts timestamp, t double, lo double, hi double")
    got = fleet.breaches(df, "s", "ts", "t", "lo", "hi").collect()
    assert len(got) == count and (not count or got[0].severity == severity)


def test_outages_start_with_the_meter_and_cluster(spark):
    """Six meters silent together are a cluster, two silent slots are none, a late meter is not silent before it starts."""
    data = []
    for m in range(6):
        data += [(m, "b", s) for s in range(0, 20) if not 5 <= s <= 8]
    data += [(6, "b", s) for s in range(0, 20) if s not in (2, 3)] + [(7, "b", s) for s in range(12, 20)]
    data += [(8, "c", s) for s in range(0, 20) if not 5 <= s <= 7]
    df = spark.createDataFrame([(m, b, s * 1800) for m, b, s in data], "m int, b string, slot long")
    got = {r.m: r for r in fleet.outages(df, "m", "b", "slot", 1800, 30).collect()}
    assert set(got) == {0, 1, 2, 3, 4, 5, 8}
    assert got[0].concurrent_meters == 5 and got[0].classification == "CLUSTERED" and got[0].duration_min == 120
    assert got[8].concurrent_meters == 0 and got[8].classification == "ISOLATED"


def test_grid_and_reading_expressions(spark):
    df = spark.sql("SELECT * FROM VALUES ('Null'), (''), (' 0 '), ('-1'), ('0.5'), ('x') AS (raw)")
    got = df.select("raw", columns.reading("raw").alias("v")).withColumn("s", columns.reading_status("v")).collect()
    assert {r.raw: r.s for r in got} == {"Null": "MISSING", "": "MISSING", " 0 ": "ZERO", "-1": "NEGATIVE", "0.5": "OK", "x": "MISSING"}
    snapped = spark.sql("SELECT timestamp'2024-01-01 10:31:05' AS ts").select(columns.snap("ts", 1800).alias("s")).first().s
    assert snapped == dt.datetime(2024, 1, 1, 10, 30)
    gps = spark.sql("SELECT * FROM VALUES (1, 0.0D, 0.0D), (2, 52.0D, 13.0D), (3, null, 1.0D), (4, 95.0D, 1.0D) AS (id, a, b)")
    assert rows(gps.select("id", columns.gps_valid("a", "b"))) == [(1, False), (2, True), (3, False), (4, False)]


def test_lead_features_skip_gaps(spark):
    hourly = spark.createDataFrame([("s", at(60 * h), v) for h, v in enumerate([90.0, None, 140.0, 80.0, 150.0])], "k string, bucket timestamp, hr double")
    anchors = spark.createDataFrame([("s", at(300))], "k string, event_ts timestamp")
    got = temporal.lead_features(hourly, anchors, "k", "bucket", "event_ts", 6, {"hr": (F.col("hr") < 40) | (F.col("hr") > 130)}).first()
    assert (got.earliest_lead_h, got.first_signal, got.breach_hours) == (3.0, "hr", 2)


def test_lead_features_of_every_event(spark):
    """Several events of one subject, each with its own look-back; no join on the subject alone."""
    hourly = spark.createDataFrame([("s", at(60 * h), 200.0 if h % 5 == 0 else 80.0) for h in range(60)], "k string, bucket timestamp, hr double")
    minutes = [30, 601, 601, 1200, 2405, 9000]
    anchors = spark.createDataFrame([("s", at(m)) for m in minutes] + [("t", at(5))], "k string, event_ts timestamp")
    got = temporal.lead_features(hourly, anchors, "k", "bucket", "event_ts", 12, {"hr": F.col("hr") > 130})
    want = {}
    for m in set(minutes):
        leads = [(m - 60 * h) / 60 for h in range(0, 60, 5) if 60 * h <= m and 60 * h >= m - 720]
        if leads:
            want[at(m)] = (round(max(leads), 6), len(leads))
    assert {r.event_ts: (round(r.earliest_lead_h, 6), r.breach_hours) for r in got.collect()} == want
