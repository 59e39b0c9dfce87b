"""Time series, temporal joins, clickstream, meter, vitals and fleet reports over the input tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeops.catalog.registry import Tables, query
from lakeops.functions.columns import fahrenheit_to_celsius, gps_valid, money, reading, reading_status, snap
from lakeops.operators import joins, sliced, temporal
from lakeops.operators.privacy import suppress_small
from lakeops.operators.quality import precision_recall
from lakeops.plans import clickstream, fleet
from lakeops.session import materialised


def near(col: str, digits: int):
    """Rounded for comparison, nudged off exact ties, which two engines may round either way."""
    return F.round(F.col(col) + 1e-9, digits).alias(col)


W = "(PARTITION BY user_id ORDER BY ts, event_id)"
SESSIONS = f"""g AS (SELECT *, CASE WHEN lag(ts) OVER {W} IS NULL OR ts - lag(ts) OVER {W} > INTERVAL 6 HOUR THEN 1 ELSE 0 END AS st FROM events),
  s AS (SELECT *, CAST(sum(st) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session_no FROM g)"""


def _sessions(t: Tables) -> DataFrame:
    return temporal.sessionize(t.events, "user_id", "ts", 6 * 3600, tie=["event_id"])


@query(f"WITH {SESSIONS} SELECT event_id, user_id, session_no, user_id || '#' || session_no AS session_key FROM s")
def sessionize(t: Tables):
    return _sessions(t).select("event_id", "user_id", "session_no", "session_key")


@query(f"""WITH {SESSIONS} SELECT user_id, session_no, min(ts) AS started, max(ts) AS ended, count(*) AS events,
  (epoch_us(max(ts)) - epoch_us(min(ts))) / 1000000.0 AS seconds FROM s GROUP BY ALL""")
def session_stats(t: Tables):
    return temporal.session_stats(_sessions(t), "user_id", "ts")


@query(f"""WITH {SESSIONS} SELECT user_id, count(DISTINCT session_no) AS own_sessions, count(DISTINCT CAST(ts AS DATE)) AS source_sessions,
  count(DISTINCT session_no) <> count(DISTINCT CAST(ts AS DATE)) AS disagree FROM s GROUP BY user_id""")
def session_disagreement(t: Tables):
    got = _sessions(t).groupBy("user_id").agg(F.countDistinct("session_no").alias("own_sessions"),
                                              F.countDistinct(F.to_date("ts")).alias("source_sessions"))
    return got.withColumn("disagree", F.col("own_sessions") != F.col("source_sessions"))


@query("""SELECT event_id, user_id, round(CAST(sum(CAST(value AS DECIMAL(12,2))) OVER w AS DOUBLE), 2) AS spent, count(*) OVER w AS n
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 15 MINUTE PRECEDING AND CURRENT ROW)""")
def rolling_sum(t: Tables):
    e = t.events.select("event_id", "user_id", "ts", "value")
    got = sliced.rolling(e, ["user_id"], "ts", 900, {"spent": F.sum(money("value")), "n": F.count(F.lit(1))})
    return got.select("event_id", "user_id", F.round(F.col("spent").cast("double"), 2).alias("spent"), "n")


RUNS = f"""f AS (SELECT *, value > 50 AS hot, lag(value > 50) OVER {W} AS was, lag(ts) OVER {W} AS pts FROM events),
  r AS (SELECT *, sum(CASE WHEN was IS NULL OR was <> hot OR ts - pts > INTERVAL 2 DAY THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run_id FROM f)"""


@query(f"WITH {RUNS} SELECT user_id, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n FROM r WHERE hot GROUP BY user_id, run_id")
def runs_above(t: Tables):
    marked = t.events.withColumn("hot", F.col("value") > 50)
    got = temporal.runs(marked, ["user_id"], "ts", "hot", max_step_seconds=2 * sliced.DAY, tie=["event_id"])
    return got.groupBy("user_id", "run_id").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"),
                                                F.count(F.lit(1)).alias("n")).drop("run_id")


@query(f"""WITH b AS (SELECT *, value < 5 OR value > 60 AS bad FROM events),
  f AS (SELECT *, lag(bad) OVER {W} AS was FROM b),
  r AS (SELECT *, sum(CASE WHEN was IS NULL OR was <> bad THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run_id FROM f),
  g AS (SELECT user_id, min(ts) AS breach_start, max(ts) AS breach_end, min(value) AS min_value, max(value) AS max_value, count(*) AS readings,
    min(event_id % 181 - 90) AS bbox_lat_min, max(event_id % 181 - 90) AS bbox_lat_max, min(event_id * 7 % 361 - 180) AS bbox_lon_min, max(event_id * 7 % 361 - 180) AS bbox_lon_max,
    round(avg(event_id), 4) AS mean_event, (epoch_us(max(ts)) - epoch_us(min(ts))) / 60000000.0 AS duration_min FROM r WHERE bad GROUP BY user_id, run_id)
  SELECT *, CASE WHEN duration_min > 120 THEN 'CRITICAL' WHEN duration_min > 60 THEN 'HIGH' ELSE 'MEDIUM' END AS severity FROM g WHERE duration_min > 30""")
def breach_runs(t: Tables):
    """Stretches out of range with their extremes and the box of places in which they happened."""
    e = t.events.withColumns({"lo": F.lit(5.0), "hi": F.lit(60.0), "lat": F.col("event_id") % 181 - 90, "lon": F.col("event_id") * 7 % 361 - 180})
    return fleet.breaches(e, "user_id", "ts", "value", "lo", "hi", tie=["event_id"], box=["lat", "lon"],
                          carry={"mean_event": F.round(F.avg("event_id"), 4)}).drop("run_id")


PRICES = """p AS (SELECT l_partkey, l_shipdate, max(l_extendedprice) AS price FROM lineitem WHERE l_returnflag <> 'R' GROUP BY ALL),
  c AS (SELECT *, lag(price) OVER (PARTITION BY l_partkey ORDER BY l_shipdate) AS was FROM p),
  m AS (SELECT * FROM c WHERE was IS NULL OR abs(price - was) > 0.01),
  iv AS (SELECT l_partkey, price, lag(price) OVER w AS prev_value, l_shipdate AS effective_start, lead(l_shipdate) OVER w AS effective_end
    FROM m WINDOW w AS (PARTITION BY l_partkey ORDER BY l_shipdate))"""


def _prices(t: Tables) -> DataFrame:
    daily = t.lineitem.where("l_returnflag <> 'R'").groupBy("l_partkey", "l_shipdate").agg(
        F.max("l_extendedprice").alias("price"))
    return temporal.derive_intervals(daily, "l_partkey", "l_shipdate", "price", 0.01, 365 * sliced.DAY)


def _points(t: Tables) -> DataFrame:
    return t.lineitem.where("l_returnflag = 'R'").select("l_orderkey", "l_linenumber", "l_partkey", "l_shipdate")


@query(f"WITH {PRICES} SELECT * FROM iv")
def price_intervals(t: Tables):
    return _prices(t)


@query(f"""WITH {PRICES} SELECT l_partkey, effective_start, price, round((price - prev_value) / prev_value, 8) AS pct_change
  FROM iv WHERE abs(round((price - prev_value) / prev_value, 8)) > 0.15""")
def price_changes(t: Tables):
    return clickstream.price_changes(_prices(t), "price").select("l_partkey", "effective_start", "price", "pct_change")


@query(f"""WITH {PRICES}, pt AS (SELECT l_orderkey, l_linenumber, l_partkey, l_shipdate FROM lineitem WHERE l_returnflag = 'R')
  SELECT l_orderkey, l_linenumber, pt.l_partkey, pt.l_shipdate, price FROM pt ASOF LEFT JOIN iv
  ON pt.l_partkey = iv.l_partkey AND pt.l_shipdate >= iv.effective_start""")
def asof_price(t: Tables):
    return joins.asof_join(_points(t), _prices(t), ["l_partkey"], "l_shipdate", "effective_start", ["price"],
                           slice_seconds=365 * sliced.DAY)


@query(f"""WITH {PRICES}, pt AS (SELECT l_orderkey, l_linenumber, l_partkey, l_shipdate FROM lineitem WHERE l_returnflag = 'R')
  SELECT l_orderkey, l_linenumber, pt.l_partkey, CASE WHEN pt.l_shipdate <= iv.effective_start + INTERVAL 30 DAY THEN price END AS price
  FROM pt ASOF LEFT JOIN iv ON pt.l_partkey = iv.l_partkey AND pt.l_shipdate >= iv.effective_start""")
def asof_price_tolerance(t: Tables):
    return joins.asof_join(_points(t), _prices(t), ["l_partkey"], "l_shipdate", "effective_start", ["price"],
                           tolerance_seconds=30 * sliced.DAY, slice_seconds=365 * sliced.DAY).drop("l_shipdate")


RANGE = f"""WITH {PRICES}, pt AS (SELECT l_orderkey, l_linenumber, l_partkey, l_shipdate FROM lineitem WHERE l_returnflag = 'R')
  SELECT l_orderkey, l_linenumber, pt.l_partkey, price, effective_start FROM pt JOIN iv ON pt.l_partkey = iv.l_partkey
  AND pt.l_shipdate >= effective_start AND (effective_end IS NULL OR pt.l_shipdate < effective_end)"""


@query(RANGE)
def range_join_plain(t: Tables):
    return joins.range_join(_points(t), _prices(t), ["l_partkey"], "l_shipdate", "effective_start",
                            "effective_end").select("l_orderkey", "l_linenumber", "l_partkey", "price", "effective_start")


@query(RANGE)
def range_join_search(t: Tables):
    """The prices of a part as one sorted array, searched for every point."""
    got = joins.range_join_search(_points(t), _prices(t), ["l_partkey"], "l_shipdate", "effective_start", "effective_end", ["price"])
    return got.select("l_orderkey", "l_linenumber", "l_partkey", "price", "effective_start")


@query(RANGE)
def range_join_grid(t: Tables):
    got = joins.range_join_grid(_points(t), _prices(t), ["l_partkey"], "l_shipdate", "effective_start",
                                "effective_end", 90 * sliced.DAY)
    return got.select("l_orderkey", "l_linenumber", "l_partkey", "price", "effective_start")


@query("""SELECT b.event_id, a.event_id AS anchor_id FROM events b JOIN events a ON a.user_id = b.user_id AND a.event_type = 'error'
  AND b.event_type = 'purchase' AND b.ts >= a.ts - INTERVAL 30 MINUTE AND b.ts < a.ts + INTERVAL 2 HOUR""")
def near_events(t: Tables):
    anchors = t.events.where("event_type = 'error'").select("user_id", F.col("event_id").alias("anchor_id"),
                                                            F.col("ts").alias("anchor_ts"))
    bought = t.events.where("event_type = 'purchase'").select("user_id", "event_id", "ts")
    return joins.near_events(bought, anchors, ["user_id"], "ts", "anchor_ts", 1_800, 7_200).select("event_id", "anchor_id")


@query("""WITH h AS (SELECT date_trunc('hour', ts) AS hour, avg(value) AS outside FROM events WHERE event_type = 'signup' GROUP BY 1)
  SELECT event_id, round(outside + 1e-9, 6) AS outside FROM events LEFT JOIN h ON date_trunc('hour', ts) = hour""")
def coarse_grain_join(t: Tables):
    """Readings joined to a series of coarser grain by the truncated hour."""
    e = t.events.withColumn("hour", F.date_trunc("hour", "ts"))
    hourly = e.where("event_type = 'signup'").groupBy("hour").agg(F.avg("value").alias("outside"))
    return e.join(hourly, "hour", "left").select("event_id", near("outside", 6))


# ---------------------------------------------------------------- grids and gaps

SLOTS = """sl AS (SELECT DISTINCT user_id, c_nationkey AS block, epoch_us(ts) // 21600000000 * 21600 AS slot FROM events JOIN customer ON user_id = c_custkey),
  b AS (SELECT user_id, block, min(slot) AS a, max(slot) AS z FROM sl GROUP BY ALL),
  g AS (SELECT user_id, block, unnest(range(a, z + 1, 21600)) AS slot FROM b),
  q AS (SELECT g.* FROM g ANTI JOIN sl ON g.user_id = sl.user_id AND g.block = sl.block AND g.slot = sl.slot)"""
OUTAGES = SLOTS + """, f AS (SELECT *, CASE WHEN slot - lag(slot) OVER (PARTITION BY user_id, block ORDER BY slot) > 21600 OR
    lag(slot) OVER (PARTITION BY user_id, block ORDER BY slot) IS NULL THEN 1 ELSE 0 END AS st FROM q),
  n AS (SELECT *, sum(st) OVER (PARTITION BY user_id, block ORDER BY slot ROWS UNBOUNDED PRECEDING) AS run_id FROM f),
  o AS (SELECT user_id, block, run_id, min(slot) AS first_slot, max(slot) AS last_slot, count(*) AS slots FROM n GROUP BY ALL HAVING count(*) >= 3),
  k AS (SELECT a.user_id, a.block, a.run_id, count(DISTINCT b.user_id) AS c FROM o a JOIN o b ON a.block = b.block AND a.user_id <> b.user_id
    AND b.first_slot <= a.last_slot AND b.last_slot >= a.first_slot GROUP BY ALL),
  ev AS (SELECT o.user_id, o.block, first_slot, last_slot, slots, slots * 360 AS duration_min, coalesce(c, 0) AS concurrent_meters,
    CASE WHEN coalesce(c, 0) >= 5 THEN 'CLUSTERED' ELSE 'ISOLATED' END AS classification
    FROM o LEFT JOIN k ON o.user_id = k.user_id AND o.block = k.block AND o.run_id = k.run_id)"""


def _slots(t: Tables) -> DataFrame:
    who = t.customer.select(F.col("c_custkey").alias("user_id"), F.col("c_nationkey").alias("block"))
    return (t.events.select("user_id", (F.floor(F.unix_seconds("ts") / 21600) * 21600).alias("slot")).distinct()
            .join(who, "user_id"))


def _outages(t: Tables) -> DataFrame:
    return fleet.outages(_slots(t), "user_id", "block", "slot", 21600, 360)


@query(f"WITH {SLOTS} SELECT user_id, block, slot FROM q")
def missing_slots(t: Tables):
    return temporal.missing_slots(_slots(t), ["user_id", "block"], "slot", 21600)


@query(f"WITH {OUTAGES} SELECT * FROM ev")
def outage_events(t: Tables):
    return _outages(t).drop("run_id")


@query(f"""WITH {OUTAGES} SELECT block, classification, count(*) AS events, CAST(sum(duration_min) AS BIGINT) AS total_minutes,
  max(concurrent_meters) AS largest_cluster FROM ev
  WHERE last_slot >= (SELECT epoch_us(max(ts)) // 1000000 - 7 * 86400 FROM events) GROUP BY ALL""")
def outage_mart(t: Tables):
    since = t.events.agg(F.unix_seconds(F.max("ts")) - 7 * 86400).scalar()
    return fleet.outage_mart(_outages(t), "block", since)


@query(f"""WITH {OUTAGES} SELECT user_id, first_slot, concurrent_meters FROM ev""")
def overlap_blocks(t: Tables):
    return _outages(t).select("user_id", "first_slot", "concurrent_meters")


@query(f"""WITH g AS (SELECT user_id, (epoch_us(ts) - epoch_us(lag(ts) OVER {W})) / 1000000.0 AS gap FROM events)
  SELECT user_id, round(quantile_cont(gap, 0.5) + 1e-9, 4) AS median_gap, round(quantile_cont(gap, 0.95) + 1e-9, 4) AS p95_gap FROM g WHERE gap IS NOT NULL GROUP BY 1""")
def gap_stats(t: Tables):
    got = temporal.gap_stats(t.events.select("user_id", "ts", "event_id"), ["user_id"], "ts", ["event_id"])
    return got.select("user_id", near("median_gap", 4), near("p95_gap", 4))


RESAMPLED = """h AS (SELECT user_id, date_trunc('hour', ts) AS bucket, avg(value) AS mean, count(value) AS obs, arg_max(value, (ts, value)) AS lv, max(ts) AS lt
    FROM events GROUP BY 1, 2),
  b AS (SELECT user_id, min(bucket) AS a, max(bucket) AS z FROM h GROUP BY 1),
  g AS (SELECT user_id, unnest(generate_series(a, z, INTERVAL 1 HOUR)) AS bucket FROM b),
  j AS (SELECT g.user_id, g.bucket, mean, coalesce(obs, 0) AS obs, last_value(lv IGNORE NULLS) OVER w AS cv, last_value(lt IGNORE NULLS) OVER w AS ct
    FROM g LEFT JOIN h ON g.user_id = h.user_id AND g.bucket = h.bucket WINDOW w AS (PARTITION BY g.user_id ORDER BY g.bucket ROWS UNBOUNDED PRECEDING)),
  rs AS (SELECT user_id, bucket, obs, CASE WHEN obs > 0 THEN mean WHEN (epoch_us(bucket) - epoch_us(ct)) / 1000000.0 <= 14400 THEN cv END AS final FROM j)"""


@query(f"""WITH {RESAMPLED} SELECT user_id, bucket, obs, round(final + 1e-9, 6) AS final,
  CASE WHEN obs > 0 THEN 'observed' WHEN final IS NOT NULL THEN 'carried' ELSE 'gap' END AS source FROM rs""")
def resample_hourly(t: Tables):
    got = temporal.resample(t.events, ["user_id"], "ts", "value", 4 * 3600)
    return got.select("user_id", "bucket", "obs", near("final", 6), "source")


@query(f"""WITH {RESAMPLED}, k AS (SELECT user_id, CASE WHEN obs > 0 THEN 'observed' WHEN final IS NOT NULL THEN 'carried' ELSE 'gap' END AS source FROM rs)
  SELECT user_id, source, count(*) AS hours, round(count(*) / CAST(sum(count(*)) OVER (PARTITION BY user_id) AS DOUBLE), 6) AS share FROM k GROUP BY user_id, source""")
def completeness_shares(t: Tables):
    from pyspark.sql import Window
    got = temporal.resample(t.events, ["user_id"], "ts", "value", 4 * 3600).groupBy("user_id", "source").agg(
        F.count(F.lit(1)).alias("hours"))
    whole = F.sum("hours").over(Window.partitionBy("user_id"))  # three rows per series
    return got.withColumn("share", F.round(F.col("hours") / whole, 6))


@query("""SELECT user_id, date_trunc('hour', ts) AS bucket, count(*) FILTER (event_type <> 'error') AS ok_readings, count(*) AS readings,
  count(*) FILTER (event_type <> 'error') / 2.0 AS completeness FROM events GROUP BY 1, 2""")
def completeness(t: Tables):
    return temporal.completeness(t.events, ["user_id"], "ts", F.col("event_type") != "error", 2)


@query("""SELECT user_id, date_trunc('hour', ts) AS hour, CAST(sum(CAST(value AS DECIMAL(12,2))) AS DOUBLE) AS load,
  count(*) FILTER (value > 0) AS ok_intervals, count(*) AS total_intervals, count(*) FILTER (value > 0) / 2.0 AS completeness FROM events GROUP BY 1, 2""")
def load_hourly(t: Tables):
    ok = F.count_if(reading_status("value") == "OK")
    return t.events.groupBy("user_id", F.date_trunc("hour", "ts").alias("hour")).agg(
        F.sum(money("value")).cast("double").alias("load"), ok.alias("ok_intervals"),
        F.count(F.lit(1)).alias("total_intervals"), (ok / 2.0).alias("completeness"))


@query(f"""WITH n AS (SELECT *, lag(value) OVER {W} AS p, lead(value) OVER {W} AS nx FROM events),
  f AS (SELECT *, coalesce(abs(value - p) > 8 AND abs(value - nx) > 8 AND abs(p - nx) < 2, false) AS is_spike FROM n)
  SELECT event_id, is_spike, value AS value_raw, round(CASE WHEN is_spike THEN (p + nx) / 2 ELSE value END, 6) AS value FROM f""")
def despike(t: Tables):
    got = temporal.despike(t.events, ["user_id"], "ts", "value", tie=["event_id"])
    return got.select("event_id", "is_spike", "value_raw", F.round("value", 6).alias("value"))


@query(f"""WITH n AS (SELECT *, lag(value) OVER {W} AS p, lead(value) OVER {W} AS nx FROM events),
  f AS (SELECT event_id, coalesce(abs(value - p) > 8 AND abs(value - nx) > 8 AND abs(p - nx) < 2, false) AS s, value > 150 AS tr FROM n)
  SELECT count(*) FILTER (s AND tr) AS hits, count(*) FILTER (s AND NOT tr) AS false_alarms, count(*) FILTER (NOT s AND tr) AS misses,
  round(count(*) FILTER (s AND tr) / CAST(nullif(count(*) FILTER (s), 0) AS DOUBLE), 6) AS "precision",
  round(count(*) FILTER (s AND tr) / CAST(nullif(count(*) FILTER (tr), 0) AS DOUBLE), 6) AS recall FROM f""")
def spike_precision_recall(t: Tables):
    found = temporal.despike(t.events, ["user_id"], "ts", "value", tie=["event_id"]).where("is_spike")
    return precision_recall(found, t.events.where("value > 150"), ["event_id"])


@query("""SELECT event_id, make_timestamp(epoch_us(ts) // 1800000000 * 1800000000) AS slot,
  CAST(CAST(floor(epoch(ts)) AS BIGINT) % 1800 AS BIGINT) AS drift_s FROM events""")
def grid_snap(t: Tables):
    return t.events.select("event_id", snap("ts", 1800).alias("slot"),
                           (F.unix_seconds("ts") - F.unix_seconds(snap("ts", 1800))).alias("drift_s"))


@query("""WITH r AS (SELECT event_id, CASE event_type WHEN 'error' THEN 'Null' WHEN 'signup' THEN '' WHEN 'view' THEN '0' WHEN 'click' THEN '-' || value
  ELSE CAST(value AS VARCHAR) END AS raw FROM events), v AS (SELECT event_id, CASE WHEN lower(trim(raw)) IN ('', 'null') THEN NULL ELSE CAST(raw AS DOUBLE) END AS energy FROM r)
  SELECT event_id, energy, CASE WHEN energy IS NULL THEN 'MISSING' WHEN energy < 0 THEN 'NEGATIVE' WHEN energy = 0 THEN 'ZERO' ELSE 'OK' END AS status FROM v""")
def reading_states(t: Tables):
    kind = F.col("event_type")
    raw = (F.when(kind == "error", "Null").when(kind == "signup", "").when(kind == "view", "0")
           .when(kind == "click", F.concat(F.lit("-"), F.col("value").cast("string")))
           .otherwise(F.col("value").cast("string")))
    return (t.events.select("event_id", reading(raw).alias("energy"))
            .withColumn("status", reading_status("energy")))


@query("""WITH lim(event_type, lo, hi) AS (VALUES ('view', 1.0, 100.0), ('click', 0.5, 80.0), ('purchase', 5.0, 200.0))
  SELECT event_id, lo IS NULL OR value BETWEEN lo AND hi AS in_range FROM events LEFT JOIN lim USING (event_type)""")
def range_flags(t: Tables):
    limits = t.spark.sql("VALUES ('view', 1.0D, 100.0D), ('click', 0.5D, 80.0D), ('purchase', 5.0D, 200.0D) AS (event_type, lo, hi)")
    return (t.events.join(F.broadcast(limits), "event_type", "left")  # three rows
            .select("event_id", (F.col("lo").isNull() | F.col("value").between(F.col("lo"), F.col("hi"))).alias("in_range")))


@query("""SELECT event_id, abs(value - 50) <= 90 AND abs(user_id - 75.0) <= 180 AND NOT (abs(value - 50) < 0.001 AND abs(user_id - 75.0) < 0.001) AS ok,
  round(CASE WHEN event_type = 'view' THEN (value - 32) * 5 / 9 ELSE value END, 8) AS celsius FROM events""")
def unit_and_position(t: Tables):
    return t.events.select("event_id", gps_valid(F.col("value") - 50, F.col("user_id") - 75.0).alias("ok"),
                           F.round(fahrenheit_to_celsius("value", F.col("event_type") == "view"), 8).alias("celsius"))


MEASURES = ("view", "click", "purchase", "signup", "error")
WIDE = """w AS (SELECT user_id, date_trunc('hour', ts) AS hour, """ + ", ".join(
    f"""arg_min(value, (ts, event_id)) FILTER (event_type='{m}') AS "{m}\"""" for m in MEASURES) + " FROM events GROUP BY 1, 2), f AS (SELECT *, CAST(" + " + ".join(
    f'("{m}" IS NOT NULL)::INT' for m in MEASURES) + """ AS INTEGER) AS filled, (epoch_us(hour) - epoch_us(lag(hour) OVER (PARTITION BY user_id ORDER BY hour))) / 60000000.0 AS gap_minutes FROM w)"""


@query(f"WITH {WIDE} SELECT * FROM f")
def long_to_wide(t: Tables):
    """One row per series and hour, one column per measure, first reading wins; how many are filled, minutes since the row before."""
    return temporal.widen(t.events, ["user_id"], F.date_trunc("hour", "ts"), "hour", "event_type", "value", MEASURES, ["ts", "event_id"])


@query(f"""WITH {WIDE} SELECT k.least_filled, count(*) FILTER (filled >= k.least_filled) AS rows, round(count(*) FILTER (filled >= k.least_filled) / CAST(count(*) AS DOUBLE), 6) AS share,
  max(gap_minutes) FILTER (filled >= k.least_filled) AS longest_gap FROM f, (SELECT unnest([1, 3, 5]) AS least_filled) k GROUP BY 1""")
def wide_sparsity(t: Tables):
    """What share of the wide rows hold all measures, three, one."""
    wide = temporal.widen(t.events, ["user_id"], F.date_trunc("hour", "ts"), "hour", "event_type", "value", MEASURES, ["ts", "event_id"])
    return temporal.sparsity(wide, "filled", [1, 3, 5], "gap_minutes")


@query(f"""WITH {RESAMPLED}, an AS (SELECT DISTINCT user_id, ts AS anchor_ts FROM events WHERE event_type = 'error'),
  n AS (SELECT rs.user_id, anchor_ts, (CAST(floor(epoch(anchor_ts)) AS BIGINT) - CAST(floor(epoch(bucket)) AS BIGINT)) / 3600.0 AS lead, CASE WHEN final > 60 THEN 'high' WHEN final < 20 THEN 'low' END AS sig
    FROM rs JOIN an ON rs.user_id = an.user_id WHERE bucket <= anchor_ts AND CAST(floor(epoch(bucket)) AS BIGINT) >= CAST(floor(epoch(anchor_ts)) AS BIGINT) - 48 * 3600)
  SELECT user_id, anchor_ts, round(max(lead), 6) AS earliest_lead_h, arg_max(sig, lead) AS first_signal, count(*) AS breach_hours FROM n WHERE sig IS NOT NULL GROUP BY 1, 2""")
def deterioration(t: Tables):
    hourly = temporal.resample(t.events, ["user_id"], "ts", "value", 4 * 3600)
    anchors = t.events.where("event_type = 'error'").select("user_id", F.col("ts").alias("anchor_ts"))
    got = temporal.lead_features(hourly, anchors, "user_id", "bucket", "anchor_ts", 48,
                                 {"high": F.col("final") > 60, "low": F.col("final") < 20})
    return got.withColumn("earliest_lead_h", F.round("earliest_lead_h", 6))


@query("""WITH g AS (SELECT c_nationkey, CAST(hour(ts) AS INTEGER) AS hour_of_day, count(DISTINCT user_id) AS s, round(avg(value) + 1e-9, 6) AS m, count(*) AS n
  FROM events JOIN customer ON user_id = c_custkey GROUP BY 1, 2)
  SELECT c_nationkey, hour_of_day, CASE WHEN s >= 5 THEN s END AS subjects, CASE WHEN s >= 5 THEN m END AS mean_value,
  CASE WHEN s >= 5 THEN n END AS readings, s < 5 AS suppressed FROM g""")
def ward_summary(t: Tables):
    ward = t.customer.select(F.col("c_custkey").alias("user_id"), "c_nationkey")
    seen = t.events.join(ward, "user_id").withColumn("hour_of_day", F.hour("ts"))
    return suppress_small(seen, ["c_nationkey", "hour_of_day"], "user_id",
                          {"mean_value": F.round(F.avg("value") + 1e-9, 6), "readings": F.count(F.lit(1))})


# ---------------------------------------------------------------- clickstream

SHOP = """e AS (SELECT event_id, user_id, ts, CAST(json_extract_string(props, '$.k') AS INTEGER) AS product,
    CASE event_type WHEN 'click' THEN 'cart' ELSE event_type END AS kind, value FROM events),
  p AS (SELECT product, CAST(CAST(ts AS DATE) AS TIMESTAMP) AS d, max(CAST(value AS DECIMAL(12,2))) AS price FROM e GROUP BY 1, 2),
  c AS (SELECT *, lag(price) OVER (PARTITION BY product ORDER BY d) AS was FROM p),
  m AS (SELECT * FROM c WHERE was IS NULL OR abs(price - was) > 0.01),
  iv AS (SELECT product, price, lag(price) OVER w AS prev_value, d AS effective_start, lead(d) OVER w AS effective_end FROM m WINDOW w AS (PARTITION BY product ORDER BY d)),
  x AS (SELECT e.*, iv.price AS catalog_price FROM e ASOF LEFT JOIN iv ON e.product = iv.product AND e.ts >= iv.effective_start),
  h AS (SELECT product, date_trunc('hour', ts) AS event_hour, catalog_price, count(*) FILTER (kind='view') AS views, count(*) FILTER (kind='cart') AS carts,
    count(*) FILTER (kind='purchase') AS purchases, coalesce(sum(catalog_price) FILTER (kind='purchase'), 0) AS revenue FROM x GROUP BY 1, 2, 3),
  ch AS (SELECT *, round(CAST((price - prev_value) AS DOUBLE) / CAST(prev_value AS DOUBLE), 8) AS pct_change FROM iv)"""


def _shop(t: Tables) -> DataFrame:
    kind = F.when(F.col("event_type") == "click", "cart").otherwise(F.col("event_type"))
    return t.events.select("event_id", "user_id", "ts", F.get_json_object("props", "$.k").cast("int").alias("product"),
                           kind.alias("kind"), money("value").alias("value"))


def _shop_prices(t: Tables) -> DataFrame:
    daily = _shop(t).groupBy("product", F.date_trunc("day", "ts").alias("d")).agg(F.max("value").alias("price"))
    return temporal.derive_intervals(daily, "product", "d", "price", 0.01)


def _priced(t: Tables) -> DataFrame:
    return joins.asof_join(_shop(t), _shop_prices(t).select("product", "price", "effective_start")
                           .withColumnRenamed("price", "catalog_price"), ["product"], "ts", "effective_start",
                           ["catalog_price"])


def _shop_changes(t: Tables) -> DataFrame:
    iv = _shop_prices(t)
    as_double = iv.withColumns({"price": F.col("price").cast("double"), "prev_value": F.col("prev_value").cast("double")})
    return clickstream.price_changes(as_double, "price")


@query(f"""WITH {SHOP} SELECT product, event_hour, CAST(catalog_price AS DOUBLE) AS catalog_price, views, carts, purchases, CAST(revenue AS DOUBLE) AS revenue,
  coalesce(round(carts / CAST(nullif(views, 0) AS DOUBLE), 6), 0.0) AS view_to_cart, coalesce(round(purchases / CAST(nullif(carts, 0) AS DOUBLE), 6), 0.0) AS cart_to_purchase,
  coalesce(round(purchases / CAST(nullif(views, 0) AS DOUBLE), 6), 0.0) AS overall_conv FROM h""")
def funnel_hourly(t: Tables):
    got = clickstream.conversion_hourly(_priced(t), "product", "ts", "kind", "catalog_price")
    return got.withColumns({c: F.col(c).cast("double") for c in ("catalog_price", "revenue")})


@query(f"""WITH {SHOP} SELECT product // 10 AS category, CAST(event_hour AS DATE) AS day, CAST(sum(views) AS BIGINT) AS views, CAST(sum(carts) AS BIGINT) AS carts,
  CAST(sum(purchases) AS BIGINT) AS purchases, round(sum(carts) / nullif(CAST(sum(views) AS DOUBLE), 0), 6) AS cart_rate,
  round(sum(purchases) / nullif(CAST(sum(views) AS DOUBLE), 0), 6) AS conversion FROM h GROUP BY 1, 2""")
def category_daily(t: Tables):
    hourly = clickstream.conversion_hourly(_priced(t), "product", "ts", "kind", "catalog_price")
    return clickstream.category_daily(hourly, F.expr("cast(product div 10 as int)"))


@query(f"""WITH {SHOP}, k AS (SELECT * FROM ch WHERE abs(pct_change) > 0.15),
  post AS (SELECT k.product, k.effective_start, sum(purchases) AS post_purchases FROM h JOIN k ON h.product = k.product AND event_hour >= effective_start
    AND event_hour < effective_start + INTERVAL 2 HOUR GROUP BY 1, 2),
  base AS (SELECT k.product, k.effective_start, pct_change, sum(purchases) AS base_purchases FROM h JOIN k ON h.product = k.product AND event_hour < effective_start
    AND event_hour >= effective_start - INTERVAL 7 DAY AND catalog_price = prev_value GROUP BY 1, 2, 3 HAVING sum(purchases) >= 1)
  SELECT base.product, base.effective_start, pct_change, CAST(base_purchases AS BIGINT) AS base_purchases, CAST(coalesce(post_purchases, 0) AS BIGINT) AS post_purchases,
  round(((coalesce(post_purchases, 0) - base_purchases / 84.0) / (base_purchases / 84.0)) / pct_change, 6) AS elasticity
  FROM base LEFT JOIN post ON base.product = post.product AND base.effective_start = post.effective_start""")
def elasticity(t: Tables):
    hourly = clickstream.conversion_hourly(_priced(t), "product", "ts", "kind", "catalog_price")
    as_double = hourly.withColumn("catalog_price", F.col("catalog_price").cast("double"))
    return clickstream.elasticity(as_double, _shop_changes(t), "product", "catalog_price", floor=1)


@query(f"""WITH {SHOP}, {SESSIONS.replace('g AS', 'sg AS').replace('FROM g', 'FROM sg')},
  xs AS (SELECT x.*, s.session_no FROM x JOIN s ON x.event_id = s.event_id), up AS (SELECT * FROM ch WHERE pct_change > 0.15),
  cart AS (SELECT xs.*, up.prev_value FROM xs JOIN up ON xs.product = up.product AND kind = 'cart' AND xs.ts >= effective_start AND xs.ts < effective_start + INTERVAL 1 DAY)
  SELECT product // 10 AS category, count(*) AS abandoned, CAST(sum(catalog_price) AS DOUBLE) AS lost_at_cart, round(CAST(sum(prev_value) AS DOUBLE), 2) AS lost_at_old
  FROM cart WHERE NOT EXISTS (SELECT 1 FROM xs b WHERE b.kind = 'purchase' AND b.user_id = cart.user_id AND b.session_no = cart.session_no AND b.product = cart.product) GROUP BY 1""")
def abandonment(t: Tables):
    priced = materialised(_priced(t), "priced")
    seen = materialised(temporal.sessionize(priced, "user_id", "ts", 6 * 3600, tie=["event_id"]), "sessions")
    got = clickstream.abandoned_carts(seen, _shop_changes(t), "product", "ts", "kind", "session_key", "catalog_price",
                                      F.expr("cast(product div 10 as int)"), within_seconds=sliced.DAY)
    return got.withColumns({"lost_at_cart": F.col("lost_at_cart").cast("double"), "lost_at_old": F.round("lost_at_old", 2)})


# ---------------------------------------------------------------- fleet and weather


@query("""WITH b AS (SELECT l_returnflag, CAST(floor(l_quantity) AS BIGINT) AS bin, avg(l_extendedprice) AS m FROM lineitem GROUP BY 1, 2),
  k AS (SELECT l_returnflag, arg_min(bin, (m, bin)) AS least_bin FROM b GROUP BY 1)
  SELECT b.l_returnflag, least_bin, round(regr_slope(m, bin) FILTER (bin <= least_bin), 4) AS slope_below,
  round(regr_slope(m, bin) FILTER (bin >= least_bin), 4) AS slope_above FROM b JOIN k ON b.l_returnflag = k.l_returnflag GROUP BY 1, 2""")
def weather_response(t: Tables):
    return fleet.binned_response(t.lineitem, "l_returnflag", "l_quantity", "l_extendedprice")


TRIPS = """tr AS (SELECT s_nationkey AS origin, c_nationkey AS destination, l_linestatus AS vehicle_type, l_quantity, l_discount,
  (epoch(l_shipdate) - epoch(o_orderdate + INTERVAL 60 DAY)) / 60.0 AS v FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey)"""


def _trips(t: Tables) -> DataFrame:
    return (t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
            .join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
            .join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey"))
            .select(F.col("s_nationkey").alias("origin"), F.col("c_nationkey").alias("destination"),
                    F.col("l_linestatus").alias("vehicle_type"), "l_quantity", "l_discount", "l_shipdate",
                    (F.col("o_orderdate") + F.expr("INTERVAL 60 DAYS")).alias("promised")))


@query(f"""WITH {TRIPS} SELECT origin, destination, vehicle_type, count(*) AS trips, max(v) AS worst_var,
  round(quantile_cont(v, 0.5) + 1e-9, 4) AS median_var, round(quantile_cont(v, 0.9) + 1e-9, 4) AS p90_var FROM tr GROUP BY 1, 2, 3""")
def arrival_performance(t: Tables):
    got = fleet.arrival_performance(_trips(t), ["origin", "destination", "vehicle_type"], "promised", "l_shipdate")
    return got.withColumns({"median_var": near("median_var", 4), "p90_var": near("p90_var", 4)})


@query(f"""WITH {TRIPS} SELECT vehicle_type, round(corr(v, l_quantity), 8) AS by_quantity, round(corr(v, l_discount), 8) AS by_discount FROM tr GROUP BY 1""")
def lateness_factors(t: Tables):
    late = _trips(t).withColumn("v", (F.unix_seconds("l_shipdate") - F.unix_seconds("promised")) / 60)
    return late.groupBy("vehicle_type").agg(F.round(F.corr("v", "l_quantity"), 8).alias("by_quantity"),
                                            F.round(F.corr("v", "l_discount"), 8).alias("by_discount"))
