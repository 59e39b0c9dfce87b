"""Change logs and ledgers: lineitem read as a change log, orders as account entries.

A line ``(l_orderkey, l_linenumber)`` changes each time it is listed again: ship date is the source
time, return flag R a delete, A an update, N a create.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeops.catalog.registry import Tables, query
from lakeops.functions.columns import money
from lakeops.operators import cdc, recon
from lakeops.operators.quality import dataset_checksum, fingerprint
from lakeops.plans import ledger

KEYS = ["l_orderkey", "l_linenumber"]
ORDER = ["l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice"]
SPLIT = "1998-01-01"


def change_log(t: Tables) -> DataFrame:
    op = F.when(F.col("l_returnflag") == "R", "d").when(F.col("l_returnflag") == "A", "u").otherwise("c")
    return t.lineitem.select(*KEYS, *ORDER, "l_quantity", "l_linestatus", op.alias("op"))


def base_state(t: Tables) -> DataFrame:
    """Lines as they stood at the split date, without the deleted ones."""
    old = cdc.latest_per_key(change_log(t).where(F.col("l_shipdate") < F.lit(SPLIT).cast("timestamp")), KEYS, ORDER)
    return old.where("op <> 'd'").drop("op").withColumn("is_deleted", F.lit(False))


def later_changes(t: Tables) -> DataFrame:
    return cdc.latest_per_key(change_log(t).where(F.col("l_shipdate") >= F.lit(SPLIT).cast("timestamp")), KEYS, ORDER)


LOG = """log AS (SELECT l_orderkey, l_linenumber, l_shipdate, l_partkey, l_suppkey, l_extendedprice, l_quantity,
  l_linestatus, CASE l_returnflag WHEN 'R' THEN 'd' WHEN 'A' THEN 'u' ELSE 'c' END AS op FROM lineitem)"""
RANKED = "row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate DESC, l_partkey DESC, l_suppkey DESC, l_extendedprice DESC)"
STATES = f"""WITH {LOG}, base AS (SELECT * FROM (SELECT *, {RANKED} AS rn FROM log WHERE l_shipdate < TIMESTAMP '{SPLIT}')
  WHERE rn = 1 AND op <> 'd'),
  chg AS (SELECT * FROM (SELECT *, {RANKED} AS rn FROM log WHERE l_shipdate >= TIMESTAMP '{SPLIT}') WHERE rn = 1)"""
MERGED = """
  SELECT coalesce(b.l_orderkey, c.l_orderkey) AS l_orderkey, coalesce(b.l_linenumber, c.l_linenumber) AS l_linenumber,
    CASE WHEN c.op IS NULL OR (b.op IS NOT NULL AND c.op = 'd') THEN b.l_shipdate ELSE c.l_shipdate END AS l_shipdate,
    CASE WHEN c.op IS NULL OR (b.op IS NOT NULL AND c.op = 'd') THEN b.l_suppkey ELSE c.l_suppkey END AS l_suppkey,
    CASE WHEN c.op IS NULL OR (b.op IS NOT NULL AND c.op = 'd') THEN b.l_linestatus ELSE c.l_linestatus END AS l_linestatus,
    CASE WHEN c.op IS NULL OR (b.op IS NOT NULL AND c.op = 'd') THEN b.l_extendedprice ELSE c.l_extendedprice END AS l_extendedprice,
    CASE WHEN c.op IS NULL OR (b.op IS NOT NULL AND c.op = 'd') THEN b.l_quantity ELSE c.l_quantity END AS l_quantity,
    (b.op IS NOT NULL AND coalesce(c.op, '') = 'd') AS is_deleted
  FROM base b FULL JOIN chg c ON b.l_orderkey = c.l_orderkey AND b.l_linenumber = c.l_linenumber
  WHERE b.op IS NOT NULL OR c.op <> 'd'"""


@query(f"""WITH {LOG} SELECT l_orderkey, l_linenumber, l_shipdate, l_partkey, l_suppkey, l_extendedprice, l_quantity,
  l_linestatus, op FROM (SELECT *, {RANKED} AS rn FROM log) WHERE rn = 1""")
def cdc_latest(t: Tables):
    return cdc.latest_per_key(change_log(t), KEYS, ORDER)


@query("""WITH k AS (SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL)
  SELECT CAST(sum(n) AS BIGINT) AS rows_in, count(*) AS rows_out, count(*) FILTER (n > 1) AS repeated_keys,
  round(count(*) / CAST(sum(n) AS DOUBLE), 4) AS collapse_ratio FROM k""")
def cdc_report(t: Tables):
    return cdc.dedup_report(change_log(t), KEYS)


@query("""SELECT l_orderkey, l_linenumber, count(*) AS copies FROM lineitem GROUP BY ALL HAVING count(*) > 1""")
def cdc_cardinality(t: Tables):
    return cdc.duplicate_keys(change_log(t), KEYS)


@query(STATES + MERGED)
def cdc_merge_soft(t: Tables):
    return (cdc.merge_cdc(base_state(t), later_changes(t), KEYS, version="l_shipdate", check=False)
            .drop("l_partkey"))


@query(STATES + f"""SELECT count(*) AS rows, true AS identical FROM ({MERGED})""")
def rerun_idempotent(t: Tables):
    """Merging the same changes a second time leaves count and hash as they were."""
    merge = lambda state: cdc.merge_cdc(state, later_changes(t), KEYS, version="l_shipdate", check=False)
    once = fingerprint(merge(base_state(t)))
    twice = fingerprint(merge(merge(base_state(t))))
    return twice.select("rows", (F.struct("rows", "hash_sum") == once.select(F.struct("rows", "hash_sum")).scalar()).alias("identical"))


@query(STATES + f"""SELECT l_orderkey, l_linenumber, l_shipdate, l_suppkey, l_extendedprice, l_quantity
  FROM ({MERGED}) WHERE NOT is_deleted""")
def cdc_merge_hard(t: Tables):
    return (cdc.merge_cdc(base_state(t).drop("is_deleted"), later_changes(t), KEYS, version="l_shipdate",
                          deleted=None, check=False).drop("l_partkey", "l_linestatus"))


@query(STATES + """SELECT coalesce(c.l_orderkey, b.l_orderkey) AS l_orderkey, coalesce(c.l_linenumber, b.l_linenumber) AS l_linenumber,
  coalesce(c.l_quantity, b.l_quantity) AS l_quantity, coalesce(b.l_suppkey, c.l_suppkey) AS l_suppkey
  FROM base b FULL JOIN chg c ON b.l_orderkey = c.l_orderkey AND b.l_linenumber = c.l_linenumber""")
def cdc_merge_plain(t: Tables):
    merged = cdc.merge_cdc(base_state(t).drop("is_deleted"), later_changes(t), KEYS, version="l_shipdate",
                           delete_op="never", update_cols=["l_quantity"], deleted=None, guard_updates=False, check=False)
    return merged.select(*KEYS, "l_quantity", "l_suppkey")


@query(f"""WITH {LOG}, late AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber
   ORDER BY l_shipdate, l_partkey, l_suppkey, l_extendedprice) AS rn FROM log) WHERE rn = 1),
  cur AS (SELECT * FROM (SELECT *, {RANKED} AS rn FROM log) WHERE rn = 1)
  SELECT l_orderkey, l_linenumber, l_shipdate, l_quantity FROM cur""")
def cdc_late_rows_ignored(t: Tables):
    """The oldest change of every key arrives once more: nothing may move."""
    log = change_log(t)
    now = cdc.latest_per_key(log, KEYS, ORDER).drop("op")
    first = log.groupBy(*KEYS).agg(F.min_by(F.struct(*[c for c in log.columns if c not in KEYS]),
                                            F.struct(*ORDER)).alias("r")).select(*KEYS, "r.*")
    replay = first.withColumn("op", F.lit("u"))
    return (cdc.merge_cdc(now, replay, KEYS, version="l_shipdate", deleted=None, check=False)
            .select(*KEYS, "l_shipdate", "l_quantity"))


@query(STATES + f""", m AS ({MERGED}), touched AS (SELECT DISTINCT year(l_shipdate) AS y FROM chg
    UNION SELECT DISTINCT year(b.l_shipdate) FROM base b JOIN chg c ON b.l_orderkey=c.l_orderkey AND b.l_linenumber=c.l_linenumber),
  kept AS (SELECT * FROM m)
  SELECT CAST(year(l_shipdate) AS INTEGER) AS ship_year, count(*) AS lines, count(*) FILTER (is_deleted) AS flagged
  FROM kept WHERE year(l_shipdate) IN (SELECT y FROM touched) GROUP BY 1""")
def cdc_merge_partitions(t: Tables):
    with_year = lambda df: df.withColumn("ship_year", F.year("l_shipdate"))
    rows, _ = cdc.merge_touched(with_year(base_state(t)), with_year(later_changes(t)), KEYS, "ship_year",
                                version="l_shipdate", check=False)
    return rows.groupBy("ship_year").agg(F.count(F.lit(1)).alias("lines"), F.count_if("is_deleted").alias("flagged"))


@query(f"""WITH {LOG}, y AS (SELECT *, year(l_shipdate) AS yr, row_number() OVER (PARTITION BY l_orderkey, l_linenumber, year(l_shipdate)
    ORDER BY l_shipdate DESC, l_partkey DESC, l_suppkey DESC, l_extendedprice DESC) AS rn FROM log),
  s AS (SELECT * FROM y WHERE rn = 1), born AS (SELECT l_orderkey, l_linenumber, min(yr) AS y0 FROM s WHERE op <> 'd' GROUP BY ALL)
  SELECT s.l_orderkey, s.l_linenumber, arg_max(l_quantity, yr) FILTER (op <> 'd') AS l_quantity,
    max(l_shipdate) FILTER (op <> 'd') AS l_shipdate, bool_or(op = 'd' AND yr > y0) AS is_deleted
  FROM s JOIN born b ON s.l_orderkey=b.l_orderkey AND s.l_linenumber=b.l_linenumber GROUP BY ALL""")
def cdc_yearly_slices(t: Tables):
    """Collapse and merge year after year, each on the state before, in one pass over the log."""
    log = change_log(t).withColumn("yr", F.year("l_shipdate"))
    return cdc.fold_slices(log, KEYS, "yr", ORDER, version="l_shipdate").select(*KEYS, "l_quantity", "l_shipdate", "is_deleted")


@query(f"""WITH {LOG}, y AS (SELECT *, CAST(l_shipdate AS DATE) + CAST(l_quantity AS INTEGER) AS arrived FROM log),
  z AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber, arrived ORDER BY l_shipdate DESC, l_partkey DESC, l_suppkey DESC, l_extendedprice DESC) AS rn FROM y),
  s AS (SELECT * FROM z WHERE rn = 1), born AS (SELECT l_orderkey, l_linenumber, min(arrived) AS d0 FROM s WHERE op <> 'd' GROUP BY ALL),
  u AS (SELECT s.*, d0, row_number() OVER (PARTITION BY s.l_orderkey, s.l_linenumber, op <> 'd' ORDER BY l_shipdate DESC, arrived) AS place
    FROM s JOIN born b ON s.l_orderkey = b.l_orderkey AND s.l_linenumber = b.l_linenumber WHERE arrived >= d0)
  SELECT l_orderkey, l_linenumber, max(l_quantity) FILTER (op <> 'd' AND place = 1) AS l_quantity, max(l_shipdate) FILTER (op <> 'd' AND place = 1) AS l_shipdate,
    bool_or(op = 'd' AND arrived > d0) AS is_deleted FROM u GROUP BY ALL""")
def cdc_arrival_days(t: Tables):
    """Day by day as changes arrive: an older change that comes late is not taken, a late delete is."""
    log = change_log(t).withColumn("arrived", F.date_add(F.to_date("l_shipdate"), F.col("l_quantity").cast("int")))
    return cdc.fold_slices(log, KEYS, "arrived", ORDER, version="l_shipdate").select(*KEYS, "l_quantity", "l_shipdate", "is_deleted")


@query("""SELECT event_id, CAST(to_json({'user_id': user_id, 'value': value}) AS VARCHAR) AS image,
  CASE WHEN event_type = 'error' THEN 'd' ELSE 'u' END AS cdc_operation, CAST(user_id AS BIGINT) AS user_id,
  CAST(value AS DECIMAL(18,2)) AS amount, make_timestamp((epoch_us(ts) // 1000) * 1000) AS source_ts FROM events""")
def cdc_envelope(t: Tables):
    """Events wrapped as change envelopes, flattened and typed again; deletes carry only ``before``."""
    image = F.struct("user_id", "value")
    gone = F.col("event_type") == "error"
    millis = F.unix_millis("ts")
    wrapped = t.events.select(
        "event_id", F.when(gone, "d").otherwise("u").alias("op"), (millis + 1000).alias("ts_ms"),
        F.struct(F.lit("events").alias("table"), F.col("event_id").alias("lsn"), millis.alias("ts_ms")).alias("source"),
        F.when(gone, image).alias("before"), F.when(~gone, image).alias("after"))
    flat = cdc.flatten_envelope(wrapped)
    typed = cdc.extract_envelope(flat, {"user_id": "bigint", "value": "decimal(18,2)"},
                                 ["source_lsn", "cdc_operation", "source_ts", "before", "after"])
    return typed.select(F.col("source_lsn").alias("event_id"), F.coalesce("after", "before").alias("image"),
                        "cdc_operation", "user_id", F.col("value").alias("amount"), "source_ts")


@query(f"""WITH {LOG}, a AS (SELECT *, l_shipdate + to_days(CAST(l_quantity AS INTEGER)) AS arrived FROM log),
  known AS (SELECT * FROM (SELECT *, {RANKED} AS rn FROM a WHERE arrived <= TIMESTAMP '2000-01-01') WHERE rn = 1 AND op <> 'd'),
  fin AS (SELECT * FROM (SELECT *, {RANKED} AS rn FROM a) WHERE rn = 1 AND op <> 'd'),
  k AS (SELECT l_suppkey, sum(CASE WHEN l_linestatus='F' THEN 1 ELSE -1 END * CAST(l_extendedprice AS DECIMAL(12,2))) AS b
    FROM known WHERE l_shipdate <= TIMESTAMP '1999-12-31' GROUP BY 1),
  r AS (SELECT l_suppkey, sum(CASE WHEN l_linestatus='F' THEN 1 ELSE -1 END * CAST(l_extendedprice AS DECIMAL(12,2))) AS b
    FROM fin WHERE l_shipdate <= TIMESTAMP '1999-12-31' GROUP BY 1)
  SELECT coalesce(k.l_suppkey, r.l_suppkey) AS l_suppkey, CAST(coalesce(k.b, 0) AS DOUBLE) AS balance_as_known,
  CAST(coalesce(r.b, 0) AS DOUBLE) AS balance_as_restated, CAST(coalesce(r.b, 0) - coalesce(k.b, 0) AS DOUBLE) AS delta
  FROM k FULL JOIN r ON k.l_suppkey = r.l_suppkey""")
def pit_known_vs_restated(t: Tables):
    log = change_log(t).withColumn("arrived", F.col("l_shipdate") + F.make_dt_interval(F.col("l_quantity").cast("int")))
    signed = F.when(F.col("l_linestatus") == "F", money("l_extendedprice")).otherwise(-money("l_extendedprice"))
    got = cdc.as_known_vs_restated(
        log, KEYS, ORDER, account="l_suppkey", amount=signed, event_ts="l_shipdate", arrival_ts="arrived", op="op",
        known_at=F.lit("2000-01-01").cast("timestamp"), cutoff=F.lit("1999-12-31").cast("timestamp"))
    return got.select("l_suppkey", *[F.col(c).cast("double").alias(c)
                                     for c in ("balance_as_known", "balance_as_restated", "delta")])


DRIFT = f"""WITH {LOG}, pub AS (SELECT * FROM (SELECT *, {RANKED} AS rn FROM log WHERE l_shipdate + to_days(CAST(l_quantity AS INTEGER)) <= TIMESTAMP '2000-01-01') WHERE rn=1 AND op <> 'd'),
  cur AS (SELECT * FROM (SELECT *, {RANKED} AS rn FROM log) WHERE rn=1 AND op <> 'd'),
  p AS (SELECT l_linestatus, CAST(l_shipdate AS DATE) AS business_date, sum(CASE WHEN l_quantity > 25 THEN 1 ELSE -1 END * CAST(l_extendedprice AS DECIMAL(12,2))) AS net FROM pub GROUP BY 1, 2),
  r AS (SELECT l_linestatus, CAST(l_shipdate AS DATE) AS business_date, sum(CASE WHEN l_quantity > 25 THEN 1 ELSE -1 END * CAST(l_extendedprice AS DECIMAL(12,2))) AS net FROM cur GROUP BY 1, 2),
  d AS (SELECT coalesce(p.l_linestatus, r.l_linestatus) AS l_linestatus, coalesce(p.business_date, r.business_date) AS business_date,
    p.net AS published, r.net AS restated, coalesce(r.net,0) - coalesce(p.net,0) AS drift,
    round(CAST(coalesce(r.net,0) - coalesce(p.net,0) AS DOUBLE) / nullif(CAST(abs(p.net) AS DOUBLE), 0), 4) AS drift_pct
    FROM p FULL JOIN r ON p.l_linestatus = r.l_linestatus AND p.business_date = r.business_date),
  m AS (SELECT *, coalesce(abs(drift_pct) > 0.001, drift <> 0) AS material FROM d)"""


def _drift(t: Tables) -> DataFrame:
    log = change_log(t)
    arrived = F.col("l_shipdate") + F.make_dt_interval(F.col("l_quantity").cast("int"))
    states = log.groupBy(*KEYS).agg(
        F.max_by(F.struct("l_shipdate", "l_linestatus", "l_quantity", "l_extendedprice", "op"),
                 F.when(arrived <= F.lit("2000-01-01").cast("timestamp"), F.struct(*ORDER))).alias("p"),
        F.max_by(F.struct("l_shipdate", "l_linestatus", "l_quantity", "l_extendedprice", "op"),
                 F.struct(*ORDER)).alias("r"))
    net = lambda side: ledger.net_by_day(states.select(f"{side}.*").where("op <> 'd'"), "l_linestatus",
                                         "l_shipdate", "l_extendedprice", F.col("l_quantity") > 25)
    return recon.restatement_drift(net("p"), net("r"), ["l_linestatus", "business_date"], "net")


@query(DRIFT + """SELECT l_linestatus, business_date, CAST(published AS DOUBLE) AS published, CAST(restated AS DOUBLE) AS restated,
  CAST(drift AS DOUBLE) AS drift, drift_pct, material FROM m""")
def restatement_drift(t: Tables):
    return _drift(t).select("l_linestatus", "business_date", *[F.col(c).cast("double").alias(c) for c in
                                                               ("published", "restated", "drift")], "drift_pct", "material")


@query(DRIFT + """SELECT l_linestatus, business_date, CAST(drift AS DOUBLE) AS drift FROM m
  ORDER BY abs(drift) DESC, l_linestatus, business_date LIMIT 3""")
def restatement_top3(t: Tables):
    return (_drift(t).orderBy(F.abs("drift").desc(), "l_linestatus", "business_date").limit(3)
            .select("l_linestatus", "business_date", F.col("drift").cast("double").alias("drift")))


@query(DRIFT + """SELECT l_linestatus, count(*) AS days, CAST(sum(drift) AS DOUBLE) AS total_drift,
  count(*) FILTER (material) AS material_days, max(abs(drift_pct)) AS worst_pct FROM m GROUP BY 1""")
def drift_rollup(t: Tables):
    return ledger.drift_rollup(_drift(t), "l_linestatus").withColumn("total_drift", F.col("total_drift").cast("double"))


# ---------------------------------------------------------------- accounts

DAILY = """d AS (SELECT o_custkey, o_orderpriority, CAST(o_orderdate AS DATE) AS business_date,
    sum(CASE WHEN o_orderstatus='F' THEN CAST(o_totalprice AS DECIMAL(12,2)) ELSE 0 END) AS credit_volume,
    sum(CASE WHEN o_orderstatus='F' THEN 0 ELSE CAST(o_totalprice AS DECIMAL(12,2)) END) AS debit_volume, count(*) AS txn_count
    FROM orders GROUP BY 1, 2, 3),
  s AS (SELECT *, sum(credit_volume - debit_volume) OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY business_date
    ROWS UNBOUNDED PRECEDING) AS closing_balance FROM d)"""


def _summary(t: Tables) -> DataFrame:
    entries = t.orders.withColumn("amount", money("o_totalprice"))
    return ledger.daily_account_summary(entries, "o_custkey", "o_orderpriority", "o_orderdate", "amount",
                                        F.col("o_orderstatus") == "F")


@query(f"""WITH {DAILY} SELECT o_custkey, o_orderpriority, business_date, CAST(closing_balance - credit_volume + debit_volume AS DOUBLE) AS opening_balance,
  CAST(credit_volume AS DOUBLE) AS credit_volume, CAST(debit_volume AS DOUBLE) AS debit_volume,
  CAST(closing_balance AS DOUBLE) AS closing_balance, txn_count FROM s""")
def daily_account_summary(t: Tables):
    cols = ("opening_balance", "credit_volume", "debit_volume", "closing_balance")
    return _summary(t).select("o_custkey", "o_orderpriority", "business_date", "txn_count",
                              *[F.col(c).cast("double").alias(c) for c in cols])


@query("""SELECT count(*) AS accounts_days, CAST(0 AS BIGINT) AS failing FROM (
  SELECT DISTINCT o_custkey, o_orderpriority, CAST(o_orderdate AS DATE) FROM orders)""")
def recon_invariant(t: Tables):
    s = _summary(t)
    off = F.abs(F.col("opening_balance") + F.col("credit_volume") - F.col("debit_volume") - F.col("closing_balance"))
    return s.agg(F.count(F.lit(1)).alias("accounts_days"), F.count_if(off > 0.01).alias("failing"))


@query(f"""WITH {DAILY} SELECT o_orderpriority, business_date, count(DISTINCT o_custkey) AS active_accounts,
  CAST(sum(closing_balance) AS DOUBLE) AS total_balance, CAST(sum(credit_volume) AS DOUBLE) AS total_credits,
  CAST(sum(debit_volume) AS DOUBLE) AS total_debits, CAST(sum(txn_count) AS BIGINT) AS total_transactions FROM s GROUP BY 1, 2""")
def exec_daily_close(t: Tables):
    out = ledger.executive_close(_summary(t), "o_custkey", "o_orderpriority")
    for c in ("total_balance", "total_credits", "total_debits"):
        out = out.withColumn(c, F.col(c).cast("double"))
    return out


@query("""WITH e AS (SELECT event_id, user_id, ts, CAST(ts AS DATE) AS business_date, CAST(value AS DECIMAL(12,2)) AS amount FROM events),
  o AS (SELECT user_id, business_date, sum(amount) AS opening_balance FROM e GROUP BY 1, 2),
  r AS (SELECT *, sum(amount) OVER (PARTITION BY user_id, business_date ORDER BY ts RANGE BETWEEN INTERVAL 6 HOUR PRECEDING AND CURRENT ROW) AS rolling_outflow FROM e),
  j AS (SELECT event_id, r.user_id, r.business_date, CAST(rolling_outflow AS DOUBLE) AS rolling_outflow, CAST(opening_balance AS DOUBLE) AS opening_balance,
    round(CAST(rolling_outflow AS DOUBLE) / CAST(opening_balance AS DOUBLE), 4) AS pct_of_opening FROM r
    JOIN o ON r.user_id = o.user_id AND r.business_date = o.business_date WHERE opening_balance > 0)
  SELECT *, CASE WHEN pct_of_opening >= 1.0 THEN 'CRITICAL' WHEN pct_of_opening >= 0.9 THEN 'HIGH' ELSE 'MEDIUM' END AS severity
  FROM j WHERE pct_of_opening >= 0.8""")
def velocity_alerts(t: Tables):
    """Spending of six hours against the user's total of the day."""
    e = t.events.select("event_id", "user_id", "ts", money("value").alias("amount"))
    openings = (e.groupBy("user_id", F.to_date("ts").alias("business_date"))
                .agg(F.sum("amount").alias("opening_balance")))
    got = ledger.velocity_alerts(e, openings, "user_id", "ts", "amount", window_seconds=6 * 3600)
    return got.select("event_id", "user_id", "business_date", F.col("rolling_outflow").cast("double").alias("rolling_outflow"),
                      F.col("opening_balance").cast("double").alias("opening_balance"), "pct_of_opening", "severity")


@query("SELECT * FROM (" + STATES + f""", m AS ({MERGED}), d AS (SELECT l_suppkey, s_nationkey, CAST(l_shipdate AS DATE) AS business_date,
    sum(CASE WHEN l_linestatus='F' THEN CAST(l_extendedprice AS DECIMAL(12,2)) ELSE 0 END) AS credit_volume,
    sum(CASE WHEN l_linestatus='F' THEN 0 ELSE CAST(l_extendedprice AS DECIMAL(12,2)) END) AS debit_volume, count(*) AS txn_count
    FROM m JOIN supplier ON l_suppkey = s_suppkey WHERE NOT is_deleted GROUP BY 1, 2, 3),
  s AS (SELECT *, sum(credit_volume - debit_volume) OVER (PARTITION BY l_suppkey, s_nationkey ORDER BY business_date ROWS UNBOUNDED PRECEDING) AS closing_balance FROM d)
  SELECT l_suppkey, s_nationkey, business_date, CAST(closing_balance - credit_volume + debit_volume AS DOUBLE) AS opening_balance,
  CAST(credit_volume AS DOUBLE) AS credit_volume, CAST(debit_volume AS DOUBLE) AS debit_volume,
  CAST(closing_balance AS DOUBLE) AS closing_balance, txn_count FROM s)""")
def ledger_daily_close(t: Tables):
    """Collapse the change log, merge it into the ledger, close every supplier's day."""
    merged = cdc.merge_cdc(base_state(t), later_changes(t), KEYS, version="l_shipdate", check=False)
    entries = merged.where(~F.col("is_deleted")).withColumn("amount", money("l_extendedprice"))
    s = ledger.daily_account_summary(entries, "l_suppkey", "s_nationkey", "l_shipdate", "amount", F.col("l_linestatus") == "F",
                                     t.supplier.select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey"))
    cols = ("opening_balance", "credit_volume", "debit_volume", "closing_balance")
    return s.select("l_suppkey", "s_nationkey", "business_date", "txn_count",
                    *[F.col(c).cast("double").alias(c) for c in cols])


@query("""WITH r AS (SELECT sha256(o_orderkey || '|' || o_custkey || '|' || o_orderstatus || '#1') AS h FROM orders),
  a AS (SELECT substr(h,1,6) || sha256(string_agg(h, chr(10) ORDER BY h)) AS h FROM r GROUP BY substr(h,1,6)),
  b AS (SELECT substr(h,1,3) || sha256(string_agg(h, chr(10) ORDER BY h)) AS h FROM a GROUP BY substr(h,1,3))
  SELECT sha256(string_agg(h, chr(10) ORDER BY h)) AS checksum FROM b""")
def checksum(t: Tables):
    return dataset_checksum(t.orders, ["o_orderkey", "o_custkey", "o_orderstatus"])
