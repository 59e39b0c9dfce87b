"""Reconciliation, quality, drift and privacy over the input tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeops.catalog.registry import Tables, query
from lakeops.functions.columns import money
from lakeops.operators import drift, privacy, quality, recon, sliced
from lakeops.operators.cdc import late_window
from lakeops.operators.features import lookback
from lakeops.session import materialised

# ---------------------------------------------------------------- reconciliation
# Our ledger is every line; the partner's has no returned lines and counts 90 seconds more on taxed ones.

LEDGERS = """o AS (SELECT l_suppkey AS partner, l_shipdate AS call_minute, CAST(l_quantity * 60 AS BIGINT) AS duration, CAST(l_extendedprice AS DECIMAL(12,2)) AS charge, l_orderkey, l_partkey FROM lineitem),
  h AS (SELECT l_suppkey AS partner, l_shipdate AS call_minute, CAST(l_quantity * 60 AS BIGINT) + CASE WHEN l_tax > 0.05 THEN 90 ELSE 0 END AS duration, CAST(l_extendedprice AS DECIMAL(12,2)) AS charge, l_orderkey, l_partkey FROM lineitem WHERE l_returnflag <> 'R'),
  on_ AS (SELECT *, row_number() OVER (PARTITION BY partner, call_minute ORDER BY duration, charge, l_orderkey, l_partkey) AS pair_no FROM o),
  hn AS (SELECT *, row_number() OVER (PARTITION BY partner, call_minute ORDER BY duration, charge, l_orderkey, l_partkey) AS pair_no FROM h),
  m AS (SELECT coalesce(a.partner, b.partner) AS partner, coalesce(a.call_minute, b.call_minute) AS call_minute, coalesce(a.pair_no, b.pair_no) AS pair_no,
    a.duration AS our_duration, b.duration AS their_duration, a.charge AS our_charge, b.charge AS their_charge,
    CASE WHEN a.partner IS NULL THEN 'MISSING_ON_OUR_SIDE' WHEN b.partner IS NULL THEN 'MISSING_ON_THEIR_SIDE' WHEN abs(a.duration - b.duration) <= 60 THEN 'MATCHED' ELSE 'DURATION_MISMATCH' END AS match_status
    FROM on_ a FULL JOIN hn b ON a.partner = b.partner AND a.call_minute = b.call_minute AND a.pair_no = b.pair_no)"""
VARIANCE = """v AS (SELECT {by}, count(*) AS total_legs, count(*) FILTER (match_status = 'MATCHED') AS matched_legs, count(*) FILTER (match_status = 'MISSING_ON_OUR_SIDE') AS missing_ours,
    count(*) FILTER (match_status = 'MISSING_ON_THEIR_SIDE') AS missing_theirs, count(*) FILTER (match_status = 'DURATION_MISMATCH') AS duration_mismatches,
    CAST(coalesce(sum(our_duration), 0) AS BIGINT) / 60.0 AS om, CAST(coalesce(sum(their_duration), 0) AS BIGINT) / 60.0 AS tm, coalesce(sum(our_charge), 0) AS our_charge, coalesce(sum(their_charge), 0) AS their_charge FROM m GROUP BY ALL)"""


def _matched(t: Tables) -> DataFrame:
    li = t.lineitem
    legs = lambda df, seconds: df.select(
        F.col("l_suppkey").alias("partner"), F.col("l_shipdate").alias("call_minute"), seconds.alias("duration"),
        money("l_extendedprice").alias("charge"), "l_orderkey", "l_partkey")
    base = (F.col("l_quantity") * 60).cast("bigint")
    ours = legs(li, base)
    theirs = legs(li.where("l_returnflag <> 'R'"), base + F.when(F.col("l_tax") > 0.05, 90).otherwise(0))
    return recon.reconcile(ours, theirs, ["partner", "call_minute"], ["duration", "charge", "l_orderkey", "l_partkey"],
                           "duration", 60, sliced.value_slice("duration", 600))


def _daily(t: Tables) -> DataFrame:
    """Variance by partner and day, written once: its aggregate and that of the months need not share a task's memory."""
    daily = recon.variance_report(_matched(t).withColumn("day", F.to_date("call_minute")), ["partner", "day"], "duration", "charge")
    return materialised(daily, "daily-variance")


def _doubles(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("double") for c in cols})


@query(f"WITH {LEDGERS} SELECT partner, call_minute, pair_no, our_duration, their_duration, match_status FROM m")
def ledger_reconcile(t: Tables):
    return _matched(t).select("partner", "call_minute", F.col("pair_no").cast("bigint").alias("pair_no"), "our_duration",
                              "their_duration", "match_status")


@query(f"""WITH {LEDGERS}, {VARIANCE.format(by='partner')} SELECT partner, total_legs, matched_legs, missing_ours, missing_theirs, duration_mismatches, round(om, 2) AS our_minutes, round(tm, 2) AS their_minutes,
  CAST(our_charge AS DOUBLE) AS our_charge, CAST(their_charge AS DOUBLE) AS their_charge, round(matched_legs / CAST(total_legs AS DOUBLE), 5) AS match_rate, CAST(our_charge - their_charge AS DOUBLE) AS variance FROM v""")
def variance_report(t: Tables):
    got = recon.variance_report(_matched(t), ["partner"], "duration", "charge").orderBy(F.abs("variance").desc(), "partner")
    return _doubles(got, "our_charge", "their_charge", "variance")


@query(f"""WITH {LEDGERS}, {VARIANCE.format(by='partner')} SELECT CAST(sum(abs(our_charge - their_charge)) AS DOUBLE) AS total_abs_variance,
  arg_max(partner, (abs(our_charge - their_charge), partner)) AS worst_partner, CAST(max(abs(our_charge - their_charge)) AS DOUBLE) AS worst_variance,
  sum(abs(our_charge - their_charge)) > 1000000 AS breached FROM v""")
def leakage(t: Tables):
    return recon.leakage(recon.variance_report(_matched(t), ["partner"], "duration", "charge"), "partner", 1_000_000)


@query(f"""WITH {LEDGERS}, {VARIANCE.format(by='partner, CAST(call_minute AS DATE) AS day')}, s AS (SELECT partner, CAST(date_trunc('month', day) AS DATE) AS statement_month, CAST(sum(total_legs) AS BIGINT) AS total_legs,
    CAST(sum(matched_legs) AS BIGINT) AS matched_legs, sum(our_charge) AS b, sum(their_charge) AS tb, sum(our_charge - their_charge) AS nv, count(DISTINCT day) AS days_included FROM v GROUP BY 1, 2)
  SELECT partner, statement_month, total_legs, matched_legs, CAST(b AS DOUBLE) AS we_billed, CAST(tb AS DOUBLE) AS they_billed, CAST(nv AS DOUBLE) AS net_variance, days_included,
  round(matched_legs / CAST(total_legs AS DOUBLE), 5) AS match_rate, CASE WHEN nv > 0 THEN 'PARTNER_OWES_US' WHEN nv < 0 THEN 'WE_OWE_PARTNER' ELSE 'BALANCED' END AS settlement_direction,
  days_included = day(last_day(statement_month)) AS month_is_whole FROM s""")
def monthly_statement(t: Tables):
    got = recon.monthly_statement(_daily(t), "partner", "day").drop("our_minutes", "their_minutes", "missing_ours", "missing_theirs")
    return _doubles(got, "we_billed", "they_billed", "net_variance")


def _digest(*cols: str) -> str:
    text = ", ".join(f"coalesce(CAST({c} AS VARCHAR), '<null>')" for c in cols)
    return f"CAST(sum(CAST(CAST('0x' || substr(sha256(concat_ws('|', {text})), 1, 15) AS BIGINT) AS HUGEINT)) AS VARCHAR)"


@query(f"""WITH {LEDGERS}, {VARIANCE.format(by='partner, CAST(call_minute AS DATE) AS day')}, d AS (SELECT *, CAST(date_trunc('month', day) AS DATE) AS statement_month FROM v),
  q AS (SELECT statement_month, count(DISTINCT day) AS days_present, {_digest('partner', 'day', *recon.SOURCED)} AS source_digest FROM d GROUP BY 1),
  s AS (SELECT partner, statement_month, CAST(sum(total_legs) AS BIGINT) AS total_legs, CAST(sum(matched_legs) AS BIGINT) AS matched_legs, sum(our_charge) AS we_billed,
    sum(their_charge) AS they_billed, sum(our_charge - their_charge) AS net_variance FROM d GROUP BY 1, 2),
  g AS (SELECT statement_month, {_digest('partner', *recon.STATED)} AS statement_digest FROM s GROUP BY 1)
  SELECT partner, s.statement_month, 'ISSUED' AS status, days_present, total_legs, matched_legs, CAST(we_billed AS DOUBLE) AS we_billed, CAST(they_billed AS DOUBLE) AS they_billed,
    CAST(net_variance AS DOUBLE) AS net_variance, CASE WHEN net_variance > 0 THEN 'PARTNER_OWES_US' WHEN net_variance < 0 THEN 'WE_OWE_PARTNER' ELSE 'BALANCED' END AS settlement_direction,
    statement_digest, source_digest FROM s JOIN q ON s.statement_month = q.statement_month JOIN g ON s.statement_month = g.statement_month WHERE days_present = day(last_day(s.statement_month))
  UNION ALL SELECT NULL, statement_month, 'REFUSED', days_present, NULL, NULL, NULL, NULL, NULL, NULL, NULL, source_digest FROM q WHERE days_present < day(last_day(statement_month))""")
def settlement_statements(t: Tables):
    """Monthly statements with digests of themselves and of their source; incomplete months are refused."""
    got = recon.settlement(_daily(t), "partner", "day")
    return _doubles(got, "we_billed", "they_billed", "net_variance")


@query("""WITH f AS (SELECT s_nationkey AS currency, l_shipdate AS day, round(1 + avg(l_discount), 4) AS rate FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE l_linestatus = 'F' GROUP BY 1, 2)
  SELECT l_linestatus, count(*) AS lines, count(*) FILTER (rate IS NULL) AS unrated FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
  LEFT JOIN f ON s_nationkey = currency AND l_shipdate = day GROUP BY 1""")
def fx_conversion(t: Tables):
    li = t.lineitem.join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey")).select(
        "l_linestatus", F.col("s_nationkey").alias("currency"), F.col("l_shipdate").alias("day"), "l_discount", "l_extendedprice")
    fx = li.where("l_linestatus = 'F'").groupBy("currency", "day").agg(F.round(1 + F.avg("l_discount"), 4).alias("rate"))
    got = recon.convert_currency(li, fx, "l_extendedprice", "currency", "day", "amount_base")
    return got.groupBy("l_linestatus").agg(F.count(F.lit(1)).alias("lines"), F.count_if(F.col("rate").isNull()).alias("unrated"))


# ---------------------------------------------------------------- quality


@query("""SELECT 'o_totalprice' AS "column", 'min' AS "check", CAST(min(o_totalprice) AS DOUBLE) AS value, min(o_totalprice) >= 0 AS passed FROM orders
  UNION ALL SELECT 'o_totalprice', 'max', max(o_totalprice), max(o_totalprice) <= 400000 FROM orders
  UNION ALL SELECT 'o_custkey', 'null_check', count(*) FILTER (o_custkey IS NULL), count(*) FILTER (o_custkey IS NULL) = 0 FROM orders
  UNION ALL SELECT 'o_orderkey', 'unique_check', count(o_orderkey) - count(DISTINCT o_orderkey), count(o_orderkey) = count(DISTINCT o_orderkey) FROM orders
  UNION ALL SELECT 'o_orderstatus', 'distinct_check', count(DISTINCT o_orderstatus), abs(count(DISTINCT o_orderstatus) - 4) <= 1 FROM orders""")
def dq_columns(t: Tables):
    return quality.check_columns(t.orders, {
        "o_totalprice": {"min": {"geq_to": 0}, "max": {"leq_to": 400_000}}, "o_custkey": {"null_check": {"equal_to": 0}},
        "o_orderkey": {"unique_check": {"equal_to": 0}}, "o_orderstatus": {"distinct_check": {"equal_to": 4, "tolerance": 0.25}}})


@query("""SELECT 'rows' AS "check", count(*) > 100 AS passed FROM orders UNION ALL SELECT 'known_status', bool_and(o_orderstatus IN ('F','O','P')) FROM orders
  UNION ALL SELECT 'cheap', bool_and(o_totalprice < 1000) FROM orders""")
def dq_table(t: Tables):
    return quality.check_table(t.orders, {"rows": "count(*) > 100", "known_status": "o_orderstatus in ('F','O','P')",
                                          "cheap": "o_totalprice < 1000"})


@query("""SELECT CAST(sum(CAST(o_totalprice AS DECIMAL(12,2))) AS DOUBLE) AS value, sum(CAST(o_totalprice AS DECIMAL(12,2))) BETWEEN 1 AND 1000000 AS passed FROM orders""")
def dq_threshold(t: Tables):
    return quality.check_threshold(t.orders, F.sum(money("o_totalprice")), 1, 1_000_000)


@query("""SELECT CAST(count(*) AS DOUBLE) AS value, abs(CAST(count(*) AS DOUBLE) - 10000) <= 10000 * 0.05 AS passed FROM events""")
def dq_value(t: Tables):
    return quality.check_value(t.events, F.count(F.lit(1)), 10_000, 0.05)


@query("""WITH d AS (SELECT CAST(ts AS DATE) AS d, value FROM events), a AS (SELECT CAST(count(*) FILTER (d = DATE '2024-01-20') AS DOUBLE) AS rn, CAST(count(*) FILTER (d = DATE '2024-01-13') AS DOUBLE) AS rt,
    CAST(sum(CAST(value AS DECIMAL(12,2))) FILTER (d = DATE '2024-01-20') AS DOUBLE) AS vn, CAST(sum(CAST(value AS DECIMAL(12,2))) FILTER (d = DATE '2024-01-13') AS DOUBLE) AS vt FROM d)
  SELECT 'rows' AS measure, rn AS now, rt AS "then", greatest(rn, rt) / least(rn, rt) <= 1.1 AS passed FROM a UNION ALL SELECT 'value', vn, vt, greatest(vn, vt) / least(vn, vt) <= 1.1 FROM a""")
def dq_interval(t: Tables):
    return quality.check_interval(t.events, "ts", "2024-01-20", 7, {"rows": F.lit(1), "value": money("value")}, 1.1)


@query("""SELECT count(*) AS rows, round(count(*) FILTER (try_cast(raw AS DOUBLE) IS NULL) / CAST(count(*) AS DOUBLE), 6) AS amount_bad
  FROM (SELECT CASE WHEN event_type = 'error' THEN 'n/a' ELSE CAST(value AS VARCHAR) END AS raw FROM events)""")
def parse_rate(t: Tables):
    raw = F.when(F.col("event_type") == "error", "n/a").otherwise(F.col("value").cast("string"))
    return quality.parse_rates(t.events.select(raw.try_cast("double").alias("amount")), ["amount"])


@query("""WITH k AS (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber) SELECT CAST(sum(n) AS BIGINT) AS rows, CAST(sum(n - 1) AS BIGINT) AS surplus,
  round(sum(n - 1) / CAST(sum(n) AS DOUBLE), 6) AS duplicate_rate FROM k""")
def duplicate_rate(t: Tables):
    return quality.duplicate_rate(t.lineitem, ["l_orderkey", "l_linenumber"])


@query("""SELECT count(*) AS rows, count(*) FILTER (nulls) AS orphans, count(DISTINCT l_orderkey) FILTER (nulls) AS dead_keys, round(count(*) FILTER (nulls) / CAST(count(*) AS DOUBLE), 6) AS orphan_share
  FROM (SELECT l_orderkey, o_orderkey IS NULL AS nulls FROM lineitem LEFT JOIN (SELECT * FROM orders WHERE o_orderstatus <> 'P') ON l_orderkey = o_orderkey)""")
def orphan_report(t: Tables):
    return quality.orphan_report(t.lineitem, "l_orderkey", t.orders.where("o_orderstatus <> 'P'"), "o_orderkey")


@query("""WITH j AS (SELECT lang, source, CAST(quality AS VARCHAR) AS quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id),
  u AS (SELECT 'lang' AS "column", lang AS v FROM j UNION ALL SELECT 'source', source FROM j UNION ALL SELECT 'quality', quality FROM j),
  c AS (SELECT "column", v, count(*) AS n FROM u GROUP BY 1, 2)
  SELECT "column", round(coalesce(sum(n) FILTER (v IS NULL), 0) / CAST(sum(n) AS DOUBLE), 6) AS null_share, count(v) AS distinct_values, arg_max(v, (n, v)) FILTER (v IS NOT NULL) AS top_value,
  round(max(n) FILTER (v IS NOT NULL) / CAST(sum(n) AS DOUBLE), 6) AS top_share FROM c GROUP BY 1""")
def profile(t: Tables):
    joined = t.documents.select("doc_id", "lang", "source").join(t.labels.select("doc_id", "quality"), "doc_id", "left")
    return quality.profile(joined, ["lang", "source", "quality"])


@query("""SELECT count(*) AS rows, count(*) FILTER (s IS NULL) AS nulls, round(avg(s), 8) AS mean, round(stddev_samp(s), 8) AS sd, min(s) AS low, max(s) AS high FROM (SELECT least(n_chars / 20000.0, 1.0) AS s FROM documents)""")
def score_distribution(t: Tables):
    got = quality.distribution(t.documents.select(F.least(F.col("n_chars") / 20000.0, F.lit(1.0)).alias("s")), "s")
    return got.withColumns({"mean": F.round("mean", 8), "sd": F.round("sd", 8)})


@query("""SELECT event_id FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-16' - INTERVAL 30 HOUR AND TIMESTAMP '2024-01-16'""")
def late_arrivals(t: Tables):
    return late_window(t.events, "ts", "2024-01-15", 6).select("event_id")


@query("""SELECT count(*) AS orders, count(DISTINCT o_custkey) AS customers FROM orders WHERE CAST(o_orderdate AS DATE) > DATE '2000-03-01' AND CAST(o_orderdate AS DATE) <= DATE '2000-06-01'""")
def lookback_months(t: Tables):
    return lookback(t.orders, "o_orderdate", "2000-06-01", months=3).agg(
        F.count(F.lit(1)).alias("orders"), F.countDistinct("o_custkey").alias("customers"))


# ---------------------------------------------------------------- drift

MELT = """b AS (SELECT unnest(['value','k','user']) AS feature, unnest([value, CAST(json_extract_string(props,'$.k') AS DOUBLE), CAST(user_id AS DOUBLE)]) AS v FROM events WHERE ts < TIMESTAMP '2024-01-16'),
  n AS (SELECT unnest(['value','k','user']) AS feature, unnest([value * 1.2, CAST(json_extract_string(props,'$.k') AS DOUBLE), CAST(user_id AS DOUBLE)]) AS v FROM events WHERE ts >= TIMESTAMP '2024-01-16'),
  e AS (SELECT feature, list_sort(list_distinct(quantile_cont(v, [0.0,0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9,1.0]))) AS ed FROM b GROUP BY 1),
  a AS (SELECT feature, v, 1 AS ib, 0 AS inn FROM b UNION ALL SELECT feature, v, 0, 1 FROM n),
  c AS (SELECT a.feature, len(list_filter(ed[2:-2], lambda x: x <= v)) AS bin, sum(ib) AS nb, sum(inn) AS nn FROM a JOIN e ON a.feature = e.feature WHERE v IS NOT NULL GROUP BY 1, 2),
  s AS (SELECT feature, greatest(nb / sum(nb) OVER (PARTITION BY feature), 1e-6) AS p, greatest(nn / sum(nn) OVER (PARTITION BY feature), 1e-6) AS q FROM c)"""


def _halves(t: Tables):
    cols = ("value", F.get_json_object("props", "$.k").cast("double").alias("k"), F.col("user_id").alias("user"), "event_type", "ts")
    e = t.events.select(*cols)
    cut = F.lit("2024-01-16").cast("timestamp")
    return e.where(F.col("ts") < cut), e.where(F.col("ts") >= cut).withColumn("value", F.col("value") * 1.2)


@query(f"WITH {MELT} SELECT feature, round(sum((q - p) * ln(q / p)), 6) AS psi FROM s GROUP BY 1")
def psi_numeric(t: Tables):
    base, now = _halves(t)
    return drift.psi_numeric(base, now, ["value", "k", "user"])


@query("""WITH x AS (SELECT unnest(['event_type', 'weekday']) AS feature, unnest([event_type, CASE WHEN isodow(ts) < 7 THEN CAST(isodow(ts) AS VARCHAR) END]) AS v, ts < TIMESTAMP '2024-01-16' AS base FROM events),
  c AS (SELECT feature, coalesce(v, '__NULL__') AS v, count(*) FILTER (base) AS b, count(*) FILTER (NOT base) AS n FROM x GROUP BY 1, 2),
  s AS (SELECT feature, greatest(b / sum(b) OVER (PARTITION BY feature), 1e-6) AS p, greatest(n / sum(n) OVER (PARTITION BY feature), 1e-6) AS q FROM c)
  SELECT feature, round(sum((q - p) * ln(q / p)), 6) AS psi FROM s GROUP BY 1""")
def psi_categorical(t: Tables):
    base, now = _halves(t)
    day = F.when(F.weekday("ts") < 6, (F.weekday("ts") + 1).cast("string"))
    return drift.psi_categorical(base.withColumn("weekday", day), now.withColumn("weekday", day), ["event_type", "weekday"])


@query(f"""WITH {MELT}, f AS (SELECT feature, round(sum((q - p) * ln(q / p)), 6) AS psi FROM s GROUP BY 1)
  SELECT round(quantile_cont(psi, 0.9), 6) AS headline, round(avg(psi), 6) AS mean_psi, max(psi) AS max_psi, count(psi) AS features,
  coalesce(string_agg(feature, ',' ORDER BY psi DESC) FILTER (psi > 0.25), '') AS drifted, quantile_cont(psi, 0.9) > 0.2 AS retrain FROM f""")
def psi_summary(t: Tables):
    base, now = _halves(t)
    return drift.drift_summary(drift.psi_numeric(base, now, ["value", "k", "user"]))


AUC = """{n} AS (SELECT d.doc_id, quality, {score} AS sc FROM documents d JOIN labels l ON d.doc_id = l.doc_id),
  {n}r AS (SELECT quality, (row_number() OVER (ORDER BY sc) * 1.0 - 1 + 0) AS x, rank() OVER (ORDER BY sc) + (count(*) OVER (PARTITION BY sc) - 1) / 2.0 AS rk FROM {n}),
  {n}a AS (SELECT round((sum(rk) FILTER (quality = 1) - count(*) FILTER (quality = 1) * (count(*) FILTER (quality = 1) + 1) / 2.0) / (count(*) FILTER (quality = 1) * count(*) FILTER (quality = 0)), 8) AS auc,
    count(*) FILTER (quality = 1) AS positives, count(*) FILTER (quality = 0) AS negatives FROM {n}r)"""


def _scored(t: Tables):
    return t.documents.join(t.labels, "doc_id").select(
        "quality", F.col("n_chars").alias("length"), F.length(F.regexp_replace("text", "[^ ]", "")).alias("spaces"))


@query("WITH " + AUC.format(n="c", score="n_chars") + " SELECT * FROM ca")
def auc(t: Tables):
    return drift.auc(_scored(t), "length", "quality", sliced.value_slice("length", 100))


@query("WITH " + AUC.format(n="c", score="n_chars") + ", " + AUC.format(n="h", score="length(text) - length(replace(text, ' ', ''))")
       + " SELECT ca.auc AS champion, ha.auc AS challenger, ha.auc >= ca.auc + 0.002 AS promote FROM ca, ha")
def champion_challenger(t: Tables):
    s = _scored(t)
    return drift.promote({"champion": drift.auc(s, "length", "quality", sliced.value_slice("length", 100)),
                          "challenger": drift.auc(s, "spaces", "quality", sliced.value_slice("spaces", 20))})


# ---------------------------------------------------------------- privacy


def _asked(t: Tables) -> DataFrame:
    """Customers in debt have asked to be forgotten."""
    return t.customer.where("c_acctbal < 0").select(F.col("c_custkey").alias("subject"))


def _scope(t: Tables) -> dict[str, DataFrame]:
    return {"customer": t.customer.withColumnRenamed("c_custkey", "subject"),
            "orders": t.orders.withColumnRenamed("o_custkey", "subject"),
            "events": t.events.withColumnRenamed("user_id", "subject")}


@query("""WITH g AS (SELECT c_custkey FROM customer WHERE c_acctbal < 0)
  SELECT 'orders' AS table_name, o_orderkey AS row_key, o_custkey AS subject FROM orders WHERE o_custkey NOT IN (FROM g)
  UNION ALL SELECT 'customer', c_custkey, c_custkey FROM customer WHERE c_custkey NOT IN (FROM g)
  UNION ALL SELECT 'events', event_id, user_id FROM events WHERE user_id NOT IN (FROM g)""")
def erase(t: Tables):
    """What is left of all three tables of the scope."""
    left = privacy.erase(_scope(t), _asked(t), "subject")
    keys = {"orders": "o_orderkey", "customer": "subject", "events": "event_id"}
    return reduce(DataFrame.unionByName, [left[n].select(F.lit(n).alias("table_name"), F.col(k).alias("row_key"), "subject") for n, k in keys.items()])


@query("""WITH g AS (SELECT c_custkey FROM customer WHERE c_acctbal < 0)
  SELECT 'customer' AS table_name, count(*) AS subject_rows FROM customer WHERE c_custkey IN (FROM g) UNION ALL SELECT 'orders', count(*) FROM orders WHERE o_custkey IN (FROM g)
  UNION ALL SELECT 'events', count(*) FROM events WHERE user_id IN (FROM g)""")
def erase_audit(t: Tables):
    return privacy.subject_rows(_scope(t), _asked(t), "subject")


@query("""WITH g AS (SELECT c_custkey FROM customer WHERE c_acctbal < 0), r AS (
  SELECT 'customer' AS table_name, count(*) AS rows_before, count(*) FILTER (c_custkey NOT IN (FROM g)) AS rows_after, CAST(0 AS BIGINT) AS residual, CAST(1 AS BIGINT) AS readable_versions FROM customer
  UNION ALL SELECT 'orders', count(*), count(*) FILTER (o_custkey NOT IN (FROM g)), 0, 1 FROM orders
  UNION ALL SELECT 'events', count(*), count(*) FILTER (user_id NOT IN (FROM g)), count(*) FILTER (user_id IN (FROM g)), 2 FROM events)
  SELECT *, rows_before - rows_after AS erased, residual = 0 AS attested, DATE '2001-08-20' + CASE table_name WHEN 'events' THEN 10 ELSE 3 END AS unrecoverable_at,
    CASE table_name WHEN 'events' THEN 'VERSION_EXPIRY' ELSE 'FILE_REMOVAL' END AS mechanism FROM r""")
def attest(t: Tables):
    """The old version of one table can still be read, so that table is not attested."""
    before = _scope(t)
    after = privacy.erase(before, _asked(t), "subject")
    readable = {n: [after[n]] for n in before}
    readable["events"] = [before["events"], after["events"]]
    rules = t.spark.sql("VALUES ('customer', 5, 3, true), ('orders', 5, 3, false), ('events', 7, 3, false) AS (table_name, version_days, noncurrent_days, pinned)")
    return privacy.unrecoverable(privacy.attest_erasure(before, readable, _asked(t), "subject"), rules, F.lit("2001-08-20").cast("date"))


@query("""WITH r AS (SELECT o_custkey, max(o_orderdate) AS requested FROM orders GROUP BY 1), d AS (SELECT *, CAST(date_diff('day', CAST(requested AS DATE), DATE '2001-08-20') AS INTEGER) AS days_open FROM r)
  SELECT *, CASE WHEN days_open > 30 THEN 'BREACHED' ELSE 'DUE_SOON' END AS state FROM d WHERE days_open >= 23""")
def deadline_watch(t: Tables):
    requests = t.orders.groupBy("o_custkey").agg(F.max("o_orderdate").alias("requested"))
    return privacy.deadline_watch(requests, "requested", "2001-08-20")


@query("""WITH g AS (SELECT c_mktsegment, c_nationkey, count(DISTINCT c_custkey) AS s, CAST(sum(CAST(c_acctbal AS DECIMAL(12,2))) AS DOUBLE) AS b FROM customer GROUP BY 1, 2)
  SELECT c_mktsegment, c_nationkey, CASE WHEN s >= 10 THEN s END AS subjects, CASE WHEN s >= 10 THEN b END AS balance, s < 10 AS suppressed FROM g""")
def k_anonymity(t: Tables):
    return privacy.suppress_small(t.customer, ["c_mktsegment", "c_nationkey"], "c_custkey",
                                  {"balance": F.sum(money("c_acctbal")).cast("double")}, k=10)


@query("""SELECT sha256('pepper' || c_custkey) AS c_custkey, c_nationkey, c_acctbal, c_mktsegment FROM customer""")
def deidentify(t: Tables):
    return privacy.deidentify(t.customer, ["c_custkey"], ["c_name"], "pepper")
