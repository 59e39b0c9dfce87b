"""Call rating, cell indicators and feature tables, bound to the input tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeops.catalog.registry import ORACLES, Tables, query
from lakeops.functions.columns import money
from lakeops.operators import cdc, features, publish, temporal
from lakeops.operators.quality import sigma_anomaly
from lakeops.operators.sliced import DAY
from lakeops.plans import telco
from lakeops.session import materialised, scratch
from lakeops.sources import tables

RUN = "2000-06-01"

# ---------------------------------------------------------------- rating

SERVICE = "CASE p_type WHEN 'ECONOMY' THEN 'VOICE' WHEN 'STANDARD' THEN 'VOICE' WHEN 'PROMO' THEN 'DATA' WHEN 'SMALL' THEN 'DATA' ELSE 'SMS' END"


def _service():
    kind = F.col("p_type")
    return (F.when(kind.isin("ECONOMY", "STANDARD"), "VOICE").when(kind.isin("PROMO", "SMALL"), "DATA")
            .otherwise("SMS"))


def _call_records(t: Tables) -> DataFrame:
    """Lines as calls: the part gives plan and service, the quantity the length."""
    li = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    seconds = ((F.col("l_quantity") - 2) * 2000).cast("int")
    return li.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("cdr_id"), F.lit("M1").alias("market"),
        F.col("l_shipdate").alias("event_ts"), F.col("l_shipdate").alias("source_ts"),
        F.struct("l_partkey", "l_suppkey", "l_extendedprice").alias("ingest_ts"),
        F.concat(F.lit("+1 ("), F.col("l_orderkey"), F.lit(")")).alias("a_number"),
        F.when(F.col("l_suppkey") > 3, F.concat(F.lit("+2-"), F.col("l_suppkey"))).alias("b_number"),
        seconds.alias("duration_sec"), (F.col("l_extendedprice") * 100).cast("bigint").alias("bytes_total"),
        _service().alias("service_type"), F.col("p_brand").alias("tariff_plan_id"))


def _tariffs(t: Tables) -> DataFrame:
    return t.part.where("p_size > 45").groupBy(_service().alias("service_type"), F.col("p_brand").alias("tariff_plan_id")).agg(
        F.lit("M1").alias("market"), F.min("p_size").alias("billing_increment_sec"),
        F.min(F.col("p_retailprice").cast("decimal(18,5)")).alias("unit_rate"))


CDR = f"""WITH c AS (SELECT l_orderkey || '-' || l_linenumber AS cdr_id, l_shipdate, l_orderkey, l_suppkey, CAST((l_quantity - 2) * 2000 AS INTEGER) AS dur,
    CAST(floor(l_extendedprice * 100) AS BIGINT) AS bytes_total, {SERVICE} AS service_type, p_brand,
    row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate DESC, l_partkey DESC, l_suppkey DESC, l_extendedprice DESC) AS rn
    FROM lineitem JOIN part ON l_partkey = p_partkey),
  tf AS (SELECT {SERVICE} AS service_type, p_brand, min(p_size) AS inc, min(CAST(p_retailprice AS DECIMAL(18,5))) AS rate FROM part WHERE p_size > 45 GROUP BY 1, 2),
  r AS (SELECT cdr_id, '+1' || l_orderkey AS a_number, CASE WHEN l_suppkey > 3 THEN '+2' || l_suppkey END AS b_number, greatest(dur, 0) AS duration_sec,
    c.service_type, CASE WHEN dur < 0 THEN 'NEGATIVE_DURATION' WHEN dur > 86400 THEN 'DURATION_OVER_24H' WHEN l_suppkey <= 3 THEN 'MISSING_B_NUMBER' ELSE 'OK' END AS quality_flag,
    CAST(CASE c.service_type WHEN 'VOICE' THEN ceil(greatest(dur, 0) / coalesce(inc, 60)) WHEN 'DATA' THEN ceil(bytes_total / 1048576.0) ELSE 1 END AS BIGINT) AS charged_units,
    coalesce(rate, 0) AS rate, CASE WHEN rate IS NULL THEN 'UNRATED_NO_TARIFF' ELSE 'RATED' END AS rated_flag, CAST(l_shipdate AS DATE) AS event_date
    FROM c LEFT JOIN tf ON c.service_type = tf.service_type AND c.p_brand = tf.p_brand WHERE rn = 1)"""


@query(CDR + """SELECT cdr_id, a_number, b_number, duration_sec, quality_flag, charged_units, rated_flag, event_date,
  CAST(charged_units * rate AS DOUBLE) AS charge_amount FROM r""")
def cdr_rating(t: Tables):
    got = telco.mediate(_call_records(t), _tariffs(t))
    return got.select("cdr_id", "a_number", "b_number", "duration_sec", "quality_flag", "charged_units", "rated_flag",
                      "event_date", F.col("charge_amount").cast("double").alias("charge_amount"))


# Orders by number modulo 5: 0 comes with the corrections only, 1 is corrected, 2 gets a correction that is older.
@query(CDR + """, k AS (SELECT *, CAST(split_part(cdr_id, '-', 1) AS BIGINT) % 5 AS part FROM r)
  SELECT cdr_id, event_date, quality_flag, rated_flag, charged_units + CASE part WHEN 1 THEN 7 ELSE 0 END AS charged_units, CAST(charged_units * rate AS DOUBLE) AS charge_amount,
    part IN (0, 1) AS from_corrections FROM k""")
def cdr_mediation(t: Tables):
    """Rated records published by month behind a gate; a batch with repeated records is refused, late corrections are merged in."""
    rated = telco.mediate(_call_records(t), _tariffs(t)).select(
        "cdr_id", "event_date", "source_ts", "quality_flag", "rated_flag", "charged_units", "charge_amount", F.trunc("event_date", "month").alias("event_month"), F.lit(False).alias("from_corrections"))
    rated = materialised(rated, "rated")
    part = F.split("cdr_id", "-")[0].cast("bigint") % 5
    rules = {"duration_known": F.col("charged_units") >= 0, "flagged": F.col("quality_flag").isNotNull(), "unrated_free": (F.col("rated_flag") == "RATED") | (F.col("charge_amount") == 0)}
    path = tables.table_path(scratch(t.spark, "mediated"), "silver", "cdr")
    publish.publish(rated.where(part != 0), path, ["event_month"], rules, ["cdr_id"])
    again = rated.where(part == 4).withColumn("charged_units", F.lit(0).cast("bigint"))
    try:
        publish.publish(again.unionByName(again), path, ["event_month"], rules, ["cdr_id"])
    except publish.GateError:
        pass  # the table keeps its rows, as the check of the result shows
    moved = F.when(part == 2, -1).otherwise(1)
    late = rated.where(part < 3).withColumns({
        "source_ts": F.timestamp_seconds(F.unix_seconds("source_ts") + moved), "from_corrections": F.lit(True),
        "charged_units": F.col("charged_units") + F.when(part == 1, 7).when(part == 2, 100).otherwise(0)})
    publish.upsert_slices(late, path, ["cdr_id"], "event_month", "source_ts", rules)
    return t.spark.read.parquet(path).select("cdr_id", "event_date", "quality_flag", "rated_flag", "charged_units",
                                             F.col("charge_amount").cast("double").alias("charge_amount"), "from_corrections")


@query(CDR + """SELECT service_type, quality_flag, rated_flag, count(*) AS records, CAST(sum(charged_units * rate) AS DOUBLE) AS charged FROM r GROUP BY 1, 2, 3""")
def cdr_rating_totals(t: Tables):
    return telco.mediate(_call_records(t), _tariffs(t)).groupBy("service_type", "quality_flag", "rated_flag").agg(
        F.count(F.lit(1)).alias("records"), F.sum("charge_amount").cast("double").alias("charged"))


BILLS = """WITH c AS (SELECT l_orderkey || '-' || l_linenumber AS bill_line_id, l_shipdate, CAST(l_extendedprice AS DECIMAL(18,5)) AS amount, l_returnflag,
    CASE l_linestatus WHEN 'F' THEN 'OWN' ELSE 'NET' || l_suppkey END AS net,
    row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate DESC, l_partkey DESC, l_suppkey DESC, l_extendedprice DESC) AS rn FROM lineitem)"""


@query(BILLS + """SELECT bill_line_id, CAST(l_shipdate AS DATE) AS event_date, CAST(amount AS DOUBLE) AS bill_amount, net = 'OWN' AS is_onnet,
  CASE WHEN net <> 'OWN' THEN net END AS partner_code FROM c WHERE rn = 1 AND l_returnflag <> 'R'""")
def bills_normalised(t: Tables):
    """Change records of bill lines, normalised and merged into an empty table with hard deletes."""
    op = F.when(F.col("l_returnflag") == "R", "D").when(F.col("l_returnflag") == "A", "U").otherwise("I")
    raw = t.lineitem.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("bill_line_id"), op.alias("op"),
        F.struct("l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice").alias("transact_seq"),
        F.col("l_shipdate").alias("transact_ts"), F.col("l_extendedprice").cast("decimal(12,2)").alias("bill_amount"),
        F.when(F.col("l_linestatus") == "F", "OWN").otherwise(F.concat(F.lit("NET"), "l_suppkey")).alias("terminating_network"))
    changes = telco.normalise_bills(raw)
    empty = changes.drop("op").where("false")
    merged = cdc.merge_cdc(empty, changes, ["bill_line_id"], version="transact_seq", delete_op="D", deleted=None, check=False)
    return merged.select("bill_line_id", "event_date", F.col("bill_amount").cast("double").alias("bill_amount"),
                         "is_onnet", "partner_code")


# ---------------------------------------------------------------- cells

# Which counter each event type stands for.
COUNTER_OF = {"click": "rrc_attempts", "view": "rrc_success", "signup": "call_attempts", "error": "call_drops",
              "purchase": "dl_bytes"}
KPI = """WITH w AS (SELECT time_bucket(INTERVAL 15 MINUTE, ts) AS window_start, user_id AS cell_id, c_nationkey AS site_id,
    sum(CAST(value AS DECIMAL(12,2))) FILTER (event_type='click') AS rrc_attempts, sum(CAST(value AS DECIMAL(12,2))) FILTER (event_type='view') AS rrc_success,
    sum(CAST(value AS DECIMAL(12,2))) FILTER (event_type='signup') AS call_attempts, sum(CAST(value AS DECIMAL(12,2))) FILTER (event_type='error') AS call_drops,
    coalesce(sum(CAST(value AS DECIMAL(12,2))) FILTER (event_type='purchase'), 0) AS total_bytes
    FROM events JOIN customer ON user_id = c_custkey WHERE c_mktsegment <> 'FURNITURE' GROUP BY 1, 2, 3)"""


def _counters(t: Tables) -> DataFrame:
    """Summed per cell, quarter of an hour and counter before they meet the cells' vendors."""
    vendor = t.customer.select(F.col("c_custkey").alias("cell_id"), F.col("c_mktsegment").alias("vendor"))
    quarter = F.window("ts", f"{telco.WINDOW_SECONDS} seconds")["start"].alias("counter_ts")
    summed = t.events.groupBy(F.col("user_id").alias("cell_id"), quarter, "event_type").agg(F.sum(money("value")).alias("counter_value"))
    return summed.join(vendor, "cell_id").select(
        "cell_id", "vendor", F.lit("R1").alias("region"), "counter_ts",
        F.concat_ws(".", F.lower("vendor"), "event_type").alias("counter_name"), "counter_value")


def _vendor_mapping(t: Tables) -> DataFrame:
    """Every vendor but one spells the counters its own way; the last one is not mapped at all."""
    vendors = t.customer.select(F.col("c_mktsegment").alias("vendor")).distinct().where("vendor <> 'FURNITURE'")
    pairs = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(v).alias("v")) for k, v in COUNTER_OF.items()])
    return vendors.select("vendor", F.explode(pairs).alias("p")).select(
        "vendor", F.concat_ws(".", F.lower("vendor"), "p.k").alias("vendor_counter"), F.col("p.v").alias("canonical_counter"))


@query(KPI + """SELECT window_start, cell_id, site_id, round(CAST(CASE WHEN rrc_attempts > 0 THEN 100.0 * rrc_success / rrc_attempts END AS DOUBLE), 4) AS rrc_success_rate,
  round(CAST(CASE WHEN call_attempts > 0 THEN 100.0 * call_drops / call_attempts END AS DOUBLE), 4) AS drop_call_rate, CAST(NULL AS DOUBLE) AS handover_success_rate,
  CAST(total_bytes AS DOUBLE) AS total_bytes FROM w""")
def kpi_pivot(t: Tables):
    topology = t.customer.select(F.col("c_custkey").alias("cell_id"), F.col("c_nationkey").alias("site_id"))
    got = telco.cell_indicators(_counters(t), _vendor_mapping(t), topology)
    rates = [F.col(c).cast("double").alias(c) for c in ("rrc_success_rate", "drop_call_rate", "handover_success_rate")]
    return got.select("window_start", "cell_id", "site_id", *rates, F.col("total_bytes").cast("double").alias("total_bytes"))


@query("""WITH s AS (SELECT user_id, avg(value) FILTER (ts < TIMESTAMP '2024-01-29') AS mu, stddev_samp(value) FILTER (ts < TIMESTAMP '2024-01-29') AS sigma,
    max(value) FILTER (ts >= TIMESTAMP '2024-01-29') AS current_value FROM events WHERE ts >= TIMESTAMP '2024-01-01' AND ts < TIMESTAMP '2024-01-31' GROUP BY 1)
  SELECT user_id, round(mu, 6) AS mu, round(sigma, 6) AS sigma, current_value FROM s WHERE sigma > 0 AND current_value > mu + 3 * sigma""")
def sigma_anomalies(t: Tables):
    got = sigma_anomaly(t.events, ["user_id"], "ts", "value", F.lit("2024-01-29").cast("timestamp"), 2 * DAY)
    return got.select("user_id", F.round("mu", 6).alias("mu"), F.round("sigma", 6).alias("sigma"), "current_value")


# ---------------------------------------------------------------- features

USAGE = f"""ev AS (SELECT o_custkey AS subscriber_id, CAST(o_orderdate AS DATE) AS event_date, date_diff('day', CAST(o_orderdate AS DATE), DATE '{RUN}') AS ago,
    CAST(floor(o_totalprice) AS BIGINT) AS dur, o_orderpriority AS b, o_orderstatus, CAST(o_totalprice AS DECIMAL(12,2)) AS charge FROM orders WHERE o_orderdate <= TIMESTAMP '{RUN}' AND o_orderdate > TIMESTAMP '{RUN}' - INTERVAL 90 DAY),
  sub AS (SELECT c_custkey AS subscriber_id, date_diff('day', CAST(min(o_orderdate) AS DATE), DATE '{RUN}') AS tenure_days FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY 1),
  ag AS (SELECT subscriber_id, CAST(sum(CASE WHEN ago < 7 THEN dur ELSE 0 END) AS BIGINT) AS v7, CAST(sum(CASE WHEN ago < 30 THEN dur ELSE 0 END) AS BIGINT) AS v30, CAST(sum(CASE WHEN ago < 90 THEN dur ELSE 0 END) AS BIGINT) AS v90,
    count(*) FILTER (ago < 30) AS e30, count(*) FILTER (ago < 30 AND o_orderstatus <> 'F') AS off30, count(DISTINCT b) FILTER (ago < 30) AS b30, count(DISTINCT b) FILTER (ago < 90) AS b90,
    sum(charge) FILTER (ago < 30) AS c30, sum(charge) FILTER (ago < 90) AS c90, min(ago) AS since FROM ev GROUP BY 1),
  us AS (SELECT sub.subscriber_id, tenure_days, CASE WHEN tenure_days >= 7 THEN coalesce(v7, 0) END AS voice_sec_7d, coalesce(v30, 0) AS voice_sec_30d, coalesce(v90, 0) AS voice_sec_90d,
    coalesce(e30, 0) AS events_30d, coalesce(b90, 0) AS distinct_b_90d, CAST(coalesce(c90, 0) AS DOUBLE) AS charge_90d,
    CASE WHEN v90 > 0 THEN round((v7 / 7.0) / (v90 / 90.0), 4) END AS voice_trend_7_90, CASE WHEN b90 > 0 THEN round(b30 * 3.0 / b90, 4) END AS social_graph_shrink,
    CASE WHEN e30 > 0 THEN round(off30 / CAST(e30 AS DOUBLE), 4) END AS offnet_share_30d, CASE WHEN tenure_days >= 7 THEN coalesce(since >= 7, true) END AS is_dormant_7d
    FROM sub LEFT JOIN ag ON sub.subscriber_id = ag.subscriber_id WHERE tenure_days >= 0)"""


def _subjects(t: Tables) -> DataFrame:
    """Customers with the days of their first and, if it was long ago, last order."""
    seen = t.orders.groupBy("o_custkey").agg(F.min("o_orderdate").alias("activation_date"),
                                             F.max("o_orderdate").alias("last_seen"))
    gone = F.when(F.col("last_seen") < F.lit("2001-01-01").cast("timestamp"), F.to_date("last_seen"))
    return (t.customer.join(seen, F.col("c_custkey") == F.col("o_custkey"))
            .select(F.col("c_custkey").alias("subscriber_id"), F.col("c_mktsegment").alias("segment"),
                    "activation_date", gone.alias("churn_date")))


def _usage(t: Tables) -> DataFrame:
    events = t.orders.select(
        F.col("o_custkey").alias("subscriber_id"), F.to_date("o_orderdate").alias("event_date"),
        F.floor("o_totalprice").alias("duration_sec"), F.lit("VOICE").alias("service_type"),
        F.lit(0).cast("bigint").alias("bytes_total"), money("o_totalprice").alias("charge_amount"),
        F.col("o_orderpriority").alias("b_number"), (F.col("o_orderstatus") == "F").alias("is_onnet"),
        F.lit("OK").alias("quality_flag"))
    return telco.usage_features(events, _subjects(t), RUN)


@query(f"WITH {USAGE} SELECT * FROM us")
def feat_usage(t: Tables):
    return _usage(t).select(
        "subscriber_id", "tenure_days", "voice_sec_7d", "voice_sec_30d", "voice_sec_90d", "events_30d", "distinct_b_90d",
        F.col("charge_90d").cast("double").alias("charge_90d"), "voice_trend_7_90",
        F.col("social_graph_shrink").cast("double").alias("social_graph_shrink"), "offnet_share_30d", "is_dormant_7d")


BILLING = f"""bl AS (SELECT o_custkey AS subscriber_id, o_orderdate AS d, o_orderkey AS id, o_totalprice AS amt, o_orderpriority = '1-URGENT' AS roam, o_totalprice > 300000 AS over,
    row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders WHERE o_orderdate <= TIMESTAMP '{RUN}' AND o_orderdate > TIMESTAMP '{RUN}' - INTERVAL 12 MONTH),
  bt AS (SELECT subscriber_id, CAST((2 * sum(CAST(round(amt * 100) AS BIGINT)) + count(*)) // (2 * count(*)) AS BIGINT) / 100.0 AS avg_bill_12m, round(stddev_samp(amt), 2) AS stddev_bill_12m, max(amt) AS max_bill_12m, count(*) AS bills_12m, count(*) FILTER (roam) AS roaming_months_12m,
    count(*) FILTER (over) AS overage_months_12m, max(amt) FILTER (rn = 1) AS last_bill_amount, quantile_disc(amt, 0.5) FILTER (rn > 1) AS median_bill_amount FROM bl GROUP BY 1),
  py AS (SELECT o_custkey AS subscriber_id, count(*) AS payments_12m, count(*) FILTER (date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) - 60 > 0) AS late_payments_12m,
    count(*) FILTER (l_returnflag = 'R') AS failed_payments_12m FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_shipdate <= TIMESTAMP '{RUN}' AND l_shipdate > TIMESTAMP '{RUN}' - INTERVAL 12 MONTH GROUP BY 1),
  bf AS (SELECT bt.*, payments_12m, late_payments_12m, failed_payments_12m, CASE WHEN median_bill_amount > 0 THEN round(last_bill_amount / median_bill_amount, 4) END AS bill_shock_ratio,
    CASE WHEN payments_12m > 0 THEN round(late_payments_12m / CAST(payments_12m AS DOUBLE), 4) END AS late_payment_rate_12m FROM bt LEFT JOIN py ON bt.subscriber_id = py.subscriber_id)"""


def _billing(t: Tables) -> DataFrame:
    bills = t.orders.select(
        F.col("o_custkey").alias("subscriber_id"), F.to_date("o_orderdate").alias("bill_date"), F.col("o_orderkey").alias("bill_id"),
        money("o_totalprice").alias("bill_amount"), (F.col("o_orderpriority") == "1-URGENT").alias("has_roaming"),
        (F.col("o_totalprice") > 300000).alias("has_overage"))
    late = F.datediff("l_shipdate", "o_orderdate") - 60
    payments = (t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
                .select(F.col("o_custkey").alias("subscriber_id"), F.to_date("l_shipdate").alias("payment_date"), late.alias("days_late"),
                        F.when(F.col("l_returnflag") == "R", "FAILED").otherwise("PAID").alias("payment_status")))
    return telco.billing_features(bills, payments, RUN)


@query(f"WITH {BILLING} SELECT * FROM bf")
def feat_billing(t: Tables):
    return _billing(t).select(
        "subscriber_id", "stddev_bill_12m", "bills_12m", "roaming_months_12m", "overage_months_12m",
        *[F.col(c).cast("double").alias(c) for c in ("avg_bill_12m", "max_bill_12m", "last_bill_amount", "median_bill_amount")],
        "payments_12m", "late_payments_12m",
        "failed_payments_12m", "bill_shock_ratio", "late_payment_rate_12m")


TOPIC_OF = {"error": "BILLING", "click": "NETWORK", "view": "DEVICE", "signup": "TARIFF", "purchase": "CANCELLATION"}
CARE = """c AS (SELECT user_id AS subscriber_id, CASE event_type WHEN 'error' THEN 'BILLING' WHEN 'click' THEN 'NETWORK' WHEN 'view' THEN 'DEVICE' WHEN 'signup' THEN 'TARIFF' ELSE 'CANCELLATION' END AS topic,
    CAST(ts AS DATE) AS d, event_id, value, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, date_diff('day', CAST(ts AS DATE), DATE '2024-01-25') AS ago FROM events WHERE CAST(ts AS DATE) <= DATE '2024-01-25'),
  r AS (SELECT *, date_diff('day', lag(d) OVER (PARTITION BY subscriber_id, topic ORDER BY d, event_id), d) <= 7 AS rep FROM c)
  SELECT subscriber_id, count(*) AS care_contacts_180d, CAST(sum(CASE WHEN ago < 7 THEN 1 ELSE 0 END) AS BIGINT) AS care_contacts_7d, count(*) FILTER (rep) AS repeat_contacts_180d,
  CAST(min(ago) AS INTEGER) AS days_since_last_contact, min(k) AS min_csat, count(*) FILTER (NOT k > 20) AS unresolved_180d, CAST(sum(CASE WHEN topic='BILLING' THEN 1 ELSE 0 END) AS BIGINT) AS care_billing_180d,
  CAST(sum(CASE WHEN topic='CANCELLATION' AND ago < 30 THEN 1 ELSE 0 END) AS BIGINT) AS care_cancellation_30d, round(count(*) FILTER (NOT k > 20) / CAST(count(*) AS DOUBLE), 4) AS unresolved_rate,
  sum(CASE WHEN topic='CANCELLATION' THEN 1 ELSE 0 END) > 0 AS asked_about_cancellation, count(*) FILTER (ago < 30) >= 3 OR count(*) FILTER (rep) >= 2 AS recent_escalation FROM r GROUP BY 1"""


@query(f"WITH {CARE}")
def feat_care(t: Tables):
    k = F.get_json_object("props", "$.k").cast("int")
    topic = F.coalesce(*[F.when(F.col("event_type") == e, F.lit(v)) for e, v in TOPIC_OF.items()])
    contacts = t.events.select(
        F.col("user_id").alias("subscriber_id"), F.to_date("ts").alias("contact_date"), F.col("event_id").alias("contact_id"),
        topic.alias("reason_category"), F.col("value").alias("handling_time_sec"), k.alias("csat_score"),
        (k > 20).alias("resolved"), F.col("event_type").alias("channel"))
    return telco.care_features(contacts, "2024-01-25").select(
        "subscriber_id", "care_contacts_180d", "care_contacts_7d", "repeat_contacts_180d", "days_since_last_contact", "min_csat",
        "unresolved_180d", "care_billing_180d", "care_cancellation_30d", "unresolved_rate", "asked_about_cancellation", "recent_escalation")


TOPUP = f"""tp AS (SELECT o_custkey AS subscriber_id, CAST(o_orderdate AS DATE) AS d, o_orderkey AS id, CAST(o_totalprice AS DECIMAL(12,2)) AS amt, o_orderpriority FROM orders
    WHERE o_orderstatus <> 'P' AND o_orderdate <= TIMESTAMP '{RUN}' AND o_orderdate > TIMESTAMP '{RUN}' - INTERVAL 720 DAY),
  gp AS (SELECT *, date_diff('day', lag(d) OVER (PARTITION BY subscriber_id ORDER BY d, id), d) AS gap FROM tp),
  tf AS (SELECT subscriber_id, count(*) AS topups_180d, CAST(sum(amt) AS DOUBLE) AS topup_amount_180d, CAST(quantile_disc(gap, 0.5) AS INTEGER) AS median_gap_days, round(avg(gap), 2) AS avg_gap_days, max(d) AS last_topup_date,
    count(DISTINCT o_orderpriority) AS distinct_channels, CAST(date_diff('day', max(d), DATE '{RUN}') AS INTEGER) AS days_since_last_topup FROM gp GROUP BY 1)"""


@query(f"""WITH {TOPUP} SELECT *, CASE WHEN median_gap_days > 0 THEN round(days_since_last_topup / CAST(median_gap_days AS DOUBLE), 3) END AS overdue_ratio,
  CASE WHEN median_gap_days > 0 THEN round(days_since_last_topup / CAST(median_gap_days AS DOUBLE), 3) END >= 2.0 AS is_overdue_2x FROM tf""")
def feat_topups(t: Tables):
    topups = t.orders.select(
        F.col("o_custkey").alias("subscriber_id"), F.to_date("o_orderdate").alias("topup_date"), F.col("o_orderkey").alias("topup_id"),
        money("o_totalprice").alias("topup_amount"), F.when(F.col("o_orderstatus") == "P", "FAILED").otherwise("SUCCESS").alias("status"),
        F.col("o_orderpriority").alias("channel"))
    return telco.topup_features(topups, RUN, days=720).select(
        "subscriber_id", "topups_180d", F.col("topup_amount_180d").cast("double").alias("topup_amount_180d"), "median_gap_days",
        "avg_gap_days", "last_topup_date", "distinct_channels", "days_since_last_topup", "overdue_ratio", "is_overdue_2x")


SCD2 = """{n}p AS (SELECT l_partkey, l_shipdate, max(l_extendedprice) AS price FROM lineitem WHERE l_linestatus = '{s}' GROUP BY ALL),
  {n}c AS (SELECT *, lag(price) OVER (PARTITION BY l_partkey ORDER BY l_shipdate) AS was FROM {n}p),
  {n} AS (SELECT l_partkey AS subscriber_id, price, l_shipdate AS vf, lead(l_shipdate) OVER (PARTITION BY l_partkey ORDER BY l_shipdate) AS vt FROM {n}c WHERE was IS NULL OR abs(price - was) > 0.01)"""


def _history(t: Tables, status: str) -> DataFrame:
    daily = t.lineitem.where(F.col("l_linestatus") == status).groupBy("l_partkey", "l_shipdate").agg(
        F.max("l_extendedprice").alias("price"))
    return temporal.derive_intervals(daily, "l_partkey", "l_shipdate", "price", 0.01, 365 * DAY).select(
        F.col("l_partkey").alias("subscriber_id"), "price", F.to_date("effective_start").alias("valid_from"),
        F.to_date("effective_end").alias("valid_to"))


@query("WITH " + SCD2.format(n="dv", s="F") + ", " + SCD2.format(n="ct", s="O") + f""", d AS (SELECT * FROM dv WHERE vf <= TIMESTAMP '{RUN}' AND (vt IS NULL OR vt > TIMESTAMP '{RUN}')),
  c AS (SELECT *, CASE WHEN price > 50000 THEN 'plan5G' ELSE 'plan4' END AS tariff_plan_id FROM ct WHERE vf <= TIMESTAMP '{RUN}' AND (vt IS NULL OR vt > TIMESTAMP '{RUN}'))
  SELECT c.subscriber_id, tariff_plan_id, c.price AS monthly_fee, d.price > 60000 AS is_5g_capable, CAST(date_diff('day', CAST(d.vf AS DATE), DATE '{RUN}') AS INTEGER) AS days_on_current_device,
  CAST(date_diff('day', DATE '{RUN}', CAST(c.vf AS DATE) + 100) AS INTEGER) AS days_to_contract_end, date_diff('day', DATE '{RUN}', CAST(c.vf AS DATE) + 100) <= 0 AS out_of_contract,
  date_diff('day', DATE '{RUN}', CAST(c.vf AS DATE) + 100) BETWEEN 0 AND 90 AS in_churn_window, NOT (d.price > 60000) AND tariff_plan_id = 'plan5G' AS paying_for_unusable_5g
  FROM c LEFT JOIN d ON c.subscriber_id = d.subscriber_id""")
def feat_device(t: Tables):
    devices = _history(t, "F").select(
        "subscriber_id", "valid_from", "valid_to", F.col("valid_from").alias("device_since"),
        F.date_sub("valid_from", 200).alias("device_launch_date"), (F.col("price") > 60000).alias("is_5g_capable"))
    contracts = _history(t, "O").select(
        "subscriber_id", "valid_from", "valid_to", F.when(F.col("price") > 50000, "plan5G").otherwise("plan4").alias("tariff_plan_id"),
        F.col("price").alias("monthly_fee"), F.col("valid_from").alias("contract_start_date"),
        F.date_add("valid_from", 100).alias("contract_end_date"))
    return telco.device_features(devices, contracts, RUN).select(
        "subscriber_id", "tariff_plan_id", "monthly_fee", "is_5g_capable", "days_on_current_device", "days_to_contract_end",
        "out_of_contract", "in_churn_window", "paying_for_unusable_5g")


NETWORK = f"""u AS (SELECT l_suppkey AS s, l_partkey AS c, count(*) AS n, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS sec, count(*) FILTER (l_returnflag = 'R') AS dr FROM lineitem
    WHERE l_shipdate <= TIMESTAMP '{RUN}' AND l_shipdate > TIMESTAMP '{RUN}' - INTERVAL 180 DAY GROUP BY 1, 2),
  q AS (SELECT l_partkey AS c, round(100.0 * count(*) FILTER (l_linestatus = 'F') / count(*), 4) AS drop_rate, round(avg(l_tax), 2) AS cong, round(avg(l_quantity), 3) AS mbps, arg_max(l_linestatus, (l_shipdate, l_linestatus)) AS tech FROM lineitem
    WHERE l_shipdate <= TIMESTAMP '{RUN}' AND l_shipdate > TIMESTAMP '{RUN}' - INTERVAL 180 DAY GROUP BY 1)
  SELECT s AS subscriber_id, round(sum(drop_rate * sec) / greatest(sum(sec), 1), 4) AS weighted_drop_rate_exposure, round(sum(mbps * sec) / greatest(sum(sec), 1), 4) AS weighted_throughput_exposure, arg_max(mbps, (sec, u.c)) AS home_cell_throughput, count(*) AS distinct_cells_30d, CAST(sum(dr) AS BIGINT) AS own_dropped_calls_30d,
  arg_max(u.c, (sec, u.c)) AS home_cell_id, arg_max(tech, (sec, u.c)) AS home_cell_technology, round(100.0 * sum(dr) / sum(n), 4) AS own_drop_rate_30d,
  CASE WHEN count(*) <= 3 THEN 'STATIC' WHEN count(*) <= 20 THEN 'LOCAL' ELSE 'MOBILE' END AS mobility_bucket FROM u LEFT JOIN q ON u.c = q.c GROUP BY 1"""


@query(f"WITH {NETWORK}")
def feat_network(t: Tables):
    records = t.lineitem.select(
        F.col("l_suppkey").alias("subscriber_id"), F.col("l_partkey").alias("cell_id"), F.to_date("l_shipdate").alias("event_date"),
        F.col("l_quantity").cast("bigint").alias("duration_sec"),
        F.when(F.col("l_returnflag") == "R", "DROPPED").otherwise("NORMAL").alias("call_end_cause"))
    cells = t.lineitem.select(
        F.col("l_partkey").alias("cell_id"), F.col("l_shipdate").alias("window_start"), F.lit(1).alias("call_attempts"),
        F.when(F.col("l_linestatus") == "F", 1).otherwise(0).alias("call_drops"), F.col("l_tax").alias("prb_utilisation"), F.col("l_quantity").alias("throughput_mbps"),
        F.col("l_linestatus").alias("technology"))
    return telco.network_features(records, cells, RUN, days=180).select(
        "subscriber_id", "weighted_drop_rate_exposure", "weighted_throughput_exposure", "home_cell_throughput", "distinct_cells_30d", "own_dropped_calls_30d", "home_cell_id",
        "home_cell_technology", "own_drop_rate_30d", "mobility_bucket")


BASE = f"""su AS (SELECT c_custkey AS subscriber_id, c_mktsegment AS segment, min(o_orderdate) AS act, CASE WHEN max(o_orderdate) < TIMESTAMP '2001-01-01' THEN CAST(max(o_orderdate) AS DATE) END AS churn
    FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY 1, 2),
  ba AS (SELECT * FROM su WHERE act < TIMESTAMP '{RUN}' + INTERVAL 1 DAY AND NOT coalesce(churn <= DATE '{RUN}', false))"""


def _assembled(t: Tables) -> DataFrame:
    base = telco.base_as_of(_subjects(t), RUN)
    wide = features.assemble(base, {"usage": _usage(t).drop("tenure_days", "feature_date"),
                                    "billing": _billing(t).drop("feature_date")}, "subscriber_id")
    return wide.withColumn("label_churned", features.future_label("churn_date", RUN, 180)).drop("churn_date")


@query(f"""WITH {BASE}, {USAGE}, {BILLING} SELECT ba.subscriber_id, segment, us.voice_sec_90d AS usage__voice_sec_90d, us.is_dormant_7d AS usage__is_dormant_7d,
  bf.bills_12m AS billing__bills_12m, bf.bill_shock_ratio AS billing__bill_shock_ratio,
  CASE WHEN churn IS NULL THEN 0 WHEN churn <= DATE '{RUN}' + 180 THEN 1 ELSE 0 END AS label_churned
  FROM ba LEFT JOIN us ON ba.subscriber_id = us.subscriber_id LEFT JOIN bf ON ba.subscriber_id = bf.subscriber_id""")
def assemble_360(t: Tables):
    return _assembled(t).select("subscriber_id", "segment", "usage__voice_sec_90d", "usage__is_dormant_7d", "billing__bills_12m",
                                "billing__bill_shock_ratio", "label_churned")


@query(f"""WITH {BASE}, l AS (SELECT subscriber_id, CASE WHEN churn IS NULL THEN 0 WHEN churn <= DATE '{RUN}' THEN NULL WHEN churn <= DATE '{RUN}' + 180 THEN 1 ELSE 0 END AS y FROM ba),
  s AS (SELECT y, CAST('0x' || substr(sha256('42:' || CAST(subscriber_id AS VARCHAR)), 1, 8) AS BIGINT) % 10000 < 8000 AS fit FROM l WHERE y IS NOT NULL)
  SELECT CASE WHEN fit THEN 'train' ELSE 'validation' END AS part, count(*) AS rows, CAST(sum(y) AS BIGINT) AS positives FROM s GROUP BY 1""")
def training_split(t: Tables):
    """Train and validation sizes and labels, of subjects whose label is known; the split hashes the key, so it is the same everywhere."""
    train, valid = features.hash_split(_assembled(t).where("label_churned is not null"), "subscriber_id")
    both = train.withColumn("part", F.lit("train")).unionByName(valid.withColumn("part", F.lit("validation")))
    return both.groupBy("part").agg(F.count(F.lit(1)).alias("rows"), F.sum("label_churned").alias("positives"))


#: The six domains of a subject and what each gives.
DOMAINS = {
    "usage": ["voice_sec_7d", "voice_sec_90d", "events_30d", "distinct_b_90d", "charge_90d", "voice_trend_7_90", "offnet_share_30d", "is_dormant_7d"],
    "billing": ["avg_bill_12m", "max_bill_12m", "bills_12m", "payments_12m", "late_payments_12m", "bill_shock_ratio", "late_payment_rate_12m"],
    "topups": ["topups_180d", "topup_amount_180d", "median_gap_days", "distinct_channels", "days_since_last_topup", "is_overdue_2x"],
    "network_experience": ["weighted_drop_rate_exposure", "weighted_throughput_exposure", "distinct_cells_30d", "own_dropped_calls_30d", "home_cell_id", "own_drop_rate_30d"],
    "care": ["care_contacts_180d", "care_contacts_7d", "repeat_contacts_180d", "min_csat", "unresolved_rate", "recent_escalation"],
    "device": ["monthly_fee", "is_5g_capable", "days_on_current_device", "days_to_contract_end", "in_churn_window"]}
FEATURES = [f"{d}__{c}" for d, cols in DOMAINS.items() for c in cols]
FEATURE_QUERY = {"usage": "feat_usage", "billing": "feat_billing", "topups": "feat_topups", "network_experience": "feat_network", "care": "feat_care", "device": "feat_device"}


def _subject_sql() -> str:
    listed = ", ".join(f"d_{d} AS ({ORACLES[q]})" for d, q in FEATURE_QUERY.items())
    columns = ", ".join(f"d_{d}.{c} AS {d}__{c}" for d, cols in DOMAINS.items() for c in cols)
    joins = " ".join(f"LEFT JOIN d_{d} ON ba.subscriber_id = d_{d}.subscriber_id" for d in DOMAINS)
    label = f"CASE WHEN churn IS NULL THEN 0 WHEN churn <= DATE '{RUN}' + 180 THEN 1 ELSE 0 END"
    known = f"DATE '{RUN}' + 180 <= (SELECT CAST(max(o_orderdate) AS DATE) FROM orders)"
    return f"WITH {BASE}, {listed}, wide AS (SELECT ba.subscriber_id, segment, {columns}, {label} AS label_churned, {known} AS label_is_observable FROM ba {joins})"


def _subject_360(t: Tables) -> DataFrame:
    """Six feature domains on the subjects of the run date, with the label and whether its horizon is over."""
    made = {"usage": feat_usage, "billing": feat_billing, "topups": feat_topups, "network_experience": feat_network, "care": feat_care, "device": feat_device}
    base = telco.base_as_of(_subjects(t), RUN).select("subscriber_id", "segment", "churn_date")
    wide = features.assemble(base, {d: made[d](t).select("subscriber_id", *cols) for d, cols in DOMAINS.items()}, "subscriber_id")
    until = t.orders.agg(F.max("o_orderdate")).scalar()
    return wide.withColumns({"label_churned": features.future_label("churn_date", RUN, 180), "label_is_observable": features.observable(RUN, 180, until)}).drop("churn_date")


@query(_subject_sql() + " SELECT * FROM wide")
def subject_360(t: Tables):
    return _subject_360(t).select("subscriber_id", "segment", *FEATURES, "label_churned", "label_is_observable")


SUMMED = ["usage__events_30d", "billing__bills_12m", "topups__topups_180d", "care__care_contacts_180d", "network_experience__distinct_cells_30d", "device__days_on_current_device"]


@query(_subject_sql() + f""", x AS (SELECT *, CAST('0x' || substr(sha256('42:' || CAST(subscriber_id AS VARCHAR)), 1, 8) AS BIGINT) % 10000 < 8000 AS fit, {' + '.join(f'coalesce({c}, 0)' for c in SUMMED)} AS total FROM wide),
  y AS (SELECT CASE WHEN fit THEN 'train' ELSE 'validation' END AS part, label_churned AS first, total FROM x WHERE label_is_observable UNION ALL SELECT 'inference', subscriber_id, total FROM x)
  SELECT part, count(*) AS rows, CAST({len(FEATURES) + 1} AS INTEGER) AS columns, CAST(sum(first) AS BIGINT) AS first_column, CAST(sum(total) AS BIGINT) AS total FROM y GROUP BY part""")
def model_sets(t: Tables):
    """Train, validation and inference files written without a header and read back by position."""
    paths = features.write_model_sets(_subject_360(t), "subscriber_id", "label_churned", "label_is_observable", FEATURES, scratch(t.spark, "model-sets"))
    parts = []
    for name, path in paths.items():
        back = t.spark.read.schema(", ".join(["first double", *(f"`{c}` double" for c in FEATURES)])).csv(path)
        parts.append(back.agg(F.count(F.lit(1)).alias("rows"), F.sum("first").cast("long").alias("first_column"), F.sum(sum((F.col(c) for c in SUMMED), F.lit(0))).cast("long").alias("total"))
                     .select(F.lit(name).alias("part"), "rows", F.lit(len(back.columns)).alias("columns"), "first_column", "total"))
    return reduce(DataFrame.unionByName, parts)


@query("""WITH s AS (SELECT doc_id, lang, least(n_chars / 20000.0, 1.0) AS score FROM documents),
  r AS (SELECT *, CAST(ntile(10) OVER (PARTITION BY lang ORDER BY score DESC, doc_id) AS INTEGER) AS risk_decile FROM s)
  SELECT doc_id, lang, score, risk_decile, CASE WHEN risk_decile = 1 THEN 'CRITICAL' WHEN risk_decile <= 2 THEN 'HIGH' WHEN risk_decile <= 5 THEN 'MEDIUM' ELSE 'LOW' END AS risk_band FROM r""")
def score_publish(t: Tables):
    from lakeops.operators.quality import assert_distribution
    scores = t.documents.select("doc_id", F.least(F.col("n_chars") / 20000.0, F.lit(1.0)).alias("score"))
    assert_distribution(scores, "score")
    got = telco.publish_scores(scores, t.documents.select("doc_id", "lang"), "score", "lang", "doc_id")
    return got.select("doc_id", "lang", "score", "risk_decile", "risk_band")
