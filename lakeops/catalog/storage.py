"""Sources, sinks, versions, layout and streams: what goes to files and comes back.

Everything is written below the folder named by ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeops.catalog.registry import Tables, query
from lakeops.functions.columns import money
from lakeops.operators import features, joins, layout, quality, versions
from lakeops.plans import retail
from lakeops.session import materialised, scratch
from lakeops.sources import dialects, tables
from lakeops.streaming import feeds

# ---------------------------------------------------------------- dialects

CALLS = """SELECT '1' || l_orderkey AS a_number, CASE WHEN l_suppkey > 5 THEN '2' || l_partkey END AS b_number, l_shipdate AS event_ts,
  CAST(l_quantity * 45 AS INTEGER) AS duration_sec, CAST(l_linenumber AS INTEGER) AS charged_units, CAST(CAST(l_extendedprice AS DECIMAL(18,5)) AS DOUBLE) AS charge_amount FROM lineitem"""


def _calls(t: Tables) -> DataFrame:
    return t.lineitem.select(
        F.concat(F.lit("1"), "l_orderkey").alias("a"), F.when(F.col("l_suppkey") > 5, F.concat(F.lit("2"), "l_partkey")).alias("b"),
        F.col("l_shipdate").alias("ts"), (F.col("l_quantity") * 45).cast("int").alias("sec"),
        F.col("l_linenumber").cast("int").alias("units"), F.col("l_extendedprice").cast("decimal(18,5)").alias("amount"))


def _read_back(t: Tables, fmt: str, path: str) -> DataFrame:
    got = dialects.read_partner(t.spark, fmt, path, "P1", "EUR", "2001-01-01")
    quality.assert_parse_rate(got, ["event_ts", "charge_amount"])
    return got.select("a_number", "b_number", "event_ts", "duration_sec", "charged_units",
                      F.col("charge_amount").cast("double").alias("charge_amount"))


@query(CALLS)
def dialect_parquet(t: Tables):
    path = scratch(t.spark, "tap3")
    _calls(t).toDF(*dialects.TAP3).write.parquet(path)
    return _read_back(t, "tap3", path)


@query(CALLS)
def dialect_positional_csv(t: Tables):
    path = scratch(t.spark, "csv1")
    (_calls(t).select("a", "b", F.date_format("ts", "ddMMyyyy").alias("d"), F.date_format("ts", "HHmmss").alias("h"), "sec", "units", "amount")
     .write.csv(path))
    return _read_back(t, "csv_v1", path)


@query(CALLS)
def dialect_minutes_csv(t: Tables):
    path = scratch(t.spark, "csv2")
    (_calls(t).select("a", "b", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), (F.col("sec") / 60).alias("m"), "units", "amount")
     .toDF(*dialects.CSV_V2).write.option("header", True).csv(path))
    return _read_back(t, "csv_v2", path)


@query(CALLS.replace("CASE WHEN l_suppkey > 5 THEN '2' || l_partkey END", "CASE WHEN l_suppkey > 5 THEN '2' || l_partkey ELSE '' END"))
def dialect_fixed_width(t: Tables):
    path = scratch(t.spark, "fixed")
    implied = (F.col("amount") * dialects.IMPLIED_DECIMALS).cast("bigint").cast("string")
    (_calls(t).select(F.concat(
        F.rpad("a", 15, " "), F.rpad(F.coalesce("b", F.lit("")), 15, " "), F.date_format("ts", "yyyyMMddHHmmss"),
        F.lpad(F.col("sec").cast("string"), 8, "0"), F.lpad(F.col("units").cast("string"), 8, "0"), F.lpad(implied, 15, "0")))
     .write.text(path))
    return _read_back(t, "fixed_width", path)


@query("""SELECT lang, count(*) AS records, count(*) FILTER (lang IS NULL) AS corrupt FROM (SELECT CASE WHEN lang <> 'es' THEN lang END AS lang FROM documents) GROUP BY 1""")
def permissive_json(t: Tables):
    """Spanish documents are written as broken records; they are kept as text, not lost."""
    path = scratch(t.spark, "json")
    good = F.to_json(F.struct("doc_id", "lang"))
    t.documents.select(F.when(F.col("lang") == "es", F.concat(F.lit("{broken "), "doc_id")).otherwise(good)).write.text(path)
    schema = t.documents.select("doc_id", "lang").schema
    got = tables.read_json_permissive(t.spark, path, schema)
    return got.groupBy("lang").agg(F.count(F.lit(1)).alias("records"), F.count("_corrupt").alias("corrupt"))


@query("""SELECT c_custkey, upper(c_mktsegment) AS segment, CAST(c_nationkey AS VARCHAR) AS city, CAST(2 AS INTEGER) AS tags FROM customer""")
def declared_json(t: Tables):
    path = scratch(t.spark, "nested")
    (t.customer.select("c_custkey", F.struct(F.col("c_nationkey").cast("string").alias("city"), F.col("c_mktsegment").alias("state")).alias("ship_address"),
                       F.array("c_mktsegment", "c_name").alias("promo_codes")).write.json(path))
    schema = "c_custkey bigint, promo_codes array<string>, ship_address struct<city: string, state: string>"
    return t.spark.read.schema(schema).json(path).select(
        "c_custkey", F.upper("ship_address.state").alias("segment"), F.col("ship_address.city").alias("city"), F.size("promo_codes").alias("tags"))


@query("""SELECT p_partkey, p_name, p_size, p_retailprice FROM part""")
def declared_csv(t: Tables):
    path = scratch(t.spark, "parts")
    t.part.select("p_partkey", "p_name", "p_size", "p_retailprice").write.option("header", True).csv(path)
    return t.spark.read.schema("p_partkey bigint, p_name string, p_size int, p_retailprice double").option("header", True).csv(path)


@query("""SELECT CAST(o_orderkey AS VARCHAR) AS order_id, upper(o_orderpriority) AS region, lower(o_orderstatus) AS order_status,
  CASE WHEN o_orderstatus = 'P' THEN 'unknown' ELSE 'web' END AS channel, CAST(o_orderdate AS DATE) AS order_date, CAST(o_custkey AS VARCHAR) AS city FROM orders""")
def retail_silver(t: Tables):
    """Orders written as untidy raw records, each one twice, and cleaned."""
    path = scratch(t.spark, "raw-orders")
    raw = t.orders.select(
        F.col("o_orderkey").cast("string").alias("order_id"), F.col("o_custkey").cast("string").alias("customer_id"),
        F.lit(" A@B.C ").alias("customer_email"), F.concat(F.lit(" "), F.lower("o_orderpriority"), F.lit(" ")).alias("region"),
        F.when(F.col("o_orderstatus") != "P", "web").alias("channel"), F.col("o_orderstatus").alias("order_status"),
        F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("order_ts"), F.lit("USD").alias("currency"),
        F.array("o_orderpriority").alias("promo_codes"), F.struct(F.col("o_custkey").cast("string").alias("city"), F.lit("S").alias("state")).alias("ship_address"),
        F.lit("2002-01-02 00:00:00").alias("ingested_at"))
    stale = raw.withColumns({"order_status": F.lit("DRAFT"), "ingested_at": F.lit("2002-01-01 00:00:00")})
    raw.unionByName(stale).write.json(path)
    return retail.clean_orders(t.spark.read.schema(retail.ORDER_SCHEMA).json(path)).select(
        "order_id", "region", "order_status", "channel", "order_date", "city")


# ---------------------------------------------------------------- tables and slices


@query("""SELECT strftime(time_bucket(INTERVAL 30 MINUTE, ts), '%Y%m%d-%H%M') AS _batch_id, count(*) AS n FROM events GROUP BY 1""")
def half_hour_batches(t: Tables):
    path = tables.table_path(scratch(t.spark, "feed"), "raw", "events")
    t.events.withColumn("day", F.to_date("ts")).write.partitionBy("day").parquet(path)
    slot = F.timestamp_seconds(F.floor(F.unix_seconds("ts") / 1800) * 1800)
    got = tables.read_batches(t.spark, f"{path}/day=*", F.date_format(slot, "yyyyMMdd-HHmm"))
    return got.groupBy("_batch_id").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT CAST(ts AS DATE) AS dt, count(*) AS n FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-09 18:00:00' AND TIMESTAMP '2024-01-11' GROUP BY 1""")
def pruned_window(t: Tables):
    """A window over a table by day: directories are pruned on the day, rows filtered on the time."""
    path = tables.write_table(t.events.withColumn("dt", F.to_date("ts")), scratch(t.spark, "by-day"), "raw", "events", ["dt"])
    got = t.spark.read.parquet(path).where(F.col("dt").between(F.lit("2024-01-09").cast("date"), F.lit("2024-01-11").cast("date")))
    inside = F.col("ts").between(F.lit("2024-01-09 18:00:00").cast("timestamp"), F.lit("2024-01-11").cast("timestamp"))
    return got.where(inside).groupBy("dt").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT o_orderpriority, count(*) AS lines FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1""")
def cross_format_join(t: Tables):
    """Orders kept as JSON joined to lines kept as Parquet."""
    path = scratch(t.spark, "orders-json")
    t.orders.select("o_orderkey", "o_orderpriority").write.json(path)
    o = t.spark.read.schema("o_orderkey bigint, o_orderpriority string").json(path)
    per_order = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("c"))
    return o.join(per_order, "o_orderkey").groupBy("o_orderpriority").agg(F.sum("c").alias("lines"))


@query("""SELECT 'b1' AS _batch_id, DATE '2024-02-01' AS extract_date, TIMESTAMP '2024-02-01 05:00:00' AS _ingested_at, count(*) AS n, true AS has_file FROM events""")
def audit_columns(t: Tables):
    raw = t.spark.read.parquet(f"{t.root}/events.parquet")
    got = tables.with_audit(raw, "b1", "2024-02-01", F.lit("2024-02-01 05:00:00").cast("timestamp"))
    return got.groupBy("_batch_id", "extract_date", "_ingested_at").agg(
        F.count(F.lit(1)).alias("n"), F.bool_and(F.col("_src_file").contains("events.parquet")).alias("has_file"))


@query("""SELECT o_orderstatus, o_orderkey, CASE WHEN o_orderstatus = 'F' THEN o_totalprice * 2 ELSE o_totalprice END AS o_totalprice FROM orders""")
def slice_replace(t: Tables):
    """One slice is written again, twice, with new values; the others stay as they were."""
    path = tables.write_table(t.orders.select("o_orderkey", "o_totalprice", "o_orderstatus"), scratch(t.spark, "slices"),
                              "silver", "orders", ["o_orderstatus"])
    again = t.orders.where("o_orderstatus = 'F'").select("o_orderkey", (F.col("o_totalprice") * 2).alias("o_totalprice"), "o_orderstatus")
    for _ in range(2):
        tables.overwrite_slices(again, path, ["o_orderstatus"])
    return tables.read_table(t.spark, path.rsplit("/", 2)[0], "silver", "orders")


@query("""SELECT CAST(ts AS DATE) AS day, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(12,2))) AS DOUBLE) AS total FROM events GROUP BY 1""")
def refreshed_aggregate(t: Tables):
    """A stored daily aggregate built from part of the data and refreshed for the last week, twice."""
    daily = lambda df: df.groupBy("day").agg(F.count(F.lit(1)).alias("n"), F.sum(money("value")).cast("double").alias("total"))
    e = t.events.withColumn("day", F.to_date("ts"))
    path = tables.table_path(scratch(t.spark, "mv"), "gold", "daily")
    tables.overwrite_slices(daily(e.where("event_type <> 'error' or day < date'2024-01-24'")), path, ["day"])
    for _ in range(2):
        tables.refresh_slice(e, daily, path, "day", F.lit("2024-01-24").cast("date"))
    return t.spark.read.parquet(path)


@query("""SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1""")
def create_table_as(t: Tables):
    """CREATE TABLE AS with partitions, read again through a second table over the same files."""
    path, tag = scratch(t.spark, "ctas"), uuid.uuid4().hex
    t.orders.select("o_orderkey", "o_totalprice", "o_orderstatus").createOrReplaceTempView(f"src_{tag}")
    t.spark.sql(f"CREATE TABLE made_{tag} USING parquet PARTITIONED BY (o_orderstatus) LOCATION '{path}' AS SELECT * FROM src_{tag}")
    t.spark.sql(f"CREATE TABLE seen_{tag} (o_orderkey BIGINT, o_totalprice DOUBLE, o_orderstatus STRING) USING parquet PARTITIONED BY (o_orderstatus) LOCATION '{path}'")
    t.spark.sql(f"MSCK REPAIR TABLE seen_{tag}")
    return t.spark.sql(f"SELECT o_orderstatus, count(*) AS n FROM seen_{tag} GROUP BY o_orderstatus")


@query("""SELECT o_orderstatus, count(*) AS n, CAST(min(o_totalprice) AS DOUBLE) AS least, 'second' AS release FROM orders GROUP BY 1""")
def create_or_replace(t: Tables):
    """A table that is made, then replaced by one with another schema and other properties."""
    table, o = f"replaced_{uuid.uuid4().hex}", t.orders
    tables.create_or_replace(o.where("o_orderstatus = 'F'").select("o_orderkey"), table, scratch(t.spark, "first-table"), {"release": "first", "only": "here"})
    tables.create_or_replace(o.select("o_orderkey", "o_totalprice", "o_orderstatus"), table, scratch(t.spark, "second-table"), {"release": "second"}, ["o_orderstatus"])
    known = {r["key"]: r["value"] for r in t.spark.sql(f"SHOW TBLPROPERTIES {table}").collect()}
    return t.spark.table(table).groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.min("o_totalprice").alias("least")).withColumn(
        "release", F.lit(known["release"] if "only" not in known else "mixed"))


@query("""SELECT CASE o_orderstatus WHEN 'F' THEN 'c1' WHEN 'O' THEN 'c2' ELSE 'c3' END AS _commit, o_orderkey FROM orders""")
def append_commits(t: Tables):
    """Three commits added one after the other, one of them told twice."""
    path = scratch(t.spark, "appended")
    for status, commit in (("F", "c1"), ("O", "c2"), ("P", "c3"), ("O", "c2")):
        tables.append_commit(t.orders.where(F.col("o_orderstatus") == status).select("o_orderkey"), path, commit)
    return t.spark.read.parquet(path).select("_commit", "o_orderkey")


@query("""SELECT 'orders' AS table_name, count(*) > 0 AS passed FROM orders UNION ALL SELECT 'events', count(*) > 0 FROM events
  UNION ALL SELECT 'dear', count(*) > 0 FROM orders WHERE o_totalprice > 1e12""")
def not_empty(t: Tables):
    return quality.not_empty({"orders": t.orders, "events": t.events, "dear": t.orders.where("o_totalprice > 1e12")})


@query("""SELECT o_orderstatus, CASE o_orderstatus WHEN 'F' THEN count(DISTINCT o_orderkey % 6) FILTER (o_orderkey % 2 = 0) ELSE 0 END AS added_files,
    CASE o_orderstatus WHEN 'F' THEN count(DISTINCT o_orderkey % 6) ELSE 0 END AS deleted_files, CASE o_orderstatus WHEN 'F' THEN 0 ELSE count(DISTINCT o_orderkey % 6) END AS kept_files,
    CASE o_orderstatus WHEN 'F' THEN count(*) FILTER (o_orderkey % 2 = 0) ELSE 0 END AS added_rows, CASE o_orderstatus WHEN 'F' THEN count(*) ELSE 0 END AS deleted_rows,
    CASE o_orderstatus WHEN 'F' THEN 0 ELSE count(*) END AS kept_rows FROM orders GROUP BY 1""")
def commit_summary(t: Tables):
    """One slice is replaced: files and rows added, deleted and kept, from the listings before and after."""
    path, files = scratch(t.spark, "commits"), F.col("o_orderkey") % 6
    rows = t.orders.select("o_orderkey", "o_orderstatus", "o_totalprice").withColumn("_file", files).repartition(12, "o_orderstatus", "_file")
    rows.write.partitionBy("o_orderstatus", "_file").parquet(path)
    before = materialised(layout.file_listing(t.spark, path, ["o_orderstatus"]), "listing")
    slice_ = rows.where("o_orderstatus = 'F' and o_orderkey % 2 = 0")
    tables.replace_slice(slice_, path, "o_orderstatus", "F", ["_file"])
    return layout.commit_summary(before, layout.file_listing(t.spark, path, ["o_orderstatus"]))


@query("""SELECT count(*) AS rows, count(l.quality) AS labelled FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""")
def training_csv(t: Tables):
    """Label first, no header; a missing feature is 0 with an indicator beside it."""
    path = scratch(t.spark, "train")
    wide = t.documents.select("doc_id", "n_chars").join(t.labels, "doc_id", "left").withColumn("y", F.lit(1))
    features.write_training_csv(wide, "y", ["n_chars", "quality"], path)
    back = t.spark.read.schema("y int, n_chars double, n_chars_missing int, quality double, quality_missing int").csv(path)
    return back.agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("quality_missing") == 0).alias("labelled"))


@query("""SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY 1""")
def report_csv(t: Tables):
    """A report of a few rows as one file with a header."""
    path = scratch(t.spark, "report")
    t.customer.groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n")).coalesce(1).write.option("header", True).csv(path)
    return t.spark.read.schema("c_mktsegment string, n bigint").option("header", True).csv(path)


@query("""SELECT DISTINCT CAST(score AS DOUBLE) AS score, doc_id FROM (SELECT doc_id, least(n_chars / 20000.0, 1.0) AS score FROM documents)""")
def headerless_scores(t: Tables):
    path = scratch(t.spark, "scores")
    t.documents.select("doc_id", F.least(F.col("n_chars") / 20000.0, F.lit(1.0))).write.csv(path)
    return t.spark.read.csv(path).toDF("doc_id", "score").select(F.col("doc_id").cast("bigint"), F.col("score").cast("double"))


# ---------------------------------------------------------------- versions

DAY1 = dt.datetime(2024, 3, 1, 12)


def _at(days: int) -> dt.datetime:
    return DAY1 + dt.timedelta(days=days)


def _orders_table(t: Tables) -> versions.VersionedTable:
    """Three commits: closed, open, and pending orders."""
    table = versions.VersionedTable(t.spark, scratch(t.spark, "orders-table"))
    small = t.orders.select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    for i, status in enumerate(("F", "O", "P")):
        table.publish(small.where(F.col("o_orderstatus") == status), "append", _at(i))
    return table


def _count(df: DataFrame, what: str) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(what).alias("what"), "rows")


def _stack(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


@query("""WITH c AS (SELECT count(*) FILTER (o_orderstatus='F') AS f, count(*) FILTER (o_orderstatus='O') AS o, count(*) AS n FROM orders)
  SELECT 'version 1' AS what, f AS rows FROM c UNION ALL SELECT 'just before commit 3', f + o FROM c UNION ALL SELECT 'at commit 2', f FROM c
  UNION ALL SELECT 'tag', f + o FROM c UNION ALL SELECT 'rolled back', f FROM c UNION ALL SELECT 'forward again', n FROM c""")
def time_travel(t: Tables):
    """Reading by number, by time (strictly older) and by tag; rolling back and forward."""
    table = _orders_table(t)
    table.tag("audit", 2, _at(3), keep_days=30)
    parts = [_count(table.read(version=1), "version 1"),
             _count(table.read(timestamp=_at(2) - dt.timedelta(seconds=1)), "just before commit 3"),
             _count(table.read(timestamp=_at(1)), "at commit 2"), _count(table.read(tag="audit"), "tag")]
    table.set_current(1, _at(4))
    parts.append(_count(table.read(), "rolled back"))
    table.set_current(3, _at(5))
    parts.append(_count(table.read(), "forward again"))
    return _stack(*parts)


@query("""WITH c AS (SELECT o_orderstatus AS s, count(*) AS n FROM orders GROUP BY 1)
  SELECT CAST(CASE s WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 3 END AS BIGINT) AS version, 'append' AS operation, n AS added_rows, true AS is_current_ancestor FROM c""")
def version_history(t: Tables):
    return _orders_table(t).history().select("version", "operation", "added_rows", "is_current_ancestor")


@query("""SELECT 'main' AS name, 'branch' AS kind, CAST(3 AS BIGINT) AS version, count(*) AS table_rows FROM orders
  UNION ALL SELECT 'close', 'tag', 1, count(*) FROM orders""")
def version_refs(t: Tables):
    table = _orders_table(t)
    table.tag("close", 1, _at(3))
    return table.refs().select("name", "kind", "version").withColumn(
        "table_rows", table.read().agg(F.count(F.lit(1))).scalar())


@query("""WITH c AS (SELECT count(*) AS n, count(*) FILTER (o_orderstatus <> 'P') AS live FROM orders)
  SELECT 'rejected batch' AS what, live AS rows FROM c UNION ALL SELECT 'accepted batch', n FROM c""")
def write_audit_publish(t: Tables):
    """A batch with repeated keys is audited beside the live table and kept out; the corrected one goes in."""
    table = versions.VersionedTable(t.spark, scratch(t.spark, "wap"))
    small = t.orders.select("o_orderkey", "o_orderstatus", "o_totalprice")
    table.publish(small.where("o_orderstatus <> 'P'"), "append", _at(0))
    audit = lambda df: quality.check_columns(df, {
        "o_orderkey": {"unique_check": {"equal_to": 0}, "null_check": {"equal_to": 0}}, "o_totalprice": {"min": {"geq_to": 0}}})
    good = small.where("o_orderstatus = 'P'")
    table.write_audit_publish(good.union(good), _at(1), audit)
    rejected = _count(table.read(), "rejected batch")
    table.write_audit_publish(good, _at(2), audit)
    return _stack(rejected, _count(table.read(), "accepted batch"))


@query("""WITH a AS (SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderstatus = 'O' THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice FROM orders WHERE o_orderstatus <> 'P') SELECT * FROM a""")
def update_and_delete(t: Tables):
    table = versions.VersionedTable(t.spark, scratch(t.spark, "dml"))
    table.publish(t.orders.select("o_orderkey", "o_orderstatus", "o_totalprice"), "append", _at(0))
    table.update_where("o_orderstatus = 'O'", {"o_totalprice": F.col("o_totalprice") + 1}, _at(1))
    table.delete_where("o_orderstatus = 'P'", _at(2))
    return table.read()


@query("""SELECT count(*) FILTER (o_orderstatus = 'P') AS added, count(*) FILTER (o_orderstatus = 'F' AND o_totalprice > 300000) AS deleted,
  count(*) FILTER (o_orderstatus = 'O') AS changed, count(*) FILTER (o_orderstatus = 'F' AND o_totalprice <= 300000) AS unchanged FROM orders""")
def version_diff(t: Tables):
    o = t.orders.select("o_orderkey", "o_orderstatus", "o_totalprice")
    table = versions.VersionedTable(t.spark, scratch(t.spark, "diff"))
    table.publish(o.where("o_orderstatus <> 'P'"), "append", _at(0))
    new = (o.where("not (o_orderstatus = 'F' and o_totalprice > 300000)")
           .withColumn("o_totalprice", F.when(F.col("o_orderstatus") == "O", F.col("o_totalprice") * 2).otherwise(F.col("o_totalprice"))))
    table.publish(new, "overwrite", _at(1))
    return versions.diff_versions(table.read(version=1), table.read(version=2), ["o_orderkey"])


@query("""SELECT 'kept' AS what, count(*) AS rows FROM orders UNION ALL SELECT 'expired versions', 1""")
def expire_versions(t: Tables):
    """The untagged old version goes, the tagged one and the directories still in use stay."""
    table = _orders_table(t)
    table.tag("keep", 1, _at(3))
    table.expire(older_than=_at(10), retain_last=1, at=_at(11))
    return _stack(_count(table.read(), "kept"),
                  table.log().where("action = 'expire'").agg(F.count(F.lit(1)).alias("rows")).select(
                      F.lit("expired versions").alias("what"), "rows"))


@query("""SELECT 'live rows' AS what, count(*) AS rows FROM orders UNION ALL SELECT 'stray directories', 1""")
def unreferenced_files(t: Tables):
    """A data directory no version knows of is reported, and left where it is."""
    table = _orders_table(t)
    t.orders.select("o_orderkey").write.parquet(f"{table.path}/data/v=99")
    stray = table.unreferenced(older_than=dt.datetime(2100, 1, 1), now=dt.datetime(2100, 1, 3))
    live = _count(table.read(), "live rows")
    return live.unionByName(live.select(F.lit("stray directories").alias("what"), F.lit(len(stray)).cast("bigint").alias("rows")))


@query("""SELECT o_orderkey, o_orderpriority AS priority, CAST(CASE WHEN o_orderstatus <> 'F' THEN 'web' END AS VARCHAR) AS channel, CAST(o_custkey AS BIGINT) AS o_custkey, CAST(o_totalprice AS DOUBLE) AS o_totalprice FROM orders""")
def schema_evolution(t: Tables):
    """Old files with an old name, a narrower type and no channel, read together with new ones."""
    path = scratch(t.spark, "evolve")
    (t.orders.where("o_orderstatus = 'F'").select("o_orderkey", "o_orderpriority", F.col("o_custkey").cast("int").alias("o_custkey"), "o_totalprice", "o_orderdate")
     .write.parquet(f"{path}/old"))
    (t.orders.where("o_orderstatus <> 'F'").select("o_orderkey", F.col("o_orderpriority").alias("priority"), F.lit("web").alias("channel"), "o_custkey", "o_totalprice")
     .write.parquet(f"{path}/new"))
    old = versions.evolve(t.spark.read.parquet(f"{path}/old"), rename={"o_orderpriority": "priority"}, drop=["o_orderdate"],
                          add={"channel": "string"}, widen={"o_custkey": "bigint"})
    return old.unionByName(t.spark.read.parquet(f"{path}/new"))


@query("""SELECT CAST(year(o_orderdate) AS INTEGER) AS y, count(*) AS n FROM orders GROUP BY 1""")
def two_layouts(t: Tables):
    """The same table with rows in monthly and in daily directories gives one answer."""
    path = scratch(t.spark, "layouts")
    o = t.orders.select("o_orderkey", "o_orderdate")
    early = F.col("o_orderdate") < F.lit("1998-01-01").cast("timestamp")
    o.where(early).withColumn("month", F.date_format("o_orderdate", "yyyy-MM")).write.partitionBy("month").parquet(f"{path}/monthly")
    o.where(~early).withColumn("year", F.year("o_orderdate")).write.partitionBy("year").parquet(f"{path}/yearly")
    both = t.spark.read.parquet(f"{path}/monthly").drop("month").unionByName(t.spark.read.parquet(f"{path}/yearly").drop("year"))
    return both.groupBy(F.year("o_orderdate").alias("y")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT o_orderkey, CAST(2 AS BIGINT) AS source_version, true AS same_again FROM orders WHERE o_orderstatus <> 'P'""")
def evidence_link(t: Tables):
    """Rows carry the version they came from; reading that version later gives the same rows."""
    table = _orders_table(t)
    stamped = table.stamped(version=2).select("o_orderkey", "source_version")
    again = table.read(version=2).select("o_orderkey", F.lit(True).alias("same_again"))
    return stamped.join(again, "o_orderkey", "left")


# ---------------------------------------------------------------- layout


def _many_files(t: Tables) -> str:
    path = scratch(t.spark, "small-files")
    t.orders.select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus").repartition(24).write.partitionBy("o_orderstatus").parquet(path)
    return path


TARGET = 128 << 20


def _contents(t: Tables, path: str) -> DataFrame:
    """What a reader of the rewritten table gets, by status."""
    return t.spark.read.parquet(path).groupBy("o_orderstatus").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("o_orderkey").alias("keys"), F.sum("o_custkey").alias("customers"), F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("total"))


COMPACTED = """SELECT o_orderstatus, count(*) AS rows, CAST(sum(o_orderkey) AS BIGINT) AS keys, CAST(sum(o_custkey) AS BIGINT) AS customers,
  sum(CAST(o_totalprice AS DECIMAL(18,2))) AS total FROM orders GROUP BY 1"""


def _dealt(t: Tables, part: Column) -> str:
    """Orders with one file for each status and part, so that any engine can count the files."""
    path = scratch(t.spark, "dealt")
    rows = t.orders.select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus", part.alias("_part"))
    rows.repartition(24, "o_orderstatus", "_part").write.partitionBy("o_orderstatus", "_part").parquet(path)
    return path


@query("""SELECT o_orderstatus, count(DISTINCT o_orderkey % 24) AS files, count(*) AS rows, count(DISTINCT o_orderkey % 24) > 9 AS compact FROM orders GROUP BY 1""")
def file_stats(t: Tables):
    stats = layout.needs_compaction(layout.file_stats(t.spark, _dealt(t, F.col("o_orderkey") % 24), ["o_orderstatus"]), 9)
    return stats.select("o_orderstatus", "files", "rows", "compact")


@query("SELECT o_orderstatus, true AS over_8_files, false AS over_500_files FROM orders GROUP BY 1")
def fragmentation_gate(t: Tables):
    """The gate on both sides of 24 files for each status."""
    stats = layout.file_stats(t.spark, _many_files(t), ["o_orderstatus"])
    both = layout.needs_compaction(layout.needs_compaction(stats, 8).withColumnRenamed("compact", "over_8_files"), 500)
    return both.select("o_orderstatus", "over_8_files", F.col("compact").alias("over_500_files"))


@query(COMPACTED)
def compact_binpack(t: Tables):
    before, after = _many_files(t), scratch(t.spark, "compacted")
    layout.compact(t.spark, before, after, TARGET, ["o_orderstatus"])
    return _contents(t, after)


@query(COMPACTED)
def compact_sort(t: Tables):
    before, after = _many_files(t), scratch(t.spark, "sorted")
    layout.compact_sorted(t.spark, before, after, TARGET, ["o_custkey"])
    return _contents(t, after)


@query(COMPACTED)
def compact_zorder(t: Tables):
    before, after = _many_files(t), scratch(t.spark, "zordered")
    layout.compact_zorder(t.spark, before, after, TARGET, ["o_custkey", "o_totalprice"])
    return _contents(t, after)


_FILES = "SELECT min(o_custkey) AS lo, max(o_custkey) AS hi FROM orders GROUP BY o_orderstatus, {part}"


@query(f"""WITH m AS (SELECT CAST(quantile_disc(c_custkey, 0.5) AS BIGINT) AS k FROM customer), a AS ({_FILES.format(part='o_orderkey % 24')}), b AS ({_FILES.format(part='o_custkey // 64')})
  SELECT 'by order' AS layout, count(*) AS files, count(*) FILTER (lo <= k AND hi >= k) AS can_match FROM a, m
  UNION ALL SELECT 'by customer', count(*), count(*) FILTER (lo <= k AND hi >= k) FROM b, m""")
def file_pruning(t: Tables):
    """How many files can hold the middle customer, dealt out by order and by range of customers."""
    middle = t.customer.agg(F.percentile_approx("c_custkey", 0.5, 1_000_000)).first()[0]
    told = [layout.prunable(t.spark, _dealt(t, part), "o_custkey", middle, middle).select(F.lit(name).alias("layout"), "files", "can_match")
            for name, part in (("by order", F.col("o_orderkey") % 24), ("by customer", F.floor(F.col("o_custkey") / 64)))]
    return told[0].unionByName(told[1])


@query("SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1")
def clustered_write(t: Tables):
    path = scratch(t.spark, "clustered")
    shaped = layout.cluster_for_write(t.orders.select("o_orderstatus", "o_orderkey"), ["o_orderstatus"], ["o_orderkey"], salts=4,
                                      salt_by=["o_orderkey"])
    shaped.write.partitionBy("o_orderstatus").parquet(path)
    return t.spark.read.parquet(path).groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT o_orderpriority, CAST(0 AS INTEGER) AS exchanges, count(*) AS lines, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS qty
  FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1""")
def bucketed_join(t: Tables):
    """Two tables bucketed alike join without a shuffle."""
    tag, buckets = uuid.uuid4().hex, t.spark.sparkContext.defaultParallelism
    layout.write_bucketed(t.orders.select(F.col("o_orderkey").alias("k"), "o_orderpriority"), f"b_orders_{tag}",
                          scratch(t.spark, "b-orders"), buckets, ["k"])
    layout.write_bucketed(t.lineitem.select(F.col("l_orderkey").alias("k"), "l_quantity"), f"b_lines_{tag}",
                          scratch(t.spark, "b-lines"), buckets, ["k"])
    joined = t.spark.table(f"b_orders_{tag}").hint("merge").join(t.spark.table(f"b_lines_{tag}"), "k")
    return joined.groupBy("o_orderpriority").agg(
        F.lit(layout.count_exchanges(joined)).alias("exchanges"), F.count(F.lit(1)).alias("lines"),
        F.sum(F.col("l_quantity").cast("bigint")).alias("qty"))


@query("""SELECT event_id, c_mktsegment FROM events JOIN customer ON user_id = c_custkey""")
def salted_join(t: Tables):
    c = t.customer.select(F.col("c_custkey").alias("user_id"), "c_mktsegment")
    return joins.salted_join(t.events.select("event_id", "user_id"), c, ["user_id"], salts=8, share=0.008).select("event_id", "c_mktsegment")


@query("""SELECT event_id, c_custkey AS user_id, c_mktsegment FROM (SELECT * FROM events WHERE event_type = 'error') FULL JOIN customer ON user_id = c_custkey
  WHERE c_custkey IS NOT NULL UNION ALL SELECT event_id, user_id, NULL FROM events WHERE event_type = 'error' AND user_id NOT IN (SELECT c_custkey FROM customer)""")
def salted_full_join(t: Tables):
    c = t.customer.select(F.col("c_custkey").alias("user_id"), "c_mktsegment")
    e = t.events.where("event_type = 'error'").select("event_id", "user_id")
    return joins.salted_join(e, c, ["user_id"], "full", salts=8, share=0.008).select("event_id", "user_id", "c_mktsegment")


@query("""WITH d AS (SELECT CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) * 24 AS DOUBLE) AS hours, count(*) AS n, round(avg(value), 6) AS a FROM events GROUP BY 1)
  SELECT round(regr_slope(n, hours) * 24, 4) AS files_per_day, round(regr_slope(a, hours) * 24, 4) AS avg_bytes_per_day FROM d""")
def layout_decay(t: Tables):
    """Daily batches stand in for commits: their size is the file count, their mean value the file size."""
    hours = (F.datediff(F.to_date("ts"), F.lit("2024-01-01")) * 24).cast("double")
    daily = t.events.groupBy(hours.alias("hours")).agg(
        F.count(F.lit(1)).alias("files"), F.round(F.avg("value"), 6).alias("avg_bytes"), F.avg("value").alias("query_seconds"))
    got = layout.layout_decay(daily)
    return got.select(F.round("files_per_day", 4).alias("files_per_day"), F.round("avg_bytes_per_day", 4).alias("avg_bytes_per_day"))


# ---------------------------------------------------------------- streams

@query("""SELECT time_bucket(INTERVAL 15 MINUTE, ts) AS window_start, user_id, count(*) AS n, round(CAST(sum(CAST(value AS DECIMAL(12,2))) AS DOUBLE), 2) AS total FROM events
  GROUP BY 1, 2""")
def stream_tumbling(t: Tables):
    got = feeds.run_closed(feeds.read_table_stream(t.spark, t.root, "events"), "ts", lambda s: feeds.tumbling(
        s, "ts", ["user_id"], "15 minutes", {"n": F.count(F.lit(1)), "total": F.sum(money("value"))}), "tumbling")
    return got.select("window_start", "user_id", "n", F.round(F.col("total").cast("double"), 2).alias("total"))


#: A quarter of the feed's time, 0 to 3, in which an event happened.
QUARTER = "(epoch_us(ts) - (SELECT min(epoch_us(ts)) FROM events)) * 4 // (SELECT max(epoch_us(ts)) - min(epoch_us(ts)) + 1 FROM events)"


def _quarters(t: Tables, late: Column) -> list[DataFrame]:
    """Events in four deliveries by time; those that ``late`` names come one delivery later than their time says."""
    e = t.events
    ends = e.agg(F.min(F.unix_micros("ts")).alias("a"), (F.max(F.unix_micros("ts")) + 1).alias("z"))
    own = F.floor((F.unix_micros("ts") - ends.select("a").scalar()) * 4 / (ends.select("z").scalar() - ends.select("a").scalar()))
    dealt = e.withColumn("_quarter", F.least(own + F.when(late, 1).otherwise(0), F.lit(3)))
    dealt = materialised(dealt, "deliveries")
    return [dealt.where(F.col("_quarter") == i).drop("_quarter") for i in range(4)]


@query(f"""WITH d AS (SELECT *, least({QUARTER} + CASE WHEN event_id % 7 = 0 THEN 1 ELSE 0 END, 3) AS quarter, time_bucket(INTERVAL 1 HOUR, ts) AS window_start FROM events),
  q AS (SELECT quarter, max(ts) AS newest FROM d GROUP BY quarter),
  w AS (SELECT d.quarter, (SELECT make_timestamp(epoch_us(max(newest)) // 1000 * 1000) - INTERVAL 6 HOUR FROM q WHERE q.quarter < d.quarter) AS mark FROM (SELECT DISTINCT quarter FROM d) d),
  a AS (SELECT d.*, mark IS NOT NULL AND window_start + INTERVAL 1 HOUR <= mark AS late FROM d JOIN w USING (quarter))
  SELECT 'window' AS what, window_start, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(12,2))) AS DOUBLE) AS total FROM a WHERE NOT late GROUP BY window_start
  UNION ALL SELECT 'dropped', NULL, count(*) FILTER (late), NULL FROM a""")
def stream_late_rows(t: Tables):
    """Four deliveries, some rows a delivery late: windows that the watermark has closed do not take them, and they are counted."""
    got, delivered = feeds.run_arrivals(_quarters(t, F.col("event_id") % 7 == 0), "ts", lambda s: feeds.tumbling(
        s, "ts", [], "1 hour", {"n": F.count(F.lit(1)), "total": F.sum(money("value"))}), "late-rows")
    rows = got.select(F.lit("window").alias("what"), "window_start", "n", F.col("total").cast("double").alias("total"))
    dropped = got.agg((F.lit(delivered) - F.coalesce(F.sum("n"), F.lit(0))).cast("long").alias("n")).select(
        F.lit("dropped").alias("what"), F.lit(None).cast("timestamp").alias("window_start"), "n", F.lit(None).cast("double").alias("total"))
    return rows.unionByName(dropped)


@query("SELECT event_id, user_id FROM events")
def stream_dedup(t: Tables):
    """The feed is replayed in full; every id comes out once."""
    stream = feeds.read_table_stream(t.spark, t.root, "events").select("event_id", "user_id", "ts")
    replay = feeds.read_table_stream(t.spark, t.root, "events").select("event_id", "user_id", "ts")
    return feeds.run_to_end(feeds.without_replays(stream.union(replay), ["event_id"], "ts"), "dedup").select("event_id", "user_id")


@query("""WITH g AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS st FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
  s AS (SELECT *, sum(st) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS no FROM g)
  SELECT user_id, min(ts) AS started, max(ts) + INTERVAL 30 MINUTE AS ended, count(*) AS events FROM s GROUP BY user_id, no""")
def stream_sessions(t: Tables):
    return feeds.run_closed(feeds.read_table_stream(t.spark, t.root, "events"), "ts", lambda s: feeds.sessions(s, "user_id", "ts", "30 minutes"), "sessions")


@query("""WITH x AS (SELECT user_id, CAST(value AS DECIMAL(12,2)) AS v, unnest(generate_series(date_trunc('minute', ts) - INTERVAL 14 MINUTE, date_trunc('minute', ts), INTERVAL 1 MINUTE)) AS window_start FROM events)
  SELECT window_start, user_id, CAST(sum(v) AS DOUBLE) AS outflow FROM x GROUP BY 1, 2""")
def stream_sliding(t: Tables):
    got = feeds.run_closed(feeds.read_table_stream(t.spark, t.root, "events"), "ts", lambda s: feeds.sliding_sums(
        s, "ts", ["user_id"], 15 * 60, 60, {"outflow": money("value")}), "sliding")
    return got.select("window_start", "user_id", F.col("outflow").cast("double").alias("outflow"))


@query(f"""WITH q AS (SELECT *, {QUARTER} AS quarter FROM events),
  s AS (SELECT *, row_number() OVER (PARTITION BY user_id, quarter ORDER BY ts DESC, event_id DESC) AS rn FROM q),
  b AS (SELECT user_id, min(quarter) AS born FROM s WHERE rn = 1 AND event_type <> 'error' GROUP BY 1)
  SELECT s.user_id, arg_max(value, quarter) FILTER (event_type <> 'error') AS value, max(ts) FILTER (event_type <> 'error') AS ts,
    bool_or(event_type = 'error' AND quarter > born) AS is_deleted FROM s JOIN b USING (user_id) WHERE rn = 1 AND quarter >= born GROUP BY 1""")
def stream_upsert(t: Tables):
    """Four deliveries of events collapsed to the last per user and merged into partitions; each is delivered twice."""
    path = scratch(t.spark, "upsert-state")
    op = F.when(F.col("event_type") == "error", "d").otherwise("u")
    batches = [b.select("user_id", "ts", "event_id", "value", op.alias("op")) for b in _quarters(t, F.lit(False))]
    apply = feeds.upsert_partitions(path, ["user_id"], ["ts", "event_id"], "ts", "op", buckets=16)
    feeds.run_deliveries(batches, apply)
    for i, batch in enumerate(batches):
        apply(batch, i)  # a restarted feed hands the same batches over again
    return feeds.read_state(t.spark, path, feeds.state_schema(batches[0].schema, "op")).select("user_id", "value", "ts", "is_deleted")
