"""Built-in projections, filters, scalar functions, joins, aggregates, windows and set operations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakeops.catalog.registry import Tables, query
from lakeops.functions.columns import money
from lakeops.operators.quantiles import exact_percentiles
from lakeops.operators import joins, sliced
from lakeops.session import materialised

# ---------------------------------------------------------------- projections


@query("""SELECT o_orderkey, o_custkey AS account, upper(o_orderpriority) AS priority,
  CAST(CAST(o_totalprice AS DECIMAL(12,2)) * 2 AS DOUBLE) AS doubled FROM orders""")
def project_select(t: Tables):
    return t.orders.select("o_orderkey", F.col("o_custkey").alias("account"),
                           F.upper("o_orderpriority").alias("priority"),
                           (money("o_totalprice") * 2).cast("double").alias("doubled"))


@query("""SELECT p_partkey, p_name, p_brand AS brand, p_size, p_size >= 25 AS is_large,
  p_size * 10 AS size_mm, 'catalogue' AS origin FROM part""")
def project_columns(t: Tables):
    return (t.part.withColumn("is_large", F.col("p_size") >= 25)
            .withColumns({"size_mm": F.col("p_size") * 10, "origin": F.lit("catalogue")})
            .withColumnRenamed("p_brand", "brand").drop("p_type", "p_retailprice"))


@query("""SELECT l_orderkey, l_linenumber,
  CAST(CAST(l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l_discount AS DECIMAL(4,2))) AS DOUBLE) AS net,
  'line' AS kind FROM lineitem""")
def project_sql_text(t: Tables):
    return t.lineitem.selectExpr(
        "l_orderkey", "l_linenumber",
        "cast(cast(l_extendedprice as decimal(12,2)) * (1 - cast(l_discount as decimal(4,2))) as double) as net",
        "'line' as kind")


@query("""SELECT c_custkey, c_mktsegment AS cust__c_mktsegment, c_acctbal AS cust__c_acctbal FROM customer""")
def project_prefixed(t: Tables):
    from lakeops.operators.features import prefixed
    return prefixed(t.customer.select("c_custkey", "c_mktsegment", "c_acctbal"), "cust", "c_custkey")


# ---------------------------------------------------------------- filters


@query("""SELECT o_orderkey, o_totalprice FROM orders
  WHERE (o_orderstatus = 'F' OR o_orderpriority = '1-URGENT') AND NOT (o_totalprice < 100000)""")
def filter_boolean(t: Tables):
    return t.orders.filter(((F.col("o_orderstatus") == "F") | (F.col("o_orderpriority") == "1-URGENT"))
                           & ~(F.col("o_totalprice") < 100000)).select("o_orderkey", "o_totalprice")


@query("""SELECT o_orderkey FROM orders WHERE o_orderstatus IN ('F','P')
  AND o_totalprice BETWEEN 100000 AND 200000""")
def filter_in_between(t: Tables):
    return (t.orders.filter(F.col("o_orderstatus").isin("F", "P"))
            .filter(F.col("o_totalprice").between(100000, 200000)).select("o_orderkey"))


@query("""SELECT d.doc_id, (l.quality IS NULL) AS unlabelled, CAST(coalesce(l.quality, -1) AS INTEGER) AS quality
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""")
def filter_null_tests(t: Tables):
    return (t.documents.select("doc_id").join(t.labels.select("doc_id", "quality"), "doc_id", "left")
            .select("doc_id", F.col("quality").isNull().alias("unlabelled"),
                    F.coalesce("quality", F.lit(-1)).cast("int").alias("quality")))


@query("""SELECT p_partkey, p_name FROM part WHERE starts_with(p_name, 's') AND regexp_matches(p_name, '(?i)RING|widget')""")
def filter_patterns(t: Tables):
    return t.part.filter(F.col("p_name").startswith("s") & F.col("p_name").rlike("(?i)RING|widget")).select(
        "p_partkey", "p_name")


@query("""SELECT o_orderkey, CASE WHEN o_totalprice >= 300000 THEN 'large' WHEN o_totalprice >= 100000 THEN 'medium'
  ELSE 'small' END AS band, CASE WHEN o_orderstatus = 'F' THEN 'closed' END AS closed FROM orders""")
def filter_case_chain(t: Tables):
    p = F.col("o_totalprice")
    return t.orders.select("o_orderkey",
                           F.when(p >= 300000, "large").when(p >= 100000, "medium").otherwise("small").alias("band"),
                           F.when(F.col("o_orderstatus") == "F", "closed").alias("closed"))


@query("""WITH j AS (SELECT d.doc_id, l.quality, l.toxic FROM documents d LEFT JOIN labels l ON d.doc_id=l.doc_id)
  SELECT doc_id, coalesce(toxic, 0) AS toxic_filled, (quality IS NOT NULL AND toxic IS NOT NULL) AS complete FROM j""")
def null_handling(t: Tables):
    joined = t.documents.select("doc_id").join(t.labels, "doc_id", "left")
    whole = joined.na.drop(how="any", subset=["quality", "toxic"]).select("doc_id", F.lit(True).alias("complete"))
    return (joined.na.fill({"toxic": 0}).select("doc_id", F.col("toxic").alias("toxic_filled"))
            .join(whole, "doc_id", "left").na.fill({"complete": False}))


# ---------------------------------------------------------------- strings


@query("""SELECT c_custkey, trim(c_name) AS name, lower(trim(c_name)) AS lowered, upper(c_mktsegment) AS segment,
  upper(substr(c_mktsegment,1,1)) || lower(substr(c_mktsegment,2)) AS titled FROM customer""")
def clean_strings(t: Tables):
    return t.customer.select("c_custkey", F.trim("c_name").alias("name"), F.lower(F.trim("c_name")).alias("lowered"),
                             F.upper("c_mktsegment").alias("segment"), F.initcap("c_mktsegment").alias("titled"))


@query("""SELECT p_partkey, split_part(p_name,' ',1) AS first_word,
  CASE WHEN len(string_split(p_name,' ')) >= 2 THEN string_split(p_name,' ')[2] END AS second_word,
  CAST(len(string_split(p_name,' ')) AS INTEGER) AS words, substr(p_brand, 7, 2) AS brand_no FROM part""")
def split_parts(t: Tables):
    words = F.split("p_name", " ")
    return t.part.select("p_partkey", words.getItem(0).alias("first_word"),
                         F.try_element_at(words, F.lit(2)).alias("second_word"), F.size(words).alias("words"),
                         F.substring("p_brand", 7, 2).alias("brand_no"))


@query("""SELECT p_partkey, regexp_extract(p_brand, '(\\w+)#(\\d+)', 1) AS maker,
  CAST(regexp_extract(p_brand, '(\\w+)#(\\d+)', 2) AS INTEGER) AS maker_no,
  regexp_extract(p_brand, 'zzz(\\d+)', 1) AS no_match, regexp_replace(p_brand, '[^0-9+]', '', 'g') AS digits FROM part""")
def regex_parts(t: Tables):
    from lakeops.functions.columns import digits_only
    return t.part.select("p_partkey", F.regexp_extract("p_brand", r"(\w+)#(\d+)", 1).alias("maker"),
                         F.regexp_extract("p_brand", r"(\w+)#(\d+)", 2).cast("int").alias("maker_no"),
                         F.regexp_extract("p_brand", r"zzz(\d+)", 1).alias("no_match"),
                         digits_only("p_brand").alias("digits"))


@query("""SELECT d.doc_id, concat_ws('/', d.lang, CAST(l.quality AS VARCHAR), d.source) AS skips_null,
  d.lang || CAST(l.quality AS VARCHAR) AS null_wins FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""")
def concat_nulls(t: Tables):
    q = F.col("quality").cast("string")
    return (t.documents.select("doc_id", "lang", "source").join(t.labels, "doc_id", "left")
            .select("doc_id", F.concat_ws("/", "lang", q, "source").alias("skips_null"),
                    F.concat("lang", q).alias("null_wins")))


# ---------------------------------------------------------------- dates and numbers


@query("""SELECT o_orderkey, CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) AS month_start,
  CAST(date_trunc('week', o_orderdate) AS TIMESTAMP) AS week_start, CAST(year(o_orderdate) AS INTEGER) AS y,
  CAST(month(o_orderdate) AS INTEGER) AS m, CAST(day(o_orderdate) AS INTEGER) AS d,
  CAST(dayofweek(o_orderdate) + 1 AS INTEGER) AS dow, strftime(o_orderdate, '%Y-%m') AS ym FROM orders""")
def date_parts(t: Tables):
    d = F.col("o_orderdate")
    return t.orders.select("o_orderkey", F.date_trunc("month", d).alias("month_start"),
                           F.date_trunc("week", d).alias("week_start"), F.year(d).alias("y"), F.month(d).alias("m"),
                           F.dayofmonth(d).alias("d"), F.dayofweek(d).alias("dow"),
                           F.date_format(d, "yyyy-MM").alias("ym"))


@query("""SELECT o_orderkey, CAST(date_diff('day', CAST(o_orderdate AS DATE), DATE '2001-12-31') AS INTEGER) AS age_days,
  CAST(CAST(o_orderdate AS DATE) + 30 AS DATE) AS plus30, CAST(CAST(o_orderdate AS DATE) - 7 AS DATE) AS minus7,
  CAST(o_orderdate + INTERVAL 1 MONTH AS DATE) AS next_month, CAST(last_day(o_orderdate) AS DATE) AS month_end,
  (CAST(o_orderdate AS DATE) = last_day(o_orderdate)) AS is_month_end,
  CAST(day(last_day(o_orderdate)) AS INTEGER) AS days_in_month,
  o_orderdate + INTERVAL 36 HOUR AS due_at FROM orders""")
def date_arith(t: Tables):
    from lakeops.functions.columns import days_in_month, is_month_end
    d = F.to_date("o_orderdate")
    return t.orders.select("o_orderkey", F.datediff(F.lit("2001-12-31"), d).alias("age_days"),
                           F.date_add(d, 30).alias("plus30"), F.date_sub(d, 7).alias("minus7"),
                           F.add_months(d, 1).alias("next_month"), F.last_day(d).alias("month_end"),
                           is_month_end(d).alias("is_month_end"), days_in_month(d).alias("days_in_month"),
                           (F.col("o_orderdate") + F.expr("INTERVAL 36 HOURS")).alias("due_at"))


@query("""SELECT o_orderkey, CAST(epoch(o_orderdate) AS BIGINT) AS epoch_s, o_orderdate AS from_ms,
  strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS as_text, CAST(NULL AS TIMESTAMP) AS unparsed FROM orders""")
def epoch_and_parse(t: Tables):
    s = F.unix_seconds("o_orderdate")
    return t.orders.select("o_orderkey", s.alias("epoch_s"), F.timestamp_millis(s * 1000).alias("from_ms"),
                           F.from_unixtime(s).alias("as_text"),
                           F.try_to_timestamp(F.col("o_orderpriority"), F.lit("yyyy-MM-dd")).alias("unparsed"))


@query("""SELECT l_orderkey, l_linenumber, CAST(ceil(l_quantity / 7) AS BIGINT) AS packs,
  round(l_extendedprice / nullif(l_quantity, 0), 8) AS unit, abs(CAST(l_quantity AS INTEGER) - 25) AS off,
  greatest(l_quantity, 10.0) AS at_least, CAST(l_quantity AS INTEGER) AS qty,
  CAST(try_cast(l_returnflag AS INTEGER) AS INTEGER) AS bad_cast,
  round(l_discount / nullif(l_tax, 0), 4) AS guarded FROM lineitem""")
def number_functions(t: Tables):
    q = F.col("l_quantity")
    return t.lineitem.select("l_orderkey", "l_linenumber", F.ceil(q / 7).alias("packs"),
                             F.round(F.try_divide("l_extendedprice", q), 8).alias("unit"),
                             F.abs(q.cast("int") - 25).alias("off"), F.greatest(q, F.lit(10.0)).alias("at_least"),
                             q.cast("int").alias("qty"), F.col("l_returnflag").try_cast("int").alias("bad_cast"),
                             F.round(F.try_divide("l_discount", "l_tax"), 4).alias("guarded"))


# ---------------------------------------------------------------- nested and semi-structured


@query("""SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
  coalesce(json_extract_string(props, '$.after'), json_extract_string(props, '$.k')) AS fallback,
  '{"user":' || user_id || ',"type":"' || event_type || '"}' AS packed, user_id AS via_struct FROM events""")
def json_props(t: Tables):
    who = F.struct(F.col("user_id").alias("user"), F.col("event_type").alias("type"))
    return t.events.select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"),
                           F.coalesce(F.get_json_object("props", "$.after"),
                                      F.get_json_object("props", "$.k")).alias("fallback"),
                           F.to_json(who).alias("packed"), who["user"].alias("via_struct"))


@query("""SELECT event_type, count(*) AS n, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS k_sum
  FROM events GROUP BY event_type""")
def variant_props(t: Tables):
    v = F.variant_get(F.parse_json("props"), "$.k", "bigint")
    return t.events.groupBy("event_type").agg(F.count("*").alias("n"), F.sum(v).alias("k_sum"))


@query("""SELECT event_id, json_extract_string(props, '$.k') AS k, CAST(NULL AS VARCHAR) AS absent FROM events""")
def map_access(t: Tables):
    m = F.from_json("props", "map<string,string>")
    return t.events.select("event_id", m["k"].alias("k"), F.try_element_at(m, F.lit("zz")).alias("absent"))


@query("""SELECT w AS word, count(*) AS n, count(DISTINCT doc_id) AS docs
  FROM (SELECT doc_id, unnest(string_split(lower(text), ' ')) AS w FROM documents) GROUP BY w""")
def explode_words(t: Tables):
    words = t.documents.select("doc_id", F.explode(F.split(F.lower("text"), " ")).alias("word"))
    per_doc = words.groupBy("word", "doc_id").agg(F.count("*").alias("c"))
    return per_doc.groupBy("word").agg(F.sum("c").alias("n"), F.count("*").alias("docs"))


@query("""WITH s AS (SELECT doc_id, CASE WHEN starts_with(lang,'e') THEN string_split(source,'_') END AS parts FROM documents)
  SELECT doc_id, unnest(CASE WHEN parts IS NULL THEN [NULL] ELSE parts END) AS part FROM s""")
def explode_outer(t: Tables):
    parts = F.when(F.col("lang").startswith("e"), F.split("source", "_"))
    return t.documents.select("doc_id", F.explode_outer(parts).alias("part"))


@query("""SELECT p_partkey, CAST(i - 1 AS INTEGER) AS pos, string_split(p_name,' ')[i] AS word
  FROM part, unnest(range(1, len(string_split(p_name,' ')) + 1)) AS u(i)""")
def posexplode_words(t: Tables):
    return t.part.select("p_partkey", F.posexplode(F.split("p_name", " ")).alias("pos", "word"))


@query("""SELECT CAST(d AS DATE) AS day, count(*) AS open_orders FROM (
  SELECT unnest(generate_series(CAST(o_orderdate AS DATE), CAST(o_orderdate AS DATE) + 6, INTERVAL 1 DAY)) AS d FROM orders)
  GROUP BY d""")
def sequence_days(t: Tables):
    d = F.to_date("o_orderdate")
    return (t.orders.select(F.explode(F.sequence(d, F.date_add(d, 6))).alias("day"))
            .groupBy("day").agg(F.count("*").alias("open_orders")))


# ---------------------------------------------------------------- joins


@query("""SELECT 'inner' AS how, count(*) AS n FROM orders o JOIN lineitem l ON o_orderkey = l_orderkey
  UNION ALL SELECT 'left', count(*) FROM orders o LEFT JOIN lineitem l ON o_orderkey = l_orderkey
  UNION ALL SELECT 'right', count(*) FROM orders o RIGHT JOIN lineitem l ON o_orderkey = l_orderkey
  UNION ALL SELECT 'full', count(*) FROM orders o FULL JOIN lineitem l ON o_orderkey = l_orderkey""")
def join_counts(t: Tables):
    """Rows of each join type.  Both sides are counted per key first, so a hot key joins as one row."""
    o = t.orders.groupBy(F.col("o_orderkey").alias("k")).agg(F.count("*").alias("a"))
    li = t.lineitem.groupBy(F.col("l_orderkey").alias("k")).agg(F.count("*").alias("b"))
    pairs = F.coalesce("a", F.lit(1)) * F.coalesce("b", F.lit(1))
    parts = [o.join(li, "k", how).agg(F.sum(pairs).alias("n")).select(F.lit(how).alias("how"), "n")
             for how in ("inner", "left", "right", "full")]
    return reduce(DataFrame.unionByName, parts)


@query("""SELECT c_custkey, o_orderkey FROM (SELECT * FROM customer WHERE c_acctbal < 0) c
  FULL JOIN (SELECT * FROM orders WHERE o_totalprice > 400000) o ON c_custkey = o_custkey
  WHERE c_custkey IS NULL OR o_orderkey IS NULL""")
def full_unmatched(t: Tables):
    c = t.customer.filter("c_acctbal < 0").select(F.col("c_custkey").alias("k"), "c_custkey")
    o = t.orders.filter("o_totalprice > 400000").select(F.col("o_custkey").alias("k"), "o_orderkey")
    return (joins.salted_join(o, c, ["k"], "full")
            .filter("c_custkey is null or o_orderkey is null").select("c_custkey", "o_orderkey"))


@query("""SELECT r_name, n_name, count(*) AS customers FROM customer JOIN nation ON c_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey GROUP BY r_name, n_name""")
def join_broadcast(t: Tables):
    # the 5 regions and 25 nations of the star schema are fixed
    places = t.nation.join(F.broadcast(t.region), F.col("n_regionkey") == F.col("r_regionkey"))
    per_nation = t.customer.groupBy("c_nationkey").agg(F.count("*").alias("customers"))
    return (per_nation.join(F.broadcast(places), F.col("c_nationkey") == F.col("n_nationkey"))
            .select("r_name", "n_name", "customers"))


@query("""SELECT o_orderkey FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey)""")
def anti_no_lines(t: Tables):
    return (t.orders.join(t.lineitem, F.col("o_orderkey") == F.col("l_orderkey"), "left_anti").select("o_orderkey"))


@query("""SELECT o_orderkey, o_custkey FROM orders o WHERE EXISTS
  (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l_returnflag = 'R')""")
def semi_orders(t: Tables):
    returned = t.lineitem.filter("l_returnflag = 'R'")
    return (t.orders.join(returned, F.col("o_orderkey") == F.col("l_orderkey"), "left_semi")
            .select("o_orderkey", "o_custkey"))


@query("""SELECT c_custkey, count(o_orderkey) AS orders,
  CAST(coalesce(sum(CAST(o_totalprice AS DECIMAL(12,2))),0) AS DOUBLE) AS spent
  FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey""")
def left_join_group(t: Tables):
    spent = t.orders.groupBy("o_custkey").agg(F.count("*").alias("orders"), F.sum(money("o_totalprice")).alias("spent"))
    return (t.customer.join(spent, F.col("c_custkey") == F.col("o_custkey"), "left")
            .select("c_custkey", F.coalesce("orders", F.lit(0)).alias("orders"),
                    F.coalesce("spent", F.lit(0)).cast("double").alias("spent")))


@query("""SELECT s_nationkey, l_linestatus, count(*) AS lines, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS qty
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey
  WHERE p_size BETWEEN 10 AND 40 AND l_shipdate >= TIMESTAMP '1997-01-01' GROUP BY ALL""")
def three_way_join(t: Tables):
    return (t.lineitem.filter(F.col("l_shipdate") >= F.lit("1997-01-01").cast("timestamp"))
            .join(t.part.filter("p_size between 10 and 40"), F.col("l_partkey") == F.col("p_partkey"))
            .join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey"))
            .groupBy("s_nationkey", "l_linestatus")
            .agg(F.count("*").alias("lines"), F.sum(F.col("l_quantity").cast("bigint")).alias("qty")))


# ---------------------------------------------------------------- aggregates


@query("""SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(sum(CAST(l_extendedprice AS DECIMAL(12,2))) AS DOUBLE) AS total,
  round(avg(l_quantity), 6) AS avg_qty, min(l_shipdate) AS first_ship, max(l_shipdate) AS last_ship,
  CAST(sum(CAST(l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l_discount AS DECIMAL(4,2)))) AS DOUBLE) AS net
  FROM lineitem GROUP BY ALL""")
def agg_basic(t: Tables):
    net = money("l_extendedprice") * (F.lit(1).cast("decimal(1,0)") - F.col("l_discount").cast("decimal(4,2)"))
    return t.lineitem.groupBy("l_returnflag", "l_linestatus").agg(
        F.count("*").alias("n"), F.sum(money("l_extendedprice")).cast("double").alias("total"),
        F.round(F.avg("l_quantity"), 6).alias("avg_qty"), F.min("l_shipdate").alias("first_ship"),
        F.max("l_shipdate").alias("last_ship"), F.sum(net).cast("double").alias("net"))


@query("""SELECT lang, count(*) AS docs, count(quality) AS labelled, count(*) - count(quality) AS missing
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY lang""")
def count_gap(t: Tables):
    return (t.documents.select("doc_id", "lang").join(t.labels, "doc_id", "left").groupBy("lang")
            .agg(F.count("*").alias("docs"), F.count("quality").alias("labelled"))
            .withColumn("missing", F.col("docs") - F.col("labelled")))


@query("""SELECT o_orderpriority, count(DISTINCT o_custkey) AS customers,
  count(DISTINCT (o_custkey, o_orderstatus)) AS pairs FROM orders GROUP BY o_orderpriority""")
def distinct_counts(t: Tables):
    return t.orders.groupBy("o_orderpriority").agg(
        F.countDistinct("o_custkey").alias("customers"),
        F.countDistinct("o_custkey", "o_orderstatus").alias("pairs"))


@query()
def approx_distinct(t: Tables):
    return t.lineitem.groupBy("l_returnflag").agg(
        F.approx_count_distinct("l_orderkey").alias("orders_default"),
        F.approx_count_distinct("l_orderkey", 0.01).alias("orders_1pct"))


@query("""SELECT o_custkey, array_to_string(list_sort(list_distinct(list(o_orderpriority))), ',') AS priorities,
  CAST(len(list_distinct(list(o_orderpriority))) AS INTEGER) AS kinds FROM orders GROUP BY o_custkey""")
def collect_sets(t: Tables):
    kinds = F.sort_array(F.collect_set("o_orderpriority"))
    return t.orders.groupBy("o_custkey").agg(F.array_join(kinds, ",").alias("priorities"), F.size(kinds).alias("kinds"))


@query("""SELECT l_orderkey, array_to_string(list_sort(list(l_linenumber)), ',') AS lines
  FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem) GROUP BY l_orderkey""")
def collect_lists(t: Tables):
    return (t.lineitem.select("l_orderkey", "l_linenumber").distinct().groupBy("l_orderkey")
            .agg(F.array_join(F.sort_array(F.collect_list("l_linenumber")), ",").alias("lines")))


@query("""SELECT o_orderstatus, count(*) FILTER (o_orderpriority='1-URGENT') AS urgent,
  count(*) FILTER (o_orderpriority='2-HIGH') AS high, count(*) FILTER (o_orderpriority='5-LOW') AS low
  FROM orders GROUP BY o_orderstatus""")
def pivot_priority(t: Tables):
    return (t.orders.groupBy("o_orderstatus").pivot("o_orderpriority", ["1-URGENT", "2-HIGH", "5-LOW"])
            .agg(F.count(F.lit(1))).toDF("o_orderstatus", "urgent", "high", "low").na.fill(0))


@query("""SELECT o_custkey, count(*) FILTER (o_orderstatus='F') AS closed, count(CASE WHEN o_totalprice>200000 THEN 1 END) AS large,
  CAST(sum(CASE WHEN o_orderstatus='F' THEN CAST(o_totalprice AS DECIMAL(12,2)) ELSE -CAST(o_totalprice AS DECIMAL(12,2)) END) AS DOUBLE) AS signed
  FROM orders GROUP BY o_custkey""")
def conditional_aggs(t: Tables):
    p = money("o_totalprice")
    closed = F.col("o_orderstatus") == "F"
    return t.orders.groupBy("o_custkey").agg(
        F.count_if(closed).alias("closed"), F.count(F.when(F.col("o_totalprice") > 200000, 1)).alias("large"),
        F.sum(F.when(closed, p).otherwise(-p)).cast("double").alias("signed"))


@query("""SELECT o_orderpriority, round(stddev_samp(o_totalprice), 3) AS sd,
  round(stddev_samp(o_totalprice)/avg(o_totalprice), 6) AS variation FROM orders GROUP BY o_orderpriority""")
def dispersion(t: Tables):
    return t.orders.groupBy("o_orderpriority").agg(
        F.round(F.stddev_samp("o_totalprice"), 3).alias("sd"),
        F.round(F.stddev_samp("o_totalprice") / F.avg("o_totalprice"), 6).alias("variation"))


@query()
def percentiles_approx(t: Tables):
    return t.orders.groupBy("o_orderpriority").agg(
        F.percentile_approx("o_totalprice", 0.5).alias("median"),
        F.percentile_approx("o_totalprice", 0.9, 1000).alias("p90"))


@query("""SELECT o_orderpriority, round(quantile_cont(o_totalprice, 0.5), 6) AS p50, round(quantile_cont(o_totalprice, 0.9), 6) AS p90
  FROM orders GROUP BY o_orderpriority""")
def percentiles(t: Tables):
    got = exact_percentiles(t.orders, ["o_orderpriority"], "o_totalprice", {"p50": 0.5, "p90": 0.9})
    return got.select("o_orderpriority", F.round("p50", 6).alias("p50"), F.round("p90", 6).alias("p90"))


@query("""SELECT l_orderkey, l_linenumber, count(*) AS copies FROM lineitem GROUP BY ALL HAVING count(*) > 1""")
def having_duplicates(t: Tables):
    return t.lineitem.groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("copies")).filter("copies > 1")


@query("""SELECT event_type, arg_min(event_id, ts) AS first_event, arg_max(event_id, ts) AS last_event FROM events GROUP BY event_type""")
def first_last_by(t: Tables):
    return t.events.groupBy("event_type").agg(
        F.min_by("event_id", "ts").alias("first_event"), F.max_by("event_id", "ts").alias("last_event"))


@query("""SELECT l_returnflag, round(corr(l_quantity, l_extendedprice), 8) AS qty_price,
  round(regr_slope(l_extendedprice, l_quantity), 4) AS slope FROM lineitem GROUP BY l_returnflag""")
def correlation(t: Tables):
    return t.lineitem.groupBy("l_returnflag").agg(
        F.round(F.corr("l_quantity", "l_extendedprice"), 8).alias("qty_price"),
        F.round(F.regr_slope("l_extendedprice", "l_quantity"), 4).alias("slope"))


@query("""SELECT count(*) || '|' || CAST(sum(CAST(o_totalprice AS DECIMAL(12,2))) AS VARCHAR) || '|' || count(DISTINCT o_custkey) AS fingerprint FROM orders""")
def total_fingerprint(t: Tables):
    return t.orders.agg(F.concat_ws("|", F.count("*"), F.sum(money("o_totalprice")),
                                    F.countDistinct("o_custkey")).alias("fingerprint"))


# ---------------------------------------------------------------- windows


@query("""SELECT o_custkey, o_orderkey, o_totalprice, rn FROM (SELECT *, row_number() OVER
  (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) WHERE rn <= 3""")
def topn_per_group(t: Tables):
    w = Window.partitionBy("o_custkey").orderBy(F.col("o_totalprice").desc(), "o_orderkey")
    return (t.orders.withColumn("rn", F.row_number().over(w)).filter("rn <= 3")
            .select("o_custkey", "o_orderkey", "o_totalprice", "rn"))


@query("""SELECT l_suppkey, l_orderkey, l_linenumber, l_quantity, CAST(rank() OVER w AS BIGINT) AS rk,
  CAST(dense_rank() OVER w AS BIGINT) AS drk, round(percent_rank() OVER w, 8) AS pct,
  CAST(ntile(4) OVER (PARTITION BY l_suppkey ORDER BY l_quantity, l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS INTEGER) AS quartile
  FROM lineitem WINDOW w AS (PARTITION BY l_suppkey ORDER BY l_quantity)""")
def rank_ties(t: Tables):
    li = t.lineitem.select("l_suppkey", "l_orderkey", "l_linenumber", "l_quantity", "l_partkey", "l_extendedprice")
    tied = sliced.tied_ranks(li, ["l_suppkey"], ["l_quantity"], ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"],
                             row_number="rn", rank="rk", dense_rank="drk", size="n")
    return tied.select("l_suppkey", "l_orderkey", "l_linenumber", "l_quantity", "rk", "drk",
                       F.round((F.col("rk") - 1) / F.greatest(F.col("n") - 1, F.lit(1)), 8).alias("pct"),
                       sliced.ntile(F.col("rn"), F.col("n"), 4).alias("quartile"))


@query("""SELECT event_id, user_id, lag(event_id) OVER w AS prev_id, lead(event_id) OVER w AS next_id,
  round((epoch_us(ts) - epoch_us(lag(ts) OVER w)) / 60000000.0, 3) AS minutes
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def lag_lead(t: Tables):
    near = sliced.neighbours(t.events.select("event_id", "user_id", "ts"), ["user_id"], ["ts", "event_id"],
                             sliced.time_slice("ts"), prev={"prev_id": "event_id", "prev_ts": "ts"},
                             following={"next_id": "event_id"})
    gap = (F.unix_micros("ts") - F.unix_micros("prev_ts")) / 60_000_000.0
    return near.select("event_id", "user_id", "prev_id", "next_id", F.round(gap, 3).alias("minutes"))


@query("""SELECT o_orderkey, o_custkey, CAST(sum(CAST(o_totalprice AS DECIMAL(12,2))) OVER w AS DOUBLE) AS so_far,
  count(*) OVER w AS nth, max(o_totalprice) OVER w AS peak FROM orders
  WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING)""")
def running_total(t: Tables):
    got = sliced.running(t.orders, ["o_custkey"], ["o_orderdate", "o_orderkey"],
                         sliced.time_slice("o_orderdate", 30 * sliced.DAY),
                         {"so_far": ("sum", money("o_totalprice")), "nth": ("count", F.lit(1)),
                          "peak": ("max", F.col("o_totalprice"))})
    return got.select("o_orderkey", "o_custkey", F.col("so_far").cast("double").alias("so_far"), "nth", "peak")


@query("""SELECT event_type, count(*) AS n, round(count(*) / CAST((SELECT count(*) FROM events) AS DOUBLE), 8) AS share
  FROM events GROUP BY event_type""")
def share_of_total(t: Tables):
    counts = t.events.groupBy("event_type").agg(F.count("*").alias("n"))
    total = t.events.agg(F.count("*").alias("all_rows"))
    return counts.select("event_type", "n", F.round(F.col("n") / total.scalar(), 8).alias("share"))


# ---------------------------------------------------------------- sort, top-k, partitions, cache


@query("""SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20""")
def topk_orders(t: Tables):
    return t.orders.select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(20)


@query("""SELECT o_orderkey, CAST(row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS BIGINT) AS position FROM orders""")
def global_sort_position(t: Tables):
    return sliced.ranks(t.orders.select("o_orderkey", "o_totalprice"), [], ["o_totalprice", "o_orderkey"],
                        sliced.value_slice("o_totalprice", 1000), row_number="position").drop("o_totalprice")


@query("""SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS latest_order FROM orders GROUP BY o_custkey""")
def latest_lookup(t: Tables):
    return t.orders.groupBy("o_custkey").agg(
        F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("latest_order"))


@query("""SELECT count(DISTINCT o_custkey) AS keys, CAST(0 AS BIGINT) AS split_keys FROM orders""")
def repartition_colocates(t: Tables):
    """Repartition by key, merge neighbouring partitions: no key may end up in two of them."""
    n = 2 * t.spark.sparkContext.defaultParallelism
    placed = (t.orders.select("o_custkey").repartition(n, "o_custkey").coalesce(n // 2)
              .withColumn("pid", F.spark_partition_id()))
    per_key = placed.groupBy("o_custkey").agg(F.min("pid").alias("lo"), F.max("pid").alias("hi"))
    return per_key.agg(F.count("*").alias("keys"), F.count_if(F.col("lo") != F.col("hi")).alias("split_keys"))


@query("""SELECT o_orderstatus, count(*) AS n, CAST(sum(CAST(o_totalprice AS DECIMAL(12,2))) AS DOUBLE) AS total,
  CAST((SELECT max(o_totalprice) FROM orders) AS DOUBLE) AS peak FROM orders GROUP BY o_orderstatus""")
def cached_reuse(t: Tables):
    """Two results over one cached input; the cache is released once they are written."""
    small = t.orders.select("o_orderstatus", "o_totalprice").cache()
    try:
        peak = small.agg(F.max("o_totalprice")).first()[0]
        return materialised(small.groupBy("o_orderstatus").agg(
            F.count("*").alias("n"), F.sum(money("o_totalprice")).cast("double").alias("total"),
            F.lit(peak).alias("peak")), "report")
    finally:
        small.unpersist()


# ---------------------------------------------------------------- set operations


@query("""SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus IN ('F','O')""")
def union_by_name(t: Tables):
    f = t.orders.filter("o_orderstatus = 'F'").select("o_orderkey", "o_orderstatus")
    o = t.orders.filter("o_orderstatus = 'O'").select("o_orderstatus", "o_orderkey")
    return f.unionByName(o)


@query("""SELECT o_orderkey AS a, o_custkey AS b FROM orders WHERE o_orderstatus='F'
  UNION ALL SELECT o_custkey, o_orderkey FROM orders WHERE o_orderstatus='O'""")
def union_by_position(t: Tables):
    f = t.orders.filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("a"), F.col("o_custkey").alias("b"))
    return f.union(t.orders.filter("o_orderstatus = 'O'").select("o_custkey", "o_orderkey"))


@query("""SELECT doc_id AS id, lang, CAST(NULL AS VARCHAR) AS url FROM documents
  UNION ALL SELECT page_id, NULL, url FROM pages""")
def union_missing(t: Tables):
    d = t.documents.select(F.col("doc_id").alias("id"), "lang")
    return d.unionByName(t.pages.select(F.col("page_id").alias("id"), "url"), allowMissingColumns=True)


@query("""SELECT DISTINCT o_custkey, o_orderstatus FROM orders""")
def distinct_rows(t: Tables):
    return t.orders.select("o_custkey", "o_orderstatus").distinct()


@query("""SELECT count(*) AS survivors FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)""")
def dedup_any(t: Tables):
    return t.lineitem.dropDuplicates(["l_orderkey", "l_linenumber"]).agg(F.count("*").alias("survivors"))
