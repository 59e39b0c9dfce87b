"""Published results over the sample shop data."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from lakeops.plans import retail
from tests.retail_rows import ITEMS, ORDERS


@pytest.fixture(scope="module")
def raw(spark):
    data = [(*r[:9], (r[9], r[10]), r[11]) for r in ORDERS]
    return spark.createDataFrame(data, retail.ORDER_SCHEMA)


@pytest.fixture(scope="module")
def orders(raw):
    return retail.clean_orders(raw).cache()


@pytest.fixture(scope="module")
def items(spark):
    return retail.clean_items(spark.createDataFrame(ITEMS, retail.ITEM_SCHEMA)).cache()


def test_silver(raw, orders, items):
    assert orders.count() == 12 and items.count() == 18
    assert orders.where("order_id = 'ORD-1002'").first().order_status == "refunded"
    assert raw.select("region").distinct().count() >= 6 and orders.select("region").distinct().count() == 3
    assert orders.where("channel = 'unknown'").count() == 1


def test_join_counts(orders, items):
    n = {how: orders.join(items, "order_id", how).count() for how in ("inner", "left", "right", "full")}
    assert n == {"inner": 17, "left": 18, "right": 18, "full": 19}
    assert items.join(orders, "order_id", "left_anti").count() == 1
    assert orders.join(items, "order_id", "left_anti").first().order_id == "ORD-1012"


def test_explode(orders):
    assert orders.select(F.explode("promo_codes")).count() == 8
    assert orders.select(F.explode_outer("promo_codes")).count() == 14


def test_aggregates(orders, items):
    completed = orders.join(items, "order_id")
    na = orders.where("region = 'NA'").agg(F.count("*").alias("n"), F.count("customer_email").alias("e")).first()
    assert (na.n, na.e) == (5, 4)
    d = orders.agg(F.countDistinct("customer_id").alias("exact"), F.approx_count_distinct("customer_id").alias("approx")).first()
    assert (d.exact, d.approx) == (7, 7)
    wide = completed.groupBy("region").pivot("department", ["Apparel", "Beauty", "Electronics", "Grocery", "Home"]).agg(F.sum("net_amount"))
    assert wide.count() == 3 and len(wide.columns) == 6


def test_windows_and_dates(spark, orders):
    ranked = spark.sql("SELECT * FROM VALUES (10), (20), (20), (30) AS (v)")
    w = Window.partitionBy(F.lit(1)).orderBy("v")
    got = ranked.select(F.rank().over(w).alias("r"), F.dense_rank().over(w).alias("d"), F.round(F.percent_rank().over(w), 3).alias("p"),
                        F.ntile(2).over(w).alias("t"), "v").orderBy("v").collect()
    assert [r.r for r in got] == [1, 2, 2, 4] and [r.d for r in got] == [1, 2, 2, 3]
    assert [r.p for r in got] == [0, 0.333, 0.333, 1] and [r.t for r in got] == [1, 1, 2, 2]
    assert orders.select(F.datediff(F.lit("2026-09-15"), "order_date").alias("d")).first().d == 16
