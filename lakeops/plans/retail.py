"""Cleaning raw shop orders and their lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeops.operators.cdc import latest_per_key

ORDER_SCHEMA = ("order_id string, customer_id string, customer_email string, region string, channel string, "
                "order_status string, order_ts string, currency string, promo_codes array<string>, "
                "ship_address struct<city: string, state: string>, ingested_at string")
ITEM_SCHEMA = ("order_id string, line_no int, sku string, department string, qty int, unit_price double, "
               "discount_pct double")


def clean_orders(raw: DataFrame) -> DataFrame:
    """Typed, trimmed orders, the newest version of each."""
    typed = raw.select(
        "order_id", "customer_id", F.lower(F.trim("customer_email")).alias("customer_email"),
        F.upper(F.trim("region")).alias("region"), F.coalesce("channel", F.lit("unknown")).alias("channel"),
        F.lower(F.trim("order_status")).alias("order_status"), F.try_to_timestamp("order_ts").alias("order_ts"), "currency",
        "promo_codes", F.try_to_timestamp("ingested_at").alias("ingested_at"), F.col("ship_address.city").alias("city"),
        F.col("ship_address.state").alias("state")).withColumn("order_date", F.to_date("order_ts"))
    return latest_per_key(typed, ["order_id"], ["ingested_at", "order_ts"])


def clean_items(raw: DataFrame) -> DataFrame:
    """Lines with gross and net amount, rounded to cents."""
    gross = F.col("qty") * F.col("unit_price")
    return raw.withColumns({
        "department": F.initcap(F.trim("department")), "gross_amount": F.round(gross, 2),
        "net_amount": F.round(gross * (1 - F.col("discount_pct")), 2)})
