"""Shop reports over a click log and a price history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeops.operators.joins import near_events
from lakeops.session import materialised

WEEK = 7 * 86_400
BASE_BLOCKS = 84  # two-hour blocks in seven days


def _rate(num: str, den: str) -> Column:
    """A rate that is 0.0 for an empty denominator, so averages do not lose the row."""
    return F.coalesce(F.round(F.try_divide(num, den), 6), F.lit(0.0))


def conversion_hourly(events: DataFrame, product: str, ts: str, kind: str, price: str) -> DataFrame:
    """Views, carts, purchases, three rates and revenue per product, hour and price."""
    is_kind = lambda k: F.col(kind) == k
    return (events.groupBy(product, F.date_trunc("hour", ts).alias("event_hour"), price)
            .agg(F.count_if(is_kind("view")).alias("views"), F.count_if(is_kind("cart")).alias("carts"),
                 F.count_if(is_kind("purchase")).alias("purchases"),
                 F.coalesce(F.sum(F.when(is_kind("purchase"), F.col(price))), F.lit(0)).alias("revenue"))
            .withColumns({"view_to_cart": _rate("carts", "views"), "cart_to_purchase": _rate("purchases", "carts"),
                          "overall_conv": _rate("purchases", "views")}))


def category_daily(conversion: DataFrame, category: Column) -> DataFrame:
    """Rates per category and day, from sums and never from rates."""
    return (conversion.groupBy(category.alias("category"), F.to_date("event_hour").alias("day"))
            .agg(F.sum("views").alias("views"), F.sum("carts").alias("carts"), F.sum("purchases").alias("purchases"))
            .withColumns({"cart_rate": F.round(F.try_divide("carts", "views"), 6),
                          "conversion": F.round(F.try_divide("purchases", "views"), 6)}))


def price_changes(intervals: DataFrame, price: str, threshold: float = 0.15) -> DataFrame:
    """Intervals that opened with a relative move above the threshold."""
    pct = F.round(F.try_divide(F.col(price) - F.col("prev_value"), F.col("prev_value")), 8)
    return intervals.withColumn("pct_change", pct).where(F.abs("pct_change") > threshold)


def elasticity(conversion: DataFrame, changes: DataFrame, product: str, price: str,
               floor: int = 30) -> DataFrame:
    """Purchases in the two hours after a change against the week before at the old price.

    The week is divided into two-hour blocks; changes with fewer than ``floor`` purchases in that
    week are left out.
    """
    rows = materialised(conversion.select(product, "event_hour", price, "purchases"), "conversion")
    at = materialised(changes.select(product, "effective_start", "prev_value", "pct_change"), "price-changes")
    keys = [product, "effective_start"]
    post = (near_events(rows, at, [product], "event_hour", "effective_start", 0, 7_200)
            .groupBy(*keys).agg(F.sum("purchases").alias("post_purchases")))
    before = near_events(rows, at, [product], "event_hour", "effective_start", WEEK, 0, slice_seconds=86_400)
    base = (before.where(F.col(price) == F.col("prev_value")).groupBy(*keys, "pct_change")
            .agg(F.sum("purchases").alias("base_purchases"))
            .where(F.col("base_purchases") >= floor))
    block = F.col("base_purchases") / BASE_BLOCKS
    moved = F.try_divide(F.coalesce("post_purchases", F.lit(0)) - block, block)
    return (base.join(post, keys, "left").select(
        *keys, "pct_change", "base_purchases", F.coalesce("post_purchases", F.lit(0)).alias("post_purchases"),
        F.round(moved / F.col("pct_change"), 6).alias("elasticity")))


def abandoned_carts(events: DataFrame, changes: DataFrame, product: str, ts: str, kind: str, session: str,
                    price: str, category: Column, within_seconds: int = 1_800) -> DataFrame:
    """Carts filled soon after a price increase and not bought in the session, per category.

    Lost revenue is stated at the price of the cart and at the price before the increase.
    """
    raised = changes.where("pct_change > 0.15").select(product, "effective_start", "prev_value")
    carts = near_events(events.where(F.col(kind) == "cart"), raised, [product], ts, "effective_start", 0,
                        within_seconds)
    bought = events.where(F.col(kind) == "purchase").select(session, product).distinct()
    return (carts.join(bought, [session, product], "left_anti").groupBy(category.alias("category"))
            .agg(F.count(F.lit(1)).alias("abandoned"), F.sum(price).alias("lost_at_cart"),
                 F.sum("prev_value").alias("lost_at_old")))
