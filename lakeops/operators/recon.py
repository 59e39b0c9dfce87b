"""Ledger reconciliation: one-to-one pairing, variance, statements, restatement drift, currency."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeops.operators import sliced
from lakeops.operators.joins import spread_join
from lakeops.operators.quality import QualityError, unordered_digest


def rate_lookup(df: DataFrame, rates: DataFrame, keys: Sequence[str], rate: str, flag: str,
                missing: str, found: str = "RATED") -> DataFrame:
    """Left join a rate table on several keys; a row without a rate is flagged and kept.

    Rate keys have few values, so the rows of a key are spread over several tasks.
    """
    return (spread_join(df, rates, list(keys), "left")
            .withColumn(flag, F.when(F.col(rate).isNull(), missing).otherwise(found)))


def convert_currency(df: DataFrame, fx: DataFrame, amount: str, currency: str, day: str, out: str) -> DataFrame:
    """Amounts in the base currency; a missing rate leaves NULL, to be counted by ``assert_rates``."""
    return (spread_join(df, fx, [currency, day], "left")
            .withColumn(out, F.round(F.col(amount) * F.col("rate"), 5)))


def assert_rates(df: DataFrame) -> DataFrame:
    missing = df.agg(F.count_if(F.col("rate").isNull())).first()[0]
    if missing:
        raise QualityError(f"{missing} rows have no exchange rate")
    return df


def _numbered(df: DataFrame, keys: Sequence[str], order: Sequence[str], slice_by: Column, side: str) -> DataFrame:
    numbered = sliced.ranks(df, keys, list(order), slice_by, row_number="pair_no")
    kept = [c for c in df.columns if c not in keys]
    return numbered.select(*keys, "pair_no", *[F.col(c).alias(f"{side}_{c}") for c in kept],
                           F.lit(True).alias(f"_{side}"))


def reconcile(ours: DataFrame, theirs: DataFrame, keys: Sequence[str], order: Sequence[str], measure: str,
              tolerance: float, slice_by: Column) -> DataFrame:
    """Pair two ledgers one to one and give every leg a ``match_status``.

    A key may occur several times on both sides; its rows are numbered by ``order`` and the number
    joins the key, so nothing multiplies and a hot key spreads over its numbers.
    """
    on = [*keys, "pair_no"]
    rows = ours.count() + theirs.count()
    left, right = (sliced.dealt(_numbered(df, keys, order, slice_by, side), on, rows) for df, side in ((ours, "our"), (theirs, "their")))
    both = left.join(right, on, "full")
    diff = F.abs(F.col(f"our_{measure}") - F.col(f"their_{measure}"))
    status = (F.when(F.col("_our").isNull(), "MISSING_ON_OUR_SIDE")
              .when(F.col("_their").isNull(), "MISSING_ON_THEIR_SIDE")
              .when(diff <= tolerance, "MATCHED").otherwise("DURATION_MISMATCH"))
    return both.withColumn("match_status", status).drop("_our", "_their")


def variance_report(matched: DataFrame, by: Sequence[str], duration: str, charge: str) -> DataFrame:
    """Counts by status, minutes, charges, match rate and variance per partner."""
    status = F.col("match_status")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return (matched.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total_legs"),
        F.count_if(status == "MATCHED").alias("matched_legs"),
        F.count_if(status == "MISSING_ON_OUR_SIDE").alias("missing_ours"),
        F.count_if(status == "MISSING_ON_THEIR_SIDE").alias("missing_theirs"),
        F.count_if(status == "DURATION_MISMATCH").alias("duration_mismatches"),
        F.round(total(f"our_{duration}") / 60.0, 2).alias("our_minutes"),
        F.round(total(f"their_{duration}") / 60.0, 2).alias("their_minutes"),
        total(f"our_{charge}").alias("our_charge"), total(f"their_{charge}").alias("their_charge"))
        .withColumn("match_rate", F.round(F.col("matched_legs") / F.greatest("total_legs", F.lit(1)), 5))
        .withColumn("variance", F.col("our_charge") - F.col("their_charge")))


def leakage(variance: DataFrame, partner: str, threshold: float) -> DataFrame:
    """One row: total absolute variance, the worst partner, whether the threshold is breached."""
    size = F.abs("variance")
    return (variance.agg(F.sum(size).cast("double").alias("total_abs_variance"),
                         F.max_by(partner, F.struct(size, partner)).alias("worst_partner"),
                         F.max(size).cast("double").alias("worst_variance"))
            .withColumn("breached", F.col("total_abs_variance") > threshold))


def monthly_statement(daily: DataFrame, partner: str, day: str, version: str | None = None) -> DataFrame:
    """Sums per partner and month, with direction, the days covered and whether the month is whole."""
    month = F.trunc(day, "month")
    sums = daily.groupBy(partner, month.alias("statement_month")).agg(
        *[F.sum(c).alias(c) for c in ("our_minutes", "their_minutes", "total_legs", "matched_legs",
                                      "missing_ours", "missing_theirs")],
        F.sum("our_charge").alias("we_billed"), F.sum("their_charge").alias("they_billed"),
        F.sum("variance").alias("net_variance"), F.countDistinct(day).alias("days_included"))
    out = (sums.withColumn("match_rate", F.round(F.col("matched_legs") / F.greatest("total_legs", F.lit(1)), 5))
           .withColumn("settlement_direction",
                       F.when(F.col("net_variance") > 0, "PARTNER_OWES_US")
                       .when(F.col("net_variance") < 0, "WE_OWE_PARTNER").otherwise("BALANCED"))
           .withColumn("month_is_whole",
                       F.col("days_included") == F.dayofmonth(F.last_day("statement_month"))))
    return out if version is None else out.withColumn("source_version", F.lit(version))


#: What the digest of a statement and of its source are taken over, in this order.
STATED = ("total_legs", "matched_legs", "we_billed", "they_billed", "net_variance")
SOURCED = ("total_legs", "matched_legs", "our_charge", "their_charge")


def settlement(daily: DataFrame, partner: str, day: str) -> DataFrame:
    """Statements of the months whose every calendar day is present, refused lines for the others.

    A statement carries the digest of all statements of its month and the digest of the daily rows it comes from, so a
    restated day shows even where the sums agree. Completeness is a matter of the month over all partners; a refused month
    has one line without a partner and without sums. Days and digests come from one aggregate over the daily rows.
    """
    month = F.trunc(day, "month")
    source = daily.groupBy(month.alias("statement_month")).agg(
        F.countDistinct(day).alias("days_present"), unordered_digest([partner, day, *SOURCED]).alias("source_digest")).withColumn(
        "days_expected", F.dayofmonth(F.last_day("statement_month")))
    sums = daily.groupBy(partner, month.alias("statement_month")).agg(
        F.sum("total_legs").alias("total_legs"), F.sum("matched_legs").alias("matched_legs"), F.sum("our_charge").alias("we_billed"),
        F.sum("their_charge").alias("they_billed"), F.sum("variance").alias("net_variance"))
    digest = sums.groupBy("statement_month").agg(unordered_digest([partner, *STATED]).alias("statement_digest"))
    whole = source.where("days_present >= days_expected").join(digest, "statement_month")
    net = F.col("net_variance")
    direction = F.when(net > 0, "PARTNER_OWES_US").when(net < 0, "WE_OWE_PARTNER").otherwise("BALANCED")
    issued = sums.join(whole, "statement_month").select(
        partner, "statement_month", F.lit("ISSUED").alias("status"), "days_present", *STATED, direction.alias("settlement_direction"),
        "statement_digest", "source_digest")
    refused = source.where("days_present < days_expected").select("statement_month", F.lit("REFUSED").alias("status"), "days_present", "source_digest")
    return issued.unionByName(refused, allowMissingColumns=True)


def assert_whole_month(daily: DataFrame, day: str, month: str) -> DataFrame:
    """The rows of ``month`` (yyyy-MM), refused when any of its days is absent."""
    rows = daily.where(F.date_format(day, "yyyy-MM") == month)
    first = F.lit(f"{month}-01").cast("date")
    got = rows.agg(F.countDistinct(day).alias("days"), F.dayofmonth(F.last_day(first)).alias("expected")).first()
    if got["days"] < got["expected"]:
        raise QualityError(f"only {got['days']} of {got['expected']} days present for {month}")
    return rows


def restatement_drift(published: DataFrame, current: DataFrame, keys: Sequence[str], value: str,
                      threshold: float = 0.001) -> DataFrame:
    """Published figures against restated ones, both sides kept; material above ``threshold``."""
    p = published.select(*keys, F.col(value).alias("published"))
    c = current.select(*keys, F.col(value).alias("restated"))
    drift = F.coalesce("restated", F.lit(0)) - F.coalesce("published", F.lit(0))
    share = F.round(F.try_divide(drift.cast("double"), F.abs("published").cast("double")), 4)
    return (p.join(c, list(keys), "full").withColumn("drift", drift).withColumn("drift_pct", share)
            .withColumn("material", F.coalesce(F.abs("drift_pct") > threshold, F.col("drift") != 0)))
