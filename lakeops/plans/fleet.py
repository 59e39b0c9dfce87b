"""Cold-chain, meter and arrival reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeops.operators import temporal
from lakeops.operators.quantiles import exact_percentiles
from lakeops.session import materialised


def breaches(readings: DataFrame, subject: str, ts: str, value: str, low: str, high: str, *,
             min_minutes: float = 30.0, carry: dict[str, Column] | None = None,
             max_step_seconds: int | None = None, tie: Sequence[str] = (), box: Sequence[str] = ()) -> DataFrame:
    """Unbroken stretches out of range for longer than ``min_minutes``, with extremes and severity.

    ``box`` names coordinates whose envelope over the stretch is reported, ``carry`` adds further aggregates of it.
    """
    out = readings.withColumn("_out", (F.col(value) < F.col(low)) | (F.col(value) > F.col(high)))
    stretch = temporal.runs(out, [subject], ts, "_out", max_step_seconds, tie)
    minutes = (F.unix_micros("breach_end") - F.unix_micros("breach_start")) / 60_000_000
    return (stretch.groupBy(subject, "run_id")
            .agg(F.min(ts).alias("breach_start"), F.max(ts).alias("breach_end"), F.min(value).alias("min_value"),
                 F.max(value).alias("max_value"), F.count(F.lit(1)).alias("readings"),
                 *[agg.alias(name) for name, agg in (temporal.envelope(*box) | (carry or {})).items()])
            .withColumn("duration_min", minutes).where(F.col("duration_min") > min_minutes)
            .withColumn("severity", F.when(F.col("duration_min") > 120, "CRITICAL")
                        .when(F.col("duration_min") > 60, "HIGH").otherwise("MEDIUM")))


def outages(readings: DataFrame, meter: str, block: str, slot: str, step: int, slot_minutes: int, *,
            min_slots: int = 3, cluster: int = 5) -> DataFrame:
    """Silent stretches of at least ``min_slots`` between a meter's first and last reading, and how many
    other meters of its block were silent at some time in the same stretch."""
    silent = temporal.missing_slots(readings, [meter, block], slot, step)
    found = temporal.slot_runs(silent, [meter, block], slot, step).where(F.col("slots") >= min_slots)
    spans = (found.withColumn("from_slot", F.expr(f"first_slot div {step}"))
             .withColumn("to_slot", F.expr(f"last_slot div {step}") + 1))
    counted = temporal.overlap_count(spans, block, meter, "from_slot", "to_slot",
                                     name="concurrent_meters")
    return (counted.select(meter, block, "run_id", "first_slot", "last_slot", "slots",
                           (F.col("slots") * slot_minutes).alias("duration_min"), "concurrent_meters")
            .withColumn("classification",
                        F.when(F.col("concurrent_meters") >= cluster, "CLUSTERED").otherwise("ISOLATED")))


def outage_mart(events: DataFrame, block: str, since_slot: Column) -> DataFrame:
    """Events, minutes and largest cluster per block and class since a slot."""
    return (events.where(F.col("last_slot") >= since_slot).groupBy(block, "classification")
            .agg(F.count(F.lit(1)).alias("events"), F.sum("duration_min").alias("total_minutes"),
                 F.max("concurrent_meters").alias("largest_cluster")))


def binned_response(df: DataFrame, group: str, axis: str, value: str) -> DataFrame:
    """Mean per whole-number bin of ``axis``, the bin with the least, and the slope on either side of it.

    The bins are few; everything after the first aggregate works on one row per bin.
    """
    bins = df.groupBy(group, F.floor(axis).alias("bin")).agg(F.avg(value).alias("mean_value"))
    least = bins.groupBy(group).agg(F.min_by("bin", F.struct("mean_value", "bin")).alias("least_bin"))
    side = lambda cond: F.regr_slope(F.when(cond, F.col("mean_value")), F.when(cond, F.col("bin")))
    return (bins.join(least, group).groupBy(group, "least_bin")
            .agg(F.round(side(F.col("bin") <= F.col("least_bin")), 4).alias("slope_below"),
                 F.round(side(F.col("bin") >= F.col("least_bin")), 4).alias("slope_above")))


def arrival_performance(trips: DataFrame, dims: Sequence[str], promised: str, actual: str) -> DataFrame:
    """Minutes late per route: trips, median, 90th percentile, worst."""
    minutes = (F.unix_seconds(actual) - F.unix_seconds(promised)) / 60
    late = materialised(trips.select(*dims, minutes.alias("variance_min")), "arrivals")  # the joins behind it run once
    spread = exact_percentiles(late, dims, "variance_min", {"median_var": 0.5, "p90_var": 0.9})
    worst = late.groupBy(*dims).agg(F.count(F.lit(1)).alias("trips"), F.max("variance_min").alias("worst_var"))
    return worst.join(spread, list(dims))
