"""Exact percentiles without holding a group's values in one task."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakeops.functions.columns import count_upto
from lakeops.session import materialised


def exact_percentiles(df: DataFrame, keys: Sequence[str], value: str, probs: Mapping[str, float],
                      bands: int = 256) -> DataFrame:
    """Interpolated percentiles per key, equal to ``percentile(value, p)``; NULL values do not count.

    Equal values of a key become one row with a count, written once. A sketch of those rows cuts the value axis into
    ``bands`` with about as many rows each, so a key that holds a third of them is spread over a third of the bands. Counts per key
    and band tell which band holds a wanted rank, and only there, on (key, band), are values put in order. Groups of
    any size go the same way.
    """
    named = list(keys)
    keys = named or ["_all"]
    base = df if named else df.withColumn("_all", F.lit(0))
    v = F.col(value).cast("double").alias("_v")
    counted = materialised(base.select(*keys, v).where(F.col("_v").isNotNull()).groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_c")), "counted")
    cuts = counted.agg(F.percentile_approx("_v", [i / bands for i in range(1, bands)], 100 * bands).alias("cuts")).scalar()
    banded = counted.withColumn("_cuts", cuts).withColumn("_band", F.coalesce(count_upto("_cuts", F.col("_v"), steps=bands.bit_length()), F.lit(0))).drop("_cuts")

    key = Window.partitionBy(*keys)
    along = key.orderBy("_band")
    sums = banded.groupBy(*keys, "_band").agg(F.sum("_c").alias("_c")).select(
        "*", F.coalesce(F.sum("_c").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"), F.sum("_c").over(key).alias("_n"))
    asked = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(float(p)).alias("p")) for name, p in probs.items()])
    pos = F.col("_w.p") * (F.col("_n") - 1)
    ranks = F.array(F.struct(F.lit("a").alias("end"), F.floor(pos).alias("rank")), F.struct(F.lit("b").alias("end"), F.ceil(pos).alias("rank")))
    wanted = (sums.withColumn("_w", F.explode(asked)).select("*", pos.alias("_pos"), F.explode(ranks).alias("_r"))
              .where((F.col("_r.rank") >= F.col("_before")) & (F.col("_r.rank") < F.col("_before") + F.col("_c")))
              .select(*[F.col(k).alias(f"_b_{k}") for k in keys], F.col("_band").alias("_b_band"), F.col("_w.name").alias("_name"),
                      F.col("_r.end").alias("_end"), "_pos", (F.col("_r.rank") - F.col("_before")).alias("_rank")))
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_b_{k}")) for k in keys])  # NULL is a group too
    upto = Window.partitionBy(*keys, "_band").orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # A value stands at the ranks from the count before it up to its own.
    placed = banded.withColumn("_upto", F.sum("_c").over(upto))
    picked = (placed.join(wanted, same & (F.col("_band") == F.col("_b_band")))
              .where((F.col("_rank") < F.col("_upto")) & (F.col("_rank") >= F.col("_upto") - F.col("_c"))))
    at = lambda end: F.max(F.when(F.col("_end") == end, F.col("_v")))
    ends = picked.groupBy(*keys, "_name", "_pos").agg(at("a").alias("_a"), at("b").alias("_b"))
    x = F.col("_a") + (F.col("_b") - F.col("_a")) * (F.col("_pos") - F.floor("_pos"))
    wide = ends.withColumn("_x", x).groupBy(*keys).pivot("_name", list(probs)).agg(F.min("_x"))
    return wide if named else wide.drop("_all")
