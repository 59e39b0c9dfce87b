"""Connected components of a graph that is too large for one machine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeops.session import materialised


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``edges`` (a, b: long): the smallest node that can be reached from it.

    Alternating large-star and small-star steps (Kiveris et al., 2014): each step hangs a node's neighbours
    on the smallest of them, so paths shorten until every component is one star. Each step is written to
    the shared folder; only a count and a checksum come to the driver.
    """
    star = materialised(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    seen = None
    while True:
        both = star.select("a", "b").union(star.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("_a"), F.least("a", "m").alias("m"))
        large = both.join(least, F.col("a") == F.col("_a")).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        large = materialised(large, "large-star")
        least = large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "_a")
        joined = large.join(least, F.col("a") == F.col("_a"))
        small = joined.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select(F.col("_a").alias("a"), F.col("m").alias("b")))
        star = materialised(small.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "small-star")
        now = star.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if now == seen:
            break
        seen = now
    return star.select(F.col("a").alias("node"), F.col("b").alias("root")).union(star.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
