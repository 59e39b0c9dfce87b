"""File layout: statistics, compaction, clustering, bucketed tables, plan checks."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakeops.functions.columns import stable_salt


def file_listing(spark: SparkSession, path: str, partition_cols: Sequence[str] = ()) -> DataFrame:
    """One row per data file: partition values, bytes, rows."""
    df = spark.read.parquet(path)
    return (df.select(*partition_cols, F.col("_metadata.file_path").alias("file"),
                      F.col("_metadata.file_size").alias("bytes"))
            .groupBy(*partition_cols, "file", "bytes").agg(F.count(F.lit(1)).alias("rows")))


def file_stats(spark: SparkSession, path: str, partition_cols: Sequence[str] = ()) -> DataFrame:
    """Files, rows and file sizes, per partition when partition columns are named."""
    return file_listing(spark, path, partition_cols).groupBy(*partition_cols).agg(
        F.count(F.lit(1)).alias("files"), F.sum("rows").alias("rows"), F.sum("bytes").alias("bytes"),
        F.round(F.avg("bytes"), 1).alias("avg_bytes"), F.percentile_approx("bytes", 0.5).alias("median_bytes"),
        F.min("bytes").alias("min_bytes"), F.max("bytes").alias("max_bytes"))


def commit_summary(before: DataFrame, after: DataFrame) -> DataFrame:
    """Files and rows that a commit added, deleted and left, per partition, from two listings of :func:`file_listing`."""
    parts = [c for c in before.columns if c not in ("file", "bytes", "rows")]
    old, new = (df.select(*parts, "file", F.col("rows").alias(n)) for df, n in ((before, "was"), (after, "now")))
    both = old.join(new, [*parts, "file"], "full")
    added, deleted = F.col("was").isNull(), F.col("now").isNull()
    total = lambda cond, rows: F.coalesce(F.sum(F.when(cond, F.col(rows))), F.lit(0))
    return both.groupBy(*parts).agg(
        F.count_if(added).alias("added_files"), F.count_if(deleted).alias("deleted_files"), F.count_if(~added & ~deleted).alias("kept_files"),
        total(added, "now").alias("added_rows"), total(deleted, "was").alias("deleted_rows"), total(~added & ~deleted, "now").alias("kept_rows"))


def needs_compaction(stats: DataFrame, max_files: int = 500) -> DataFrame:
    return stats.withColumn("compact", F.col("files") > max_files)


def _files_wanted(spark: SparkSession, path: str, target_bytes: int, parts: Sequence[str]) -> DataFrame:
    return file_listing(spark, path, parts).groupBy(*parts).agg(
        F.greatest(F.ceil(F.sum("bytes") / target_bytes), F.lit(1)).cast("int").alias("_files"))


def compact(spark: SparkSession, path: str, out: str, target_bytes: int, partition_cols: Sequence[str] = ()) -> None:
    """Rewrite small files into files of about ``target_bytes``.

    Rows of a partition are spread over as many salts as it needs files, so a partition that holds
    most of the table is written by many tasks. Files are numbered and each is a task of its own: a task never holds two.
    """
    wanted = _files_wanted(spark, path, target_bytes, partition_cols)
    df = spark.read.parquet(path)
    if not partition_cols:
        df.repartition(wanted.first()["_files"]).write.mode("overwrite").option("compression", "zstd").parquet(out)
        return
    total = wanted.agg(F.sum("_files")).first()[0]
    before = Window.orderBy(*partition_cols).rowsBetween(Window.unboundedPreceding, -1)
    first = wanted.select(*[F.col(c).alias(f"_p_{c}") for c in partition_cols], "_files", F.coalesce(F.sum("_files").over(before), F.lit(0)).alias("_first"))
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"_p_{c}")) for c in partition_cols])
    number = (F.col("_first") + stable_salt(list(df.columns), F.col("_files"))).cast("int")
    (df.join(first, same, "left").select(*df.columns, number.alias("_file")).repartitionById(total, "_file").drop("_file")
     .write.mode("overwrite").option("compression", "zstd").partitionBy(*partition_cols).parquet(out))


def _write_ranges(df: DataFrame, n: int, order: Sequence[str | Column], out: str) -> None:
    """``n`` files of adjacent ranges.  A salt ends the range key, so a value that holds much of the
    table is cut into several files instead of filling one task."""
    (df.withColumn("_salt", stable_salt(list(df.columns), 1 << 20)).repartitionByRange(n, *order, "_salt")
     .sortWithinPartitions(*order).drop("_salt", "_z")
     .write.mode("overwrite").option("compression", "zstd").parquet(out))


def compact_sorted(spark: SparkSession, path: str, out: str, target_bytes: int,
                   sort_cols: Sequence[str | Column]) -> None:
    """Rewrite in range-partitioned, sorted files, so that file bounds are narrow on the sort columns."""
    n = _files_wanted(spark, path, target_bytes, []).first()["_files"]
    _write_ranges(spark.read.parquet(path), n, sort_cols, out)


def zorder_key(df: DataFrame, cols: Sequence[str], bits: int = 6) -> Column:
    """Interleaved bits of each column's rank band; sort by it to cluster on several columns at once.

    Bands come from approximate quantiles, so skewed values still fill all of them.
    """
    bands = 2 ** bits
    probs = [i / bands for i in range(1, bands)]
    cuts = df.select(*[F.percentile_approx(F.col(c).cast("double"), probs).alias(c) for c in cols]).first()
    key = F.lit(0).cast("bigint")
    for j, c in enumerate(cols):
        edges = F.array(*[F.lit(x) for x in cuts[c]])
        value = F.coalesce(F.col(c).cast("double"), F.lit(float("-inf")))
        band = F.size(F.filter(edges, lambda e, v=value: e < v)).cast("bigint")
        for b in range(bits):
            bit = F.shiftright(band, b).bitwiseAND(F.lit(1))
            key = key.bitwiseOR(F.shiftleft(bit, b * len(cols) + j))
    return key


def compact_zorder(spark: SparkSession, path: str, out: str, target_bytes: int, cols: Sequence[str],
                   bits: int = 6) -> None:
    df = spark.read.parquet(path)
    n = _files_wanted(spark, path, target_bytes, []).first()["_files"]
    _write_ranges(df.withColumn("_z", zorder_key(df, cols, bits)), n, ["_z"], out)


def prunable(spark: SparkSession, path: str, col: str, low, high) -> DataFrame:
    """One row: files, and how many of them could hold a value in ``[low, high]`` by their bounds."""
    per_file = spark.read.parquet(path).groupBy(F.col("_metadata.file_path").alias("file")).agg(
        F.min(col).alias("lo"), F.max(col).alias("hi"))
    return per_file.agg(F.count(F.lit(1)).alias("files"),
                        F.count_if((F.col("lo") <= high) & (F.col("hi") >= low)).alias("can_match"))


def cluster_for_write(df: DataFrame, keys: Sequence[str], order: Sequence[str], salts: int = 1,
                      salt_by: Sequence[str] | None = None) -> DataFrame:
    """Distribute by the partition keys and sort inside, the way files should come out.

    ``salts`` above 1 splits every key over that many tasks, for hours that hold far more than others.
    """
    spread = [*keys] if salts == 1 else [*keys, stable_salt(list(salt_by or df.columns), salts)]
    return df.repartition(*spread).sortWithinPartitions(*keys, *order)


def write_bucketed(df: DataFrame, table: str, path: str, buckets: int, keys: Sequence[str]) -> None:
    """Save a table bucketed and sorted by its join keys; two such tables with the same number of
    buckets join without a shuffle."""
    (df.repartition(buckets, *keys).write.mode("overwrite").option("path", path)
     .bucketBy(buckets, *keys).sortBy(*keys).saveAsTable(table))


def plan_text(df: DataFrame) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def count_exchanges(df: DataFrame) -> int:
    """Hash shuffles in the physical plan before it runs."""
    return plan_text(df).count("Exchange hashpartitioning")


def layout_decay(stats: DataFrame, hours: str = "hours", files: str = "files", avg_bytes: str = "avg_bytes",
                 seconds: str = "query_seconds") -> DataFrame:
    """One row: files added and average size lost per day of small commits, and the hours until the
    query takes twice as long as right after compaction; compact more often than that."""
    h = F.col(hours)
    return (stats.agg(F.round(F.regr_slope(F.col(files), h) * 24, 6).alias("files_per_day"),
                      F.round(F.regr_slope(F.col(avg_bytes), h) * 24, 6).alias("avg_bytes_per_day"),
                      F.min_by(seconds, hours).alias("fresh_seconds"),
                      F.regr_slope(F.col(seconds), h).alias("_slope"))
            .withColumn("hours_to_double", F.when(F.col("_slope") > 0,
                                                  F.round(F.col("fresh_seconds") / F.col("_slope"), 6)))
            .drop("_slope"))
