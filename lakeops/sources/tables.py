"""Reading and writing tables: Parquet directories by layer and name, and idempotent slices."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def load(spark: SparkSession, root: str, name: str) -> DataFrame:
    """One input table.  Zone-less timestamps are cast once, here; epoch functions refuse them."""
    df = spark.read.parquet(f"{root}/{name}.parquet")
    return df.select(*[
        F.col(f.name).cast("timestamp").alias(f.name) if isinstance(f.dataType, T.TimestampNTZType)
        else F.col(f.name)
        for f in df.schema.fields])


def table_path(root: str, layer: str, name: str) -> str:
    return f"{root.rstrip('/')}/{layer}/{name}"


def read_table(spark: SparkSession, root: str, layer: str, name: str) -> DataFrame:
    return spark.read.parquet(table_path(root, layer, name))


def write_table(df: DataFrame, root: str, layer: str, name: str,
                partition_by: Sequence[str] = (), codec: str = "zstd") -> str:
    """Overwrite a layer table; returns its path."""
    path = table_path(root, layer, name)
    df.write.mode("overwrite").option("compression", codec).partitionBy(*partition_by).parquet(path)
    return path


def overwrite_slices(df: DataFrame, path: str, slice_cols: Sequence[str]) -> None:
    """Replace exactly the slices present in ``df`` and leave the others alone."""
    (df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(*slice_cols).parquet(path))


def replace_slice(df: DataFrame, path: str, slice_col: str, value: str, partition_by: Sequence[str] = ()) -> None:
    """Make ``df`` all there is in one slice, also where the slice's own partitions become fewer."""
    target = f"{path}/{slice_col}={value}"
    df.where(F.col(slice_col) == value).drop(slice_col).write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy(*partition_by).parquet(target)


def append_commit(df: DataFrame, path: str, commit: str, column: str = "_commit") -> None:
    """Add rows as one commit, in a directory of its own; a commit that is written again replaces itself and nothing else."""
    overwrite_slices(df.withColumn(column, F.lit(commit)), path, [column])


def create_or_replace(df: DataFrame, table: str, path: str, properties: dict[str, str], partition_by: Sequence[str] = ()) -> None:
    """A catalog table over Parquet files with the given properties; one of that name is replaced, schema and all."""
    spark = df.sparkSession
    spark.sql(f"DROP TABLE IF EXISTS {table}")
    df.write.mode("overwrite").option("path", path).partitionBy(*partition_by).format("parquet").saveAsTable(table)
    listed = ", ".join(f"'{k}' = '{v}'" for k, v in properties.items())
    spark.sql(f"ALTER TABLE {table} SET TBLPROPERTIES ({listed})")


def refresh_slice(source: DataFrame, build: Callable[[DataFrame], DataFrame], path: str,
                  slice_col: str, since: Column) -> None:
    """Recompute a stored aggregate from ``since`` on and swap in those slices only."""
    overwrite_slices(build(source.where(F.col(slice_col) >= since)), path, [slice_col])


def with_audit(df: DataFrame, batch_id: str, run_date: str, ingested_at: Column) -> DataFrame:
    """Bronze audit columns.  The ingest time is passed in, so a rerun gives the same rows."""
    return df.select("*", F.col("_metadata.file_path").alias("_src_file"),
                     ingested_at.alias("_ingested_at"), F.lit(batch_id).alias("_batch_id"),
                     F.lit(run_date).cast("date").alias("extract_date"))


def read_json_permissive(spark: SparkSession, path: str, schema: T.StructType,
                         corrupt: str = "_corrupt") -> DataFrame:
    """JSON lines that keep unreadable records as text instead of failing or losing them."""
    declared = T.StructType([*schema.fields, T.StructField(corrupt, T.StringType())])
    return (spark.read.schema(declared).option("mode", "PERMISSIVE")
            .option("columnNameOfCorruptRecord", corrupt).json(path))


def read_batches(spark: SparkSession, glob: str, batch_id: Column) -> DataFrame:
    """A globbed half-hour feed, each row stamped with the batch its time falls into."""
    return spark.read.parquet(glob).withColumn("_batch_id", batch_id)
