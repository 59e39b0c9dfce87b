"""Streaming forms of the micro-batch feeds, each with a batch twin elsewhere in the package.

Late rows are accepted for six hours by default.  In append mode a window or session appears once
the watermark has passed its end; ``run_closed`` and ``run_arrivals`` end with a last call that closes them all.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeops.operators.cdc import latest_per_key, merge_cdc
from lakeops.operators.versions import VersionedTable
from lakeops.session import materialised, scratch
from lakeops.sources import files
from lakeops.sources.tables import overwrite_slices

LATE = "6 hours"


def _end() -> Column:
    """The end of time, for a feed."""
    return F.to_timestamp(F.lit("9000-01-01"))


def read_table_stream(spark: SparkSession, root: str, name: str, files_per_batch: int | None = None) -> DataFrame:
    """A Parquet table as a stream of its files; zone-less timestamps are cast, as in batch."""
    path = f"{root}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    if files.is_directory(spark, path):
        df = reader.parquet(path)
    else:
        df = reader.option("pathGlobFilter", f"{name}.parquet").parquet(root)
    return df.select(*[F.col(f.name).cast("timestamp").alias(f.name) if isinstance(f.dataType, T.TimestampNTZType)
                       else F.col(f.name) for f in schema.fields])


def tumbling(stream: DataFrame, ts: str, keys: Sequence[str], width: str, aggs: Mapping[str, Column],
             late: str = LATE, slide: str | None = None) -> DataFrame:
    """Windowed aggregates per key; with ``slide`` the windows overlap."""
    window = F.window(ts, width, slide) if slide else F.window(ts, width)
    return (stream.withWatermark(ts, late).groupBy(window.alias("w"), *keys)
            .agg(*[a.alias(n) for n, a in aggs.items()])
            .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys, *aggs))


def sliding_sums(stream: DataFrame, ts: str, keys: Sequence[str], width: int, slide: int, sums: Mapping[str, Column],
                 late: str = LATE) -> DataFrame:
    """Sums per key over overlapping windows of ``width`` seconds, one beginning every ``slide`` seconds, as ``tumbling`` gives them.

    The state does not hold a row for each of the ``width / slide`` windows an event is in. It holds the event in two blocks twice as
    long as a window; a block gives the windows that begin in its first half, when it closes. So a late row counts until its block
    has closed, up to ``width`` after its window, and a key's events of one block must fit a row.
    """
    if width % slide:
        raise ValueError("the width of a window is no multiple of the slide")
    n, step = width // slide, slide * 1_000_000
    kinds = dict(stream.agg(*[F.sum(c).alias(a) for a, c in sums.items()]).dtypes)
    held = F.struct(F.floor(F.unix_micros(ts) / F.lit(step)).alias("at"), *[c.alias(a) for a, c in sums.items()])
    blocks = (stream.withWatermark(ts, late).withColumn("_held", held)
              .groupBy(F.window(ts, f"{2 * width} seconds", f"{width} seconds").alias("w"), *keys).agg(F.collect_list("_held").alias("_all")))
    first = F.floor(F.unix_micros("w.start") / F.lit(step))
    inside = lambda i: F.filter("_all", lambda e: (e["at"] >= first + i) & (e["at"] < first + i + n))
    windows = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.struct((first + i).alias("at"), inside(i).alias("rows")))
    each = blocks.select(*keys, F.explode(F.filter(windows, lambda x: F.size(x["rows"]) > 0)).alias("_x"))

    def total(a: str) -> Column:
        kind = kinds[a]
        return F.aggregate("_x.rows", F.lit(None).cast(kind), lambda s, e: F.coalesce((s + e[a]).cast(kind), s, e[a].cast(kind))).alias(a)

    start = F.col("_x.at") * step
    return each.select(F.timestamp_micros(start).alias("window_start"), F.timestamp_micros(start + width * 1_000_000).alias("window_end"),
                       *keys, *map(total, sums))


def without_replays(stream: DataFrame, ids: Sequence[str], ts: str, late: str = LATE) -> DataFrame:
    """Drop repeated ids that arrive within the late window; the first one stays."""
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark(list(ids))


def sessions(stream: DataFrame, user: str, ts: str, gap: str, late: str = LATE) -> DataFrame:
    """Sessions that end ``gap`` after their last event."""
    return (stream.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("w"), user)
            .agg(F.count(F.lit(1)).alias("events"))
            .select(user, F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "events"))


def run_to_end(df: DataFrame, label: str) -> DataFrame:
    """Process what is there into a Parquet sink and read the result."""
    spark = df.sparkSession
    out = scratch(spark, label)
    (df.writeStream.format("parquet").outputMode("append").option("checkpointLocation", scratch(spark, f"{label}-progress"))
     .trigger(availableNow=True).start(out).awaitTermination())
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in df.schema.fields])
    return spark.read.schema(schema).parquet(out)


def _run(df: DataFrame, out: str, progress: str):
    query = (df.writeStream.format("parquet").outputMode("append").option("checkpointLocation", progress)
             .trigger(availableNow=True).start(out))
    query.awaitTermination()
    return query


def _last_call(spark: SparkSession, schema: T.StructType, ts: str, path: str) -> None:
    """One row without values at the end of time: it moves the watermark past every open window, and its own never closes."""
    values = [F.lit(None).cast(f.dataType).alias(f.name) if f.name != ts else _end().cast(f.dataType).alias(ts) for f in schema.fields]
    spark.range(1).select(*values).write.mode("append").parquet(path)


def run_closed(stream: DataFrame, ts: str, build: Callable[[DataFrame], DataFrame], label: str) -> DataFrame:
    """Process what is there, then close every window that is still open: the result covers all rows of the stream.

    A second source beside the stream stays empty until the first is read; a restart from the same checkpoint then takes the
    last call from it.
    """
    spark = stream.sparkSession
    tail, out, progress = (scratch(spark, f"{label}-{x}") for x in ("tail", "out", "progress"))
    spark.createDataFrame([], stream.schema).write.parquet(tail)
    built = build(stream.unionByName(spark.readStream.schema(stream.schema).parquet(tail)))
    _run(built, out, progress)
    _last_call(spark, stream.schema, ts, tail)
    _run(built, out, progress)
    return spark.read.schema(T.StructType([T.StructField(f.name, f.dataType) for f in built.schema.fields])).parquet(out)


def run_arrivals(arrivals: Sequence[DataFrame], ts: str, build: Callable[[DataFrame], DataFrame], label: str) -> tuple[DataFrame, int]:
    """A feed that gets its files in several deliveries, each taken as a batch of its own before the next one comes.

    The watermark moves from batch to batch, so rows whose window it has passed are dropped. Returns the rows of all
    windows, closed by a last call, and how many rows were delivered, as an observed metric of the batches.
    """
    spark, schema = arrivals[0].sparkSession, arrivals[0].schema
    inbox, out, progress = (scratch(spark, f"{label}-{x}") for x in ("inbox", "out", "progress"))
    delivered = 0
    for arrival in (*arrivals, None):
        if arrival is None:
            _last_call(spark, schema, ts, inbox)
        else:
            arrival.select(*schema.names).write.mode("append").parquet(inbox)
        seen = spark.readStream.schema(schema).parquet(inbox).observe("arrived", F.count_if(F.col(ts).isNull() | (F.col(ts) < _end())).alias("rows"))
        built = build(seen)
        for step in _run(built, out, progress).recentProgress:
            row = step.observedMetrics.get("arrived")
            delivered += row["rows"] if row is not None and row["rows"] is not None else 0
    return spark.read.schema(T.StructType([T.StructField(f.name, f.dataType) for f in built.schema.fields])).parquet(out), delivered


_APPLIED = "rows long, keys long, batch_id long"


def read_state(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The rows of a state kept by :func:`upsert_partitions`; none before the first batch."""
    return spark.read.schema(schema).parquet(f"{path}/rows") if files.is_directory(spark, f"{path}/rows") else spark.createDataFrame([], schema)


def applied_batches(spark: SparkSession, path: str) -> DataFrame:
    """batch_id, rows and keys of every batch that has been applied."""
    return (spark.read.schema(_APPLIED).parquet(f"{path}/applied") if files.is_directory(spark, f"{path}/applied")
            else spark.createDataFrame([], _APPLIED)).select("batch_id", "rows", "keys")


def state_schema(batch: T.StructType, op: str, deleted: str = "is_deleted") -> T.StructType:
    kept = [T.StructField(f.name, f.dataType) for f in batch.fields if f.name != op]
    return T.StructType([*kept, T.StructField(deleted, T.BooleanType()), T.StructField("_bucket", T.IntegerType())])


def upsert_partitions(path: str, keys: Sequence[str], order: Sequence[str], version: str, op: str, buckets: int = 64,
                      deleted: str = "is_deleted", **options) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that merges each batch into Parquet partitions by hash of the key.

    Only the partitions that the batch's keys live in are read, merged beside the table and swapped in; a ledger then
    notes the batch. A batch in the ledger is not applied again, and one that was swapped in without being noted changes
    nothing the second time, because the merge takes only newer versions. Deletes are flags, so no partition can become
    empty and keep its old rows.
    """
    def apply(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        if not applied_batches(spark, path).where(F.col("batch_id") == batch_id).isEmpty():
            return
        bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")
        staged = materialised(latest_per_key(batch, keys, order).withColumn("_bucket", bucket), "staged")
        touched = [r[0] for r in staged.select("_bucket").distinct().collect()]  # at most ``buckets``
        state = read_state(spark, path, state_schema(batch.schema, op, deleted)).where(F.col("_bucket").isin(touched))
        merged = merge_cdc(state, staged, [*keys, "_bucket"], version=version, op=op, deleted=deleted, check=False, **options)
        overwrite_slices(materialised(merged, "merged").hint("rebalance", "_bucket"), f"{path}/rows", ["_bucket"])
        noted = batch.agg(F.count(F.lit(1)).alias("rows")).select("rows", staged.agg(F.count(F.lit(1))).scalar().alias("keys"), F.lit(batch_id).cast("long").alias("batch_id"))
        overwrite_slices(noted, f"{path}/applied", ["batch_id"])

    return apply


def upsert_batches(table: VersionedTable, keys: Sequence[str], order: Sequence[str], version: str, op: str,
                   clock: Callable[[int], dt.datetime], **options) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function: collapse the batch, merge it, publish a version.

    The version is named after the batch id, and a batch that already published one is skipped, so a
    restarted query does not apply it twice.
    """
    def apply(batch: DataFrame, batch_id: int) -> None:
        name = f"batch-{batch_id}"
        table.refresh()
        if not table.log().where((F.col("action") == "commit") & (F.col("operation") == name)).isEmpty():
            return
        staged = latest_per_key(batch, keys, order)
        current = table.current()
        if current is None:
            values = [c for c in batch.columns if c != op]
            state = batch.select(*values).withColumn("is_deleted", F.lit(False)).where("false")
        else:
            state = table.read(version=current)
        merged = merge_cdc(state, staged, keys, version=version, op=op, check=False, **options)
        table.publish(merged, name, clock(batch_id))

    return apply


def run_deliveries(deliveries: Sequence[DataFrame], apply: Callable[[DataFrame, int], None]) -> None:
    """Hand a feed's deliveries to ``apply`` as micro-batches, one delivery each, through one checkpoint."""
    spark, schema = deliveries[0].sparkSession, deliveries[0].schema
    inbox, progress = scratch(spark, "inbox"), scratch(spark, "deliveries-progress")
    for delivery in deliveries:
        delivery.write.mode("append").parquet(inbox)
        (spark.readStream.schema(schema).parquet(inbox).writeStream.foreachBatch(apply).option("checkpointLocation", progress)
         .trigger(availableNow=True).start().awaitTermination())


def run_upserts(stream: DataFrame, apply: Callable[[DataFrame, int], None]) -> None:
    (stream.writeStream.foreachBatch(apply).option("checkpointLocation", scratch(stream.sparkSession, "upserts"))
     .trigger(availableNow=True).start().awaitTermination())
