"""Exact duplicates found by sorting contents.

Texts are compared without white space. Sampled splitters deal the rows out by ranges of content, an external sort inside
each range sets equal texts next to one another, best row first, and every row is compared in full with the one before
it. A splitter is bounded: the first characters and the SHA-256 of a text, then the order in which its rows are
preferred, so a text that a third of all rows hold is cut into many ranges like any other stretch of the order. What lies
across a border is joined up afterwards: the texts at both sides of a border are compared in full as well.
"""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakeops.llm.common import matching, task, texts
from lakeops.session import materialised

WHITE = r"[\x20\x09-\x0D]+"
_ROWS = "id long, tkey long, sha string, part int, run long, first boolean, head long, opens string, closes string"


def _neighbours(batches):
    """Number the stretches of equal texts in one sorted range; only its first and its last row keep their texts."""
    from pyspark import TaskContext

    part, run, head, last, held = TaskContext.get().partitionId(), -1, None, None, None

    def made(batch, firsts, runs, heads, opens, closes):
        n = batch.num_rows
        edge = [pa.array([None] * n, pa.string()) if t is None else pa.array([*([None] * at), t, *([None] * (n - 1 - at))], pa.string())
                for t, at in ((opens, 0), (closes, n - 1))]
        return pa.RecordBatch.from_arrays(
            [batch.column("id"), batch.column("tkey"), batch.column("sha"), pa.array([part] * n, pa.int32()), runs, firsts, heads, *edge],
            names=[f.split()[0] for f in _ROWS.split(", ")])

    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        bodies = batch.column("norm")
        firsts = pa.concat_arrays([pa.array([last is None or last != bodies[0].as_py()]), pc.not_equal(bodies.slice(1), bodies.slice(0, n - 1))])
        runs = pc.add(pc.cumulative_sum(firsts.cast(pa.int64())), run)
        ids, heads = batch.column("id").to_pylist(), []
        for i, new in enumerate(firsts.to_pylist()):
            head = ids[i] if new else head
            heads.append(head)
        opens = bodies[0].as_py() if last is None else None
        last, run = bodies[n - 1].as_py(), runs[n - 1].as_py()
        if held:
            yield made(*held, None)
        held = (batch, firsts, runs, pa.array(heads, pa.int64()), opens)
    if held:
        yield made(*held, last)


def copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", head: int = 64) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 and tkey (hash of the original text) for every row of ``docs``.

    Of texts that are equal without white space the row with the most characters in the original stays, then that with
    the smallest id (NULL last); of rows that agree in all of these exactly one is kept. NULL texts are empty, and empty
    texts equal one another. Repeated rows are told each, an empty table gives no row, other columns are left aside
    whatever their names. A text must fit a row; ``head`` characters of it and its hash are what a splitter holds.
    """
    rows = texts(docs, id_col, text_col)
    rows = rows.select("id", F.xxhash64("text").alias("tkey"), F.length("text").alias("points"), F.regexp_replace("text", WHITE, "").alias("norm"))
    rows = rows.select("*", F.substring("norm", 1, head).alias("head"), F.sha2("norm", 256).alias("sha"), F.spark_partition_id().alias("copy"))
    best = [F.col("points").desc(), F.col("id").asc_nulls_last(), F.col("copy")]
    ranged = rows.repartitionByRange("head", "sha", *best).sortWithinPartitions("head", "sha", "norm", *best)
    told = materialised(ranged.select("id", "tkey", "sha", "norm").mapInArrow(task(_neighbours), _ROWS), "content-sort")

    stretches = told.groupBy("part", "run").agg(F.count(F.lit(1)).alias("n"), F.max("head").alias("head"))
    joined = _across(told)
    sums = (joined.join(stretches, ["part", "run"]).groupBy("owner_part", "owner_run")
            .agg(F.sum("n").alias("total"), F.max(F.when((F.col("part") == F.col("owner_part")) & (F.col("run") == F.col("owner_run")), F.col("head"))).alias("keep")))
    spans = joined.join(sums, ["owner_part", "owner_run"]).select(
        "part", "run", "total", "keep", (F.col("part") != F.col("owner_part")).alias("goes_on"))
    resolved = stretches.join(spans, ["part", "run"], "left").select(
        "part", "run", F.when(F.col("total").isNull(), F.col("head")).otherwise(F.col("keep")).alias("keep_id"),
        F.coalesce("total", "n").alias("group_size"), F.coalesce("goes_on", F.lit(False)).alias("goes_on"))
    return told.select("id", "tkey", "sha", "part", "run", "first").join(resolved, ["part", "run"]).select(
        F.col("id").alias("doc_id"), "keep_id", "group_size", (F.col("first") & ~F.col("goes_on")).alias("kept"), F.col("sha").alias("text_sha256"), "tkey")


def _across(told: DataFrame) -> DataFrame:
    """The stretches (part, run) that lie across borders, each with the one (owner_part, owner_run) where its text begins.

    One row a range meets in one task, without its texts; those are compared by a join on the number of the range.
    """
    order = Window.orderBy("part")
    closes = told.filter("closes IS NOT NULL").select("part", F.col("run").alias("last"), "closes")
    opens = told.filter("opens IS NOT NULL").select("part", "opens")
    borders = closes.select("part", "last", F.lag("part").over(order).alias("previous"))
    agree = (borders.join(opens, "part").join(closes.select(F.col("part").alias("previous"), "closes"), "previous", "left")
             .select("part", "last", F.coalesce(F.col("opens") == F.col("closes"), F.lit(False)).alias("goes_on")))
    # A range of one stretch that goes on hands over the owner that it has itself.
    handed = F.when(~(F.col("goes_on") & (F.col("last") == 0)), F.struct(F.col("part").alias("part"), F.col("last").alias("run")))
    owned = agree.withColumn("owner", F.last(handed, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))).filter("goes_on")
    begun = owned.select(F.col("owner.part").alias("part"), F.col("owner.run").alias("run"), F.col("owner.part").alias("owner_part"), F.col("owner.run").alias("owner_run")).distinct()
    return owned.select("part", F.lit(0).cast("long").alias("run"), F.col("owner.part").alias("owner_part"), F.col("owner.run").alias("owner_run")).union(begun)


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that repeat another one's text, all columns kept. Rows equal in id and text fall to one."""
    kept = matching(docs, copies(docs, id_col, text_col).filter("kept"), "left_semi", id_col, text_col)
    return kept.dropDuplicates(["_lakeops_row", "_lakeops_text"]).select(*docs.columns)
