"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeops.session import materialised


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *more: str) -> DataFrame:
    """Only the columns an operator works on: ``id`` and ``text`` (NULL: empty), and ``more`` under their own names."""
    return docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *more)


def task(fn: Callable, *args):
    """A partition function for ``mapInArrow`` that calls the module-level ``fn(batches, *args)``.

    Workers import the module by name, so what it keeps (tokenizers, compiled patterns) is kept for as long
    as the worker lives. Where the package is not installed for the workers, they look where the driver found it.
    """
    module, name, root = fn.__module__, fn.__name__, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

    def run(batches):
        import importlib
        import sys

        if root not in sys.path:
            sys.path.append(root)
        yield from getattr(importlib.import_module(module), name)(batches, *args)

    return run


_REMEMBERED: dict = {}


def remembered(key, make: Callable):
    """What a worker keeps from task to task: one thing at a time, so that a worker that is used again by another operator
    does not carry along what the one before it has learned."""
    if key not in _REMEMBERED:
        _REMEMBERED.clear()
        _REMEMBERED[key] = make()
    return _REMEMBERED[key]


def in_batches(batches: Iterator[pa.RecordBatch], rows: int = 256, chars: int = 4 << 20, column: str = "text"):
    """Cut Arrow batches into lists of Python rows of bounded count and text length."""
    for batch in batches:
        lengths = pc.binary_length(batch.column(column)).to_pylist()
        start = held = 0
        for i, n in enumerate(lengths):
            held += n or 0
            if i - start + 1 >= rows or held >= chars:
                yield batch.slice(start, i - start + 1)
                start, held = i + 1, 0
        if start < len(lengths):
            yield batch.slice(start)


def _running(batches, column):
    from pyspark import TaskContext

    part, total = TaskContext.get().partitionId(), 0
    for batch in batches:
        values = batch.column(column).to_numpy(zero_copy_only=False).astype("int64")
        ends = values.cumsum() + total
        total = int(ends[-1]) if len(ends) else total
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in batch.schema.names), pa.array(ends - values), pa.array([part] * len(values), pa.int32())],
            names=[*batch.schema.names, "_before", "_part"])


def prefix_sum(df: DataFrame, order: list[str], value: str, name: str) -> DataFrame:
    """Add ``name``: the sum of ``value`` over all rows before this one in the order of ``order``.

    Rows are dealt out by ranges of the order and summed inside each range; the only rows that meet in
    one task are the totals, one for each range. The result is written once, so that the ranges cannot
    change under a recomputation.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    kept = materialised(ranged.mapInArrow(task(_running, value), _with(df, "_before long, _part int")), "prefix")
    w = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = kept.groupBy("_part").agg(F.sum(value).alias("_sum")).select("_part", F.coalesce(F.sum("_sum").over(w), F.lit(0)).alias("_base"))
    return kept.join(bases, "_part").withColumn(name, F.col("_base") + F.col("_before")).drop("_part", "_base", "_before")


def _with(df: DataFrame, more: str) -> str:
    return ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields), more])


def crc32_of(column: Column) -> Column:
    """Unsigned CRC-32 of a text or binary column as a long."""
    return F.crc32(column.cast("binary"))


def row_key(id_column: Column, text_hash: Column) -> list[Column]:
    """Two numbers, never NULL, that name a row by its id and the hash of its text."""
    return [F.xxhash64(id_column.isNull(), id_column, text_hash).alias("_lakeops_row"), text_hash.alias("_lakeops_text")]


def matching(docs: DataFrame, rows: DataFrame, how: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` semi- or anti-joined with ``rows`` (doc_id, tkey); the columns ``_lakeops_row`` and ``_lakeops_text`` stay on."""
    keyed = docs.withColumns(dict(zip(("_lakeops_row", "_lakeops_text"), row_key(F.col(id_col).cast("long"), F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))))))
    return keyed.join(rows.select(*row_key(F.col("doc_id"), F.col("tkey"))), ["_lakeops_row", "_lakeops_text"], how)
