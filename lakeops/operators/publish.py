"""Putting a table's new partitions beside the live ones, auditing what was written, and swapping them in."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeops.operators.cdc import duplicate_keys, merge_cdc
from lakeops.operators.quality import QualityError
from lakeops.session import materialised
from lakeops.sources.tables import overwrite_slices


class GateError(QualityError):
    """What was staged did not pass its audit; the table has been left as it was."""


def audit(staged: DataFrame, rules: Mapping[str, Column], unique: Sequence[str] = (), least_rows: int = 1) -> DataFrame:
    """One row per rule: rule, failing, passed.

    A rule is a condition that must be true for every row (NULL counts as false); all of them share one aggregate. ``unique``
    adds one on repeated keys and ``least_rows`` one on the number of rows.
    """
    counts = [F.count_if(~F.coalesce(rule, F.lit(False))).alias(name) for name, rule in rules.items()]
    one = staged.agg(F.greatest(F.lit(least_rows) - F.count(F.lit(1)), F.lit(0)).alias("least_rows"), *counts)
    told = one.select(F.inline(F.array(*[F.struct(F.lit(c).alias("rule"), F.col(c).alias("failing")) for c in one.columns])))
    if unique:
        repeated = duplicate_keys(staged, unique).agg(F.count(F.lit(1)).alias("failing"))
        told = told.unionByName(repeated.select(F.lit("unique").alias("rule"), "failing"))
    return told.withColumn("passed", F.col("failing") == 0)


def publish(df: DataFrame, path: str, slice_cols: Sequence[str], rules: Mapping[str, Column] | None = None,
            unique: Sequence[str] = (), least_rows: int = 1) -> DataFrame:
    """Stage ``df``, audit the staged rows and replace exactly their slices at ``path``; returns the staged rows.

    Readers see the old slices until the swap. A failing audit raises :class:`GateError` before the table is touched, and a
    run that is repeated replaces the same slices by the same rows.
    """
    staged = materialised(df, "staged")
    failed = audit(staged, rules or {}, unique, least_rows).where(~F.col("passed")).collect()  # one row per rule
    if failed:
        raise GateError("; ".join(f"{r['rule']}: {r['failing']}" for r in failed))
    overwrite_slices(staged.hint("rebalance", *slice_cols), path, slice_cols)  # few files a slice, a hot slice in several
    return staged


def upsert_slices(changes: DataFrame, path: str, keys: Sequence[str], slice_col: str, version: str,
                  rules: Mapping[str, Column] | None = None, unique: Sequence[str] | None = None) -> DataFrame:
    """Merge ``changes`` (one row per key) into the slices they fall into, through the same gate.

    The slice is part of the key, so only the slices of the changes are read, and rows elsewhere stay as they are. A row is
    replaced by one with a newer ``version`` and left alone otherwise; rows without a match are inserted.
    """
    gate = list(unique if unique is not None else keys)
    repeated = duplicate_keys(changes, gate).agg(F.count(F.lit(1))).first()[0]
    if repeated:
        raise GateError(f"unique: {repeated}")
    target = changes.sparkSession.read.parquet(path).select(*changes.columns)
    touched = target.join(changes.select(slice_col).distinct(), slice_col, "left_semi").select(*changes.columns)
    merged = merge_cdc(touched, changes.withColumn("_op", F.lit("u")), [*keys, slice_col], version=version, op="_op", deleted=None, check=False)
    return publish(merged, path, [slice_col], rules, gate)
