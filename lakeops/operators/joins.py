"""Joins for skewed keys and for time ranges."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeops.functions.columns import count_upto, stable_salt
from lakeops.operators import sliced


def hot_keys(df: DataFrame, keys: Sequence[str], share: float = 0.001, threshold: int | None = None) -> DataFrame:
    """Keys that hold more than a share of all rows, or more than ``threshold`` rows.

    There are at most ``1 / share`` (or ``rows / threshold``) of them.
    """
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    if threshold is not None:
        return counts.where(F.col("_n") > threshold).select(*keys)
    total = df.agg(F.count(F.lit(1))).scalar()
    return counts.where(F.col("_n") > F.lit(share) * total).select(*keys)


def salted_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner", salts: int = 16,
                share: float = 0.001, threshold: int | None = None,
                spread_by: Sequence[str] | None = None) -> DataFrame:
    """Equi join that spreads the left rows of hot keys over ``salts`` tasks.

    Only the right rows of hot keys are replicated.  A full outer join takes the unmatched right
    rows by a separate anti join, since replicas would show up as false strays.
    """
    if how not in ("inner", "left", "full"):
        raise ValueError(f"salted_join cannot do a {how} join")
    keys = list(keys)
    hot = hot_keys(left, keys, share, threshold).withColumn("_hot", F.lit(True))
    hot = F.broadcast(hot) if threshold is None else hot  # a share bounds the list; a threshold does not
    salt = stable_salt(list(spread_by or left.columns), salts)
    spread = (left.join(hot, keys, "left")
              .withColumn("_salt", F.when(F.col("_hot"), salt).otherwise(F.lit(0))).drop("_hot"))
    every = F.when(F.col("_hot"), F.array(*[F.lit(i) for i in range(salts)])).otherwise(F.array(F.lit(0)))
    copied = right.join(hot, keys, "left").withColumn("_salt", F.explode(every)).drop("_hot")
    joined = spread.join(copied, [*keys, "_salt"], "left" if how == "full" else how).drop("_salt")
    if how == "full":
        strays = right.join(left.select(*keys).distinct(), keys, "left_anti")
        joined = joined.unionByName(strays, allowMissingColumns=True)
    return joined


def spread_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner", salts: int = 16,
                spread_by: Sequence[str] | None = None) -> DataFrame:
    """Inner or left join on keys of few values: every left row goes to one of ``salts`` tasks of its key.

    The right side is listed once per salt, so it should be a table of rates, codes or the like.
    """
    if how not in ("inner", "left"):
        raise ValueError(f"spread_join cannot do a {how} join")
    placed = left.withColumn("_salt", stable_salt(list(spread_by or left.columns), salts))
    listed = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return placed.join(listed, [*keys, "_salt"], how).drop("_salt")


def range_join(points: DataFrame, intervals: DataFrame, keys: Sequence[str], ts: str, start: str,
               end: str, how: str = "inner") -> DataFrame:
    """``start <= ts < end`` beside an equi key, an open end lasting for ever.

    Joined by grid cells, so that no key's points and intervals are paired whole. A cell is as long as the usual
    interval, but no interval gets more than about 4,096 cells.
    """
    length = (F.unix_seconds(end) - F.unix_seconds(start)).cast("double")
    usual = intervals.agg(F.percentile_approx(length, 0.5)).scalar()
    span = points.agg(F.unix_seconds(F.max(ts))).scalar() - intervals.agg(F.unix_seconds(F.min(start))).scalar()
    cell = F.greatest(F.ceil(F.coalesce(usual, F.lit(0.0))), F.ceil(F.coalesce(span, F.lit(0)) / 4096), F.lit(1))
    return _by_cell(points, intervals, keys, ts, start, end, cell, how)


def range_join_grid(points: DataFrame, intervals: DataFrame, keys: Sequence[str], ts: str, start: str,
                    end: str, grid_seconds: int) -> DataFrame:
    """The same rows as ``range_join`` with cells of a chosen length; choose it near the usual length of an interval."""
    return _by_cell(points, intervals, keys, ts, start, end, F.lit(grid_seconds), "inner")


def _by_cell(points: DataFrame, intervals: DataFrame, keys: Sequence[str], ts: str, start: str, end: str, seconds: Column,
             how: str) -> DataFrame:
    """An equi join on (key, grid cell).

    Each interval is listed once per cell it covers, open ends up to the last point; the exact
    range stays as a residual, so a cell shared by two intervals cannot match twice.  A hot key is
    spread over its cells.
    """
    last = points.agg(F.max(ts)).scalar()
    cell = lambda c: F.floor(F.unix_seconds(c) / seconds)
    until = F.least(F.coalesce(F.col(end), last), last)
    covered = (intervals.where(F.col(start) <= last)
               .where(F.col(end).isNull() | (F.col(end) > F.col(start)))
               .withColumn("_cover", F.explode(F.sequence(cell(F.col(start)), cell(until))))
               .withColumnsRenamed({k: f"_i_{k}" for k in keys}))
    placed = points.withColumn("_cell", cell(F.col(ts)))
    match = [F.col(k) == F.col(f"_i_{k}") for k in keys] + [F.col("_cell") == F.col("_cover"), F.col(ts) >= F.col(start),
                                                            F.col(end).isNull() | (F.col(ts) < F.col(end))]
    return placed.join(covered, reduce(and_, match), how).drop("_cell", "_cover", *[f"_i_{k}" for k in keys])


def range_join_search(points: DataFrame, intervals: DataFrame, keys: Sequence[str], ts: str, start: str, end: str,
                      cols: Sequence[str] = (), how: str = "inner") -> DataFrame:
    """The same rows as ``range_join`` where the intervals are the small side: an equi join on the key and a binary search.

    A key's intervals become one sorted array, with the running maximum of their ends beside it, which must fit a row.
    For a point the search gives the stretch of the array that can hold it: after the intervals that have all
    ended, up to the last one begun. Points are neither copied nor paired, and as nothing is grouped afterwards the planner may
    broadcast the arrays or split a hot key. Intervals may overlap; an empty one holds nothing.
    """
    if how not in ("inner", "left"):
        raise ValueError(f"range_join_search cannot do a {how} join")
    cols = list(dict.fromkeys([start, end, *cols]))
    ended = F.max(F.struct(F.col(end).isNull().alias("open"), F.col(end).alias("at")))
    upto = Window.partitionBy(*keys).orderBy(start).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    known = intervals.where(F.col(start).isNotNull()).withColumn("_ended", ended.over(upto))
    row = F.struct(F.col(start).alias("_s"), "_ended", F.col(end).alias("_e"), *[F.col(c) for c in cols])
    listed = known.groupBy(*keys).agg(F.array_sort(F.collect_list(row)).alias("_all"))
    arrays = listed.select(*keys, "_all", F.col("_all._s").alias("_starts"), F.array_sort("_all._ended").alias("_ended"))
    found = points.join(arrays, list(keys), how)
    first = count_upto("_ended", F.struct(F.lit(False).alias("open"), F.col(ts).alias("at")))
    begun = count_upto("_starts", F.col(ts))
    stretch = F.slice("_all", first + 1, F.greatest(begun - first, F.lit(0)))
    hits = F.filter(stretch, lambda i: (i["_s"] <= F.col(ts)) & (i["_e"].isNull() | (F.col(ts) < i["_e"])))
    out = found.select(*points.columns, (F.explode_outer(hits) if how == "left" else F.explode(hits)).alias("_hit"))
    return out.select(*points.columns, *[F.col("_hit")[c].alias(c) for c in cols])


def asof_join(left: DataFrame, right: DataFrame, keys: Sequence[str], left_ts: str, right_ts: str,
              cols: Sequence[str], tolerance_seconds: int | None = None,
              order_right: Sequence[str] = (), slice_seconds: int = sliced.DAY) -> DataFrame:
    """For every left row the newest right row at or before it, or NULL.

    Both sides are stacked and the last right row is carried forward; on a tie the right row goes
    first.  A NULL key matches nothing.  Nothing is paired up, so the cost is one sort of both sides whatever the match rate.
    """
    held = F.struct(F.col(right_ts).alias("_at"), *[F.col(c).alias(c) for c in cols])
    known = right.where(reduce(and_, [F.col(k).isNotNull() for k in keys], F.lit(True)))  # a NULL key equals nothing
    marks = known.select(*keys, F.col(right_ts).alias("_ts"), F.lit(0).alias("_side"),
                         F.struct(*(order_right or [F.lit(0).alias("o")])).alias("_order"), held.alias("_held"))
    rows = left.select(*keys, F.col(left_ts).alias("_ts"), F.lit(1).alias("_side"), F.struct("*").alias("_left"))
    stacked = marks.unionByName(rows, allowMissingColumns=True)
    filled = sliced.running(stacked, keys, ["_ts", "_side", "_order"], sliced.time_slice("_ts", slice_seconds),
                            {"_match": ("last", F.col("_held"))}).where("_side = 1")
    match = F.col("_match")
    if tolerance_seconds is not None:
        age = F.unix_micros("_ts") - F.unix_micros(match["_at"])
        match = F.when(age <= tolerance_seconds * 1_000_000, match)
    return filled.select("_left.*", *[match[c].alias(c) for c in cols])


def near_events(events: DataFrame, anchors: DataFrame, keys: Sequence[str], ts: str, anchor: str,
                before_seconds: int = 0, after_seconds: int = 0, slice_seconds: int = 3_600) -> DataFrame:
    """Events in ``[anchor - before, anchor + after)`` of an anchor with the same key.

    Equi join on (key, slice): each anchor is listed in every slice its reach touches.
    """
    lo = F.unix_seconds(anchor) - before_seconds
    hi = F.unix_seconds(anchor) + after_seconds + 1
    listed = anchors.withColumn(
        "_cell", F.explode(F.sequence(F.floor(lo / slice_seconds), F.floor(hi / slice_seconds))))
    placed = events.withColumn("_cell", F.floor(F.unix_seconds(ts) / slice_seconds))
    gap = F.unix_micros(ts) - F.unix_micros(anchor)
    return (placed.join(listed, [*keys, "_cell"])
            .where((gap >= -before_seconds * 1_000_000) & (gap < after_seconds * 1_000_000)).drop("_cell"))


def scd2_as_of(df: DataFrame, at: str | Column, valid_from: str = "valid_from",
               valid_to: str = "valid_to") -> DataFrame:
    """Dimension rows valid at a date, half open, NULL end meaning current."""
    d = F.lit(at).cast("date") if isinstance(at, str) else at
    return df.where((F.col(valid_from) <= d) & (F.col(valid_to).isNull() | (F.col(valid_to) > d)))
