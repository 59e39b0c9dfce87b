"""Ordered computations that never need a whole key in one task.

``Window.partitionBy(key)`` puts every row of a key into one task, which breaks as soon as one
key holds a large part of the table.  Each function here cuts a key into slices of its order
axis (a day of time, a band of values), runs the ordinary window inside ``(key, slice)``, reduces
every slice to one summary row, carries the summaries along the key, and joins them back.  Rows
are shuffled once, on ``(key, slice)``; what is ordered per key is only the summaries, whose
number is bounded by the length of the axis.

Neighbours and ranks count first: where no key holds more than a thousandth of the rows, keys stay whole.

As in SQL windows, rows whose key is NULL are one group: keys are compared as one struct, in which NULLs are equal.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeops.functions.columns import count_upto
from lakeops.session import materialised

SLICE, KEY = "_slice", "_key"
DAY = 86_400
_BEFORE_ALL = -(1 << 60)
SMALL_KEYS = 1000  # the fewest times that the largest key goes into all rows where keys stay whole
TASK_ROWS = 250_000


def time_slice(ts: str | Column, seconds: int = DAY) -> Column:
    """Slice number of a timestamp; NULL sorts first, as in a window."""
    col = F.col(ts) if isinstance(ts, str) else ts
    return F.coalesce(F.floor(F.unix_seconds(col) / F.lit(seconds)), F.lit(_BEFORE_ALL))


def value_slice(value: str | Column, width: float, descending: bool = False) -> Column:
    """Slice number of a numeric order column; NULL sorts first, or last when descending."""
    col = F.col(value) if isinstance(value, str) else value
    band = F.floor(col / F.lit(width))
    return F.coalesce(-band, F.lit(-_BEFORE_ALL)) if descending else F.coalesce(band, F.lit(_BEFORE_ALL))


def _cut(df: DataFrame, keys: Sequence[str], slice_by: Column) -> tuple[DataFrame, list[str]]:
    """The rows with their slice, and the column that stands for the key."""
    sliced = df.withColumn(SLICE, slice_by)
    return (sliced.withColumn(KEY, F.struct(*keys)), [KEY]) if keys else (sliced, [])


def dealt(df: DataFrame, keys: Sequence[str | Column], rows: int) -> DataFrame:
    """``rows`` rows by key, over more tasks than the session's shuffles have when those would get over ``TASK_ROWS`` each."""
    tasks = -(-rows // TASK_ROWS)
    return df.repartition(tasks, *keys) if tasks > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def _whole(df: DataFrame, keys: Sequence[str]) -> DataFrame | None:
    """The rows, to be put in order key by key; None if a key holds so many that it has to be cut."""
    if not keys:
        return None
    n = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).agg(F.max("_n").alias("most"), F.sum("_n").alias("rows")).first()
    return dealt(df, keys, n["rows"]) if n["rows"] and n["most"] * SMALL_KEYS <= n["rows"] else None


def _along(keys: Sequence[str]):
    return Window.partitionBy(*keys).orderBy(SLICE)


def _back(rows: DataFrame, summary: DataFrame, keys: Sequence[str]) -> DataFrame:
    return rows.join(summary, [*keys, SLICE], "left")


def neighbours(df: DataFrame, keys: Sequence[str], order: Sequence[str], slice_by: Column, *,
               prev: Mapping[str, str] | None = None,
               following: Mapping[str, str] | None = None) -> DataFrame:
    """``lag`` / ``lead`` by one row: ``prev={"prev_price": "price"}`` adds the previous row's price."""
    prev, following = dict(prev or {}), dict(following or {})
    whole = _whole(df, keys)
    if whole is not None:
        beside = Window.partitionBy(*keys).orderBy(*order)
        near = [F.lag(F.col(c)).over(beside).alias(a) for a, c in prev.items()] + [F.lead(F.col(c)).over(beside).alias(a) for a, c in following.items()]
        return whole.select(*[F.col(c) for c in df.columns if c not in (*prev, *following)], *near)
    sliced, keys = _cut(df, keys, slice_by)
    at = F.struct(*order)
    inside = Window.partitionBy(*keys, SLICE).orderBy(*order)
    rows, ends, carried = sliced, [], []
    if prev:
        held = F.struct(*[F.col(c).alias(a) for a, c in prev.items()])
        rows = rows.withColumn("_prev", F.lag(held).over(inside))
        ends.append(F.max_by(held, at).alias("_last"))
        carried.append(F.lag("_last").over(_along(keys)).alias("_carried_prev"))
    if following:
        held = F.struct(*[F.col(c).alias(a) for a, c in following.items()])
        rows = rows.withColumn("_next", F.lead(held).over(inside))
        ends.append(F.min_by(held, at).alias("_first"))
        carried.append(F.lead("_first").over(_along(keys)).alias("_carried_next"))
    summary = sliced.groupBy(*keys, SLICE).agg(*ends).select(*keys, SLICE, *carried)
    joined = _back(rows, summary, keys)
    out = [F.coalesce("_prev", "_carried_prev")[a].alias(a) for a in prev]
    out += [F.coalesce("_next", "_carried_next")[a].alias(a) for a in following]
    return joined.select(*[F.col(c) for c in df.columns if c not in (*prev, *following)], *out)


def _combine(kind: str, own: Column, carried: Column) -> Column:
    if kind == "sum":
        return F.coalesce(own + carried, own, carried)
    if kind == "count":
        return own + F.coalesce(carried, F.lit(0))
    if kind == "min":
        return F.least(own, carried)
    if kind == "max":
        return F.greatest(own, carried)
    return F.coalesce(own, carried)


def running(df: DataFrame, keys: Sequence[str], order: Sequence[str], slice_by: Column,
            aggs: Mapping[str, tuple[str, Column]]) -> DataFrame:
    """Running aggregates from the first row of a key to the current one.

    ``aggs`` maps an output name to ``(kind, expression)`` with kind ``sum``, ``count``, ``min``,
    ``max`` or ``last`` (last value that is not NULL).
    """
    sliced, keys = _cut(df, keys, slice_by)
    at = F.struct(*order)
    inside = (Window.partitionBy(*keys, SLICE).orderBy(*order)
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    before = _along(keys).rowsBetween(Window.unboundedPreceding, -1)
    plain = {"sum": F.sum, "count": F.count, "min": F.min, "max": F.max}
    merge = {"sum": F.sum, "count": F.sum, "min": F.min, "max": F.max}
    rows, totals, carried, out = sliced, [], [], []
    for i, (alias, (kind, expr)) in enumerate(aggs.items()):
        if kind == "last":
            rows = rows.withColumn(f"_own{i}", F.last(expr, ignorenulls=True).over(inside))
            totals.append(F.max_by(expr, F.when(expr.isNotNull(), at)).alias(f"_t{i}"))
            carried.append(F.last(f"_t{i}", ignorenulls=True).over(before).alias(f"_c{i}"))
        else:
            rows = rows.withColumn(f"_own{i}", plain[kind](expr).over(inside))
            totals.append(plain[kind](expr).alias(f"_t{i}"))
            carried.append(merge[kind](f"_t{i}").over(before).alias(f"_c{i}"))
        out.append(_combine(kind, F.col(f"_own{i}"), F.col(f"_c{i}")).alias(alias))
    summary = sliced.groupBy(*keys, SLICE).agg(*totals).select(*keys, SLICE, *carried)
    return _back(rows, summary, keys).select(*[c for c in df.columns if c not in aggs], *out)


def ranks(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], slice_by: Column, *,
          row_number: str | None = None, rank: str | None = None, dense_rank: str | None = None,
          size: str | None = None) -> DataFrame:
    """Ranking columns and the group size.  ``slice_by`` must rise along ``order``; equal order
    values share a slice by construction, so ties rank as in a plain window."""
    asked = {row_number: F.row_number(), rank: F.rank(), dense_rank: F.dense_rank()}
    uncut = _whole(df, keys)
    if uncut is not None:
        ordered, every = Window.partitionBy(*keys).orderBy(*order), Window.partitionBy(*keys)
        out = [c.over(ordered).cast("long").alias(name) for name, c in asked.items() if name]
        return uncut.select("*", *out, *([F.count(F.lit(1)).over(every).alias(size)] if size else []))
    sliced, keys = _cut(df, keys, slice_by)
    inside = Window.partitionBy(*keys, SLICE).orderBy(*order)
    before = _along(keys).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    rows = sliced
    if row_number:
        rows = rows.withColumn("_rn", F.row_number().over(inside))
    if rank:
        rows = rows.withColumn("_rk", F.rank().over(inside))
    if dense_rank:
        rows = rows.withColumn("_dr", F.dense_rank().over(inside))
    counted = rows if dense_rank else sliced
    totals = [F.count(F.lit(1)).alias("_n")]
    if dense_rank:
        totals.append(F.max("_dr").alias("_d"))
    summary = counted.groupBy(*keys, SLICE).agg(*totals)
    carried = [F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"),
               F.sum("_n").over(whole).alias("_size")]
    if dense_rank:
        carried.append(F.coalesce(F.sum("_d").over(before), F.lit(0)).alias("_dbefore"))
    joined = _back(rows, summary.select(*keys, SLICE, *carried), keys)
    out = []
    if row_number:
        out.append((F.col("_rn") + F.coalesce("_before", F.lit(0))).alias(row_number))
    if rank:
        out.append((F.col("_rk") + F.coalesce("_before", F.lit(0))).alias(rank))
    if dense_rank:
        out.append((F.col("_dr") + F.coalesce("_dbefore", F.lit(0))).alias(dense_rank))
    if size:
        out.append(F.col("_size").alias(size))
    return joined.select(*df.columns, *out)


def cut(df: DataFrame, keys: Sequence[str], order: Sequence[str], slices: int = 64, per_slice: int = 64,
        name: str = "_cut") -> DataFrame:
    """Add a slice number that follows ``order`` inside each key, with bounds taken from the data.

    ``slices * per_slice`` rows, those whose hash is lowest, stand for the whole; every ``per_slice``-th of a key's ends a
    slice. So a slice holds about ``1 / slices`` of all rows whatever the values are, keys with less than that stay whole,
    and with a tie-break in ``order`` rows of one value are cut too. The sample is all that is broadcast, whatever the size
    of the table. Use the column as ``slice_by`` of the functions below with the same order.
    """
    order = list(order)
    at = F.struct(*order)
    drawn = df.select(*keys, at.alias("_at")).orderBy(F.xxhash64(*keys, "_at")).limit(slices * per_slice)
    steps = F.sequence(F.lit(per_slice), F.size("_all"), F.lit(per_slice))
    ends = (drawn.groupBy(*keys).agg(F.array_sort(F.collect_list("_at")).alias("_all")).where(F.size("_all") >= per_slice)
            .select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.transform(steps, lambda i: F.get("_all", i - 1)).alias("_ends")))
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys], F.lit(True))
    placed = df.join(F.broadcast(ends), same, "left")
    # Rows at a bound come before it, so a slice ends with its bound.
    number = F.when(F.col("_ends").isNotNull(), count_upto("_ends", at, inclusive=False, steps=max(1, slices.bit_length()))).otherwise(F.lit(0))
    return placed.select(*[F.col(c) for c in df.columns], number.cast("long").alias(name))


def tied_ranks(df: DataFrame, keys: Sequence[str], order: Sequence[str], tie: Sequence[str], *, row_number: str, rank: str,
               dense_rank: str, size: str, slices: int = 64) -> DataFrame:
    """Row number by ``order`` and ``tie``, rank and dense rank by ``order`` alone, and the size of the group, in one pass.

    Slices come from :func:`cut` over ``order`` and ``tie``, so a key with a third of all rows at two values is spread too. A
    tie that began in an earlier slice takes its rank from there: what a slice hands on is its size, how many values it
    has, its first and last value and where its last value begins. The ranked rows are written once.
    """
    order, tie = list(order), list(tie)
    sliced, keys = _cut(cut(df, keys, [*order, *tie], slices, name=SLICE), keys, F.col(SLICE))
    inside = Window.partitionBy(*keys, SLICE)
    by_all, by_order = inside.orderBy(*order, *tie), inside.orderBy(*order)
    ranked = materialised(sliced.select("*", F.row_number().over(by_all).alias("_rn"), F.rank().over(by_order).alias("_rk"),
                                        F.dense_rank().over(by_order).alias("_dr"), F.struct(*order).alias("_at")), "ranks")
    along = _along(keys)
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    own = ranked.groupBy(*keys, SLICE).agg(F.count(F.lit(1)).alias("_n"), F.max("_dr").alias("_d"), F.max("_rk").alias("_tail"),
                                           F.min("_at").alias("_first"), F.max("_at").alias("_last"))
    own = own.select("*", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), F.sum("_n").over(Window.partitionBy(*keys)).alias("_size"),
                     F.coalesce(F.lag("_last").over(along).eqNullSafe(F.col("_first")) & F.lag("_n").over(along).isNotNull(), F.lit(False)).alias("_goes_on"))
    onward = F.when(~(F.col("_goes_on") & (F.col("_d") == 1)), F.col("_before") + F.col("_tail"))
    carried = own.select(
        *keys, SLICE, "_before", "_size", "_goes_on", F.last(onward, ignorenulls=True).over(before).alias("_begun"),
        (F.coalesce(F.sum("_d").over(before), F.lit(0)) - F.sum(F.col("_goes_on").cast("long")).over(along.rowsBetween(Window.unboundedPreceding, 0))).alias("_dbefore"))
    joined = _back(ranked, carried, keys)
    return joined.select(
        *df.columns, (F.col("_rn") + F.col("_before")).alias(row_number),
        F.when(F.col("_goes_on") & (F.col("_dr") == 1), F.col("_begun")).otherwise(F.col("_rk") + F.col("_before")).alias(rank),
        (F.col("_dr") + F.col("_dbefore")).alias(dense_rank), F.col("_size").alias(size))


def ntile(number: Column, size: Column, tiles: int) -> Column:
    """Tile of a row from its row number and group size, larger tiles first as in SQL."""
    base, extra = F.floor(size / tiles), size % tiles
    wide = extra * (base + 1)
    narrow = extra + F.ceil((number - wide) / F.greatest(base, F.lit(1)))
    return F.when(number <= wide, F.ceil(number / (base + 1))).otherwise(narrow).cast("int")


def rolling(df: DataFrame, keys: Sequence[str], ts: str, seconds: int,
            aggs: Mapping[str, Column], slice_seconds: int = DAY) -> DataFrame:
    """Aggregates over ``[ts - seconds, ts]``, both ends included, exact to the microsecond.

    A row is also copied into the next slice when it can still matter there, so each slice holds
    everything its rows look back on; the copies are dropped afterwards.
    """
    width = max(seconds, slice_seconds)
    own = time_slice(ts, width)
    reach = F.coalesce(F.floor((F.unix_seconds(ts) + seconds + 1) / width), own)  # no time: its own slice only
    spread = df.withColumn("_own", own).withColumn(SLICE, F.explode(F.sequence(own, reach)))
    frame = (Window.partitionBy(*keys, SLICE).orderBy(F.unix_micros(ts))
             .rangeBetween(-seconds * 1_000_000, 0))
    windowed = spread.select("*", *[agg.over(frame).alias(a) for a, agg in aggs.items()])
    return windowed.where(F.col("_own") == F.col(SLICE)).select(*df.columns, *aggs)


def islands(df: DataFrame, keys: Sequence[str], order: Sequence[str], slice_by: Column,
            carry: Sequence[str], breaks: Callable[[Column, Column], Column],
            number: str = "island") -> DataFrame:
    """Number the stretches of a series, starting at 1.

    ``breaks(current, previous)`` gets two structs holding the ``carry`` columns and says whether
    the current row starts a new stretch; the first row of a key always does.
    """
    sliced, keys = _cut(df, keys, slice_by)
    held = F.struct(*carry)
    at = F.struct(*order)
    inside = Window.partitionBy(*keys, SLICE).orderBy(*order)
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)

    def with_starts(frame: DataFrame) -> DataFrame:
        before = frame.withColumn("_was", F.lag(held).over(inside))
        starts = F.when(F.col("_was").isNotNull() & breaks(held, F.col("_was")), 1).otherwise(0)
        return before.withColumn("_starts", starts)

    rows = with_starts(sliced).withColumn("_nth", F.sum("_starts").over(upto))
    needed = list(dict.fromkeys([*keys, SLICE, *order, *carry]))
    summary = (
        with_starts(sliced.select(*needed))
        .groupBy(*keys, SLICE)
        .agg(F.min_by(held, at).alias("_first"), F.max_by(held, at).alias("_last"),
             F.sum("_starts").alias("_inner"))
        .withColumn("_was", F.lag("_last").over(_along(keys)))
        .withColumn("_opens", F.when(F.col("_was").isNull() | breaks(F.col("_first"), F.col("_was")), 1)
                    .otherwise(0))
        .withColumn("_base", F.sum(F.col("_opens") + F.col("_inner")).over(
            _along(keys).rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_inner"))
        .select(*keys, SLICE, "_base")
    )
    joined = _back(rows, summary, keys)
    return joined.select(*df.columns, (F.col("_nth") + F.coalesce("_base", F.lit(1))).alias(number))
