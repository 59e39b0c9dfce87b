"""Series operators: sessions, runs, intervals, grids, resampling, overlap counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeops.operators import sliced
from lakeops.operators.quantiles import exact_percentiles
from lakeops.session import materialised


def _micros_between(later: Column, earlier: Column) -> Column:
    return F.unix_micros(later) - F.unix_micros(earlier)


def sessionize(df: DataFrame, user: str, ts: str, gap_seconds: int, tie: Sequence[str] = (),
               slice_seconds: int = sliced.DAY) -> DataFrame:
    """Adds ``session_no`` and ``session_key``; a gap longer than ``gap_seconds`` starts a session."""
    found = sliced.islands(
        df, [user], [ts, *tie], sliced.time_slice(ts, slice_seconds), [ts],
        lambda now, was: _micros_between(now[ts], was[ts]) > gap_seconds * 1_000_000, "session_no")
    return found.withColumn("session_key", F.concat_ws("#", F.col(user).cast("string"),
                                                       F.col("session_no").cast("string")))


def session_stats(sessions: DataFrame, user: str, ts: str) -> DataFrame:
    """One row per session: start, end, events, seconds."""
    return (sessions.groupBy(user, "session_no")
            .agg(F.min(ts).alias("started"), F.max(ts).alias("ended"), F.count(F.lit(1)).alias("events"))
            .withColumn("seconds", _micros_between(F.col("ended"), F.col("started")) / 1_000_000))


def runs(df: DataFrame, keys: Sequence[str], ts: str, flag: str, max_step_seconds: int | None = None,
         tie: Sequence[str] = (), slice_seconds: int = sliced.DAY) -> DataFrame:
    """The flagged rows with their ``run_id``.

    A run ends at the first row without the flag, or after a step longer than ``max_step_seconds``.
    """
    def breaks(now: Column, was: Column) -> Column:
        changed = now["_on"] != was["_on"]
        if max_step_seconds is None:
            return changed
        return changed | (_micros_between(now[ts], was[ts]) > max_step_seconds * 1_000_000)

    marked = df.withColumn("_on", F.coalesce(F.col(flag), F.lit(False)))
    found = sliced.islands(marked, keys, [ts, *tie], sliced.time_slice(ts, slice_seconds), ["_on", ts],
                           breaks, "run_id")
    return found.where("_on").drop("_on")


def envelope(*coordinates: str, prefix: str = "bbox") -> dict[str, Column]:
    """Aggregates for the smallest box around the rows of a group: ``bbox_lat_min``, ``bbox_lat_max`` and so on."""
    return {f"{prefix}_{c}_{side}": agg(c) for c in coordinates for side, agg in (("min", F.min), ("max", F.max))}


def derive_intervals(df: DataFrame, key: str, ts: str, value: str, min_delta: float,
                     slice_seconds: int = 30 * sliced.DAY) -> DataFrame:
    """Validity intervals of an observed value: ``[effective_start, effective_end)``, last one open.

    A change no larger than ``min_delta`` is noise.  Expects one observation per key and time.  The
    changes are written once, since the second pass and most callers read them more than once.
    """
    by = sliced.time_slice(ts, slice_seconds)
    seen = sliced.neighbours(df.select(key, ts, value), [key], [ts], by, prev={"_was": value})
    moved = seen.where(F.col("_was").isNull() | (F.abs(F.col(value) - F.col("_was")) > min_delta)).drop("_was")
    moved = materialised(moved, "changes")  # the second pass reads it twice
    closed = sliced.neighbours(moved, [key], [ts], by, prev={"prev_value": value},
                               following={"effective_end": ts})
    return closed.select(key, F.col(value), "prev_value", F.col(ts).alias("effective_start"), "effective_end")


def gaps(df: DataFrame, keys: Sequence[str], ts: str, tie: Sequence[str] = (),
         slice_seconds: int = sliced.DAY) -> DataFrame:
    """Adds ``gap_seconds`` since the previous row of the series."""
    seen = sliced.neighbours(df, keys, [ts, *tie], sliced.time_slice(ts, slice_seconds), prev={"_was": ts})
    return seen.withColumn("gap_seconds", _micros_between(F.col(ts), F.col("_was")) / 1_000_000).drop("_was")


def gap_stats(df: DataFrame, keys: Sequence[str], ts: str, tie: Sequence[str] = (),
              slice_seconds: int = sliced.DAY) -> DataFrame:
    """Median and 95th percentile of the gaps of every series."""
    measured = gaps(df.select(*keys, ts, *tie), keys, ts, tie, slice_seconds).select(*keys, "gap_seconds")
    return exact_percentiles(materialised(measured, "gaps"), keys, "gap_seconds",
                             {"median_gap": 0.5, "p95_gap": 0.95})


def resample(df: DataFrame, keys: Sequence[str], ts: str, value: str, max_carry_seconds: Column | int,
             unit: str = "hour", bounds: DataFrame | None = None) -> DataFrame:
    """One row per key and hour between the series' ends: mean, extremes, count, and a final value.

    The final value is the observed mean; without one, the last reading if it is not older than
    ``max_carry_seconds`` at the start of the hour; otherwise NULL.  ``source`` says which.
    Readings are reduced to hours first, so what is ordered per key is at most the hours of its life.
    """
    bucket = F.date_trunc(unit, ts)
    seen = F.col(value).isNotNull()
    hourly = df.groupBy(*keys, bucket.alias("bucket")).agg(
        F.avg(value).alias("mean"), F.min(value).alias("low"), F.max(value).alias("high"),
        F.count(value).alias("obs"),
        F.max_by(F.struct(F.col(value).alias("v"), F.col(ts).alias("at")),
                 F.when(seen, F.struct(ts, value))).alias("_final"))
    ends = bounds if bounds is not None else df.groupBy(*keys).agg(
        F.min(bucket).alias("_from"), F.max(bucket).alias("_to"))
    grid = ends.withColumn("bucket", F.explode(F.sequence("_from", "_to", F.expr(f"INTERVAL 1 {unit}"))))
    joined = grid.drop("_from", "_to").join(hourly, [*keys, "bucket"], "left")
    past = (Window.partitionBy(*keys).orderBy("bucket")
            .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    limit = F.lit(max_carry_seconds) if isinstance(max_carry_seconds, int) else max_carry_seconds
    carried = joined.withColumn("_last", F.last("_final", ignorenulls=True).over(past))
    age = _micros_between(F.col("bucket"), F.col("_last.at")) / 1_000_000
    obs = F.coalesce("obs", F.lit(0))
    final = F.when(obs > 0, F.col("mean")).when(age <= limit, F.col("_last.v"))
    return (carried.withColumn("obs", obs).withColumn("final", final)
            .withColumn("source", F.when(obs > 0, "observed").when(final.isNotNull(), "carried").otherwise("gap"))
            .drop("_final", "_last"))


def completeness(df: DataFrame, keys: Sequence[str], ts: str, ok: Column, expected: int,
                 unit: str = "hour") -> DataFrame:
    """Usable readings per bucket as a fraction of the expected number."""
    return (df.groupBy(*keys, F.date_trunc(unit, ts).alias("bucket"))
            .agg(F.count_if(ok).alias("ok_readings"), F.count(F.lit(1)).alias("readings"))
            .withColumn("completeness", F.col("ok_readings") / F.lit(expected)))


def despike(df: DataFrame, keys: Sequence[str], ts: str, value: str, jump: float = 8.0, agree: float = 2.0,
            tie: Sequence[str] = (), slice_seconds: int = sliced.DAY) -> DataFrame:
    """Replace a reading that is far from both neighbours while they agree; the raw value is kept."""
    near = sliced.neighbours(df, keys, [ts, *tie], sliced.time_slice(ts, slice_seconds),
                             prev={"_p": value}, following={"_n": value})
    v, p, n = F.col(value), F.col("_p"), F.col("_n")
    spike = F.coalesce((F.abs(v - p) > jump) & (F.abs(v - n) > jump) & (F.abs(p - n) < agree), F.lit(False))
    return (near.withColumn("is_spike", spike).withColumn(f"{value}_raw", v)
            .withColumn(value, F.when(F.col("is_spike"), (p + n) / 2).otherwise(v)).drop("_p", "_n"))


def missing_slots(df: DataFrame, keys: Sequence[str], slot: str, step: int) -> DataFrame:
    """Grid slots (whole numbers) between a series' first and last reading that hold none."""
    present = df.select(*keys, slot).distinct()
    grid = (present.groupBy(*keys).agg(F.min(slot).alias("_a"), F.max(slot).alias("_b"))
            .select(*keys, F.explode(F.sequence("_a", "_b", F.lit(step).cast("bigint"))).alias(slot)))
    return grid.join(present, [*keys, slot], "left_anti")


def slot_runs(slots: DataFrame, keys: Sequence[str], slot: str, step: int) -> DataFrame:
    """Runs of adjacent slots: first, last, how many."""
    numbered = sliced.islands(slots, keys, [slot], sliced.value_slice(slot, step * 4096), [slot],
                              lambda now, was: now[slot] - was[slot] > step, "run_id")
    return numbered.groupBy(*keys, "run_id").agg(
        F.min(slot).alias("first_slot"), F.max(slot).alias("last_slot"), F.count(F.lit(1)).alias("slots"))


def _counts_below(points: DataFrame, probes: DataFrame, group: Sequence[str], probe_id: Sequence[str],
                  inclusive: bool, width: int) -> DataFrame:
    """For every probe the number of points of its group with ``x < probe.x`` (or ``<=``)."""
    marks = points.select(*group, "x", F.lit(0 if inclusive else 1).alias("_kind"), F.lit(1).alias("_point"))
    asks = probes.select(*group, "x", F.lit(1 if inclusive else 0).alias("_kind"), *probe_id)
    stacked = marks.unionByName(asks, allowMissingColumns=True)
    counted = sliced.running(stacked, group, ["x", "_kind"], sliced.value_slice("x", width),
                             {"_n": ("count", F.col("_point"))})
    return counted.where(F.col("_point").isNull())


def overlap_count(df: DataFrame, group: str, member: str, start: str, end: str, *,
                  name: str = "others", width: int = 1024) -> DataFrame:
    """For every interval ``[start, end)`` of whole numbers from 0, how many other
    members of its group have an interval that overlaps it.  A member's own intervals must not overlap.

    Intervals are never paired.  A member overlaps in a stretch of neighbouring intervals, so
    members = intervals overlapped - gaps between two of them.  The first term is a difference of two
    running counts.  The second asks for gaps lying inside the interval; dyadic cells of the start
    axis turn that into running counts too, with a row per gap and level; the levels follow from the
    last end of the data.
    """
    ids = [group, member, start, end]
    df = materialised(df, "intervals")
    low, high = df.agg(F.min(start), F.max(end)).first()
    if low is not None and low < 0:
        raise ValueError(f"intervals begin at {low}; shift them to begin at 0 or later")
    levels = max(1, int(high or 0).bit_length())
    ivs = df.select(*ids)
    starts = ivs.select(group, F.col(start).alias("x"))
    ends = ivs.select(group, F.col(end).alias("x"))
    by_end = ivs.withColumn("x", F.col(end))
    by_start = ivs.withColumn("x", F.col(start))
    begun = _counts_below(starts, by_end, [group], ids[1:], False, width).select(*ids, F.col("_n").alias("k"))
    over = _counts_below(ends, by_start, [group], ids[1:], True, width).select(*ids, (-F.col("_n")).alias("k"))

    own = sliced.neighbours(ivs, [group, member], [start], sliced.value_slice(start, width),
                            following={"_then": start}).where(F.col("_then").isNotNull())
    levels_up = F.sequence(F.lit(0), F.lit(levels))
    cells = (own.select(group, F.col(end).alias("_from"), F.col("_then").alias("x"),
                        F.explode(levels_up).alias("_level"))
             .withColumn("_cell", F.call_function("shiftright", F.col("_from"), F.col("_level")))
             .select(group, "_level", "_cell", "x"))
    first = F.col(start) + 1
    asks = (ivs.where(F.col(end) > first)
            .select(*ids, F.explode(levels_up).alias("_level"))
            .withColumn("_at", F.call_function("shiftright", first, F.col("_level"))))
    leaf = asks.where("_level = 0").select(*ids, "_level", F.col("_at").alias("_cell"))
    wings = (asks.where((F.col("_level") < levels) & (F.col("_at") % 2 == 0))
             .select(*ids, "_level", (F.col("_at") + 1).alias("_cell")))
    probes = leaf.unionByName(wings).withColumn("x", F.col(end))
    inside = _counts_below(cells, probes, [group, "_level", "_cell"], ids[1:], False, width).select(
        *ids, (-F.col("_n")).alias("k"))
    total = begun.unionByName(over).unionByName(inside).groupBy(*ids).agg((F.sum("k") - 1).alias(name))
    return df.join(total, ids, "left")


def lead_features(hourly: DataFrame, anchors: DataFrame, key: str, bucket: str, anchor: str, hours: int,
                  breaches: dict[str, Column]) -> DataFrame:
    """Earliest breach in the hours before an event, and which measure breached first.

    ``breaches`` maps a measure to a condition; a NULL reading is no breach.  Every event is listed in
    the hours it looks back on and joined on (key, hour), so a subject's history is never paired whole.
    """
    hour = lambda c: F.floor(F.unix_seconds(c) / 3600)
    lead = (F.unix_seconds(anchor) - F.unix_seconds(bucket)) / 3600
    listed = (anchors.select(key, anchor).distinct()
              .withColumn("_hour", F.explode(F.sequence(hour(anchor) - hours - 1, hour(anchor)))))
    near = (hourly.withColumn("_hour", hour(bucket)).join(listed, [key, "_hour"])
            .where((F.col(bucket) <= F.col(anchor))
                   & (F.unix_seconds(bucket) >= F.unix_seconds(anchor) - hours * 3600)).drop("_hour"))
    signal = F.coalesce(*[F.when(cond, F.lit(name)) for name, cond in breaches.items()])
    hit = near.withColumn("_signal", signal).withColumn("_lead", lead).where(F.col("_signal").isNotNull())
    return hit.groupBy(key, anchor).agg(
        F.max("_lead").alias("earliest_lead_h"), F.max_by("_signal", "_lead").alias("first_signal"),
        F.count(F.lit(1)).alias("breach_hours"))


def widen(df: DataFrame, keys: Sequence[str], bucket: Column, name: str, measure: str, value: str, measures: Sequence[str],
          first_by: Sequence[str], slice_seconds: int = 30 * sliced.DAY) -> DataFrame:
    """Long readings to one row per key and bucket with a column per measure, the first reading winning.

    Adds ``filled``, the number of measures present, and ``gap_minutes`` since the key's row before; the gap is taken over
    the wide rows, slice by slice.
    """
    wide = df.groupBy(*keys, bucket.alias(name)).pivot(measure, list(measures)).agg(F.min_by(value, F.struct(*first_by)))
    filled = wide.withColumn("filled", sum((F.col(m).isNotNull().cast("int") for m in measures), F.lit(0)))
    spaced = gaps(filled, keys, name, slice_seconds=slice_seconds)
    return spaced.withColumn("gap_minutes", F.col("gap_seconds") / 60).drop("gap_seconds")


def sparsity(wide: DataFrame, filled: str, levels: Sequence[int], gap: str) -> DataFrame:
    """For each level the rows with at least as many values, their share of all rows and the longest gap before one; one aggregate."""
    at = {n: F.col(filled) >= n for n in levels}
    one = wide.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(c).alias(f"r{n}") for n, c in at.items()], *[F.max(F.when(c, F.col(gap))).alias(f"g{n}") for n, c in at.items()])
    rows = [F.struct(F.lit(n).alias("least_filled"), F.col(f"r{n}").alias("rows"), F.round(F.try_divide(f"r{n}", "n"), 6).alias("share"), F.col(f"g{n}").alias("longest_gap")) for n in levels]
    return one.select(F.inline(F.array(*rows)))
