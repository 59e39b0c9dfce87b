"""Gates and reports about data: emptiness, keys, rates, rules, profiles, fingerprints."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeops.operators.cdc import duplicate_keys


class QualityError(ValueError):
    """A gate refused the data."""


def assert_not_empty(df: DataFrame, what: str = "input") -> DataFrame:
    if df.isEmpty():
        raise QualityError(f"{what} is empty")
    return df


def not_empty(tables: Mapping[str, DataFrame]) -> DataFrame:
    """One row per table: whether it holds a row; no table is read further than its first one."""
    firsts = [df.select(F.lit(name).alias("table_name")).limit(1).agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table_name"), (F.col("n") > 0).alias("passed"))
              for name, df in tables.items()]
    return reduce(DataFrame.unionByName, firsts)


def assert_unique(df: DataFrame, keys: Sequence[str], what: str = "table") -> DataFrame:
    if not duplicate_keys(df, keys).isEmpty():
        raise QualityError(f"{what} holds duplicates of {list(keys)}")
    return df


def parse_rates(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """One row: rows, and per column the share that could not be parsed (is NULL)."""
    return df.agg(F.count(F.lit(1)).alias("rows"),
                  *[F.round(F.try_divide(F.count_if(F.col(c).isNull()), F.count(F.lit(1))), 6).alias(f"{c}_bad")
                    for c in cols])


def assert_parse_rate(df: DataFrame, cols: Sequence[str], limit: float = 0.001) -> DataFrame:
    row = parse_rates(df, cols).first()
    bad = {c: row[f"{c}_bad"] for c in cols if (row[f"{c}_bad"] or 0) > limit}
    if bad:
        raise QualityError(f"unparseable share above {limit}: {bad}")
    return df


def duplicate_rate(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row: rows, surplus copies, their share."""
    return (df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
            .agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("rows"),
                 F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("surplus"))
            .withColumn("duplicate_rate", F.round(F.try_divide("surplus", "rows"), 6)))


def assert_duplicate_rate(df: DataFrame, keys: Sequence[str], limit: float = 0.005) -> DataFrame:
    row = duplicate_rate(df, keys).first()
    if not row["rows"]:
        raise QualityError("no rows in the window")
    if row["duplicate_rate"] > limit:
        raise QualityError(f"duplicate share {row['duplicate_rate']} above {limit}")
    return df


def distribution(df: DataFrame, score: str) -> DataFrame:
    s = F.col(score)
    return df.agg(F.count(F.lit(1)).alias("rows"), F.count_if(s.isNull()).alias("nulls"), F.avg(s).alias("mean"),
                  F.stddev_samp(s).alias("sd"), F.min(s).alias("low"), F.max(s).alias("high"))


def assert_distribution(df: DataFrame, score: str, min_mean: float = 0.01, max_mean: float = 0.45,
                        min_sd: float = 0.02) -> DataFrame:
    """Refuse scores that are missing, off in the mean, or nearly constant."""
    row = distribution(df, score).first()
    if not row["rows"]:
        raise QualityError("no scores")
    if row["nulls"]:
        raise QualityError(f"{row['nulls']} scores are NULL")
    if not min_mean <= row["mean"] <= max_mean:
        raise QualityError(f"mean score {row['mean']} outside [{min_mean}, {max_mean}]")
    if (row["sd"] or 0.0) < min_sd:
        raise QualityError(f"score deviation {row['sd']} below {min_sd}")
    return df


_MEASURES = {
    "null_check": lambda c: F.count_if(c.isNull()).cast("double"),
    "distinct_check": lambda c: F.countDistinct(c).cast("double"),
    "unique_check": lambda c: (F.count(c) - F.countDistinct(c)).cast("double"),
    "min": lambda c: F.min(c).cast("double"),
    "max": lambda c: F.max(c).cast("double"),
}
_TESTS = {
    "equal_to": lambda v, x: v == x,
    "greater_than": lambda v, x: v > x,
    "less_than": lambda v, x: v < x,
    "geq_to": lambda v, x: v >= x,
    "leq_to": lambda v, x: v <= x,
}


def check_columns(df: DataFrame, rules: Mapping[str, Mapping[str, Mapping[str, float]]]) -> DataFrame:
    """``{"price": {"min": {"geq_to": 0}}}`` to one row per rule: column, check, value, passed.

    All rules share one scan.
    """
    flat = [(col, check, test) for col, checks in rules.items() for check, test in checks.items()]
    one = df.agg(*[_MEASURES[check](F.col(col)).alias(f"_{i}") for i, (col, check, _) in enumerate(flat)])
    rows = []
    for i, (col, check, test) in enumerate(flat):
        value = F.col(f"_{i}")
        passed = F.lit(True)
        for name, bound in test.items():
            if name != "tolerance":
                if name == "equal_to" and "tolerance" in test:
                    near = F.abs(value - bound) <= abs(bound) * test["tolerance"]
                    passed = passed & near
                else:
                    passed = passed & _TESTS[name](value, F.lit(float(bound)))
        rows.append(F.struct(F.lit(col).alias("column"), F.lit(check).alias("check"), value.alias("value"),
                             F.coalesce(passed, F.lit(False)).alias("passed")))
    return one.select(F.inline(F.array(*rows)))


def check_table(df: DataFrame, checks: Mapping[str, str]) -> DataFrame:
    """Boolean SQL expressions to one row each.  A row-level condition must hold for every row; an
    expression over aggregates is taken as it is."""
    one = df.agg(*[(F.expr(t) if _is_aggregate(t) else F.coalesce(F.bool_and(F.expr(t)), F.lit(True))).alias(n)
                   for n, t in checks.items()])
    return one.select(F.inline(F.array(*[F.struct(F.lit(n).alias("check"), F.col(n).alias("passed"))
                                         for n in checks])))


def _is_aggregate(text: str) -> bool:
    lowered = text.lower().replace(" ", "")
    return any(f"{fn}(" in lowered for fn in ("count", "sum", "avg", "min", "max", "stddev"))


def check_value(df: DataFrame, measure: Column, expected: float, tolerance: float = 0.0) -> DataFrame:
    v = measure.cast("double")
    return df.agg(v.alias("value"), (F.abs(v - expected) <= abs(expected) * tolerance).alias("passed"))


def check_threshold(df: DataFrame, measure: Column, low: float, high: float) -> DataFrame:
    v = measure.cast("double")
    return df.agg(v.alias("value"), v.between(low, high).alias("passed"))


def check_interval(df: DataFrame, date_col: str, day: str, days_back: int, measures: Mapping[str, Column],
                   max_ratio: float) -> DataFrame:
    """Compare measures of ``day`` with those of ``days_back`` days before: the larger may be at most
    ``max_ratio`` times the smaller.  ``measures`` hold row expressions that are summed."""
    d = F.to_date(date_col)
    today = F.lit(day).cast("date")
    earlier = F.date_sub(today, days_back)
    aggs = []
    for name, expr in measures.items():
        aggs += [F.sum(F.when(d == today, expr)).cast("double").alias(f"{name}_now"),
                 F.sum(F.when(d == earlier, expr)).cast("double").alias(f"{name}_then")]
    one = df.where((d == today) | (d == earlier)).agg(*aggs)
    rows = [F.struct(F.lit(n).alias("measure"), F.col(f"{n}_now").alias("now"), F.col(f"{n}_then").alias("then"),
                     F.coalesce(F.try_divide(F.greatest(f"{n}_now", f"{n}_then"),
                                             F.least(f"{n}_now", f"{n}_then")) <= max_ratio,
                                F.lit(False)).alias("passed")) for n in measures]
    return one.select(F.inline(F.array(*rows)))


def orphan_report(children: DataFrame, child_key: str, parents: DataFrame, parent_key: str) -> DataFrame:
    """One row: child rows, orphans, share, and how many dead keys they use.

    Children are counted per key first, so a hot key joins as one row.
    """
    per_key = children.groupBy(F.col(child_key).alias("_k")).agg(F.count(F.lit(1)).alias("_n"))
    known = parents.select(F.col(parent_key).alias("_k")).distinct().withColumn("_known", F.lit(True))
    marked = per_key.join(known, "_k", "left")
    return (marked.agg(F.sum("_n").alias("rows"),
                       F.coalesce(F.sum(F.when(F.col("_known").isNull(), F.col("_n"))), F.lit(0)).alias("orphans"),
                       F.count_if(F.col("_known").isNull()).alias("dead_keys"))
            .withColumn("orphan_share", F.round(F.try_divide("orphans", "rows"), 6)))


def profile(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Per column: NULL share, distinct values, the most frequent value and its share."""
    cols = list(cols or df.columns)
    long = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in cols])).alias("x"))
    per_value = long.groupBy("x.column", "x.value").agg(F.count(F.lit(1)).alias("n"))
    real = F.col("value").isNotNull()
    return per_value.groupBy("column").agg(
        F.round(F.coalesce(F.sum(F.when(~real, F.col("n"))), F.lit(0)) / F.sum("n"), 6).alias("null_share"),
        F.count("value").alias("distinct_values"),
        F.max_by("value", F.when(real, F.struct("n", "value"))).alias("top_value"),
        F.round(F.max(F.when(real, F.col("n"))) / F.sum("n"), 6).alias("top_share"))


def row_text(cols: Sequence[str]) -> Column:
    """Canonical text of a row; NULL is spelled out so that it differs from the empty string."""
    return F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("<null>")) for c in cols])


def dataset_checksum(df: DataFrame, cols: Sequence[str], prefix: Sequence[int] = (6, 3, 0)) -> DataFrame:
    """One row: SHA-256 over all rows, independent of their order.

    Equal rows are counted first, then hashes are folded level by level over shorter prefixes, so no
    task sees more than a small share of them.
    """
    level = (df.groupBy(row_text(cols).alias("_t")).agg(F.count(F.lit(1)).alias("_n"))
             .select(F.sha2(F.concat_ws("#", "_t", "_n"), 256).alias("h")))
    for length in prefix:
        level = (level.groupBy(F.substring("h", 1, length).alias("p"))
                 .agg(F.sha2(F.array_join(F.sort_array(F.collect_list("h")), "\n"), 256).alias("folded"))
                 .select(F.concat("p", "folded").alias("h")))
    return level.select(F.col("h").alias("checksum"))


def unordered_digest(cols: Sequence[str]) -> Column:
    """An aggregate: 60 bits of every row's SHA-256, summed exactly.  Order does not matter, repeated rows do.

    The halves are summed as longs, which decimals would take much longer for.
    """
    bits = F.conv(F.substring(F.sha2(row_text(cols), 256), 1, 15), 16, 10).cast("long")
    high, low = (F.sum(half).cast("decimal(20,0)") for half in (F.shiftright(bits, 30), bits.bitwiseAND(F.lit((1 << 30) - 1))))
    return (high * F.lit(1 << 30).cast("decimal(10,0)") + low).cast("string")


def fingerprint(df: DataFrame) -> DataFrame:
    """One row: count and an order-free hash sum, cheap enough to run before and after a rewrite."""
    return df.agg(F.count(F.lit(1)).alias("rows"),
                  F.sum(F.xxhash64(*df.columns).cast("decimal(20,0)")).alias("hash_sum"))


def assert_idempotent(before: DataFrame, after: DataFrame) -> None:
    if fingerprint(before).first() != fingerprint(after).first():
        raise QualityError("the rerun changed the table")


def precision_recall(found: DataFrame, truth: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row: hits, false alarms, misses, precision, recall of a detector."""
    f = found.select(*keys).distinct().withColumn("_f", F.lit(1))
    t = truth.select(*keys).distinct().withColumn("_t", F.lit(1))
    both = f.join(t, list(keys), "full")
    return (both.agg(F.count_if(F.col("_f").isNotNull() & F.col("_t").isNotNull()).alias("hits"),
                     F.count_if(F.col("_t").isNull()).alias("false_alarms"),
                     F.count_if(F.col("_f").isNull()).alias("misses"))
            .withColumn("precision", F.round(F.try_divide("hits", F.col("hits") + F.col("false_alarms")), 6))
            .withColumn("recall", F.round(F.try_divide("hits", F.col("hits") + F.col("misses")), 6)))


def sigma_anomaly(df: DataFrame, keys: Sequence[str], ts: str, value: str, window_start: Column,
                  window_seconds: int, k: float = 3.0, history_days: int = 28) -> DataFrame:
    """Rows of the current window above their own mean + k deviations over the days before it.

    History and current window come out of one aggregate per series; a flat history raises nothing.
    """
    since = _micros(ts) - F.unix_micros(window_start)
    history = (since < 0) & (since >= -history_days * 86_400_000_000)
    current = (since >= 0) & (since < window_seconds * 1_000_000)
    v = F.col(value)
    stats = df.where(history | current).groupBy(*keys).agg(
        F.avg(F.when(history, v)).alias("mu"), F.stddev_samp(F.when(history, v)).alias("sigma"),
        F.max(F.when(current, v)).alias("current_value"))
    return stats.where((F.col("sigma") > 0) & (F.col("current_value") > F.col("mu") + k * F.col("sigma")))


def _micros(ts: str) -> Column:
    return F.unix_micros(F.col(ts))
