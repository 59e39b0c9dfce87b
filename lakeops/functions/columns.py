"""Small column expressions shared by the operators and reports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def money(c: str | Column, precision: int = 12, scale: int = 2) -> Column:
    """Exact amounts: sums of doubles depend on the order of the rows."""
    return _col(c).cast(f"decimal({precision},{scale})")


def digits_only(c: str | Column) -> Column:
    """Phone-number normalisation: keep digits and the plus sign."""
    return F.regexp_replace(_col(c), "[^0-9+]", "")


def is_month_end(d: str | Column) -> Column:
    return F.to_date(_col(d)) == F.last_day(_col(d))


def days_in_month(d: str | Column) -> Column:
    return F.dayofmonth(F.last_day(_col(d)))


def fahrenheit_to_celsius(value: str | Column, is_fahrenheit: Column) -> Column:
    v = _col(value)
    return F.when(is_fahrenheit, (v - 32) * 5 / 9).otherwise(v)


def ratio(num: str | Column, den: str | Column, scale: float = 1.0, digits: int | None = None) -> Column:
    """``scale * num / den``; NULL, not an error, when the denominator is zero, negative or missing."""
    value = F.when(_col(den) > 0, F.lit(scale) * _col(num) / _col(den))
    return value if digits is None else F.round(value, digits)


def weighted_mean(value: str | Column, weight: str | Column) -> Column:
    """Aggregate: exposure-weighted mean with a floor of one on the total weight."""
    return F.sum(_col(value) * _col(weight)) / F.greatest(F.sum(_col(weight)), F.lit(1))


def reading(text: str | Column) -> Column:
    """A number from text in which '' and 'Null' stand for a missing reading."""
    bare = F.trim(_col(text))
    return F.when(~F.lower(bare).isin("", "null"), bare).try_cast("double")


def reading_status(value: str | Column) -> Column:
    v = _col(value)
    return (F.when(v.isNull(), "MISSING").when(v < 0, "NEGATIVE").when(v == 0, "ZERO").otherwise("OK"))


def gps_valid(lat: str | Column, lon: str | Column) -> Column:
    """False for a missing, out-of-range or near-(0, 0) position; never NULL."""
    la, lo = _col(lat), _col(lon)
    at_origin = (F.abs(la) < 0.001) & (F.abs(lo) < 0.001)
    sane = la.between(-90, 90) & lo.between(-180, 180) & ~at_origin
    return F.coalesce(sane, F.lit(False))


def snap(ts: str | Column, seconds: int) -> Column:
    """The grid point at or before a timestamp."""
    return F.timestamp_seconds(F.floor(F.unix_seconds(_col(ts)) / seconds) * seconds)


def stable_salt(keys: list[str | Column], buckets: int | Column) -> Column:
    """A salt that is the same on every attempt of a task, unlike ``rand()``.

    The partition a row is read from takes part, so copies of one row spread as well.
    """
    n = F.lit(buckets) if isinstance(buckets, int) else buckets
    return F.pmod(F.xxhash64(*[_col(k) for k in keys], F.spark_partition_id()), n).cast("int")


def count_upto(ascending: str | Column, x: Column, inclusive: bool = True, steps: int | None = None) -> Column:
    """How many elements of a sorted array are at most ``x`` (below it, when not ``inclusive``), by binary search.

    ``steps`` halvings serve arrays of up to ``2 ** steps - 1`` elements; without it an array is halved as often as its own size needs.
    """
    values = _col(ascending)
    halvings = F.length(F.bin(F.size(values))) if steps is None else F.lit(steps)

    def halve(at: Column, _: Column) -> Column:
        middle = F.shiftright(at["low"] + at["high"], 1).cast("int")
        passed = F.get(values, middle) <= x if inclusive else F.get(values, middle) < x
        going = at["low"] < at["high"]
        return F.struct(F.when(going & passed, middle + 1).otherwise(at["low"]).alias("low"),
                        F.when(going & ~passed, middle).otherwise(at["high"]).alias("high"))

    start = F.struct(F.lit(0).alias("low"), F.size(values).alias("high"))
    return F.aggregate(F.sequence(F.lit(1), halvings), start, halve, lambda at: at["low"])
