"""Erasure with attestation, suppression of small groups, de-identification."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def erase(tables: Mapping[str, DataFrame], ids: DataFrame, key: str) -> dict[str, DataFrame]:
    """Every table of a scope without the rows of the listed subjects."""
    gone = ids.select(key).distinct()
    return {name: df.join(gone, key, "left_anti") for name, df in tables.items()}


def subject_rows(tables: Mapping[str, DataFrame], ids: DataFrame, key: str) -> DataFrame:
    """How many rows each table holds about the listed subjects."""
    gone = ids.select(key).distinct()
    counts = [df.join(gone, key, "left_semi").agg(F.count(F.lit(1)).alias("subject_rows"))
              .select(F.lit(name).alias("table_name"), "subject_rows") for name, df in tables.items()]
    return reduce(DataFrame.unionByName, counts)


def attest_erasure(before: Mapping[str, DataFrame], readable: Mapping[str, Sequence[DataFrame]],
                   ids: DataFrame, key: str) -> DataFrame:
    """Per table: rows before and after, rows erased, and what is left of the subjects in *any*
    version that can still be read (``readable``, newest last).  Attested only when nothing is."""
    gone = ids.select(key).distinct()
    rows = []
    for name, old in before.items():
        was = old.agg(F.count(F.lit(1)).alias("rows_before"))
        now = readable[name][-1].agg(F.count(F.lit(1)).alias("rows_after"))
        left = reduce(DataFrame.unionByName, [
            v.join(gone, key, "left_semi").agg(F.count(F.lit(1)).alias("n")) for v in readable[name]])
        residual = left.agg(F.sum("n").alias("residual"))
        rows.append(old.sparkSession.range(1).select(
            F.lit(name).alias("table_name"), was.scalar().alias("rows_before"), now.scalar().alias("rows_after"),
            residual.scalar().alias("residual"), F.lit(len(readable[name])).cast("bigint").alias("readable_versions")))
    return (reduce(DataFrame.unionByName, rows)
            .withColumn("erased", F.col("rows_before") - F.col("rows_after"))
            .withColumn("attested", F.col("residual") == 0))


def unrecoverable(attestation: DataFrame, retention: DataFrame, erased_at: Column) -> DataFrame:
    """Add from when on the erased rows cannot be brought back, and what decides it.

    ``retention`` has per ``table_name`` the days until an old version expires, the days its files stay after that, and
    whether a branch or tag pins one. Pinned versions never expire, so there is no such time; without an old version that
    can be read, only the files' days count. A table without a rule has no time either.
    """
    old, days = F.col("readable_versions") > 1, F.col("noncurrent_days")
    until = F.when(F.col("pinned") & old, None).otherwise(days + F.when(old, F.col("version_days")).otherwise(0))
    why = (F.when(days.isNull(), "NO_RULE").when(F.col("pinned") & old, "PINNED").when(old, "VERSION_EXPIRY").otherwise("FILE_REMOVAL"))
    return (attestation.join(retention, "table_name", "left")
            .withColumns({"unrecoverable_at": F.date_add(erased_at, until.cast("int")), "mechanism": why}).drop("version_days", "noncurrent_days", "pinned"))


def deadline_watch(requests: DataFrame, requested: str, as_of: str, limit_days: int = 30,
                   warn_days: int = 7) -> DataFrame:
    """Open requests that breach the deadline or are within ``warn_days`` of it."""
    open_days = F.datediff(F.lit(as_of).cast("date"), F.to_date(requested))
    state = F.when(open_days > limit_days, "BREACHED").otherwise("DUE_SOON")
    return (requests.withColumn("days_open", open_days)
            .where(F.col("days_open") >= limit_days - warn_days).withColumn("state", state))


def suppress_small(df: DataFrame, dims: Sequence[str], subject: str, measures: Mapping[str, Column],
                   k: int = 5) -> DataFrame:
    """Group by ``dims``; measures of groups with fewer than ``k`` subjects become NULL."""
    grouped = df.groupBy(*dims).agg(F.countDistinct(subject).alias("_subjects"),
                                    *[m.alias(a) for a, m in measures.items()])
    shown = F.col("_subjects") >= k
    return grouped.select(*dims, F.when(shown, F.col("_subjects")).alias("subjects"),
                          *[F.when(shown, F.col(a)).alias(a) for a in measures], (~shown).alias("suppressed"))


def deidentify(df: DataFrame, tokenise: Sequence[str], drop: Sequence[str], salt: str) -> DataFrame:
    """Identifiers become salted hashes, direct attributes disappear."""
    out = df.drop(*drop)
    for c in tokenise:
        out = out.withColumn(c, F.sha2(F.concat(F.lit(salt), F.col(c).cast("string")), 256))
    return out
