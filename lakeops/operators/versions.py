"""Versioned Parquet tables by convention: data directories plus a small Parquet log.

A version is a list of data directories.  An append adds one directory to its parent's list, an
overwrite starts a new list, so publishing never copies what did not change.  The log holds one row
per action; it grows with commits, not with data.  There is one writer at a time: this is a way to
lay out Parquet, not a table format.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from lakeops.sources import files

LOG_SCHEMA = ("seq bigint, action string, version bigint, committed_at timestamp, operation string, "
              "added_rows bigint, parent bigint, parts array<string>, name string, keep_until timestamp")


class VersionError(ValueError):
    """A version, tag or time that cannot be read."""


class VersionedTable:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._known: list | None = None

    # ------------------------------------------------------------ log

    def log(self) -> DataFrame:
        """Every action ever taken on the table."""
        where = f"{self.path}/_log"
        if not files.exists(self.spark, where):
            return self.spark.createDataFrame([], LOG_SCHEMA)
        return self.spark.read.schema(LOG_SCHEMA).parquet(where)

    def refresh(self) -> None:
        """Forget what was read of the log, after another process wrote to the table."""
        self._known = None

    def _rows(self) -> list:
        if self._known is None:
            self._known = self.log().orderBy("seq").collect()
        return self._known

    def _write(self, at: dt.datetime, *entries: dict) -> None:
        """Append log rows, all of them in one file."""
        rows = self._rows()
        new = []
        for i, fields in enumerate(entries):
            entry = dict.fromkeys([c.split()[0] for c in LOG_SCHEMA.split(", ")])
            entry.update(seq=len(rows) + i, committed_at=at, **fields)
            new.append(Row(**entry))
        (self.spark.createDataFrame(new, LOG_SCHEMA).coalesce(1)
         .write.mode("append").parquet(f"{self.path}/_log"))
        self._known = rows + new

    def _commits(self) -> dict:
        rows = self._rows()
        expired = {r.version for r in rows if r.action == "expire"}
        return {r.version: r for r in rows if r.action == "commit" and r.version not in expired}

    def current(self) -> int | None:
        """The live version: the target of the newest pointer move."""
        moves = [r.version for r in self._rows() if r.action == "set_current"]
        return moves[-1] if moves else None

    def history(self) -> DataFrame:
        """Readable versions with their parent and whether they are on the live line."""
        commits = self._commits()
        line, v = set(), self.current()
        while v is not None and v in commits:
            line.add(v)
            v = commits[v].parent
        rows = [(c.version, c.committed_at, c.operation, c.added_rows, c.parent, c.version in line)
                for c in commits.values()]
        return self.spark.createDataFrame(
            rows, "version bigint, committed_at timestamp, operation string, added_rows bigint, "
                  "parent bigint, is_current_ancestor boolean")

    def refs(self) -> DataFrame:
        """Named references: the live pointer, tags and open branches."""
        live = {}
        for r in self._rows():
            if r.action in ("tag", "branch"):
                live[r.name] = (r.name, r.action, r.version, r.keep_until)
            elif r.action == "drop_branch":
                live.pop(r.name, None)
        rows = list(live.values())
        if self.current() is not None:
            rows.append(("main", "branch", self.current(), None))
        return self.spark.createDataFrame(rows, "name string, kind string, version bigint, keep_until timestamp")

    # ------------------------------------------------------------ write

    def publish(self, df: DataFrame, operation: str, at: dt.datetime, *, live: bool = True,
                partition_by: Sequence[str] = ()) -> int:
        """Write a new version (``append`` or ``overwrite``) and, unless told not to, make it live."""
        commits = self._commits()
        version = max([r.version for r in self._rows() if r.action == "commit"], default=0) + 1
        parent = self.current()
        part = f"{self.path}/data/v={version}"
        df.write.option("compression", "zstd").partitionBy(*partition_by).parquet(part)
        before = commits[parent].parts if parent is not None else []
        added = self.spark.read.parquet(part).count()
        entries = [dict(action="commit", version=version, operation=operation, added_rows=added, parent=parent,
                        parts=[*before, part] if operation == "append" else [part])]
        if live:
            entries.append(dict(action="set_current", version=version))
        self._write(at, *entries)
        return version

    def set_current(self, version: int, at: dt.datetime) -> None:
        """Roll back, or forward again: only the pointer moves."""
        self._parts(version)
        self._write(at, dict(action="set_current", version=version))

    def tag(self, name: str, version: int, at: dt.datetime, keep_days: int | None = None) -> None:
        self._parts(version)
        until = at + dt.timedelta(days=keep_days) if keep_days is not None else None
        self._write(at, dict(action="tag", version=version, name=name, keep_until=until))

    def update_where(self, where: str, changes: Mapping[str, Column], at: dt.datetime) -> int:
        now = self.read()
        hit = F.coalesce(F.expr(where), F.lit(False))
        new = now.select(*[F.when(hit, changes[c]).otherwise(F.col(c)).alias(c) if c in changes else F.col(c)
                           for c in now.columns])
        return self.publish(new, "overwrite", at)

    def delete_where(self, where: str, at: dt.datetime) -> int:
        return self.publish(self.read().where(~F.coalesce(F.expr(where), F.lit(False))), "delete", at)

    def write_audit_publish(self, df: DataFrame, at: dt.datetime, audit: Callable[[DataFrame], DataFrame],
                            branch: str = "audit", operation: str = "append") -> tuple[bool, DataFrame]:
        """Write beside the live line, audit there, go live only if every rule passed.

        ``audit`` maps the candidate table to rows ``(check, passed)``.  A rejected version stays
        readable by number until it expires, but never becomes current.
        """
        version = self.publish(df, operation, at, live=False)
        self._write(at, dict(action="branch", version=version, name=branch))
        report = audit(self.read(version=version))
        clean = report.where(~F.coalesce(F.col("passed"), F.lit(False))).isEmpty()
        closing = [dict(action="drop_branch", version=version, name=branch)]
        if clean:
            closing.append(dict(action="set_current", version=version))
        self._write(at, *closing)
        return clean, report

    # ------------------------------------------------------------ read

    def _parts(self, version: int) -> list[str]:
        commits = self._commits()
        if version not in commits:
            raise VersionError(f"version {version} does not exist or has expired")
        return commits[version].parts

    def resolve(self, version: int | None = None, timestamp: dt.datetime | None = None,
                tag: str | None = None) -> int:
        """A version number from a number, a tag, or a time: the version that was live strictly before it."""
        if version is not None:
            return version
        rows = self._rows()
        if tag is not None:
            found = [r.version for r in rows if r.action in ("tag", "branch") and r.name == tag]
            if not found:
                raise VersionError(f"no tag {tag}")
            return found[-1]
        if timestamp is not None:
            found = [r.version for r in rows if r.action == "set_current" and r.committed_at < timestamp]
            if not found:
                raise VersionError(f"no version is older than {timestamp}")
            return found[-1]
        if self.current() is None:
            raise VersionError("the table has no version yet")
        return self.current()

    def read(self, version: int | None = None, timestamp: dt.datetime | None = None,
             tag: str | None = None) -> DataFrame:
        parts = self._parts(self.resolve(version, timestamp, tag))
        frames = [self.spark.read.parquet(p) for p in parts]
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)

    def stamped(self, **at) -> DataFrame:
        """The rows with the version they were read from, as evidence for later."""
        version = self.resolve(**at)
        return self.read(version=version).withColumn("source_version", F.lit(version).cast("bigint"))

    # ------------------------------------------------------------ upkeep

    def expire(self, older_than: dt.datetime, retain_last: int, at: dt.datetime) -> list[int]:
        """Drop old versions and the directories nothing else refers to.

        The newest ``retain_last`` versions, the live one, and tagged ones (within their retention)
        stay.  Reading an expired version fails.
        """
        commits = self._commits()
        keep = set(sorted(commits)[-retain_last:]) | {self.current()}
        keep |= {r.version for r in self._rows()
                 if r.action == "tag" and (r.keep_until is None or r.keep_until > at)}
        gone = [v for v, r in commits.items() if v not in keep and r.committed_at < older_than]
        needed = {p for v, r in commits.items() if v not in gone for p in r.parts}
        if gone:
            self._write(at, *[dict(action="expire", version=v) for v in gone])
        for part in {p for v in gone for p in commits[v].parts} - needed:
            files.remove(self.spark, part)
        return gone

    def unreferenced(self, older_than: dt.datetime, now: dt.datetime) -> list[str]:
        """Data directories no readable version refers to.  Report only; less than a day old is refused,
        since a write may still be under way."""
        if now - older_than < dt.timedelta(hours=24):
            raise VersionError("directories younger than 24 hours may belong to a running write")
        needed = {p.rsplit("/", 1)[1] for r in self._commits().values() for p in r.parts}
        cut = older_than.timestamp() * 1000
        return [f"{self.path}/data/{name}" for name, changed in files.children(self.spark, f"{self.path}/data")
                if name not in needed and changed < cut]


def diff_versions(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row: keys added, deleted, changed and unchanged between two versions."""
    def hashed(df: DataFrame, name: str) -> DataFrame:
        rest = [c for c in df.columns if c not in keys]
        return df.select(*keys, F.xxhash64(*rest).alias(name))

    both = hashed(old, "_a").join(hashed(new, "_b"), list(keys), "full")
    a, b = F.col("_a"), F.col("_b")
    return both.agg(F.count_if(a.isNull()).alias("added"), F.count_if(b.isNull()).alias("deleted"),
                    F.count_if(a != b).alias("changed"), F.count_if(a == b).alias("unchanged"))


# The type changes a reader may apply without losing a value.
WIDENINGS = {
    ("int", "bigint"), ("smallint", "int"), ("smallint", "bigint"), ("tinyint", "smallint"), ("tinyint", "int"),
    ("tinyint", "bigint"), ("float", "double"), ("int", "double"), ("date", "timestamp"),
}


def can_widen(old: str, new: str) -> bool:
    """Same type, a listed widening, or a decimal that gains precision at the same scale."""
    if old == new or (old, new) in WIDENINGS:
        return True
    if old.startswith("decimal(") and new.startswith("decimal("):
        (p1, s1), (p2, s2) = (tuple(map(int, t[8:-1].split(","))) for t in (old, new))
        return s1 == s2 and p2 >= p1
    return False


def evolve(df: DataFrame, *, rename: Mapping[str, str] | None = None, drop: Sequence[str] = (),
           add: Mapping[str, str] | None = None, widen: Mapping[str, str] | None = None,
           order: Sequence[str] | None = None) -> DataFrame:
    """Read old rows under a new schema: renamed, dropped, added (NULL) and widened columns."""
    out = df.withColumnsRenamed(dict(rename or {})).drop(*drop)
    types = dict(out.dtypes)
    for c, new in (widen or {}).items():
        if not can_widen(types[c], new):
            raise VersionError(f"{c}: {types[c]} cannot become {new} without losing values")
        out = out.withColumn(c, F.col(c).cast(new))
    for c, new in (add or {}).items():
        out = out.withColumn(c, F.lit(None).cast(new))
    return out.select(*order) if order else out
