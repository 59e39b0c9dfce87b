"""Change-data-capture: envelopes, latest-wins collapse, guarded upserts, bitemporal balances."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeops.session import checkpointed


class MergeCardinalityError(ValueError):
    """More than one change row for a key reached a merge."""


def flatten_envelope(df: DataFrame) -> DataFrame:
    """``op, ts_ms, source{lsn, ts_ms}, before, after`` to flat columns, images kept as JSON text."""
    return df.select(
        F.col("op").alias("cdc_operation"),
        F.timestamp_millis("source.ts_ms").alias("source_ts"),
        F.timestamp_millis("ts_ms").alias("arrival_ts"),
        F.col("source.lsn").alias("source_lsn"),
        F.to_json("before").alias("before"),
        F.to_json("after").alias("after"),
    )


def extract_envelope(df: DataFrame, fields: dict[str, str], keep: Sequence[str] = ()) -> DataFrame:
    """Typed fields out of the images.  A delete has no ``after``, so ``before`` supplies its key.

    ``fields`` maps a field name to its SQL type; an unreadable value becomes NULL.
    """
    cols = [F.coalesce(F.get_json_object("after", f"$.{name}"),
                       F.get_json_object("before", f"$.{name}")).try_cast(dtype).alias(name)
            for name, dtype in fields.items()]
    return df.select(*cols, *keep)


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """The newest row of every key by ``order``, never by arrival or file order.

    Spark limits each key to its first row before the shuffle already (WindowGroupLimit), so copies of
    a hot key arrive as one row per task.
    """
    newest = Window.partitionBy(*keys).orderBy(
        *[(F.col(c) if isinstance(c, str) else c).desc_nulls_last() for c in order])
    return df.withColumn("_nth", F.row_number().over(newest)).where("_nth = 1").drop("_nth")


def dedup_report(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row: rows in, rows out, collapse ratio, keys seen more than once."""
    return (df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
            .agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("rows_in"), F.count(F.lit(1)).alias("rows_out"),
                 F.count_if(F.col("_n") > 1).alias("repeated_keys"))
            .withColumn("collapse_ratio", F.round(F.try_divide("rows_out", "rows_in"), 4)))


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")


def check_cardinality(changes: DataFrame, keys: Sequence[str]) -> None:
    """Refuse a change set in which a key occurs twice, before anything is written."""
    if not duplicate_keys(changes, keys).isEmpty():
        raise MergeCardinalityError(f"the change set holds a key of {list(keys)} more than once")


def merge_cdc(target: DataFrame, changes: DataFrame, keys: Sequence[str], *, version: str,
              op: str = "op", delete_op: str = "d", update_cols: Sequence[str] | None = None,
              deleted: str | None = "is_deleted", guard_updates: bool = True,
              guard_deletes: bool = False, check: bool = True) -> DataFrame:
    """Upsert a collapsed change set; returns the new state with the target's columns.

    * matched and deleted: the row is flagged in ``deleted``, or dropped when that is None
    * matched and newer by ``version`` (any, without ``guard_updates``): ``update_cols`` and the
      version are taken over, by default all columns
    * unmatched and not deleted: inserted
    * everything else leaves the target as it was; a stale delete still wins unless ``guard_deletes``

    One full outer join, so one shuffle of each side.
    """
    if check:
        check_cardinality(changes, keys)
    rest = [c for c in target.columns if c not in keys]
    values = [c for c in rest if c != deleted]
    update = set(update_cols if update_cols is not None else values) | {version}
    t = target.select(*keys, F.struct(*[F.col(c) for c in rest]).alias("_t"))
    s = changes.select(*keys, F.struct(F.col(op).alias("_op"), *[F.col(c) for c in values]).alias("_s"))
    both = t.join(s, list(keys), "full")

    old, new = F.col("_t"), F.col("_s")
    kill = new.isNotNull() & (new["_op"] == delete_op)
    newer = new[version] > old[version]
    kills = kill & old.isNotNull() & (newer if guard_deletes else F.lit(True))
    inserts = old.isNull() & ~kill
    updates = old.isNotNull() & new.isNotNull() & ~kill & (newer if guard_updates else F.lit(True))

    keep = old.isNotNull() | inserts
    if deleted is None:
        keep = keep & ~kills
    columns = []
    for c in target.columns:
        if c in keys:
            columns.append(F.col(c))
        elif c == deleted:
            columns.append(F.when(inserts, F.lit(False)).when(kills, F.lit(True)).otherwise(old[c]).alias(c))
        else:
            take = (inserts | updates) if c in update else inserts
            columns.append(F.when(take, new[c]).otherwise(old[c]).cast(target.schema[c].dataType).alias(c))
    return both.where(F.coalesce(keep, F.lit(False))).select(*columns)


def merge_touched(target: DataFrame, changes: DataFrame, keys: Sequence[str], part: str,
                  **options) -> tuple[DataFrame, DataFrame]:
    """``merge_cdc`` on the partitions a batch touches: the ones it writes to and the ones its keys
    live in now, so a correction that moves a row's date cannot leave a second copy behind.

    Returns the new rows of those partitions and the list of partitions to replace.
    """
    lands = changes.select(part).distinct()
    lives = target.join(changes.select(*keys).distinct(), list(keys), "left_semi").select(part).distinct()
    touched = lands.union(lives).distinct()
    affected = target.join(touched, part, "left_semi")
    return merge_cdc(affected, changes, keys, **options), touched


def run_slices(target: DataFrame, slices: Iterable[str], changes_of: Callable[[str], DataFrame],
               keys: Sequence[str], order: Sequence[str], checkpoint_every: int = 5, **options) -> DataFrame:
    """Collapse and merge one slice after the other; each slice builds on the state before it."""
    state = target
    for i, name in enumerate(slices, 1):
        staged = latest_per_key(changes_of(name), keys, order)
        state = merge_cdc(state, staged, keys, check=False, **options)
        if i % checkpoint_every == 0:
            state = checkpointed(state)
    return state


def fold_slices(changes: DataFrame, keys: Sequence[str], slice_col: str, order: Sequence[str], *, version: str,
                op: str = "op", delete_op: str = "d", update_cols: Sequence[str] | None = None, deleted: str | None = "is_deleted",
                guard_updates: bool = True, guard_deletes: bool = False, target: DataFrame | None = None) -> DataFrame:
    """The state that :func:`run_slices` reaches, from one pass over the log instead of one scan and merge per slice.

    The newest change of every key and slice is found first, so a hot key is reduced before it shuffles; what is left of a
    key, one change per slice, is put in order and folded by the rules of :func:`merge_cdc`. ``target`` is the state to
    begin with (its columns: keys, values and ``deleted``). A key's changes must fit a row: one for each slice. A NULL
    slice comes first, and as in a merge a NULL key is a key of its own in each change.
    """
    values = [c for c in changes.columns if c not in (*keys, slice_col, op)]
    update = set(update_cols if update_cols is not None else values) | {version}
    types = {f.name: f.dataType.simpleString() for f in changes.schema.fields}
    state = "struct<" + ",".join([*(f"`{c}`:{types[c]}" for c in values), "_gone:boolean"]) + ">"
    newest = latest_per_key(changes, [*keys, slice_col], order)
    known = reduce(and_, [F.col(k).isNotNull() for k in keys])
    listed = (newest.groupBy(*keys, F.when(~known, F.col(slice_col)).alias("_apart"))
              .agg(F.array_sort(F.collect_list(F.struct(F.col(slice_col).alias("_slice"), F.col(op).alias("_op"), *values))).alias("_changes")))
    if target is None:
        listed = listed.withColumn("_start", F.lit(None).cast(state))
    else:
        gone = F.coalesce(F.col(deleted), F.lit(False)) if deleted else F.lit(False)
        held = target.select(*keys, F.struct(*values, gone.alias("_gone")).cast(state).alias("_start"))
        listed = held.join(listed, list(keys), "full").withColumn("_changes", F.coalesce("_changes", F.array().cast(listed.schema["_changes"].dataType)))

    def step(old: Column, new: Column) -> Column:
        kill = F.coalesce(new["_op"] == delete_op, F.lit(False))
        newer = F.coalesce(new[version] > old[version], F.lit(False))
        taken = F.struct(*[(new[c] if c in update else old[c]).alias(c) for c in values], old["_gone"].alias("_gone"))
        flagged = F.struct(*[old[c].alias(c) for c in values], F.lit(True).alias("_gone")) if deleted else F.lit(None).cast(state)
        born = F.struct(*[new[c].alias(c) for c in values], F.lit(False).alias("_gone"))
        return (F.when(old.isNull(), F.when(~kill, born))
                .when(kill & (newer if guard_deletes else F.lit(True)), flagged)
                .when(~kill & (newer if guard_updates else F.lit(True)), taken).otherwise(old)).cast(state)

    folded = listed.select(*keys, F.aggregate("_changes", F.col("_start"), step).alias("_end")).where(F.col("_end").isNotNull())
    return folded.select(*keys, *[F.col("_end")[c].alias(c) for c in values], *([F.col("_end._gone").alias(deleted)] if deleted else []))


def late_window(df: DataFrame, ts: str, run_date: str, hours: int) -> DataFrame:
    """Rows of the run day plus everything that may still arrive late for it."""
    end = F.date_add(F.lit(run_date).cast("date"), 1).cast("timestamp")
    start = end - F.make_dt_interval(F.lit(0), F.lit(hours + 24))
    return df.where(F.col(ts).between(start, end))


def as_known_vs_restated(changes: DataFrame, keys: Sequence[str], order: Sequence[str], *, account: str,
                         amount: Column, event_ts: str, arrival_ts: str, op: str, known_at: Column,
                         cutoff: Column, delete_op: str = "d") -> DataFrame:
    """Balance per account as known at ``known_at`` beside the balance with everything since.

    Both states come out of one pass over the change log: the newest change per key among those
    that had arrived, and the newest among all.
    """
    row = F.struct(F.col(account).alias("account"), amount.alias("amount"),
                   F.col(event_ts).alias("event_ts"), F.col(op).alias("op"))
    at = F.struct(*order)
    states = changes.groupBy(*keys).agg(
        F.max_by(row, F.when(F.col(arrival_ts) <= known_at, at)).alias("known"),
        F.max_by(row, at).alias("restated"))
    stacked = states.select(F.explode(F.array(
        F.struct(F.lit("known").alias("state"), F.col("known").alias("r")),
        F.struct(F.lit("restated").alias("state"), F.col("restated").alias("r")))).alias("s"))
    live = stacked.select("s.state", "s.r.*").where(
        (F.col("op") != delete_op) & (F.col("event_ts") <= cutoff))
    balance = lambda state: F.coalesce(F.sum(F.when(F.col("state") == state, F.col("amount"))), F.lit(0))
    return (live.groupBy(F.col("account").alias(account))
            .agg(balance("known").alias("balance_as_known"), balance("restated").alias("balance_as_restated"))
            .withColumn("delta", F.col("balance_as_restated") - F.col("balance_as_known")))
