import datetime as dt

from pyspark.sql import functions as F

from lakeops.operators import versions
from lakeops.streaming import feeds
from tests.conftest import rows

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "id int, k string, ts timestamp, v int, op string"


def feed(spark, tmp_path, *batches):
    """One file per batch, read one file per micro-batch in that order."""
    root = tmp_path / "in"
    for i, batch in enumerate(batches):
        data = [(a, k, T0 + dt.timedelta(hours=h), v, op) for a, k, h, v, op in batch]
        out = root / "feed.parquet" / f"b{i}"
        spark.createDataFrame(data, SCHEMA).coalesce(1).write.parquet(str(out))
        for f in out.glob("part-*.parquet"):
            f.rename(root / "feed.parquet" / f"{i:03d}.parquet")
            import os
            os.utime(root / "feed.parquet" / f"{i:03d}.parquet", (1_700_000_000 + i, 1_700_000_000 + i))
        for f in out.iterdir():
            f.unlink()
        out.rmdir()
    return feeds.read_table_stream(spark, str(root), "feed", files_per_batch=1)


def test_rows_later_than_the_watermark_are_dropped(spark, tmp_path):
    stream = feed(spark, tmp_path, [(1, "a", 0, 1, "u")], [(2, "a", 20, 1, "u")], [(3, "a", 30, 1, "u")],
                  [(4, "a", 1, 100, "u"), (5, "a", 27, 10, "u")], [(6, "a", 60, 1, "u")])
    got = feeds.run_to_end(feeds.tumbling(stream, "ts", ["k"], "1 hour", {"s": F.sum("v")}), "late")
    by_hour = {int((r.window_start - T0).total_seconds() // 3600): r.s for r in got.collect()}
    assert by_hour == {0: 1, 20: 1, 27: 10, 30: 1}


def test_replays_come_out_once(spark, tmp_path):
    stream = feed(spark, tmp_path, [(1, "a", 0, 1, "u"), (2, "a", 1, 1, "u")], [(2, "a", 1, 1, "u"), (3, "a", 2, 1, "u")])
    got = feeds.run_to_end(feeds.without_replays(stream, ["id"], "ts"), "replay")
    assert sorted(r.id for r in got.collect()) == [1, 2, 3]


def test_upserts_by_batch_equal_the_final_state_and_apply_once(spark, tmp_path):
    stream = feed(spark, tmp_path, [(1, "a", 0, 1, "u"), (2, "b", 0, 2, "u"), (3, "a", 1, 3, "u")], [(4, "b", 2, 2, "d"), (5, "c", 2, 9, "u")], [(6, "a", 0.5, 77, "u")])
    table = versions.VersionedTable(spark, str(tmp_path / "state"))
    apply = feeds.upsert_batches(table, ["k"], ["ts", "id"], "ts", "op", lambda i: T0 + dt.timedelta(days=i))
    feeds.run_upserts(stream, apply)
    table.refresh()
    want = [("a", 3, False), ("b", 2, True), ("c", 9, False)]
    assert rows(table.read().select("k", "v", "is_deleted")) == want
    versions_before = table.history().count()
    apply(spark.createDataFrame([(9, "z", T0, 1, "u")], SCHEMA), 0)
    assert table.history().count() == versions_before == 3


def test_sliding_sums_are_the_windows_of_tumbling(spark, tmp_path):
    """Also for empty sums, equal times, the bounds of blocks and a second batch; the state holds two rows an event."""
    minutes = [0, 0, 1, 14, 14.5, 15, 29, 29.99, 30, 44, 700, 701, -3]
    data = [(i, "ab"[i % 2] if i % 5 else None, m / 60, None if i % 4 == 1 else i + 1, "u") for i, m in enumerate(minutes)]
    stream = lambda n: feed(spark, tmp_path / n, data[:7], data[7:])
    want = feeds.run_closed(stream("a"), "ts", lambda s: feeds.tumbling(s, "ts", ["k"], "15 minutes", {"s": F.sum("v")}, slide="1 minute"), "plain")
    got = feeds.run_closed(stream("b"), "ts", lambda s: feeds.sliding_sums(s, "ts", ["k"], 900, 60, {"s": F.col("v")}), "blocks")
    assert got.schema.names == want.schema.names and [f.dataType for f in got.schema] == [f.dataType for f in want.schema]
    assert rows(got) == rows(want) and len(rows(got)) > 100


def test_sliding_sums_hold_two_rows_an_event(spark, tmp_path):
    stream = feed(spark, tmp_path, [(i, "a", i, 1, "u") for i in range(20)])
    built = feeds.sliding_sums(stream, "ts", ["k"], 900, 60, {"s": F.col("v")}, late="9 days")
    query = feeds._run(built, str(tmp_path / "out"), str(tmp_path / "progress"))
    assert max(p.stateOperators[0].numRowsTotal for p in query.recentProgress) == 40
