"""Versions, slices, layout and dialects on disk."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from lakeops.operators import layout, quality, versions
from lakeops.session import materialised, shared_dir
from lakeops.sources import dialects, tables
from tests.conftest import rows

AT = dt.datetime(2024, 5, 1, 12)


def hours(n):
    return AT + dt.timedelta(hours=n)


@pytest.fixture()
def table(spark, tmp_path):
    return versions.VersionedTable(spark, str(tmp_path / "t"))


@pytest.fixture()
def three(spark, table):
    for i in range(3):
        table.publish(spark.range(i * 80, (i + 1) * 80), "append", hours(i))
    return table


def test_time_travel_is_strictly_older(three):
    assert three.read().count() == 240 and three.read(version=1).count() == 80
    assert three.read(timestamp=hours(2)).count() == 160
    assert three.read(timestamp=hours(2) + dt.timedelta(seconds=1)).count() == 240
    with pytest.raises(versions.VersionError):
        three.read(timestamp=hours(0))


def test_rollback_and_forward(three):
    three.set_current(1, hours(5))
    assert three.read().count() == 80
    assert three.history().where("is_current_ancestor").count() == 1
    three.set_current(3, hours(6))
    assert three.read().count() == 240 and three.history().where("is_current_ancestor").count() == 3


def test_tag_does_not_move(spark, three):
    three.tag("close", 2, hours(4), keep_days=30)
    three.publish(spark.range(5), "overwrite", hours(5))
    assert three.read(tag="close").count() == 160 and three.read().count() == 5
    with pytest.raises(versions.VersionError):
        three.read(tag="nope")


def test_write_audit_publish(spark, three):
    audit = lambda df: quality.check_columns(df, {"id": {"unique_check": {"equal_to": 0}}})
    ok, report = three.write_audit_publish(spark.range(4), hours(3), audit)
    assert not ok and three.read().count() == 240 and not report.first()["passed"]
    ok, _ = three.write_audit_publish(spark.range(1000, 1002), hours(4), audit)
    assert ok and three.read().count() == 242
    assert three.refs().where("name = 'audit'").isEmpty()


def test_expire_keeps_tagged_and_shared_directories(spark, three):
    three.tag("keep", 1, hours(3))
    assert three.expire(older_than=hours(10), retain_last=1, at=hours(11)) == [2]
    assert three.read().count() == 240 and three.read(tag="keep").count() == 80
    with pytest.raises(versions.VersionError):
        three.read(version=2)
    three.publish(spark.range(3), "overwrite", hours(12))
    gone = three.expire(older_than=hours(100), retain_last=1, at=hours(101))
    assert gone == [3] and three.read(tag="keep").count() == 80


def test_unreferenced_is_a_report_with_a_floor(spark, three):
    spark.range(2).write.parquet(f"{three.path}/data/v=99")
    later = dt.datetime.now() + dt.timedelta(days=3)
    with pytest.raises(versions.VersionError):
        three.unreferenced(later - dt.timedelta(hours=1), later)
    assert [p.rsplit("/", 1)[1] for p in three.unreferenced(later - dt.timedelta(days=2), later)] == ["v=99"]


def test_two_handles_share_the_log(spark, three):
    other = versions.VersionedTable(spark, three.path)
    other.publish(spark.range(1), "append", hours(9))
    three.refresh()
    assert three.current() == 4


def test_update_delete_and_diff(spark, table):
    table.publish(spark.sql("SELECT * FROM VALUES (1, 'a'), (2, 'b'), (3, null) AS (id, v)"), "append", hours(0))
    table.update_where("v = 'a'", {"v": F.lit("z")}, hours(1))
    table.delete_where("v = 'b'", hours(2))
    assert rows(table.read()) == [(1, "z"), (3, None)]
    d = versions.diff_versions(table.read(version=1), table.read(), ["id"]).first()
    assert (d.added, d.deleted, d.changed, d.unchanged) == (0, 1, 1, 1)


def test_evolution_refuses_narrowing(spark):
    df = spark.sql("SELECT 1 AS a, cast(1.5 as decimal(10,2)) AS d, 'x' AS old")
    out = versions.evolve(df, rename={"old": "new"}, add={"extra": "string"}, widen={"a": "bigint", "d": "decimal(12,2)"})
    assert dict(out.dtypes) == {"a": "bigint", "d": "decimal(12,2)", "new": "string", "extra": "string"}
    with pytest.raises(versions.VersionError):
        versions.evolve(spark.sql("SELECT 1L AS a"), widen={"a": "int"})
    assert not versions.can_widen("decimal(10,2)", "decimal(12,3)")


def test_slices_not_written_survive(spark, tmp_path):
    path = str(tmp_path / "s")
    df = spark.createDataFrame([("x", 1, "d1"), ("y", 2, "d2")], "p string, v int, d string")
    tables.overwrite_slices(df, path, ["p", "d"])
    for _ in range(2):
        tables.overwrite_slices(spark.createDataFrame([("x", 9, "d1")], df.schema), path, ["p", "d"])
    assert rows(spark.read.parquet(path).select("p", "v")) == [("x", 9), ("y", 2)]


def test_materialised_keeps_schema_and_rows(spark):
    df = spark.sql("SELECT 1 AS a, 'x' AS b, cast(2.50 as decimal(10,2)) AS c")
    assert materialised(df).dtypes == df.dtypes and rows(materialised(df)) == rows(df)
    assert shared_dir(spark)


def test_bucketed_join_needs_equal_counts(spark, tmp_path):
    a, b = spark.range(1000), spark.range(0, 1000, 3)
    for name, df, n in (("bk_a", a, 8), ("bk_b", b, 8), ("bk_c", b, 4)):
        layout.write_bucketed(df, name, str(tmp_path / name), n, ["id"])
    same = spark.table("bk_a").hint("merge").join(spark.table("bk_b"), "id")
    other = spark.table("bk_a").hint("merge").join(spark.table("bk_c"), "id")
    assert layout.count_exchanges(same) == 0 and layout.count_exchanges(other) == 1
    assert same.count() == other.count() == 334
    for name in ("bk_a", "bk_b", "bk_c"):
        spark.sql(f"DROP TABLE {name}")


def test_compaction_keeps_rows(spark, tmp_path):
    src = str(tmp_path / "src")
    df = spark.range(5000).select("id", (F.col("id") % 7).alias("k"), F.when(F.col("id") < 4500, "hot").otherwise("cold").alias("p"))
    df.repartition(20).write.partitionBy("p").parquet(src)
    before = quality.fingerprint(spark.read.parquet(src).select("id", "k", "p")).first()
    for name, run in {"bin": lambda o: layout.compact(spark, src, o, 1 << 20, ["p"]), "sort": lambda o: layout.compact_sorted(spark, src, o, 8 << 10, ["id"]),
                      "z": lambda o: layout.compact_zorder(spark, src, o, 8 << 10, ["id", "k"], bits=4)}.items():
        out = str(tmp_path / name)
        run(out)
        assert quality.fingerprint(spark.read.parquet(out).select("id", "k", "p")).first() == before
        assert layout.file_stats(spark, out).first().files < layout.file_stats(spark, src).first().files
    pruned = layout.prunable(spark, str(tmp_path / "sort"), "id", 10, 20).first()
    assert pruned.can_match == 1 < pruned.files


def test_unknown_dialect_raises(spark):
    with pytest.raises(ValueError):
        dialects.read_partner(spark, "fax", "/nowhere", "P", "EUR", "2024-01-01")


def test_minutes_become_seconds_and_bad_values_null(spark, tmp_path):
    path = tmp_path / "v2.csv"
    path.write_text("calling_msisdn,called_msisdn,start_time,duration_minutes,billed_units,net_amount\n1,2,2024-01-01T10:00:00,1.5,2,0.12345\n3,4,never,x,1,1\n")
    got = dialects.read_partner(spark, "csv_v2", str(path), "P", "EUR", "2024-01-01").orderBy("a_number").collect()
    assert got[0].duration_sec == 90 and float(got[0].charge_amount) == 0.12345
    assert got[1].event_ts is None and got[1].duration_sec is None
    with pytest.raises(quality.QualityError):
        quality.assert_parse_rate(dialects.read_minutes_csv(spark, str(path)), ["event_ts"])


def test_fixed_width_has_five_implied_decimals(spark, tmp_path):
    path = tmp_path / "fixed.txt"
    path.write_text("4411           4422           20240101100000000000900000000200000001234567\n"[:0]
                    + "4411".ljust(15) + "4422".ljust(15) + "20240101100000" + "00000090" + "00000002" + "000000001234567" + "\n")
    got = dialects.read_fixed_width(spark, str(path)).first()
    assert (got.a_number, got.duration_sec, got.charged_units, float(got.charge_amount)) == ("4411", 90, 2, 12.34567)
    assert got.event_ts == dt.datetime(2024, 1, 1, 10)


def test_compaction_gives_every_file_a_task_of_its_own(spark, tmp_path):
    """NULL partitions too; tasks that held two files grew with the table's largest partitions."""
    src, out = str(tmp_path / "in"), tmp_path / "out"
    spark.range(20_000).select("id", F.when(F.col("id") % 9 > 0, F.col("id") % 9).alias("p")).repartition(3).write.partitionBy("p").parquet(src)
    target = 4_000
    wanted = sum(r["_files"] for r in layout._files_wanted(spark, src, target, ["p"]).collect())
    layout.compact(spark, src, str(out), target, ["p"])
    files = [f.name for f in out.rglob("part-*.parquet")]
    assert len(files) == len({f[:10] for f in files}) == wanted > 9
    assert rows(spark.read.parquet(str(out)).select("id", "p")) == rows(spark.read.parquet(src).select("id", "p"))


def test_model_sets_are_written_from_one_wide_table(spark, tmp_path, monkeypatch):
    from lakeops.operators import features
    made = []
    monkeypatch.setattr(features, "materialised", lambda df, label: made.append(label) or materialised(df, label))
    wide = spark.range(50).select("id", (F.col("id") % 2).alias("y"), (F.col("id") > 4).alias("known"), F.lit(None).cast("int").alias("x"), F.lit("unused").alias("z"))
    paths = features.write_model_sets(wide, "id", "y", "known", ["x"], str(tmp_path))
    n = {name: spark.read.schema("a double, x double").csv(p).count() for name, p in paths.items()}
    assert made == ["wide"] and n["inference"] == 50 and n["train"] + n["validation"] == 45
