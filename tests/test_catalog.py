"""Every registered query against its SQL in DuckDB, and what its plan must not contain."""

import duckdb
import pytest

import __spark_entry__ as entry_point
from lakeops.operators.layout import plan_text
from pyspark.sql import Window
from pyspark.sql import functions as F

from scripts.check_oracles import TABLES, rows_of
from tests.plan_guard import Guard

#: Rows that may meet in one task, in any plan a query runs: totals, one row a slice, a day or a range.
SINGLE = 600

QUERIES, ORACLES = entry_point.queries(), entry_point.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, sf, name):
    guard = Guard(spark)
    df = QUERIES[name](spark, sf)
    plan = plan_text(df)
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    got = [tuple(r) for r in df.collect()]
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    for run in guard.fresh():
        # A compaction that packs a small table into one file says so by its number of files, which follows the bytes.
        assert [x for x in guard.single_partition_rows(run) if x[1] > SINGLE and "REPARTITION_BY_NUM" not in x[0]] == []
        assert guard.windows_over_joins(run) == []
    if name in ORACLES:
        res = duck.execute(ORACLES[name])
        cols = [d[0] for d in res.description]
        assert sorted(cols) == sorted(df.columns)
        assert rows_of(df.columns, got) == rows_of(cols, res.fetchall())
    else:
        assert got


def test_entry(spark):
    assert entry_point.entry(spark).count() > 0


def test_the_guard_sees_eager_plans_too(spark, tmp_path):
    spark.range(2000).withColumn("k", F.col("id") % 10).write.parquet(str(tmp_path / "rows"))
    df = spark.read.parquet(str(tmp_path / "rows"))
    guard = Guard(spark)
    df.withColumn("n", F.row_number().over(Window.orderBy("id"))).write.parquet(str(tmp_path / "numbered"))
    joined = df.hint("merge").join(df.select("k", F.col("id").alias("other")).where("other < 10"), "k")
    joined.withColumn("n", F.row_number().over(Window.partitionBy("k").orderBy("id"))).write.parquet(str(tmp_path / "windowed"))
    df.agg(F.sum("id")).collect()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    runs = guard.fresh()
    assert [n for r in runs for _, n in guard.single_partition_rows(r) if n > SINGLE] == [2000]
    assert len([w for r in runs for w in guard.windows_over_joins(r)]) == 1
