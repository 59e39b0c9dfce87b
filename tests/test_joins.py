import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from lakeops.operators import joins
from tests.conftest import rows

START = dt.datetime(2024, 1, 1)


def at(hours):
    return START + dt.timedelta(hours=hours)


@pytest.fixture(scope="module")
def skewed(spark):
    rnd = random.Random(3)
    left = spark.createDataFrame([(0 if i % 3 else rnd.randint(1, 30), i) for i in range(600)], "k int, id int")
    right = spark.createDataFrame([(k, n) for k in range(0, 40) for n in range(2)], "k int, n int")
    return left, right


@pytest.mark.parametrize("bound", [{"threshold": 50}, {"share": 0.05}])
@pytest.mark.parametrize("how", ["inner", "left", "full"])
def test_salted_join_equals_plain_join(skewed, how, bound):
    left, right = skewed
    got = joins.salted_join(left, right, ["k"], how, salts=4, **bound).select("k", "id", "n")
    assert rows(got) == rows(left.join(right, "k", how).select("k", "id", "n"))


def test_salted_join_refuses_other_joins(skewed):
    with pytest.raises(ValueError):
        joins.salted_join(*skewed, ["k"], "right")


@pytest.fixture(scope="module")
def history(spark):
    points = spark.createDataFrame(
        [("a", at(h / 2), i) for i, h in enumerate(range(-3, 60))] + [("b", at(5), 900), ("c", at(1), 901)],
        "k string, ts timestamp, id int")
    intervals = spark.createDataFrame([
        ("a", at(0), at(1), 10.0), ("a", at(1), at(1.5), 11.0), ("a", at(1.5), at(20), 12.0), ("a", at(20), None, 13.0),
        ("b", at(5), None, 20.0), ("b", at(2), at(5), 21.0)], "k string, start timestamp, end timestamp, price double")
    return points, intervals


@pytest.mark.parametrize("grid", [900, 3600, 86_400])
def test_grid_range_join_equals_plain_range_join(history, grid):
    points, intervals = history
    want = joins.range_join(points, intervals, ["k"], "ts", "start", "end").select("id", "price")
    got = joins.range_join_grid(points, intervals, ["k"], "ts", "start", "end", grid).select("id", "price")
    assert rows(got) == rows(want)
    assert got.groupBy("id").count().where("count > 1").isEmpty()


def overlapping(spark, seed):
    """Points and intervals of two hot keys: overlapping, nested, empty, open and without a start."""
    rnd = random.Random(seed)
    pts = [(i, rnd.choice(["a", "a", "b", None, "z"]), None if i % 40 == 0 else at(rnd.uniform(0, 5000))) for i in range(400)]
    ivs = []
    for i in range(90):
        s = rnd.uniform(-100, 5000)
        e = None if i % 30 == 0 else at(s + rnd.choice([0, -5, 3, 40, 40, 2000]))
        ivs.append((rnd.choice(["a", "a", "b", None, "q"]), None if i % 45 == 1 else at(s), e, float(i)))
    return (spark.createDataFrame(pts, "id int, k string, ts timestamp"), spark.createDataFrame(ivs, "k string, start timestamp, end timestamp, price double"),
            [(p[0], i[3]) for p in pts for i in ivs if p[1] is not None and p[1] == i[0] and p[2] is not None and i[1] is not None and i[1] <= p[2] and (i[2] is None or p[2] < i[2])])


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_range_joins_hold_against_all_pairs(spark, seed):
    points, intervals, want = overlapping(spark, seed)
    pairs = lambda df: sorted((r.id, r.price) for r in df.collect())
    assert want and pairs(joins.range_join(points, intervals, ["k"], "ts", "start", "end").select("id", "price")) == sorted(want)
    assert pairs(joins.range_join_search(points, intervals, ["k"], "ts", "start", "end", ["price"])) == sorted(want)
    alone = sorted(set(range(400)) - {i for i, _ in want})
    for left in (joins.range_join_search(points, intervals, ["k"], "ts", "start", "end", ["price"], "left"),
                 joins.range_join(points, intervals, ["k"], "ts", "start", "end", "left")):
        got = left.select("id", "price").collect()
        assert sorted((r.id, r.price) for r in got if r.price is not None) == sorted(want) and sorted(r.id for r in got if r.price is None) == alone
    for empty in (joins.range_join(points.limit(0), intervals, ["k"], "ts", "start", "end"), joins.range_join_search(points, intervals.limit(0), ["k"], "ts", "start", "end")):
        assert empty.isEmpty()


def test_search_joins_without_pairing(spark):
    points, intervals, _ = overlapping(spark, 1)
    from lakeops.operators.layout import plan_text
    plan = plan_text(joins.range_join_search(points, intervals, ["k"], "ts", "start", "end", ["price"]))
    assert "NestedLoop" not in plan and "Cartesian" not in plan and "Join [k" in plan.replace("HashJoin", "Join").replace("SortMergeJoin", "Join")
    assert "start#" not in "".join(x for x in plan.splitlines() if "Join" in x)  # the range is no part of the join


def test_binary_search(spark):
    from lakeops.functions.columns import count_upto
    from lakeops.operators.layout import plan_text
    df = spark.range(-1, 12).select("id", F.array(*[F.lit(v) for v in (1, 3, 3, 7, 9)]).cast("array<bigint>").alias("a"))
    got = df.select("id", count_upto("a", F.col("id")).alias("upto"), count_upto("a", F.col("id"), inclusive=False).alias("below")).collect()
    assert all(r.upto == sum(v <= r.id for v in (1, 3, 3, 7, 9)) and r.below == sum(v < r.id for v in (1, 3, 3, 7, 9)) for r in got)


def test_asof_join_takes_the_newest_at_or_before(history):
    points, intervals = history
    got = {r.id: r.price for r in joins.asof_join(points, intervals, ["k"], "ts", "start", ["price"]).collect()}
    assert got[0] is None and got[901] is None
    assert got[900] == 20.0  # a change at the point's own time counts
    left = points.collect()
    right = intervals.collect()
    for p in left:
        cand = [(i.start, i.price) for i in right if i.k == p.k and i.start <= p.ts]
        assert got[p.id] == (max(cand)[1] if cand else None)


@pytest.mark.parametrize("seconds", [3600, 86_400 * 365])
def test_asof_join_null_keys_match_nothing(spark, seconds):
    left = spark.createDataFrame([(1, None, at(5)), (2, "a", at(5))], "id int, k string, ts timestamp")
    right = spark.createDataFrame([(None, at(4), 5.0), ("a", at(1), 7.0)], "k string, start timestamp, price double")
    got = {r.id: r.price for r in joins.asof_join(left, right, ["k"], "ts", "start", ["price"], slice_seconds=seconds).collect()}
    assert got == {1: None, 2: 7.0}


def test_spread_join_equals_plain_join(skewed):
    left, right = skewed
    for how in ("inner", "left"):
        assert rows(joins.spread_join(left, right, ["k"], how).select("k", *[c for c in left.columns if c != "k"])) == rows(
            left.join(right, ["k"], how).select("k", *[c for c in left.columns if c != "k"]))
    with pytest.raises(ValueError, match="full"):
        joins.spread_join(left, right, ["k"], "full")


def test_asof_join_tolerance(history):
    points, intervals = history
    got = {r.id: r.price for r in joins.asof_join(points, intervals, ["k"], "ts", "start", ["price"], tolerance_seconds=3600).collect()}
    late = [p.id for p in points.collect() if p.k == "a" and p.ts > at(21)]
    assert late and all(got[i] is None for i in late)


def test_near_events_window_is_half_open(spark):
    events = spark.createDataFrame([("a", at(h), i) for i, h in enumerate([-1, 0, 1.999, 2])], "k string, ts timestamp, id int")
    anchors = spark.createDataFrame([("a", at(0))], "k string, anchor timestamp")
    assert [r.id for r in joins.near_events(events, anchors, ["k"], "ts", "anchor", 0, 7200).orderBy("id").collect()] == [1, 2]
    assert [r.id for r in joins.near_events(events, anchors, ["k"], "ts", "anchor", 3600, 0).orderBy("id").collect()] == [0]


def test_scd2_as_of(spark):
    df = spark.sql("""SELECT * FROM VALUES (1, date'2024-01-01', date'2024-02-01'), (2, date'2024-02-01', null), (3, date'2024-03-01', null)
                      AS (id, valid_from, valid_to)""")
    assert [r.id for r in joins.scd2_as_of(df, "2024-02-01").collect()] == [2]
    assert [r.id for r in joins.scd2_as_of(df, "2024-01-31").collect()] == [1]


def test_no_nested_loops(history):
    points, intervals = history
    from lakeops.operators.layout import plan_text
    plan = plan_text(joins.range_join_grid(points, intervals, ["k"], "ts", "start", "end", 3600))
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_copies_of_one_row_spread(spark):
    copies = spark.range(0, 400, 1, 16).select(F.lit(1).alias("k"))
    from lakeops.functions.columns import stable_salt
    assert copies.select(stable_salt(["k"], 8).alias("s")).distinct().count() > 3


def test_a_search_halves_an_array_as_often_as_its_size_needs(spark):
    from lakeops.functions.columns import count_upto
    from lakeops.operators.layout import plan_text
    df = spark.createDataFrame([(list(range(n)), x) for n in (0, 1, 2, 3, 7, 8, 9, 40) for x in (-1, 0, 1, 6, 8, 39, 50)] + [(None, 1)], "a array<int>, x int")
    got = df.select("a", "x", count_upto("a", F.col("x")).alias("le"), count_upto("a", F.col("x"), inclusive=False).alias("lt"))
    for r in got.where("a is not null").collect():
        assert (r.le, r.lt) == (sum(v <= r.x for v in r.a), sum(v < r.x for v in r.a))
    assert "sequence(1, 31" not in plan_text(got) and "[1,2,3,4,5,6,7,8,9,10,11,12," not in plan_text(got).replace(" ", "")
