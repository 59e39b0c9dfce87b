import datetime as dt

import pytest
from pyspark.sql import functions as F

from lakeops.operators import cdc
from lakeops.plans import ledger
from tests.conftest import rows

T = dt.datetime(2024, 1, 10)
STATE = "id string, amount decimal(18,2), status string, ts timestamp, is_deleted boolean"
CHANGE = "id string, amount decimal(18,2), status string, ts timestamp, op string"


def day(n):
    return T + dt.timedelta(days=n)


@pytest.fixture()
def target(spark):
    return spark.sql("""SELECT * FROM VALUES ('a', 1.00, 'new', timestamp'2024-01-10', false), ('b', 2.00, 'new', timestamp'2024-01-10', false),
                        ('c', 3.00, 'new', timestamp'2024-01-10', true) AS (id, amount, status, ts, is_deleted)""").select(
        "id", F.col("amount").cast("decimal(18,2)").alias("amount"), "status", "ts", "is_deleted")


def changes(spark, *entries):
    from decimal import Decimal
    return spark.createDataFrame([(i, Decimal(a), s, t, o) for i, a, s, t, o in entries], CHANGE)


def merged(target, ch, **kw):
    return {r.id: (float(r.amount), r.status, r.is_deleted) for r in cdc.merge_cdc(target, ch, ["id"], version="ts", **kw).collect()}


def test_soft_merge_branches(spark, target):
    ch = changes(spark, ("a", "9", "paid", day(1), "u"), ("b", "9", "gone", day(1), "d"), ("x", "5", "new", day(1), "c"), ("y", "6", "new", day(1), "d"))
    assert merged(target, ch) == {"a": (9.0, "paid", False), "b": (2.0, "new", True), "c": (3.0, "new", True), "x": (5.0, "new", False)}


def test_late_update_changes_nothing(spark, target):
    assert merged(target, changes(spark, ("a", "9", "old", day(-1), "u")))["a"] == (1.0, "new", False)


def test_stale_delete_wins_unless_guarded(spark, target):
    ch = changes(spark, ("a", "9", "old", day(-1), "d"))
    assert merged(target, ch)["a"][2] is True
    assert merged(target, ch, guard_deletes=True)["a"][2] is False


def test_update_leaves_the_deleted_flag(spark, target):
    assert merged(target, changes(spark, ("c", "9", "back", day(1), "u")))["c"] == (9.0, "back", True)


def test_update_columns_are_limited(spark, target):
    got = merged(target, changes(spark, ("a", "9", "paid", day(1), "u")), update_cols=["status"])
    assert got["a"] == (1.0, "paid", False)


def test_hard_delete(spark, target):
    hard = target.drop("is_deleted")
    ch = changes(spark, ("a", "9", "x", day(1), "d"), ("b", "9", "paid", day(1), "u"), ("z", "1", "new", day(1), "d"))
    got = cdc.merge_cdc(hard, ch, ["id"], version="ts", deleted=None)
    assert [r.id for r in got.orderBy("id").collect()] == ["b", "c"]


def test_two_changes_for_a_key_are_refused(spark, target):
    ch = changes(spark, ("a", "9", "x", day(1), "u"), ("a", "8", "y", day(2), "u"))
    with pytest.raises(cdc.MergeCardinalityError):
        cdc.merge_cdc(target, ch, ["id"], version="ts")
    assert target.count() == 3


def test_merge_twice_is_merge_once(spark, target):
    ch = changes(spark, ("a", "9", "paid", day(1), "u"), ("x", "5", "new", day(1), "c"))
    once = cdc.merge_cdc(target, ch, ["id"], version="ts")
    assert rows(once) == rows(cdc.merge_cdc(once, ch, ["id"], version="ts"))


def test_latest_wins_over_arrival_order(spark):
    df = spark.createDataFrame([("k", 2, 9, "new"), ("k", 1, 10, "old"), ("k", 2, 8, "tie"), (None, 1, 1, "nokey")], "id string, ts int, lsn int, v string")
    got = {r.id: r.v for r in cdc.latest_per_key(df, ["id"], ["ts", "lsn"]).collect()}
    assert got == {"k": "new", None: "nokey"}
    again = cdc.latest_per_key(cdc.latest_per_key(df, ["id"], ["ts", "lsn"]), ["id"], ["ts", "lsn"])
    assert again.count() == 2
    report = cdc.dedup_report(df, ["id"]).first()
    assert (report.rows_in, report.rows_out, report.repeated_keys, report.collapse_ratio) == (4, 2, 1, 0.5)


def test_delete_envelope_takes_its_key_from_before(spark):
    df = spark.read.json(spark.sparkContext.parallelize([
        '{"op":"c","ts_ms":1700000000123,"source":{"table":"t","lsn":1,"ts_ms":1700000000000},"before":null,"after":{"transaction_id":"a","amount":1.5,"status":"N"}}',
        '{"op":"d","ts_ms":1700000001000,"source":{"table":"t","lsn":2,"ts_ms":1700000000500},"before":{"transaction_id":"a","amount":1.5,"status":"N"},"after":null}']))
    flat = cdc.flatten_envelope(df)
    got = cdc.extract_envelope(flat, {"transaction_id": "string", "amount": "decimal(18,2)"}, ["cdc_operation", "source_lsn"]).orderBy("source_lsn").collect()
    assert [r.transaction_id for r in got] == ["a", "a"] and [r.cdc_operation for r in got] == ["c", "d"]


def test_moved_date_leaves_no_second_copy(spark):
    target = spark.createDataFrame([("a", 1, day(0), "2024-01"), ("b", 2, day(0), "2024-02"), ("c", 3, day(0), "2024-03")], "id string, v int, ts timestamp, part string")
    ch = spark.createDataFrame([("a", 9, day(1), "2024-02", "u")], "id string, v int, ts timestamp, part string, op string")
    got, touched = cdc.merge_touched(target, ch, ["id"], "part", version="ts", deleted=None)
    assert sorted(r.part for r in touched.collect()) == ["2024-01", "2024-02"]
    assert rows(got.select("id", "v", "part")) == [("a", 9, "2024-02"), ("b", 2, "2024-02")]


def test_slices_build_on_each_other(spark):
    log = spark.createDataFrame([("a", 1, day(0), "c", 1), ("a", 2, day(1), "u", 2), ("b", 5, day(0), "c", 1), ("b", 5, day(2), "d", 3)], "id string, v int, ts timestamp, op string, n int")
    empty = spark.createDataFrame([], "id string, v int, ts timestamp, is_deleted boolean")
    run = lambda: cdc.run_slices(empty, [1, 2, 3], lambda n: log.where(F.col("n") == n).drop("n"), ["id"], ["ts"], version="ts", checkpoint_every=2)
    assert rows(run().select("id", "v", "is_deleted")) == [("a", 2, False), ("b", 5, True)]
    assert rows(run()) == rows(run())


def test_known_and_restated_balances(spark):
    log = spark.createDataFrame([
        ("t1", 1, "acc", 10.0, day(0), day(0), "c"), ("t1", 2, "acc", 15.0, day(0), day(5), "u"),
        ("t2", 1, "acc", 7.0, day(0), day(6), "c"), ("t3", 1, "acc", 100.0, day(9), day(9), "c"), ("t4", 1, "other", 3.0, day(0), day(0), "c"),
        ("t4", 2, "other", 3.0, day(0), day(4), "d")], "id string, lsn int, account string, amount double, event_ts timestamp, arrival timestamp, op string")
    got = cdc.as_known_vs_restated(log, ["id"], ["lsn"], account="account", amount=F.col("amount").cast("decimal(18,2)"), event_ts="event_ts",
                                   arrival_ts="arrival", op="op", known_at=F.lit(day(2)), cutoff=F.lit(day(3)))
    assert {r.account: (float(r.balance_as_known), float(r.balance_as_restated), float(r.delta)) for r in got.collect()} == {
        "acc": (10.0, 22.0, 12.0), "other": (3.0, 0.0, -3.0)}


def test_currencies_keep_their_own_balance(spark):
    df = spark.createDataFrame([("a", "EUR", day(0), 10, "CASH_IN"), ("a", "USD", day(0), 4, "CASH_OUT"), ("a", "EUR", day(1), 3, "DEBIT")],
                               "account string, currency string, ts timestamp, amount int, tx string").withColumn("amount", F.col("amount").cast("decimal(18,2)"))
    s = ledger.daily_account_summary(df, "account", "currency", "ts", "amount", F.col("tx") == "CASH_IN")
    got = {(r.currency, str(r.business_date)): (float(r.opening_balance), float(r.closing_balance)) for r in s.collect()}
    assert got == {("EUR", "2024-01-10"): (0, 10), ("USD", "2024-01-10"): (0, -4), ("EUR", "2024-01-11"): (10, 7)}
    assert ledger.unbalanced(s).isEmpty()


def test_late_window(spark):
    df = spark.sql("SELECT * FROM VALUES (timestamp'2024-01-14 18:00:00'), (timestamp'2024-01-14 17:59:59'), (timestamp'2024-01-16 00:00:00') AS (ts)")
    assert cdc.late_window(df, "ts", "2024-01-15", 6).count() == 2


def test_latest_is_limited_before_the_shuffle(spark, sf):
    from lakeops.operators.layout import plan_text
    plan = plan_text(cdc.latest_per_key(spark.read.parquet(f"{sf}/events.parquet"), ["user_id"], ["ts"]))
    before_shuffle = plan[plan.index("Exchange"):]
    assert "WindowGroupLimit" in before_shuffle and "Partial" in before_shuffle
