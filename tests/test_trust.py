"""Quality gates, reconciliation, drift, privacy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakeops.operators import drift, features, privacy, quality, recon, sliced
from tests.conftest import rows


def test_gates(spark):
    df = spark.sql("SELECT * FROM VALUES (1, 0.1D), (2, 0.2D), (2, 0.3D) AS (id, s)")
    quality.assert_not_empty(df)
    quality.assert_unique(df, ["id", "s"])
    for bad in (lambda: quality.assert_not_empty(df.where("false")), lambda: quality.assert_unique(df, ["id"]),
                lambda: quality.assert_distribution(df, "s", max_mean=0.1), lambda: quality.assert_distribution(df.withColumn("s", F.lit(0.2)), "s"),
                lambda: quality.assert_distribution(df.withColumn("s", F.lit(None).cast("double")), "s"),
                lambda: quality.assert_duplicate_rate(df, ["id"]), lambda: quality.assert_duplicate_rate(df.where("false"), ["id"]),
                lambda: quality.assert_idempotent(df, df.limit(2))):
        with pytest.raises(quality.QualityError):
            bad()
    quality.assert_distribution(df, "s")


def test_checksum_ignores_order_but_not_copies(spark):
    df = spark.range(200).select("id", F.when(F.col("id") % 3 == 0, F.lit("x")).alias("v"))
    one = quality.dataset_checksum(df, ["id", "v"]).first()[0]
    assert quality.dataset_checksum(df.orderBy(F.rand(1)).repartition(7), ["id", "v"]).first()[0] == one
    assert quality.dataset_checksum(df.union(df.limit(1)), ["id", "v"]).first()[0] != one
    assert quality.dataset_checksum(df.fillna(""), ["id", "v"]).first()[0] != one


def test_reconcile_pairs_one_to_one(spark):
    cols = "p string, m int, sec int, charge int, id int"
    ours = spark.createDataFrame([("x", 1, 60, 5, 1), ("x", 1, 60, 5, 2), ("x", 1, 300, 9, 3), ("y", 1, 10, 1, 4)], cols)
    theirs = spark.createDataFrame([("x", 1, 62, 5, 1), ("x", 1, 61, 5, 2), ("z", 1, 10, 1, 5), ("y", 1, 100, 1, 6)], cols)
    got = recon.reconcile(ours, theirs, ["p", "m"], ["sec", "id"], "sec", 2, sliced.value_slice("sec", 60))
    assert rows(got.groupBy("p", "match_status").count()) == [
        ("x", "MATCHED", 2), ("x", "MISSING_ON_THEIR_SIDE", 1), ("y", "DURATION_MISMATCH", 1), ("z", "MISSING_ON_OUR_SIDE", 1)]
    v = recon.variance_report(got, ["p"], "sec", "charge")
    x = v.where("p = 'x'").first()
    assert (x.total_legs, x.matched_legs, x.our_charge, x.their_charge, x.match_rate) == (3, 2, 19, 10, 0.66667)
    worst = recon.leakage(v, "p", 5).first()
    assert (worst.total_abs_variance, worst.worst_partner, worst.breached) == (10, "x", True)


def test_partial_month_and_missing_rate_are_refused(spark):
    days = spark.sql("SELECT explode(sequence(date'2024-02-01', date'2024-02-28')) AS d")
    with pytest.raises(quality.QualityError):
        recon.assert_whole_month(days, "d", "2024-02")
    whole = days.union(spark.sql("SELECT date'2024-02-29'"))
    assert recon.assert_whole_month(whole, "d", "2024-02").count() == 29
    fx = spark.sql("SELECT 'USD' AS currency, 1 AS day, 0.9D AS rate")
    rows_in = spark.sql("SELECT * FROM VALUES ('USD', 1, 10.0D), ('GBP', 1, 10.0D) AS (currency, day, amount)")
    with pytest.raises(quality.QualityError):
        recon.assert_rates(recon.convert_currency(rows_in, fx, "amount", "currency", "day", "base"))


def test_restatement_keeps_both_sides_and_survives_zero(spark):
    p = spark.sql("SELECT * FROM VALUES (1, 100.0D), (2, 0.0D), (3, 5.0D) AS (d, net)")
    c = spark.sql("SELECT * FROM VALUES (1, 100.05D), (2, 1.0D), (4, 7.0D) AS (d, net)")
    got = {r.d: (r.drift_pct, r.material) for r in recon.restatement_drift(p, c, ["d"], "net").collect()}
    assert got == {1: (0.0005, False), 2: (None, True), 3: (-1.0, True), 4: (None, True)}


def psi_by_hand(e, a, bins=10):
    edges = np.unique(np.quantile(e, np.linspace(0, 1, bins + 1)))
    edges[0], edges[-1] = -np.inf, np.inf
    x = np.clip(np.histogram(e, edges)[0] / len(e), 1e-6, None)
    y = np.clip(np.histogram(a, edges)[0] / len(a), 1e-6, None)
    return float(((y - x) * np.log(y / x)).sum())


def test_psi(spark):
    rnd = np.random.default_rng(5)
    base = {"n": rnd.normal(0, 1, 700), "spiky": np.where(rnd.random(700) < 0.7, 0.0, rnd.random(700)), "flat": np.ones(700)}
    now = {"n": rnd.normal(0.4, 1.2, 500), "spiky": np.where(rnd.random(500) < 0.5, 0.0, rnd.random(500)), "flat": np.ones(500)}
    to_df = lambda d: spark.createDataFrame(list(zip(*[v.tolist() for v in d.values()])), ", ".join(f"{k} double" for k in d))
    b, n = to_df(base), to_df(now)
    got = {r.feature: r.psi for r in drift.psi_numeric(b, n, ["n", "spiky", "flat"]).collect()}
    assert got["n"] == pytest.approx(psi_by_hand(base["n"], now["n"]), abs=2e-6)
    assert got["spiky"] == pytest.approx(psi_by_hand(base["spiky"], now["spiky"]), abs=2e-6)
    assert got["flat"] == 0.0
    assert all(r.psi == 0.0 for r in drift.psi_numeric(b, b, ["n", "spiky"]).collect())
    assert drift.psi_numeric(b, n.limit(99), ["n"]).first().psi is None
    cat = b.select(F.when(F.col("n") > 0, "hi").alias("c"))
    assert drift.psi_categorical(cat, cat, ["c"]).first().psi == 0.0
    one = drift.drift_summary(spark.sql("SELECT * FROM VALUES ('a', 0.1D), ('b', 0.5D), ('c', cast(null as double)) AS (feature, psi)")).first()
    assert (one.headline, one.features, one.drifted, one.retrain) == (0.46, 2, "b", True)


def test_auc_and_promotion(spark):
    df = spark.sql("SELECT * FROM VALUES (0.1D, 0), (0.4D, 0), (0.4D, 1), (0.8D, 1) AS (s, y)")
    assert drift.auc(df, "s", "y", sliced.value_slice("s", 0.25)).first().auc == 0.875
    assert drift.beats_champion(0.8, 0.802) and not drift.beats_champion(0.8, 0.8019)


def test_erasure_is_attested_only_when_no_version_keeps_the_rows(spark):
    before = {"t": spark.sql("SELECT * FROM VALUES (1), (2), (3) AS (id)")}
    ids = spark.sql("SELECT 2 AS id")
    after = privacy.erase(before, ids, "id")
    assert rows(after["t"]) == [(1,), (3,)]
    assert rows(privacy.subject_rows(before, ids, "id")) == [("t", 1)]
    still = privacy.attest_erasure(before, {"t": [before["t"], after["t"]]}, ids, "id").first()
    assert (still.residual, still.attested) == (1, False)
    done = privacy.attest_erasure(before, {"t": [after["t"]]}, ids, "id").first()
    assert (done.rows_before, done.rows_after, done.residual, done.attested) == (3, 2, 0, True)


def test_small_groups_are_suppressed(spark):
    df = spark.sql("SELECT * FROM VALUES ('a',1,10),('a',2,10),('b',1,10),('b',1,20) AS (g, s, v)")
    got = {r.g: (r.subjects, r.total, r.suppressed) for r in privacy.suppress_small(df, ["g"], "s", {"total": F.sum("v")}, k=2).collect()}
    assert got == {"a": (2, 20, False), "b": (None, None, True)}


def test_labels_and_split(spark):
    df = spark.sql("SELECT * FROM VALUES (1, null), (2, date'2024-01-01'), (3, date'2024-01-15'), (4, date'2024-03-01') AS (id, churn)")
    got = [r.y for r in df.withColumn("y", features.future_label("churn", "2024-01-01", 30)).orderBy("id").collect()]
    assert got == [0, None, 1, 0]
    many = spark.range(5000)
    a, b = features.hash_split(many, "id")
    again, _ = features.hash_split(many.repartition(13), "id")
    assert a.count() + b.count() == 5000 and 3800 < a.count() < 4200 and rows(a) == rows(again)


def test_precision_recall(spark):
    got = quality.precision_recall(spark.sql("SELECT explode(array(1,2,3)) AS id"), spark.sql("SELECT explode(array(2,3,4,5)) AS id"), ["id"]).first()
    assert (got.hits, got.false_alarms, got.misses, got.precision, got.recall) == (2, 1, 2, 0.666667, 0.5)


def test_lookback_is_half_open_on_dates_and_timestamps(spark):
    df = spark.sql("SELECT * FROM VALUES (timestamp'2024-01-10 23:59:59'), (timestamp'2024-01-03 00:00:00'), (timestamp'2024-01-04 00:00:00'), (timestamp'2024-01-11 00:00:00') AS (ts)")
    days = [r.ts.day for r in features.lookback(df, "ts", "2024-01-10", days=7).orderBy("ts").collect()]
    assert days == [4, 10]
    dates = df.select(F.to_date("ts").alias("ts"))
    assert [r.ts.day for r in features.lookback(dates, "ts", "2024-01-10", days=7).orderBy("ts").collect()] == [4, 10]


def test_unordered_digest_sums_sixty_bits_exactly(spark):
    import hashlib
    df = spark.createDataFrame([(i % 900, str(i)) for i in range(1000)] + [(None, None)], "a int, b string")
    texts = [f"{i % 900}|{i}" for i in range(1000)] + ["<null>|<null>"]
    got = df.agg(quality.unordered_digest(["a", "b"]).alias("d"))
    assert got.first().d == str(sum(int(hashlib.sha256(t.encode()).hexdigest()[:15], 16) for t in texts))
    assert df.limit(0).agg(quality.unordered_digest(["a"])).first()[0] is None
    assert "sum(cast(conv" not in got._jdf.queryExecution().toString().lower()
