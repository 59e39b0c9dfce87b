"""Population drift and model comparison."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeops.operators import sliced
from lakeops.operators.quantiles import exact_percentiles

EPSILON = 1e-6


def _melt(df: DataFrame, cols: list[str], dtype: str) -> DataFrame:
    return df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(c).cast(dtype).alias("v")) for c in cols])).alias("x")).select("x.*")


def _index(base_share: Column, now_share: Column) -> Column:
    e, a = F.greatest(base_share, F.lit(EPSILON)), F.greatest(now_share, F.lit(EPSILON))
    return F.sum((a - e) * F.ln(a / e))


def psi_numeric(base: DataFrame, now: DataFrame, cols: list[str], bins: int = 10, min_rows: int = 100) -> DataFrame:
    """Population stability index per numeric feature.

    Bin edges are exact quantiles of the baseline with repeats dropped; the end bins are open.
    Fewer than ``min_rows`` values on a side gives NULL, fewer than three edges 0.
    """
    b, n = _melt(base, cols, "double"), _melt(now, cols, "double")
    names = {f"q{i:02d}": i / bins for i in range(bins + 1)}
    edges = exact_percentiles(b, ["feature"], "v", names).select(
        "feature", F.array_distinct(F.array(*names)).alias("edges"))
    inner = edges.select("feature", F.size("edges").alias("n_edges"),
                         F.slice("edges", F.lit(2), F.greatest(F.size("edges") - 2, F.lit(0))).alias("cuts"))
    both = (b.select("feature", "v", F.lit("base").alias("side"))
            .unionByName(n.select("feature", "v", F.lit("now").alias("side"))).where("v is not null"))
    binned = both.join(F.broadcast(inner), "feature").withColumn(  # one row per feature
        "bin", F.size(F.filter("cuts", lambda cut: cut <= F.col("v"))))
    side = lambda s: F.count_if(F.col("side") == s)
    counts = binned.groupBy("feature", "n_edges", "bin").agg(side("base").alias("b"), side("now").alias("n"))
    # the totals run over at most `bins` rows per feature
    whole = Window.partitionBy("feature")
    shares = counts.withColumns({"tb": F.sum("b").over(whole), "tn": F.sum("n").over(whole)})
    listed = base.sparkSession.range(1).select(F.explode(F.array(*[F.lit(c) for c in cols])).alias("feature"))
    scored = shares.groupBy("feature").agg(
        F.max("n_edges").alias("n_edges"), F.max("tb").alias("tb"), F.max("tn").alias("tn"),
        F.count(F.lit(1)).alias("seen_bins"),
        _index(F.col("b") / F.col("tb"), F.try_divide("n", "tn")).alias("raw"))
    psi = (F.when(F.least("tb", "tn") < min_rows, F.lit(None).cast("double"))
           .when(F.col("n_edges") < 3, F.lit(0.0)).otherwise(F.round("raw", 6)))
    return listed.join(scored, "feature", "left").select("feature", psi.alias("psi"))


def psi_categorical(base: DataFrame, now: DataFrame, cols: list[str]) -> DataFrame:
    """Population stability index per categorical feature; NULL is a level of its own."""
    b = _melt(base, cols, "string").select("feature", "v", F.lit(1).alias("b"), F.lit(0).alias("n"))
    n = _melt(now, cols, "string").select("feature", "v", F.lit(0).alias("b"), F.lit(1).alias("n"))
    counts = (b.unionByName(n).withColumn("v", F.coalesce("v", F.lit("__NULL__")))
              .groupBy("feature", "v").agg(F.sum("b").alias("b"), F.sum("n").alias("n")))
    totals = counts.groupBy("feature").agg(F.sum("b").alias("tb"), F.sum("n").alias("tn"))
    return (counts.join(F.broadcast(totals), "feature")  # one row per feature
            .groupBy("feature").agg(F.round(_index(F.try_divide("b", "tb"), F.try_divide("n", "tn")), 6).alias("psi")))


def drift_summary(per_feature: DataFrame, alert: float = 0.25, retrain_above: float = 0.20) -> DataFrame:
    """One row: the 90th percentile of the features' indexes as headline, mean, max, the drifted ones.

    A mean over many features hides a few badly drifted ones.  The input has one row per feature.
    """
    p = F.col("psi")
    drifted = F.sort_array(F.collect_list(F.when(p > alert, F.struct((-p).alias("o"), "feature"))))
    return (per_feature.where(p.isNotNull())
            .agg(F.round(F.percentile("psi", 0.9), 6).alias("headline"), F.round(F.avg(p), 6).alias("mean_psi"),
                 F.max(p).alias("max_psi"), F.count(p).alias("features"),
                 F.array_join(drifted["feature"], ",").alias("drifted"))
            .withColumn("retrain", F.col("headline") > retrain_above))


def auc(df: DataFrame, score: str, label: str, slice_by: Column) -> DataFrame:
    """One row: area under the ROC curve by rank sums, ties counted half.

    Rows are reduced to one per distinct score; negatives below each score are a running count.
    """
    per = df.where(F.col(score).isNotNull() & F.col(label).isNotNull()).groupBy(score).agg(
        F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) == 0).alias("q"))
    below = sliced.running(per, [], [score], slice_by, {"upto": ("sum", F.col("q"))})
    wins = F.sum(F.col("p") * (F.col("upto") - F.col("q") / 2))
    return below.agg(F.round(F.try_divide(wins, F.sum("p") * F.sum("q")), 8).alias("auc"),
                     F.sum("p").alias("positives"), F.sum("q").alias("negatives"))


def beats_champion(champion: float, challenger: float, margin: float = 0.002) -> bool:
    """A challenger replaces the champion only when it is better by the margin."""
    return challenger >= champion + margin


def promote(metrics: Mapping[str, DataFrame], margin: float = 0.002) -> DataFrame:
    """Compare two one-row metric frames ``{"champion": …, "challenger": …}``."""
    a = metrics["champion"].select(F.col("auc").alias("v")).scalar()
    b = metrics["challenger"].select(F.col("auc").alias("v")).scalar()
    spark = metrics["champion"].sparkSession
    return spark.range(1).select(a.alias("champion"), b.alias("challenger"),
                                 F.coalesce(b >= a + margin, F.lit(False)).alias("promote"))
