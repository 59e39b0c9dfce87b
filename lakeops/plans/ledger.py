"""Account ledger reports built on a current-state ledger."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeops.functions.columns import money
from lakeops.operators import sliced

# Transaction types that take money out of an account.
OUTFLOW_TYPES = ("CASH_OUT", "PAYMENT", "TRANSFER", "DEBIT")


def daily_account_summary(ledger: DataFrame, account: str, currency: str, ts: str, amount: str,
                          is_credit: Column, accounts: DataFrame | None = None) -> DataFrame:
    """Credits, debits, count, opening and closing balance per account, currency and day.

    The balance runs over one row per day, so an account with very many entries is small here. A currency
    that belongs to the account comes from ``accounts`` (account, currency), joined to the days.
    """
    value = F.col(amount)
    keys = [account, currency] if accounts is None else [account]
    daily = ledger.groupBy(*keys, F.to_date(ts).alias("business_date")).agg(
        F.sum(F.when(is_credit, value).otherwise(F.lit(0))).alias("credit_volume"),
        F.sum(F.when(is_credit, F.lit(0)).otherwise(value)).alias("debit_volume"),
        F.count(F.lit(1)).alias("txn_count"))
    if accounts is not None:
        daily = daily.join(accounts.select(account, currency), account)
    upto = (Window.partitionBy(account, currency).orderBy("business_date")
            .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    net = F.col("credit_volume") - F.col("debit_volume")
    return (daily.withColumn("closing_balance", F.sum(net).over(upto))
            .withColumn("opening_balance", F.col("closing_balance") - net))


def unbalanced(summary: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """Rows where opening + credits - debits is not the closing balance; there must be none."""
    drift = (F.col("opening_balance") + F.col("credit_volume") - F.col("debit_volume") - F.col("closing_balance"))
    return summary.withColumn("drift", drift).where(F.abs("drift") > tolerance)


def executive_close(summary: DataFrame, account: str, currency: str) -> DataFrame:
    """Active accounts, balances and volumes per currency and day."""
    return summary.groupBy(currency, "business_date").agg(
        F.countDistinct(account).alias("active_accounts"), F.sum("closing_balance").alias("total_balance"),
        F.sum("credit_volume").alias("total_credits"), F.sum("debit_volume").alias("total_debits"),
        F.sum("txn_count").alias("total_transactions"))


def velocity_alerts(outflows: DataFrame, openings: DataFrame, account: str, ts: str, amount: str,
                    window_seconds: int = 900, threshold: float = 0.80) -> DataFrame:
    """Outflow of a rolling window against the day's opening balance.

    ``openings`` has one ``opening_balance`` per account and ``business_date``.
    """
    dated = outflows.withColumn("business_date", F.to_date(ts))
    rolled = sliced.rolling(dated, [account, "business_date"], ts, window_seconds,
                            {"rolling_outflow": F.sum(amount)}, slice_seconds=3_600)
    share = F.round(F.col("rolling_outflow").cast("double") / F.col("opening_balance").cast("double"), 4)
    return (rolled.join(openings.where("opening_balance > 0"), [account, "business_date"])
            .withColumn("pct_of_opening", share).where(F.col("pct_of_opening") >= threshold)
            .withColumn("severity", F.when(F.col("pct_of_opening") >= 1.0, "CRITICAL")
                        .when(F.col("pct_of_opening") >= 0.9, "HIGH").otherwise("MEDIUM")))


def net_by_day(ledger: DataFrame, currency: str, ts: str, amount: str, is_credit: Column) -> DataFrame:
    """Signed total per currency and day."""
    signed = F.when(is_credit, money(amount)).otherwise(-money(amount))
    return ledger.groupBy(currency, F.to_date(ts).alias("business_date")).agg(F.sum(signed).alias("net"))


def drift_rollup(drift: DataFrame, currency: str) -> DataFrame:
    """Per currency: days compared, total drift, material days."""
    return drift.groupBy(currency).agg(
        F.count(F.lit(1)).alias("days"), F.sum("drift").alias("total_drift"),
        F.count_if("material").alias("material_days"), F.max(F.abs("drift_pct")).alias("worst_pct"))
