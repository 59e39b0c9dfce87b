"""Partner call records in four dialects, read into one schema.

Values that cannot be read become NULL and are judged by ``quality.assert_parse_rate``, so one bad
record does not stop a file and many do.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The common schema of partner call records.
COMMON = {
    "a_number": "string", "b_number": "string", "event_ts": "timestamp", "duration_sec": "int",
    "charged_units": "int", "charge_amount": "decimal(18,5)",
}

# Column names of the pre-decoded dialect, in the order of COMMON.
TAP3 = ["callingNumber", "calledNumber", "callEventStartTimeStamp", "totalCallEventDuration", "chargedUnits",
        "chargeAmount"]

# Fields of the headerless and of the headered CSV dialect.
CSV_V1 = ["a_number", "b_number", "call_date", "call_time", "duration_sec", "units", "amount"]
CSV_V2 = ["calling_msisdn", "called_msisdn", "start_time", "duration_minutes", "billed_units", "net_amount"]

# Start and width of the fields of the fixed-width dialect, in the order of COMMON.
FIXED = {"a_number": (1, 15), "b_number": (16, 15), "event_ts": (31, 14), "duration_sec": (45, 8),
         "charged_units": (53, 8), "charge_amount": (61, 15)}
IMPLIED_DECIMALS = 100_000


def _common(df: DataFrame, **cols: Column) -> DataFrame:
    return df.select(*[cols[name].try_cast(dtype).alias(name) for name, dtype in COMMON.items()])


def _as_text(names: list[str]) -> str:
    return ", ".join(f"{name} string" for name in names)


def read_parquet_dialect(spark: SparkSession, path: str) -> DataFrame:
    """Already decoded; only the names differ."""
    df = spark.read.parquet(path)
    return _common(df, **{name: F.col(theirs) for name, theirs in zip(COMMON, TAP3)})


def read_positional_csv(spark: SparkSession, path: str) -> DataFrame:
    """No header; columns by position; day and time of day in two columns."""
    df = spark.read.option("header", False).schema(_as_text(CSV_V1)).csv(path)
    return _common(df, a_number=F.col("a_number"), b_number=F.col("b_number"),
                   event_ts=F.try_to_timestamp(F.concat("call_date", F.lit(" "), "call_time"),
                                               F.lit("ddMMyyyy HHmmss")),
                   duration_sec=F.col("duration_sec"), charged_units=F.col("units"), charge_amount=F.col("amount"))


def read_minutes_csv(spark: SparkSession, path: str) -> DataFrame:
    """Header; ISO times; durations are decimal minutes."""
    df = spark.read.option("header", True).schema(_as_text(CSV_V2)).csv(path)
    seconds = F.round(F.col("duration_minutes").try_cast("double") * 60)
    return _common(df, a_number=F.col("calling_msisdn"), b_number=F.col("called_msisdn"),
                   event_ts=F.try_to_timestamp("start_time"), duration_sec=seconds,
                   charged_units=F.col("billed_units"), charge_amount=F.col("net_amount"))


def read_fixed_width(spark: SparkSession, path: str) -> DataFrame:
    """Positions, zero padding and five implied decimals."""
    df = spark.read.text(path)
    part = {name: F.trim(F.substring("value", start, width)) for name, (start, width) in FIXED.items()}
    amount = part["charge_amount"].try_cast("decimal(18,0)").cast("decimal(23,5)") / IMPLIED_DECIMALS
    return _common(df, **{**part, "event_ts": F.try_to_timestamp(part["event_ts"], F.lit("yyyyMMddHHmmss")), "charge_amount": amount})


READERS = {"tap3": read_parquet_dialect, "csv_v1": read_positional_csv, "csv_v2": read_minutes_csv,
           "fixed_width": read_fixed_width}


def read_partner(spark: SparkSession, source_format: str, path: str, partner_code: str, currency: str,
                 settlement_date: str) -> DataFrame:
    """Records of one partner in the common schema, with partner, currency, format and day."""
    if source_format not in READERS:
        raise ValueError(f"unknown partner format {source_format}; known: {sorted(READERS)}")
    return READERS[source_format](spark, path).select(
        F.lit(partner_code).alias("partner_code"), "*", F.lit(currency).alias("currency"),
        F.lit(source_format).alias("source_format"), F.lit(settlement_date).cast("date").alias("settlement_date"))
