"""Exchange rates: daily rows with one column per currency, turned into one row per currency."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgerloom import fixed_values as fv
from ledgerloom.functions.columns import lookup
from ledgerloom.schemas import RATE
from ledgerloom.sources.readers import empty, read_raw


#: Heading of the date column of the published rate table (fixed value).
PUBLISHED_DATE = "日期"


def read_rate_table(spark: SparkSession, path: str) -> DataFrame:
    """Daily rates per 100 units: a date column, then one column per currency name. The published
    heading of the date column becomes `rate_date`."""
    return read_raw(spark, path).withColumnRenamed(PUBLISHED_DATE, "rate_date")


def fx_rates_long(wide: DataFrame, date: str | None, date_column: str = "rate_date") -> DataFrame:
    """Rates of exactly one day, per unit and rounded half-even to 4 places. No day, no rates."""
    if not date:
        return empty(wide.sparkSession, "fx_rates")
    currencies = [c for c in wide.columns if c != date_column]
    return (
        wide.filter(F.col(date_column).cast("date") == F.lit(date).cast("date"))
        .select(*[F.col(f"`{c}`").cast("decimal(19,6)").alias(c) for c in currencies])
        .unpivot([], currencies, "currency_name", "quoted")
        .select(
            "currency_name",
            F.bround(F.col("quoted") / 100, 4).cast(RATE).alias("rate"),
            lookup(F.col("currency_name"), fv.CURRENCY_CODES).alias("currency"),
        )
    )
