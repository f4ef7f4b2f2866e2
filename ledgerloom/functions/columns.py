"""Column expressions shared by the workpapers. All of them stay inside the JVM."""

from __future__ import annotations

from functools import reduce
from operator import add, or_

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ledgerloom.schemas import MONEY


def money(value: Column | str | int) -> Column:
    if isinstance(value, int):
        value = F.lit(value)
    elif isinstance(value, str):
        value = F.col(value)
    return value.cast(MONEY)


def zero() -> Column:
    return money(0)


def text(value: str | None = None) -> Column:
    return F.lit(value).cast("string")


def or_zero(value: Column | str) -> Column:
    return F.coalesce(money(value), zero())


def shortfall(value: Column) -> Column:
    """The amount by which `value` is below zero, else 0; NULL counts as not below."""
    return F.when(value < 0, -value).otherwise(zero())


def total_of(*columns: str) -> Column:
    return money(reduce(add, [F.col(c) for c in columns]))


def any_null(*columns: str) -> Column:
    return reduce(or_, [F.col(c).isNull() for c in columns])


def prefix_in(column: str, *prefixes: str) -> Column:
    """Account-prefix test that reaches the file scan (startswith is pushed down, left() is not)."""
    return reduce(or_, [F.col(column).startswith(p) for p in prefixes])


def sub_account(column: str, prefix: str) -> Column:
    """Accounts below `prefix` whose next character is above '0'."""
    return F.col(column).startswith(prefix) & (F.substring(column, len(prefix) + 1, 1) > "0")


def lookup(column: Column, mapping: dict[str, str]) -> Column:
    """Label for each listed code, NULL for any other."""
    chain = None
    for code, label in mapping.items():
        chain = F.when(column == code, label) if chain is None else chain.when(column == code, label)
    return chain


def rate_of(currency: str, rates: DataFrame) -> Column:
    """The rate of a currency, NULL without one, from `rates` (currency, rate) of one day.

    The day's rates are one row, a map that comes by scalar subquery, so nothing is joined or shuffled by currency. Two rates
    for one currency are an error.
    """
    entries = F.collect_list(F.struct("currency", "rate"))
    known = rates.where(F.col("currency").isNotNull()).select(F.map_from_entries(entries)).scalar()
    return F.element_at(known, F.col(currency))


def drop_prefix(column: str, length: int = 2) -> Column:
    return F.expr(f"substring({column}, {length + 1})")


def strip_leading_zeros(column: Column) -> Column:
    return F.regexp_replace(column, "^0+", "")


def as_columns(df: DataFrame, spec: dict[str, Column | str]) -> DataFrame:
    """Select exactly the columns of `spec`, in its order, under its names."""
    return df.select(
        [(F.col(c) if isinstance(c, str) else c).alias(name) for name, c in spec.items()]
    )


def null_row(spark: SparkSession, types: dict[str, str]) -> DataFrame:
    """One row of typed NULLs, in one partition."""
    return spark.range(0, 1, 1, 1).selectExpr(*[f"cast(NULL AS {kind}) AS {name}" for name, kind in types.items()])
