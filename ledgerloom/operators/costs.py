"""Expense matrix by month and finance costs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ledgerloom import fixed_values as fv
from ledgerloom.functions.columns import money, null_row, or_zero, text, total_of
from ledgerloom.rules import LedgerRules

PERIOD_COLUMNS = [f"p{i:02d}" for i in range(1, len(fv.PERIODS) + 1)]


def period_label(period: Column) -> Column:
    """`n月` for months 1 to 12, one adjustment label above; the text may read '1.0' or '013'."""
    number = period.cast("double").cast("int")
    return F.when(number > 12, fv.ADJUSTMENT_PERIOD).otherwise(F.concat(number.cast("string"), F.lit("月")))


def cost_detail(cost_postings: DataFrame, func_area: str) -> DataFrame:
    """Accounts by 13 periods for one functional area, then a blank row and a total row.

    The pivot values are given, so no job runs to find them. The row number comes after the
    aggregation, over one row per account of the area.
    """
    names = dict(zip(fv.PERIODS, PERIOD_COLUMNS))
    matrix = (
        # Accounts without a name do not appear; 'temp' is the name of the period spine.
        cost_postings.filter((F.col("func_area") == func_area) & (F.col("account_name") != "temp"))
        .withColumn("label", period_label(F.col("period")))
        .groupBy("account_code", "account_name")
        .pivot("label", fv.PERIODS)
        .agg(F.sum("amount"))
        .withColumnsRenamed(names)
        .withColumns({c: or_zero(c) for c in PERIOD_COLUMNS})
        .withColumn("total", total_of(*PERIOD_COLUMNS))
    )
    figures = [*PERIOD_COLUMNS, "total"]
    columns = ["seq", "account_code", "account_name", *figures, "section"]
    by_account = Window.orderBy("account_code", "account_name")
    detail = matrix.withColumn("seq", F.row_number().over(by_account)).withColumn("section", F.lit(1))
    total = matrix.agg(*[or_zero(F.sum(c)).alias(c) for c in figures]).select(
        F.lit(None).cast("int").alias("seq"), text().alias("account_code"),
        text(fv.TOTAL_LABEL).alias("account_name"), *figures, F.lit(3).alias("section"),
    )
    types = {f.name: f.dataType.simpleString() for f in total.schema.fields[:-1]}
    blank = null_row(total.sparkSession, types).withColumn("section", F.lit(2))
    return detail.select(*columns).unionByName(blank).unionByName(total)


def finance_cost(trial_balance: DataFrame, rules: LedgerRules) -> DataFrame:
    """Finance cost lines; interest income is shown negated, the grand total is not."""
    lines = trial_balance.filter(F.col("account_name").contains(rules.finance_pattern))

    def label(position: int, fallback: str) -> Column:
        chain = None
        for account, labels in fv.FINANCE_COST_LINES.items():
            step = (F.col("account_code") == account, F.lit(labels[position]))
            chain = F.when(*step) if chain is None else chain.when(*step)
        return chain.otherwise(F.col(fallback))

    # Accounts outside the list: number and level 2 fall back to the name, level 1 to the code.
    grouped = lines.groupBy(
        label(0, "account_name").alias("seq"),
        label(1, "account_code").alias("level1"),
        label(2, "account_name").alias("level2"),
    ).agg(money(F.sum("lc_close")).alias("amount"))
    grand_total = lines.select(money(F.sum("lc_close"))).scalar()
    income = F.col("seq") == fv.INTEREST_INCOME_GROUP
    return grouped.select(
        "seq", "level1", "level2",
        F.when(income, money(-F.col("amount"))).otherwise(F.col("amount")).alias("amount"),
        grand_total.alias("total"),
    )
