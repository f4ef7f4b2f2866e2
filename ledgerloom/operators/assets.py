"""Intangible assets."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ledgerloom import fixed_values as fv
from ledgerloom.functions.columns import lookup, money
from ledgerloom.functions.joins import left_outer
from ledgerloom.rules import LedgerRules


def purchases(asset_postings: DataFrame, rules: LedgerRules) -> DataFrame:
    """Purchases per asset, reversals left out."""
    return (
        asset_postings.filter(
            F.col("gl_account").contains(rules.intangible_account) & F.col("reversal_of").isNull()
        )
        .groupBy("asset_no").agg(money(F.sum("amount")).alias("purchase"))
    )


def intangible_detail(asset_register: DataFrame, asset_postings: DataFrame, rules: LedgerRules) -> DataFrame:
    """One row per intangible asset: both periods by one conditional aggregation, plus purchases."""

    def latest(tag: str, value) -> F.Column:
        return F.max(F.when(F.col("period_tag") == tag, value))

    accumulated = F.abs(F.col("accum_dep"))
    assets = (
        asset_register.filter(F.col("asset_class").startswith(rules.intangible_class_prefix))
        .groupBy("asset_no", "asset_name", "asset_class", "life_months")
        .agg(
            latest(fv.THIS, F.col("in_service")).alias("in_service"),
            money(latest(fv.LAST, F.col("cost"))).alias("opening_cost"),
            money(latest(fv.LAST, accumulated)).alias("opening_accum"),
            money(latest(fv.THIS, accumulated) - latest(fv.LAST, accumulated)).alias("charge"),
        )
    )
    return left_outer(
        assets, purchases(asset_postings, rules), ["asset_no"], by=["asset_no", "asset_name"]
    ).select(
        "asset_no", lookup(F.col("asset_class"), fv.INTANGIBLE_CLASSES).alias("asset_class"), "asset_name",
        "in_service", "opening_cost", "opening_accum", "charge", "life_months", "purchase",
    )
