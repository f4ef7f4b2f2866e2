"""Checks on the inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ledgerloom.functions.columns import text


def duplicate_party_names(open_items: DataFrame, postings: DataFrame, accruals: DataFrame) -> DataFrame:
    """Party codes that carry more than one name within a source and currency.

    The schedules group by name but join by code, so such parties appear more than once.
    """
    names = (
        open_items.select(text("open_items").alias("source"), "party_code",
                          F.col("doc_currency").alias("currency"), "party_name")
        .unionByName(postings.select(text("postings").alias("source"), "party_code",
                                     F.col("doc_currency").alias("currency"), "party_name"))
        .unionByName(accruals.select(text("accruals").alias("source"), F.col("vendor_code").alias("party_code"),
                                     "currency", F.col("vendor_name").alias("party_name")))
    )
    return (
        names.distinct()
        .groupBy("source", "party_code", "currency").agg(F.count(F.lit(1)).alias("names"))
        .filter(F.col("names") > 1)
    )
