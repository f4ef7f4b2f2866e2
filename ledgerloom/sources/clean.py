"""Cleaning: from contract-read exports to the canonical tables."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ledgerloom import fixed_values as fv
from ledgerloom.functions.columns import drop_prefix, strip_leading_zeros, text
from ledgerloom.schemas import AMOUNT, TABLES, conform
from ledgerloom.sources.contracts import TRIAL_BALANCE_COLUMNS
from ledgerloom.sources.readers import BadValues


def tagged(df: DataFrame, period: str | None = None, source: str | None = None) -> DataFrame:
    """Add the period and source tags that tell the exports apart after the union."""
    if period is not None:
        df = df.withColumn("period_tag", F.lit(period))
    if source is not None:
        df = df.withColumn("source_tag", F.lit(source))
    return df


def union_tagged(*parts: DataFrame) -> DataFrame:
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part, allowMissingColumns=True)
    return result


def clean_open_items(*parts: DataFrame) -> DataFrame:
    return conform(union_tagged(*parts).filter(F.col("account_code").isNotNull()), "open_items")


def clean_postings(*parts: DataFrame) -> DataFrame:
    return conform(union_tagged(*parts), "postings")


def clean_accruals(raw: DataFrame) -> DataFrame:
    """Vendor code without its two-character prefix and leading zeros; no currency means CNY."""
    code = F.coalesce(F.col("vendor_code"), F.lit("00"))
    return conform(
        raw.withColumn("vendor_code", code)
        .withColumn("vendor_code", strip_leading_zeros(drop_prefix("vendor_code")))
        .withColumn("currency", F.coalesce(F.col("currency"), F.lit("CNY"))),
        "accruals",
    )


def clean_trial_balance(raw: DataFrame, bad: BadValues | None = None) -> DataFrame:
    """Canonical names and types, account code without its two-character prefix.

    Columns beyond the declared ones are kept as they are. A NULL code stays NULL. `bad` counts values of other types.
    """
    named = raw.withColumnsRenamed({s: n for s, n in TRIAL_BALANCE_COLUMNS.items() if s in raw.columns})
    declared = {f.name: f.dataType for f in TABLES["trial_balance"].fields}
    if bad is not None:
        named = bad.typed(named, "TB", declared)
    typed = named.select(
        [F.col(f"`{c}`").cast(declared[c]).alias(c) if c in declared else F.col(f"`{c}`") for c in named.columns]
    )
    return typed.withColumn("account_code", drop_prefix("account_code"))


def clean_asset_register(this: DataFrame, last: DataFrame) -> DataFrame:
    return conform(union_tagged(tagged(this, fv.THIS), tagged(last, fv.LAST)), "asset_register")


def clean_asset_scrapped(this: DataFrame, last: DataFrame) -> DataFrame:
    return conform(union_tagged(tagged(this, fv.THIS), tagged(last, fv.LAST)), "asset_scrapped")


def clean_cost_postings(raw: DataFrame) -> DataFrame:
    return conform(raw.filter(F.col("account_code").isNotNull()), "cost_postings")


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the folder that `spark.checkpoint.dir` names."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(checkpoint_dir(spark))
    return df.checkpoint()


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share."""
    configured = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return tempfile.mkdtemp(prefix="ledgerloom-checkpoint-")


def row_index(df: DataFrame, order_by: list[str], name: str = "id") -> DataFrame:
    """Number the rows 0, 1, 2, ... in the order of `order_by`, without one task holding all rows.

    A range sort gives every partition its place; the checkpoint pins which row sits where;
    the offsets come from one count per partition, so the running sum sees only as many rows
    as there are partitions.
    """
    ordered = checkpointed(df.sort(*order_by).withColumn("_at", F.monotonically_increasing_id()))
    within = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    placed = ordered.withColumn("_part", F.shiftright("_at", 33)).withColumn("_row", within)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
        .select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    )
    # Broadcast is safe: one row per partition, whatever the size of the table.
    return (
        placed.join(F.broadcast(offsets), "_part")
        .withColumn(name, (F.col("_offset") + F.col("_row")).cast("long"))
        .drop("_at", "_part", "_row", "_offset")
    )


def clean_asset_postings(raw: DataFrame) -> DataFrame:
    """Numbered as the source is, or in the order of documents where the rows do not come from one."""
    if "id" in raw.columns:
        return conform(raw, "asset_postings")
    order = [c for c in raw.columns if c != "id"]
    return conform(row_index(raw, ["doc_no", *[c for c in order if c != "doc_no"]]), "asset_postings")


# ---------------------------------------------------------------------------- adjustments

def type_by_name(df: DataFrame) -> DataFrame:
    """Columns named like a code, name or currency become text, those named like an amount decimal."""

    def typed(column: str) -> Column:
        if any(fragment in column for fragment in fv.TEXT_FRAGMENTS):
            return F.col(f"`{column}`").cast("string").alias(column)
        if any(fragment in column for fragment in fv.MONEY_FRAGMENTS):
            return F.col(f"`{column}`").cast(AMOUNT).alias(column)
        return F.col(f"`{column}`")

    return df.select([typed(c) for c in df.columns])


def roll_up_adjustments(df: DataFrame, amount: str = "amount", also_by: tuple[str, ...] = ()) -> DataFrame:
    """Amounts rounded half-even to cents and summed by the first three columns.

    A row that lacks one of those three keys does not count.
    """
    keys = df.columns[:3]
    complete = df.dropna(subset=keys)
    return complete.groupBy(*keys, *also_by).agg(F.sum(F.bround(amount, 2)).cast(AMOUNT).alias(amount))


def load_adjustments(sheets: DataFrame, suffix: str, amount: str = "amount") -> DataFrame:
    """Adjustment sheets of one ledger. Sheets of the two trade ledgers are rolled up, others kept.

    Those of the trade ledgers may carry the headers of the published template.
    """
    ledger = fv.ADJUSTMENT_LEDGERS.get(suffix, suffix)
    if ledger in fv.ADJUSTMENT_LEDGERS.values():
        sheets = sheets.withColumnsRenamed(fv.ADJUSTMENT_HEADERS)
        amount = fv.ADJUSTMENT_HEADERS.get(amount, amount)
    kind = F.col("kind")
    for sheet, code in fv.ADJUSTMENT_SHEETS.items():
        kind = F.when(F.col("kind") == sheet, code).otherwise(kind)
    sheets = sheets.withColumn("kind", kind)
    if ledger in fv.ADJUSTMENT_LEDGERS.values():
        sheets = roll_up_adjustments(sheets, amount, also_by=("kind",))
    return type_by_name(sheets).withColumn("ledger", text(ledger))
