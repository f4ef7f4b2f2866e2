"""Loading flows: read every export of a module, clean it, and return the canonical tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerloom import fixed_values as fv
from ledgerloom.schemas import TABLES, conform
from ledgerloom.sources import contracts, rates
from ledgerloom.sources.clean import (
    clean_accruals, clean_asset_postings, clean_asset_register, clean_asset_scrapped,
    clean_cost_postings, clean_open_items, clean_postings, clean_trial_balance, load_adjustments, tagged,
    union_tagged,
)
from ledgerloom.sources.readers import BadValues, adjustment_sheets, empty, load_sources
from ledgerloom.sources.sinks import discard, read_table, stage, switch

Tables = dict[str, DataFrame]


def _required(frames: Tables, *names: str) -> None:
    missing = [n for n in names if n not in frames]
    if missing:
        raise ValueError(f"sources missing or unreadable: {missing}")


def _with_trial_balance(spark: SparkSession, tables: Tables, frames: Tables, bad: BadValues | None) -> Tables:
    """The trial balance is an empty table where none is given."""
    tables["trial_balance"] = clean_trial_balance(frames["TB"], bad) if "TB" in frames else empty(spark, "trial_balance")
    return tables


def build_arap_tables(
    spark: SparkSession, paths: dict[str, str], end_date: str | None = None, rate_table: DataFrame | None = None,
    bad: BadValues | None = None,
) -> tuple[Tables, DataFrame]:
    """Open items, postings, accruals, revaluation, rates and the trial balance.

    The trial balance is an empty table where none is given: only two sections of the payables
    schedule come from it.
    """
    frames, status = load_sources(spark, paths, contracts.ARAP_CONTRACTS, bad)
    _required(frames, *[n for n in contracts.ARAP_CONTRACTS if n != "TB"])
    tables = {
        "open_items": clean_open_items(
            tagged(frames["FBL1H_THIS"], fv.THIS, fv.VENDOR), tagged(frames["FBL1H_LAST"], fv.LAST, fv.VENDOR),
            tagged(frames["FBL5H_THIS"], fv.THIS, fv.CUSTOMER), tagged(frames["FBL5H_LAST"], fv.LAST, fv.CUSTOMER),
        ),
        "postings": clean_postings(
            tagged(frames["FBL1H_OCCUR"], source=fv.VENDOR), tagged(frames["FBL5H_OCCUR"], source=fv.CUSTOMER)
        ),
        "accruals": clean_accruals(frames["ZFI072N_THIS"]),
        "fx_revaluation": frames["FOREIGN_CURRENCY"],
        "fx_rates": empty(spark, "fx_rates") if rate_table is None else rates.fx_rates_long(rate_table, end_date),
    }
    return _with_trial_balance(spark, tables, frames, bad), status


def build_asset_tables(spark: SparkSession, paths: dict[str, str], bad: BadValues | None = None) -> tuple[Tables, DataFrame]:
    frames, status = load_sources(spark, paths, contracts.ASSET_CONTRACTS, bad)
    _required(frames, *[n for n in contracts.ASSET_CONTRACTS if n != "TB"])
    tables = {
        "asset_register": clean_asset_register(frames["ZFI022_THIS"], frames["ZFI022_LAST"]),
        "asset_scrapped": clean_asset_scrapped(frames["ZFI022_THIS_SCRAP"], frames["ZFI022_LAST_SCRAP"]),
        "asset_postings": clean_asset_postings(frames["FBL3H_OCCUR"]),
    }
    return _with_trial_balance(spark, tables, frames, bad), status


def build_cost_tables(spark: SparkSession, paths: dict[str, str], bad: BadValues | None = None) -> tuple[Tables, DataFrame]:
    frames, status = load_sources(spark, paths, contracts.COST_CONTRACTS, bad)
    _required(frames, "FBL3H_THIS")
    return _with_trial_balance(spark, {"cost_postings": clean_cost_postings(frames["FBL3H_THIS"])}, frames, bad), status


def build_trial_balance(spark: SparkSession, paths: dict[str, str], bad: BadValues | None = None) -> tuple[Tables, DataFrame]:
    frames, status = load_sources(spark, paths, contracts.TRIAL_BALANCE_CONTRACTS, bad)
    _required(frames, "TB")
    return _with_trial_balance(spark, {}, frames, bad), status


def build_adjustments(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """The table `adjustments` from one folder of sheets per trade ledger, by its published name."""
    unknown = [ledger for ledger in paths if ledger not in fv.ADJUSTMENT_LEDGERS]
    if unknown:
        raise ValueError(f"not a trade ledger: {unknown}")
    parts = [load_adjustments(adjustment_sheets(spark, path), ledger) for ledger, path in paths.items()]
    return conform(union_tagged(empty(spark, "adjustments"), *parts), "adjustments")


# Schedules read one source of the open items and postings, checks one period.
_PARTITIONS = {"open_items": ("period_tag", "source_tag"), "postings": ("source_tag",)}


class BadLoad(ValueError):
    """Values that do not fit their columns; `rows` holds source, column and count."""

    def __init__(self, rows: list[tuple[str, str, int]]):
        super().__init__("; ".join(f"{source}: {n} bad values in {column}" for source, column, n in rows))
        self.rows = rows


def save_tables(tables: Tables, base: str, project: dict[str, str] | None = None, bad: BadValues | None = None) -> None:
    """Write the canonical tables below `base`, replacing those of the project.

    All tables are written beside the old ones first. If one fails, or `bad` has counted values that do not fit (a BadLoad
    then), the old tables stay as they were.
    """
    staged: list[tuple[str, str]] = []
    spark = SparkSession.active()
    try:
        for name, df in tables.items():
            staged.append(stage(df, f"{base}/{name}", project, _PARTITIONS.get(name, ())))
        if bad is not None and (rows := bad.rows()):
            raise BadLoad(rows)
    except BaseException:
        for version in staged:
            discard(spark, *version)
        raise
    for version in staged:
        switch(spark, *version)


def load_tables(spark: SparkSession, base: str, names: list[str], project: dict[str, str] | None = None) -> Tables:
    """Read saved tables back, with their declared schemas.

    The trial balance keeps the columns of its export, so its schema comes from its files.
    """
    return {
        name: read_table(spark, f"{base}/{name}", project, None if name == "trial_balance" else TABLES[name])
        for name in names
    }
