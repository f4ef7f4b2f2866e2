"""The workpapers by name, built from the canonical tables."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from ledgerloom import fixed_values as fv
from ledgerloom.operators import assets, checks, costs, other_ledger, payables, receivables
from ledgerloom.rules import LedgerRules
from ledgerloom.schemas import TABLES
from ledgerloom.sources import sinks
from ledgerloom.sources.clean import checkpointed
from ledgerloom.sources.readers import empty

# Intermediate results that several workpapers read.
SHARED = ("ap_temp", "ap_fx_temp", "ap_adj_temp", "ap_fx_adj_temp", "ar_detail", "other_ledger")


class Workpapers:
    """Workpapers over one set of tables. Everything is lazy; each name is built once.

    With `materialize`, shared intermediates are checkpointed when first used. They hold one
    row per party and currency, so writing them once is cheaper than scanning the ledger
    again for every workpaper of a run.
    """

    def __init__(self, tables: Mapping[str, DataFrame], rules: LedgerRules | None = None, materialize: bool = False):
        self.tables = tables
        self.rules = rules or LedgerRules()
        self.materialize = materialize
        self._built: dict[str, DataFrame] = {}

    def __getitem__(self, name: str) -> DataFrame:
        """A workpaper by its name or its published name; KeyError for any other."""
        name = fv.VIEW_NAMES.get(name, name)
        if name not in self._built:
            df = BUILDERS[name](self)
            self._built[name] = checkpointed(df) if self.materialize and name in SHARED else df
        return self._built[name]

    def read(self, spark: SparkSession, name: str) -> DataFrame:
        """As by index, but without rows where the tables it needs are not loaded; the columns are the workpaper's own."""
        try:
            return self[name]
        except MissingTable:
            return spark.createDataFrame([], self.schema(spark, name))

    def schema(self, spark: SparkSession, name: str) -> StructType:
        """A workpaper's columns under these rules, told by building it over empty declared tables; no job runs."""
        return Workpapers({table: empty(spark, table) for table in TABLES}, self.rules)[name].schema

    def export(self, name: str, path: str, fmt: str = "csv") -> None:
        """Write a workpaper in the published order, with its published column labels where it has some."""
        sinks.export(self[name], path, LABELS.get(fv.VIEW_NAMES.get(name, name)), fmt)

    def register_views(self, published_names: bool = False) -> list[str]:
        """Create a temporary view per workpaper whose tables are loaded; returns their names."""
        labels = {v: k for k, v in fv.VIEW_NAMES.items()}
        created = []
        for name in BUILDERS:
            try:
                df = self[name]
            except MissingTable:
                continue
            view = labels.get(name, name) if published_names else name
            df.createOrReplaceTempView(f"`{view}`" if published_names else view)
            created.append(view)
        return created

    def t(self, name: str) -> DataFrame:
        try:
            return self.tables[name]
        except KeyError:
            raise MissingTable(name) from None

    def cost_detail(self, func_area: str) -> DataFrame:
        return costs.cost_detail(self.t("cost_postings"), func_area)

    def finance_cost(self) -> DataFrame:
        return costs.finance_cost(self.t("trial_balance"), self.rules)

    def adjusted_ap(self) -> tuple[DataFrame, DataFrame]:
        """Adjusted payables and prepayments; restated at period-end rates if nothing was revalued."""
        if self.t("fx_revaluation").isEmpty():
            return self["ap_fx_adj_detail"], self["prepaid_fx_adj_detail"]
        return self["ap_adj_detail"], self["prepaid_adj_detail"]

    def adjusted_ar(self) -> tuple[DataFrame, DataFrame]:
        """Adjusted receivables and advance receipts, chosen as for payables."""
        if self.t("fx_revaluation").isEmpty():
            return self["ar_fx_adj_detail"], self["advance_fx_adj_receipts"]
        return self["ar_adj_detail"], self["advance_adj_receipts"]


class MissingTable(LookupError):
    """A table that a workpaper needs is not loaded."""


def _ledger(w: Workpapers) -> list[DataFrame]:
    return [w.t("open_items"), w.t("postings")]


def _ap_schedule(temp: str, control_temp: str | None = None, zero_unaudited: bool = False) -> Callable:
    def build(w: Workpapers) -> DataFrame:
        parties = w[temp]
        if "doc_amount_post" in parties.columns:
            parties = parties.withColumnRenamed("doc_amount_post", "doc_amount")
        plain = control_temp is not None and w.rules.fx_control_uses_plain_reclass
        control = payables.ap_control_rows(
            w.t("trial_balance"), w[control_temp if plain else temp], w.rules,
            zero_unaudited and w.rules.adjusted_control_unaudited_zero,
        )
        return payables.ap_schedule(parties, control, w["misc_accrual"], w["accrued_expense"])

    return build


ADJUSTED = ("gl_adj", "other_adj")


def _advance_fx_adj(w: Workpapers) -> DataFrame:
    base = "ar_adj_detail" if w.rules.adjusted_fx_advance_uses_plain else "ar_fx_adj_detail"
    return receivables.advance_receipts(w[base], w.rules, ADJUSTED)


BUILDERS: dict[str, Callable[[Workpapers], DataFrame]] = {
    # Payables
    "ap_blank": lambda w: payables.ap_blank(w.t("open_items").sparkSession),
    "misc_accrual": lambda w: payables.misc_accrual(w.t("accruals")),
    "accrued_expense": lambda w: payables.accrued_expense(w.t("trial_balance"), w.rules),
    "ap_temp": lambda w: payables.ap_temp(*_ledger(w), w.t("accruals"), w.t("fx_revaluation"), w.rules),
    "ap_control_rows": lambda w: payables.ap_control_rows(w.t("trial_balance"), w["ap_temp"], w.rules),
    "ap_detail": _ap_schedule("ap_temp"),
    "prepaid_detail": lambda w: payables.prepaid_detail(w["ap_temp"], w.rules),
    # Payables restated at period-end rates
    "ap_fx_temp": lambda w: payables.ap_fx_temp(w["ap_temp"], w.t("fx_rates"), w.rules),
    "ap_fx_detail": _ap_schedule("ap_fx_temp", control_temp="ap_temp"),
    "prepaid_fx_detail": lambda w: payables.prepaid_fx_detail(w["ap_fx_temp"], w.rules),
    # Payables with adjustments
    "ap_adj_temp": lambda w: payables.ap_adj_temp(w["ap_temp"], w.t("adjustments")),
    "ap_adj_detail": _ap_schedule("ap_adj_temp", zero_unaudited=True),
    "ap_fx_adj_temp": lambda w: payables.ap_adj_temp(w["ap_fx_temp"], w.t("adjustments")),
    "ap_fx_adj_detail": _ap_schedule("ap_fx_adj_temp", zero_unaudited=True),
    "prepaid_adj_detail": lambda w: payables.prepaid_adj_detail(w["ap_adj_temp"], w.rules),
    "prepaid_fx_adj_detail": lambda w: payables.prepaid_adj_detail(w["ap_fx_adj_temp"], w.rules),
    # Receivables
    "ar_detail": lambda w: receivables.ar_detail(*_ledger(w), w.t("fx_revaluation"), w.rules),
    "advance_receipts": lambda w: receivables.advance_receipts(w["ar_detail"], w.rules),
    "ar_fx_temp": lambda w: receivables.ar_fx_temp(w["ar_detail"], w.t("fx_rates"), w.rules),
    "ar_fx_detail": lambda w: receivables.ar_fx_detail(w["ar_fx_temp"]),
    "advance_fx_receipts": lambda w: receivables.advance_receipts(w["ar_fx_temp"], w.rules, doc="doc_amount_pre"),
    "ar_adj_detail": lambda w: receivables.ar_adj_detail(w["ar_detail"], w.t("adjustments")),
    "ar_fx_adj_detail": lambda w: receivables.ar_adj_detail(w["ar_fx_detail"], w.t("adjustments")),
    "advance_adj_receipts": lambda w: receivables.advance_receipts(w["ar_adj_detail"], w.rules, ADJUSTED),
    "advance_fx_adj_receipts": _advance_fx_adj,
    # Other receivables and payables
    "cleared_documents": lambda w: other_ledger.cleared_documents(w.t("postings"), w.rules),
    "other_movement": lambda w: other_ledger.movement(w.t("postings"), w.rules),
    "other_ledger": lambda w: other_ledger.ledger_detail(*_ledger(w), w.rules),
    "other_receivable_detail": lambda w: other_ledger.other_ledger_schedule(
        w["other_ledger"], fv.RECEIVABLE, w.rules
    ),
    "other_payable_detail": lambda w: other_ledger.other_ledger_schedule(w["other_ledger"], fv.PAYABLE, w.rules),
    # Assets
    "intangible_detail": lambda w: assets.intangible_detail(w.t("asset_register"), w.t("asset_postings"), w.rules),
    # Checks
    "name_pairs": lambda w: payables.name_pairs(
        payables.ap_totals(*_ledger(w), w.t("accruals"), w.t("fx_revaluation"), replace(w.rules, party_names_in_key=False)), w.rules
    ),
    "duplicate_party_names": lambda w: checks.duplicate_party_names(*_ledger(w), w.t("accruals")),
}

# The published column labels of each workpaper that is shown; intermediates have none.
LABELS: dict[str, dict[str, str]] = {
    **{
        f"{paper}{variant}_detail": labels
        for paper, labels in (("ap", fv.PAYABLE_LABELS), ("prepaid", fv.PAYABLE_LABELS), ("ar", fv.RECEIVABLE_LABELS))
        for variant in ("", "_fx", "_adj", "_fx_adj")
    },
    **{f"advance{variant}_receipts": fv.ADVANCE_LABELS for variant in ("", "_fx", "_adj", "_fx_adj")},
    "other_receivable_detail": fv.OTHER_LEDGER_LABELS,
    "other_payable_detail": fv.OTHER_LEDGER_LABELS,
    "intangible_detail": fv.INTANGIBLE_LABELS,
}
