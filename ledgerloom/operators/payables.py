"""Payables and prepayments."""

from __future__ import annotations

from functools import reduce
from operator import mul

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ledgerloom import fixed_values as fv
from ledgerloom.functions.columns import (
    as_columns, money, null_row, or_zero, rate_of, shortfall, sub_account, text, total_of, zero,
)
from ledgerloom.functions.joins import left_outer
from ledgerloom.functions.pairing import gathered, lines, overlaid, paired
from ledgerloom.rules import LedgerRules
from ledgerloom.schemas import MONEY

KEYS = ["party_code", "currency"]
NAME = ["party_name"]
ROLLFORWARD = ["opening", "increase", "decrease", "closing"]
PRESSURE = ["closing", "accrual", "fx_adj", "gl_adj", "other_adj"]
DETAIL = [
    "party_code", "party_name", "tb_class", "nature", *ROLLFORWARD, "accrual", "gl_adj",
    "neg_reclass", "fx_adj", "other_adj", "unaudited", "currency", "doc_amount",
]


# ---------------------------------------------------------------- sources of the rollforward

def _payable_items(open_items: DataFrame, rules: LedgerRules) -> DataFrame:
    return open_items.filter(
        F.col("account_name").contains(rules.payable_pattern) & (F.col("source_tag") == fv.VENDOR)
    ).withColumnRenamed("doc_currency", "currency")


def _payable_moves(postings: DataFrame, rules: LedgerRules) -> DataFrame:
    return postings.filter(
        (F.col("source_tag") == fv.VENDOR)
        & F.col("account_code").startswith(rules.payable_prefix)
        & F.col("doc_type").isin(*rules.payable_increase_types)
    ).withColumnRenamed("doc_currency", "currency")


# ---------------------------------------------------------------------------- rollforward

LEDGER = ["closing", "opening", "increase"]


def ap_totals(
    open_items: DataFrame, postings: DataFrame, accruals: DataFrame, fx_revaluation: DataFrame, rules: LedgerRules
) -> DataFrame:
    """The totals of each party and currency as arrays by source: every table is read once, lines are grouped once.

    Revaluation has no names and attaches to the ledger side only; goods accruals that net to 0 are left out.
    """
    items = _payable_items(open_items, rules).filter(F.col("period_tag").isin(fv.THIS, fv.LAST))
    this = F.col("period_tag") == fv.THIS
    columns = {"party_code": "party_code", "currency": "currency", "party_name": "party_name"}
    parts = [
        lines(items, F.when(this, F.lit("closing")).otherwise(F.lit("opening")), columns, -F.col("local_amount"), F.when(this, -F.col("doc_amount"))),
        lines(_payable_moves(postings, rules), F.lit("increase"), columns, -F.col("local_amount")),
        lines(
            accruals.filter(F.col("misc_charge").isNull()), F.lit("accrual"),
            {**columns, "party_code": "vendor_code", "party_name": "vendor_name"}, F.col("accrual_local"), F.col("accrual_doc"),
        ),
        lines(
            fx_revaluation.filter(F.col("gl_account").startswith(rules.payable_prefix)), F.lit("revaluation"),
            {**columns, "party_name": text()}, -F.col("posted_amount"),
        ),
    ]
    kept = {**{s: None for s in LEDGER}, "accrual": money("local") != 0, "revaluation": None}
    if rules.party_names_in_key:  # revaluation has no name: it is spread to the names of its key afterwards
        named = gathered(parts[:-1], [*KEYS, *NAME], [], {k: v for k, v in kept.items() if k != "revaluation"}, complete=KEYS)
        revalued = gathered(parts[-1:], KEYS, [], {"revaluation": None}).drop("_apart")
        return left_outer(named, revalued, KEYS, by=[*KEYS, *NAME])
    return gathered(parts, KEYS, NAME, kept)


def _totals(grouped: DataFrame, rules: LedgerRules) -> DataFrame:
    in_ledger = F.size("closing") + F.size("opening") + F.size("increase") > 0
    revalued = F.when(in_ledger, F.get("revaluation", F.lit(0))["local"])
    rows = paired(grouped.withColumn("fx_adj", money(revalued)), [*LEDGER, "accrual"], [] if rules.party_names_in_key else NAME)
    return rows.select(
        *KEYS, *NAME, *[money(F.col(s)["local"]).alias(s) for s in [*LEDGER, "accrual"]], "fx_adj",
        money(F.col("closing")["doc"]).alias("closing_doc"), money(F.col("accrual")["doc"]).alias("accrual_doc"),
    )


def name_pairs(totals: DataFrame, rules: LedgerRules) -> DataFrame:
    """Party codes whose names pair up in the payables, and into how many rows; read before the pairs are made."""
    sources = [*LEDGER, "accrual"]
    counted = totals.where(F.col("_apart") == "").withColumns({s: F.size(s) for s in sources})
    pairs = reduce(mul, [F.greatest(F.col(s), F.lit(1)).cast("long") for s in sources])
    return counted.select(*KEYS, *sources, pairs.alias("pairs")).where(F.col("pairs") > 1)


def ap_temp(
    open_items: DataFrame, postings: DataFrame, accruals: DataFrame, fx_revaluation: DataFrame,
    rules: LedgerRules,
) -> DataFrame:
    """Payable rollforward per party and currency, before presentation.

    The decrease is the balancing figure. A balance below zero is moved to prepayments
    (`neg_reclass`), which leaves `unaudited` at zero or above.
    """
    totals = _totals(ap_totals(open_items, postings, accruals, fx_revaluation, rules), rules)
    balances = totals.withColumns({
        **{c: or_zero(c) for c in ("opening", "increase", "closing", "accrual", "fx_adj")},
        "doc_amount_pre": money(or_zero("closing_doc") + or_zero("accrual_doc")),
        "gl_adj": zero(),
        "other_adj": zero(),
        "tb_class": text(""),
        "nature": text(""),
    }).withColumn("decrease", money(F.col("opening") + F.col("increase") - F.col("closing")))
    settled = _reclassify(balances)
    return settled.withColumn("doc_amount_post", _doc_unless_zero()).select(
        *DETAIL[:-1], "doc_amount_pre", "doc_amount_post"
    )


def _reclassify(df: DataFrame) -> DataFrame:
    pressure = total_of(*PRESSURE)
    return df.withColumn("neg_reclass", shortfall(pressure)).withColumn(
        "unaudited", money(pressure + F.col("neg_reclass"))
    )


def _doc_unless_zero() -> Column:
    return F.when(F.col("unaudited") == 0, zero()).otherwise(F.col("doc_amount_pre"))


# ----------------------------------------------------------------- sections of the schedule

def ap_blank(spark: SparkSession) -> DataFrame:
    """The separator row of the schedule: 16 typed NULLs."""
    texts = {"party_code", "party_name", "tb_class", "nature", "currency"}
    return null_row(spark, {c: "string" if c in texts else MONEY for c in DETAIL})


def misc_accrual(accruals: DataFrame) -> DataFrame:
    """Accrued miscellaneous charges, one row per currency."""
    totals = (
        accruals.filter(F.col("misc_charge").isNotNull())
        .groupBy("currency")
        .agg(money(F.sum("accrual_local")).alias("accrual"), money(F.sum("accrual_doc")).alias("doc_amount"))
    )
    return as_columns(totals, {
        "party_code": text(fv.MISC_ACCRUAL_CODE),
        "party_name": text(fv.MISC_ACCRUAL_NAME),
        "tb_class": text(fv.MISC_ACCRUAL_CLASS),
        "nature": text(""),
        **{c: zero() for c in ROLLFORWARD},
        "accrual": "accrual",
        **{c: zero() for c in ("gl_adj", "neg_reclass", "fx_adj", "other_adj")},
        "unaudited": "accrual",
        "currency": "currency",
        "doc_amount": "doc_amount",
    })


def accrued_expense(trial_balance: DataFrame, rules: LedgerRules) -> DataFrame:
    """Accrued expense accounts of the trial balance, shown credit-positive."""
    return as_columns(trial_balance.filter(F.col("account_code").startswith(rules.accrued_prefix)), {
        "party_code": "account_code",
        "party_name": "account_name",
        "tb_class": text(""),
        "nature": text(""),
        "opening": money(-F.col("lc_open")),
        "increase": money("lc_credit"),
        "decrease": money("lc_debit"),
        "closing": money(-F.col("lc_close")),
        **{c: zero() for c in ("accrual", "gl_adj", "neg_reclass", "fx_adj", "other_adj")},
        "unaudited": money(-F.col("lc_close")),
        "currency": "currency",
        "doc_amount": money(-F.col("fc_close")),
    })


def ap_control_rows(
    trial_balance: DataFrame, temp: DataFrame, rules: LedgerRules, zero_unaudited: bool = False
) -> DataFrame:
    """Control accounts of the trial balance; one of them carries the total reclassification."""
    # The totals of the schedule come by scalar subquery: nothing is joined, only one row moves.
    # All columns are totalled together, so that the subquery reads the very shuffles that the
    # schedule itself reads instead of scanning the ledger again for one column.
    figures = [f.name for f in temp.schema.fields if f.dataType.typeName() == "decimal"]
    totals = temp.select(F.struct(*[F.sum(c).alias(c) for c in figures])).scalar()
    reclassified = money(-totals["neg_reclass"])

    def only(account: str, value: Column) -> Column:
        return money(F.when(F.col("account_code") == account, value).otherwise(zero()))

    closing = money("lc_close")
    rows = as_columns(
        trial_balance.filter(sub_account("account_code", rules.payable_prefix)), {
            "party_code": "account_code",
            "party_name": "account_name",
            "tb_class": text(""),
            "nature": text(""),
            "opening": money(-F.col("lc_open")),
            "increase": zero(),
            "decrease": money(F.col("lc_close") - F.col("lc_open")),
            "closing": money(-F.col("lc_close")),
            "accrual": only(rules.accrual_account, closing),
            "gl_adj": only(rules.gl_adjustment_account, closing),
            "neg_reclass": only(rules.neg_reclass_account, reclassified),
            "fx_adj": only(rules.fx_account, closing),
            "other_adj": zero(),
            "currency": "currency",
            "doc_amount": zero(),
        })
    unaudited = (
        zero() if zero_unaudited else total_of("closing", "accrual", "gl_adj", "neg_reclass", "fx_adj")
    )
    return rows.withColumn("unaudited", unaudited).select(*DETAIL)


def ap_schedule(parties: DataFrame, control: DataFrame, misc: DataFrame, accrued: DataFrame) -> DataFrame:
    """The payables schedule; `section` keeps the order of its parts."""
    blank = ap_blank(parties.sparkSession)
    parts = [parties, blank, misc, blank, control, accrued]
    numbered = [part.select(*DETAIL, F.lit(n).alias("section")) for n, part in enumerate(parts, start=1)]
    return reduce(DataFrame.union, numbered)


# ----------------------------------------------------------------------------- FX rollback

def ap_fx_temp(temp: DataFrame, fx_rates: DataFrame, rules: LedgerRules) -> DataFrame:
    """Foreign-currency rows restated at the period-end rate; without a rate they turn NULL."""
    foreign = F.col("currency") != rules.base_currency
    restated = money(F.round(F.col("doc_amount_pre") * rate_of("currency", fx_rates), 2))
    return temp.withColumns({
        "fx_adj": F.when(foreign, money(restated - F.col("unaudited"))).otherwise(F.col("fx_adj")),
        "unaudited": F.when(foreign, restated).otherwise(F.col("unaudited")),
    }).withColumn("doc_amount", _doc_unless_zero()).select(*DETAIL, "doc_amount_pre")


# ------------------------------------------------------------------------------ adjustments

def ap_adj_temp(temp: DataFrame, adjustments: DataFrame) -> DataFrame:
    """Manual adjustments laid over the rollforward, then reclassified again."""
    kinds = {kind: f"{kind}_amount" for kind in (fv.GL, fv.CONSTRUCTION, fv.REBATE)}
    rows = adjustments.filter(F.col("ledger") == fv.PAYABLE).select(*KEYS, "kind", money("amount").alias("amount"))
    temp = overlaid(temp, rows, KEYS, kinds, by=[*KEYS, *NAME])
    built = F.col("construction_amount")
    adjusted = temp.withColumns({
        "decrease": money(F.col("decrease") + F.coalesce(built, zero())),
        "closing": money(F.col("closing") - F.coalesce(built, zero())),
        "accrual": F.coalesce(built, F.col("accrual")),
        "gl_adj": F.coalesce(F.col("gl_amount"), F.col("gl_adj")),
        "other_adj": F.coalesce(F.col("rebate_amount"), F.col("other_adj")),
    })
    return _reclassify(adjusted).withColumn("doc_amount", _doc_unless_zero()).select(*DETAIL, "doc_amount_pre")


# ------------------------------------------------------------------------------ prepayments

def _prepaid_doc(rules: LedgerRules) -> Column:
    home = F.col("currency") == rules.base_currency
    return F.when(home, F.col("neg_reclass")).otherwise(_negated("doc_amount_pre"))


def _negated(column: str) -> Column:
    return money(-F.col(column))


_IDENTITY = {c: c for c in ("party_code", "party_name", "tb_class", "nature")}


def _flipped_rollforward() -> dict[str, Column]:
    """A debit balance shown as an asset: what decreased the payable increases the prepayment."""
    return {
        "opening": _negated("opening"),
        "increase": _negated("decrease"),
        "decrease": _negated("increase"),
        "closing": _negated("closing"),
    }


def prepaid_detail(temp: DataFrame, rules: LedgerRules) -> DataFrame:
    return as_columns(temp.filter(F.col("neg_reclass") > 0), {
        **_IDENTITY,
        "closing": _negated("closing"),
        "neg_reclass": zero(),
        "accrual": _negated("accrual"),
        "fx_adj": _negated("fx_adj"),
        "other_adj": _negated("other_adj"),
        "prepaid": "neg_reclass",
        "other_noncurrent": zero(),
        "currency": "currency",
        "doc_amount": _prepaid_doc(rules),
    })


def prepaid_fx_detail(fx_temp: DataFrame, rules: LedgerRules) -> DataFrame:
    return as_columns(fx_temp.filter(F.col("neg_reclass") > 0), {
        **_IDENTITY,
        **_flipped_rollforward(),
        "prepaid": "neg_reclass",
        "other_noncurrent": zero(),
        "currency": "currency",
        "doc_amount": _prepaid_doc(rules),
    })


def prepaid_adj_detail(adj_temp: DataFrame, rules: LedgerRules) -> DataFrame:
    return as_columns(adj_temp.filter(F.col("neg_reclass") > 0), {
        **_IDENTITY,
        **_flipped_rollforward(),
        "neg_reclass": zero(),
        "accrual": _negated("accrual"),
        "fx_adj": _negated("fx_adj"),
        "other_adj": _negated("other_adj"),
        "prepaid": "neg_reclass",
        "other_noncurrent": zero(),
        "currency": "currency",
        "doc_amount": _prepaid_doc(rules),
    })
