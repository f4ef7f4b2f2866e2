"""Receivables and advance receipts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ledgerloom import fixed_values as fv
from ledgerloom.functions.columns import any_null, as_columns, money, or_zero, rate_of, shortfall, text, total_of, zero
from ledgerloom.functions.joins import left_outer
from ledgerloom.functions.pairing import overlaid
from ledgerloom.rules import LedgerRules

KEYS = ["account_code", "account_name", "party_code", "party_name", "currency"]
ROLLFORWARD = ["opening", "increase", "decrease", "closing"]


def ar_detail(
    open_items: DataFrame, postings: DataFrame, fx_revaluation: DataFrame, rules: LedgerRules
) -> DataFrame:
    """Receivable rollforward per account, party and currency.

    Opening, closing and increase carry the same five keys, so one union and one grouping
    replace two full outer joins: one scan per table and one shuffle of partial sums.
    """
    items = open_items.filter(
        F.col("account_name").contains(rules.receivable_pattern)
        & F.col("period_tag").isin(fv.LAST, fv.THIS)
    )
    last = F.col("period_tag") == fv.LAST
    key_columns = {c: c for c in KEYS} | {"currency": "doc_currency"}
    nothing = F.lit(None).cast("decimal(19,2)")
    balances = as_columns(items, {
        **key_columns,
        "source": "period_tag",
        "opening": F.when(last, F.col("local_amount")),
        "closing": F.when(~last, F.col("local_amount")),
        "closing_doc": F.when(~last, F.col("doc_amount")),
        "increase": nothing,
    })
    moves = as_columns(
        postings.filter(
            F.col("account_name").contains(rules.receivable_pattern)
            & (F.col("doc_type") == rules.receivable_increase_type)
        ), {
            **key_columns,
            # Posting exports pad the account code; through a number it matches the balances.
            "account_code": F.col("account_code").cast("bigint").cast("string"),
            "source": text("moved"),
            "opening": nothing,
            "closing": nothing,
            "closing_doc": nothing,
            "increase": "local_amount",
        })
    # A key with a NULL matches nothing: keep such rows apart by source.
    rows = balances.unionByName(moves).withColumn("_apart", F.when(any_null(*KEYS), F.col("source")))
    totals = (
        rows.groupBy(*KEYS, "_apart")
        .agg(
            F.max(F.col("source") == fv.LAST).alias("has_opening"),
            *[money(F.sum(c)).alias(c) for c in ("opening", "closing", "closing_doc", "increase")],
        )
        .drop("_apart")
    )
    revaluation = (
        fx_revaluation.filter(
            F.col("gl_account").isin(*rules.receivable_fx_accounts) & F.col("party_code").isNotNull()
        )
        .groupBy(F.col("gl_account").alias("account_code"), "party_code", "currency")
        .agg(money(F.sum("posted_amount")).alias("fx_adj"))
    )
    # Revaluation belongs to the opening side: a row without an opening balance gets none.
    detail = left_outer(totals, revaluation, ["account_code", "party_code", "currency"], by=KEYS).withColumns({
        "fx_adj": F.when(F.col("has_opening"), or_zero("fx_adj")).otherwise(zero()),
        "increase": or_zero("increase"),
        "closing": or_zero("closing"),
    })
    exposed = F.col("closing") + F.col("fx_adj")
    tested = F.col("closing") if rules.receivable_sign_test_ignores_fx else exposed
    return detail.withColumns({
        "decrease": money(F.col("increase") + or_zero("opening") - F.col("closing")),
        "reclass": shortfall(money(exposed)),
        "reported": money(exposed + shortfall(money(tested))),
    }).withColumn(
        "doc_amount", F.when(F.col("reported") == 0, zero()).otherwise(or_zero("closing_doc"))
    ).select(
        "account_code", "account_name", "party_code", "party_name", *ROLLFORWARD, "fx_adj", "reclass",
        "reported", "currency", "doc_amount",
    )


def ar_fx_temp(detail: DataFrame, fx_rates: DataFrame, rules: LedgerRules) -> DataFrame:
    """Foreign-currency receivables restated at the period-end rate.

    Without a rate the reported amount is NULL and nothing is reclassified.
    """
    foreign = F.col("currency") != rules.base_currency
    rated = detail.withColumn("rate", rate_of("currency", fx_rates))
    converted = F.col("doc_amount") * F.col("rate")
    restated = money(converted)
    return rated.select(
        "account_code", "account_name", "party_code", "party_name", *ROLLFORWARD,
        F.col("rate").cast("decimal(19,4)").alias("rate"),
        F.when(foreign, money(converted - F.col("closing"))).otherwise(zero()).alias("fx_adj"),
        F.when(foreign, shortfall(restated)).otherwise(shortfall(F.col("closing"))).alias("reclass"),
        F.when(foreign, restated)
        .otherwise(F.when(F.col("closing") < 0, zero()).otherwise(F.col("closing"))).alias("reported"),
        "currency",
        # Tests the amount reported before restatement.
        F.when(F.col("reported") < 0, zero()).otherwise(F.col("doc_amount")).alias("doc_amount"),
        F.col("doc_amount").alias("doc_amount_pre"),
    )


def ar_fx_detail(fx_temp: DataFrame) -> DataFrame:
    return fx_temp.drop("doc_amount_pre")


def ar_adj_detail(detail: DataFrame, adjustments: DataFrame) -> DataFrame:
    """Ledger and rebate adjustments laid over the receivables, then reclassified again."""
    keys = ["party_code", "currency"]
    rows = adjustments.filter(F.col("ledger") == fv.RECEIVABLE).select(*keys, "kind", money("amount").alias("amount"))
    kinds = {fv.GL: "gl_adj", fv.REBATE: "other_adj"}
    detail = overlaid(detail, rows, keys, kinds, by=KEYS).withColumns({name: or_zero(name) for name in kinds.values()})
    pressure = total_of("closing", "fx_adj", "gl_adj", "other_adj")
    return detail.select(
        "account_code", "account_name", "party_code", "party_name", *ROLLFORWARD, "fx_adj",
        shortfall(pressure).alias("reclass"),
        "gl_adj", "other_adj",
        money(pressure + shortfall(pressure)).alias("reported"),
        "currency",
        F.when(pressure < 0, zero()).otherwise(F.col("doc_amount")).alias("doc_amount"),
    )


def advance_receipts(
    detail: DataFrame, rules: LedgerRules, adjustments: tuple[str, ...] = (), doc: str = "doc_amount"
) -> DataFrame:
    """Credit balances of receivables as advance receipts, split into net and tax.

    `adjustments` names further adjustment columns that count towards the balance.
    """
    parts = ["closing", "fx_adj", *adjustments]
    negated: dict[str, Column] = {c: money(-F.col(c)) for c in parts}
    advances = as_columns(detail.filter(F.col("reclass") > 0), {
        "party_code": "party_code",
        "party_name": "party_name",
        "relation": text(""),
        "sales_region": text(""),
        "opening": money(-F.col("opening")),
        "increase": "decrease",
        "decrease": "increase",
        **negated,
        "unaudited": money(-total_of(*parts)),
        "currency": "currency",
        "closing_doc": money(-F.col(doc)),
    })
    abroad = F.col("currency") != rules.base_currency
    net = F.when(abroad, F.col("unaudited")).otherwise(
        money(F.col("unaudited") / F.lit(rules.vat_divisor))
    )
    return advances.withColumn("contract_liab", net).withColumn(
        "other_cur_liab", money(F.col("unaudited") - F.col("contract_liab"))
    )
