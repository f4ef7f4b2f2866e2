"""Other receivables and other payables: one shared detail, presented from either side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ledgerloom import fixed_values as fv
from ledgerloom.functions.columns import money, null_row, or_zero, prefix_in, shortfall, zero
from ledgerloom.functions.joins import no_spread, null_spread
from ledgerloom.functions.pairing import gathered, lines, paired
from ledgerloom.rules import LedgerRules

KEYS = ["party_code", "currency", "account_code"]
LABELS = ["party_name", "account_name"]
COLUMNS = [
    "party_code", "party_name", "currency", "opening", "debit", "credit", "closing", "closing_doc",
    "account_name", "account_code", "opening_adj", "ent_reclass", "ent_other", "audited_opening",
    "reported", "closing_doc_reported",
]


def _is_payable(rules: LedgerRules) -> Column:
    return F.col("account_code").startswith(rules.other_payable_prefix)


def _own_accounts(rules: LedgerRules) -> Column:
    return prefix_in("account_code", rules.other_receivable_prefix, rules.other_payable_prefix)


def _signed(value: Column, rules: LedgerRules) -> Column:
    """Receivables debit-positive, payables credit-positive."""
    return money(F.when(_is_payable(rules), -value).otherwise(value))


def cleared_documents(postings: DataFrame, rules: LedgerRules) -> DataFrame:
    """Documents whose clearing lines on these accounts net to zero."""
    return (
        postings.filter(
            _own_accounts(rules) & (F.col("doc_type") == rules.clearing_type) & F.col("doc_no").isNotNull()
        )
        .groupBy("doc_no").agg(money(F.sum("local_amount")).alias("doc_total"))
        .filter(F.col("doc_total") == 0)
    )


def uncleared_lines(postings: DataFrame, rules: LedgerRules) -> DataFrame:
    """Increases per document, party, currency and account (`moved`), without cleared documents.

    Lines are summed per document and party first, so a document that holds a large share of
    the lines shrinks before the join; lines without a document number, which match nothing,
    are spread over many tasks.
    """
    payable = _is_payable(rules)
    increases = (payable & (F.col("dc_flag") == rules.credit_flag)) | (
        ~payable & (F.col("dc_flag") == rules.debit_flag)
    )
    by = ["party_code", "party_name", "doc_currency", "account_code", "account_name"]
    documents = (
        postings.filter(_own_accounts(rules) & increases)
        .groupBy("doc_no", *by).agg(F.sum("local_amount").alias("moved"))
        .selectExpr("*", null_spread(["doc_no"], by))
    )
    cleared = cleared_documents(postings, rules).selectExpr("doc_no", no_spread(["doc_no"]))
    return documents.join(cleared, ["doc_no", "_spread"], "left_anti")


def movement(postings: DataFrame, rules: LedgerRules) -> DataFrame:
    """Increase per party, currency and account, without cleared documents."""
    moved = uncleared_lines(postings, rules).groupBy(
        "party_code", "party_name", F.col("doc_currency").alias("currency"), "account_code", "account_name"
    ).agg(F.sum("moved").alias("moved"))
    return moved.withColumn("increase", _signed(F.col("moved"), rules)).drop("moved")


def ledger_totals(open_items: DataFrame, postings: DataFrame, rules: LedgerRules) -> DataFrame:
    """The totals of each party, currency and account as arrays by source; balances that net to 0 are left out."""
    items = open_items.filter(_own_accounts(rules) & F.col("period_tag").isin(fv.THIS, fv.LAST))
    this = F.col("period_tag") == fv.THIS
    columns = {c: c for c in (*KEYS, *LABELS)} | {"currency": "doc_currency"}
    parts = [
        lines(items, F.when(this, F.lit("closing")).otherwise(F.lit("opening")), columns, F.col("local_amount"), F.when(this, F.col("doc_amount"))),
        lines(uncleared_lines(postings, rules), F.lit("increase"), columns, F.col("moved")),
    ]
    return gathered(parts, KEYS, LABELS, {"opening": money("local") != 0, "closing": money("local") != 0, "increase": None})


def ledger_detail(open_items: DataFrame, postings: DataFrame, rules: LedgerRules) -> DataFrame:
    """Opening, debit, credit and closing of both sides; the account code tells the side."""
    sources = ["opening", "closing", "increase"]
    rows = paired(ledger_totals(open_items, postings, rules), sources, LABELS)
    both = rows.select(
        *KEYS, *LABELS, *[_signed(F.col(s)["local"], rules).alias(s) for s in sources],
        _signed(F.col("closing")["doc"], rules).alias("closing_doc"),
    )
    filled = both.withColumns({c: or_zero(c) for c in ("opening", "closing", "closing_doc", "increase")})
    # The side that carries the recorded increase; the other one is the balancing figure.
    plug = money(F.col("opening") + F.col("increase") - F.col("closing"))
    return filled.withColumns({
        "debit": F.when(_is_payable(rules), plug).otherwise(F.col("increase")),
        "credit": F.when(_is_payable(rules), F.col("increase")).otherwise(plug),
        "opening_adj": shortfall(F.col("opening")),
        "ent_reclass": shortfall(F.col("closing")),
        "ent_other": zero(),
    })


def other_ledger_schedule(detail: DataFrame, side: str, rules: LedgerRules) -> DataFrame:
    """Own accounts, a separator, and the other side's negative balances reclassified here."""
    own = _is_payable(rules) if side == fv.PAYABLE else ~_is_payable(rules)
    rows = detail.filter(own | (F.col("closing") < 0) | (F.col("opening") < 0)).withColumn("_own", own)

    def by_owner(mine: Column, theirs: Column) -> Column:
        return money(F.when(F.col("_own"), mine).otherwise(theirs))

    reclassed = F.col("ent_reclass") + F.col("ent_other")
    presented = rows.withColumns({
        "section": F.when(F.col("_own"), F.lit(1)).otherwise(F.lit(3)),
        "audited_opening": by_owner(F.col("opening") + F.col("opening_adj"), F.col("opening_adj")),
        "reported": by_owner(F.col("closing") + reclassed, reclassed),
        "closing_doc_reported": by_owner(
            F.greatest(F.col("closing_doc"), zero()), shortfall(F.col("closing_doc"))
        ),
        "opening": by_owner(F.col("opening"), zero()),
        "closing": by_owner(F.col("closing"), zero()),
    }).select(*COLUMNS, "section")
    types = {f.name: f.dataType.simpleString() for f in presented.schema.fields[:-1]}
    separator = null_row(detail.sparkSession, types).withColumn("section", F.lit(2))
    return presented.unionByName(separator)
