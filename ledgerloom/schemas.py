"""Declared schemas of the canonical tables; every load casts to these, nothing is inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.types import DecimalType, IntegerType, LongType, StringType, StructField, StructType

AMOUNT = "decimal(19,2)"  # one ledger line
MONEY = "decimal(38,2)"  # sums: 19 digits overflow once enough lines add up
RATE = "decimal(19,4)"

_TYPES = {
    "text": StringType(), "amount": DecimalType(19, 2), "rate": DecimalType(19, 4), "int": IntegerType(),
    "long": LongType(),
}


def _struct(**fields: str) -> StructType:
    return StructType([StructField(name, _TYPES[kind]) for name, kind in fields.items()])


_ITEM = dict(
    company_code="text", account_code="text", account_name="text", party_code="text",
    party_name="text", doc_currency="text", doc_amount="amount", local_currency="text",
    local_amount="amount",
)
_ASSET = dict(
    company_code="text", asset_no="text", asset_class="text", asset_name="text", spec="text",
    in_service="text", cost="amount", accum_dep="amount", life_months="int", used_months="int",
)

TABLES: dict[str, StructType] = {
    "open_items": _struct(**_ITEM, period_tag="text", source_tag="text"),
    "postings": _struct(
        **_ITEM, dc_flag="text", doc_type="text", doc_no="text", reversal_of="text", source_tag="text",
    ),
    "accruals": _struct(
        vendor_code="text", vendor_name="text", currency="text", company_code="text",
        misc_charge="text", accrual_local="amount", accrual_doc="amount",
    ),
    "fx_revaluation": _struct(
        party_code="text", gl_account="text", currency="text", posted_amount="amount",
    ),
    "trial_balance": _struct(
        account_code="text", account_name="text", currency="text",
        fc_open="amount", fc_debit="amount", fc_credit="amount", fc_close="amount",
        lc_open="amount", lc_debit="amount", lc_credit="amount", lc_close="amount",
    ),
    "fx_rates": _struct(currency_name="text", rate="rate", currency="text"),
    "asset_register": _struct(**_ASSET, period_tag="text"),
    "asset_scrapped": _struct(**_ASSET, disposal_date="text", period_tag="text"),
    "asset_postings": _struct(
        company_code="text", fiscal_year="int", period="int", posting_date="text", doc_no="text",
        doc_type="text", gl_account="text", gl_text="text", dc_flag="text", currency="text",
        amount="amount", text="text", reversal_of="text", asset_no="text", txn_code="text",
        ref_proc="text", txn_type="text", id="long",
    ),
    "cost_postings": _struct(
        entry_date="text", period="text", doc_no="text", account_code="text", account_name="text",
        amount="amount", text="text", func_area="text",
    ),
    "adjustments": _struct(
        party_code="text", party_name="text", currency="text", amount="amount", kind="text", ledger="text",
    ),
    "projects": _struct(
        company_group="text", company_name="text", project_year="text", project_month="text",
    ),
}


def conform(df: DataFrame, table: str) -> DataFrame:
    """Cast the columns of `df` that `table` declares, in declared order; keep only those."""
    present = set(df.columns)
    return df.selectExpr(
        *[f"cast({f.name} AS {f.dataType.simpleString()}) AS {f.name}" for f in TABLES[table].fields if f.name in present]
    )
