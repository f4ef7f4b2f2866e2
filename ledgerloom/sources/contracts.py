"""Contracts: which columns an export must hold, what they are called here, and their types."""

from __future__ import annotations

from dataclasses import dataclass, field

from ledgerloom.schemas import TABLES


@dataclass(frozen=True)
class Contract:
    """One export. `columns` maps required source columns to canonical names, in order.

    Without columns the export passes through whole. `table` names the canonical table whose
    types apply. `header_row` is the zero-based line of the header in text files. `positions` adds
    `id`, the row's number in the source.
    """

    table: str | None = None
    columns: dict[str, str] = field(default_factory=dict)
    header_row: int = 0
    optional: bool = False
    positions: bool = False

    def __post_init__(self):
        if self.table and self.table not in TABLES:
            raise ValueError(f"unknown table {self.table!r}")


# Column headers of the accounting exports.
_VENDOR_ITEM = {
    "公司代码": "company_code",
    "总账科目": "account_code",
    "总账科目：长文本": "account_name",
    "供应商": "party_code",
    "供应商科目：名称 1": "party_name",
    "凭证货币代码": "doc_currency",
    "凭证货币价值": "doc_amount",
    "公司代码货币代码": "local_currency",
    "公司代码货币价值": "local_amount",
}
_CUSTOMER_ITEM = {
    "公司代码": "company_code",
    "总账科目": "account_code",
    "总账科目：短文本": "account_name",
    "客户": "party_code",
    "客户科目：姓名 1": "party_name",
    "凭证货币代码": "doc_currency",
    "凭证货币价值": "doc_amount",
    "公司代码货币代码": "local_currency",
    "公司代码货币价值": "local_amount",
}
_DOCUMENT = {
    "借/贷标识": "dc_flag",
    "凭证类型": "doc_type",
    "凭证编号": "doc_no",
    "冲销关于": "reversal_of",
}
_ACCRUAL = {
    "供应商编码": "vendor_code",
    "供应商名称": "vendor_name",
    "币种": "currency",
    "公司代码": "company_code",
    "杂费描述": "misc_charge",
    "结算金额": "accrual_local",
    "原币暂估金额": "accrual_doc",
}
_FX_REVALUATION = {
    "账户": "party_code",
    "总帐帐目": "gl_account",
    "货币": "currency",
    "记帐金额": "posted_amount",
}
TRIAL_BALANCE_COLUMNS = {
    "科目代码": "account_code",
    "科目名称": "account_name",
    "货币代码": "currency",
    "外币期初": "fc_open",
    "外币借方": "fc_debit",
    "外币贷方": "fc_credit",
    "外币期末": "fc_close",
    "本位币货币期初": "lc_open",
    "本位货币借方": "lc_debit",
    "本位货币贷方": "lc_credit",
    "本位货币期末": "lc_close",
}
_ASSET = {
    "公司代码": "company_code",
    "主资产号": "asset_no",
    "资产类别": "asset_class",
    "固定资产名称": "asset_name",
    "规格型号": "spec",
    "开始使用日期": "in_service",
    "原值": "cost",
    "累计折旧": "accum_dep",
    "折旧年限(月份)": "life_months",
    "已折旧年限(月份)": "used_months",
}
_SCRAPPED = _ASSET | {"注销日期": "disposal_date"}
_ASSET_POSTING = {
    "公司代码": "company_code",
    "财年": "fiscal_year",
    "记帐期间": "period",
    "过帐日期": "posting_date",
    "凭证编号": "doc_no",
    "凭证类型": "doc_type",
    "总账科目": "gl_account",
    "总账科目：短文本": "gl_text",
    "借/贷标识": "dc_flag",
    "公司代码货币代码": "currency",
    "公司代码货币价值": "amount",
    "文本": "text",
    "冲销关于": "reversal_of",
    "资产": "asset_no",
    "事务代码": "txn_code",
    "参考过程": "ref_proc",
    "事务类型": "txn_type",
}
_COST_POSTING = {
    "输入日期": "entry_date",
    "记帐期间": "period",
    "凭证编号": "doc_no",
    "总账科目": "account_code",
    "总账科目：短文本": "account_name",
    "公司代码货币价值": "amount",
    "文本": "text",
    "功能范围：文本": "func_area",
}

TRIAL_BALANCE = Contract(optional=True)

ARAP_CONTRACTS = {
    "FBL1H_THIS": Contract("open_items", _VENDOR_ITEM),
    "FBL1H_LAST": Contract("open_items", _VENDOR_ITEM),
    "FBL1H_OCCUR": Contract("postings", _VENDOR_ITEM | _DOCUMENT),
    "FBL5H_THIS": Contract("open_items", _CUSTOMER_ITEM),
    "FBL5H_LAST": Contract("open_items", _CUSTOMER_ITEM),
    "FBL5H_OCCUR": Contract("postings", _CUSTOMER_ITEM | _DOCUMENT),
    "ZFI072N_THIS": Contract("accruals", _ACCRUAL),
    "FOREIGN_CURRENCY": Contract("fx_revaluation", _FX_REVALUATION, header_row=8),
    "TB": TRIAL_BALANCE,
}
ASSET_CONTRACTS = {
    "ZFI022_THIS": Contract("asset_register", _ASSET),
    "ZFI022_LAST": Contract("asset_register", _ASSET),
    "ZFI022_THIS_SCRAP": Contract("asset_scrapped", _SCRAPPED),
    "ZFI022_LAST_SCRAP": Contract("asset_scrapped", _SCRAPPED),
    "FBL3H_OCCUR": Contract("asset_postings", _ASSET_POSTING, positions=True),
    "TB": TRIAL_BALANCE,
}
COST_CONTRACTS = {
    "FBL3H_THIS": Contract("cost_postings", _COST_POSTING),
    "TB": TRIAL_BALANCE,
}
TRIAL_BALANCE_CONTRACTS = {"TB": Contract()}
