"""Names, codes and labels that the workpapers must show or match exactly."""

# --- Fixed values: tags -------------------------------------------------------------
THIS, LAST = "this", "last"
VENDOR, CUSTOMER = "VENDOR", "CUSTOMER"
GL, CONSTRUCTION, REBATE = "gl", "construction", "rebate"
PAYABLE, RECEIVABLE = "payable", "receivable"
EMPTY_SOURCE = "empty"

# --- Fixed values: currency names of the rate table -> ISO codes ----------------------
CURRENCY_CODES = {
    "美元": "USD",
    "欧元": "EUR",
    "日元": "JPY",
    "港元": "HKD",
    "英镑": "GBP",
    "澳元": "AUD",
    "新西兰元": "NZD",
    "新加坡元": "SGD",
    "瑞士法郎": "CHF",
    "加元": "CAD",
    "澳门元": "MOP",
    "林吉特": "MYR",
    "卢布": "RUB",
    "兰特": "ZAR",
    "韩元": "KRW",
    "迪拉姆": "AED",
    "里亚尔": "SAR",
    "福林": "HUF",
    "兹罗提": "PLN",
    "丹麦克朗": "DKK",
    "瑞典克朗": "SEK",
    "挪威克朗": "NOK",
    "里拉": "TRY",
    "比索": "MXN",
    "泰铢": "THB",
}

# --- Fixed values: the 13 period columns of the expense matrix --------------------------
MONTHS = [f"{m}月" for m in range(1, 13)]
ADJUSTMENT_PERIOD = "13期调整"
PERIODS = [*MONTHS, ADJUSTMENT_PERIOD]
TOTAL_LABEL = "合计"

# --- Fixed values: the row of goods-receipt miscellaneous accruals -----------------------
MISC_ACCRUAL_CODE = "14010070"
MISC_ACCRUAL_NAME = "材料采购（GR/IR）-杂费"
MISC_ACCRUAL_CLASS = "其他"

# --- Fixed values: intangible asset classes ---------------------------------------------
INTANGIBLE_CLASSES = {
    "Z800": "土地",
    "Z810": "海域使用权",
    "Z820": "商标",
    "Z830": "软件",
    "Z840": "专利技术",
    "Z850": "非专利技术",
    "Z860": "特许权",
}

# --- Fixed values: finance cost lines, account -> (group, level 1, level 2) ----------------
FINANCE_COST_LINES = {
    "66030010": ("1", "利息支出", "银行贷款 or 企业借款"),
    "66030030": ("1", "利息支出", "票据贴息"),
    "66030070": ("2", "减：利息收入", "金融机构存款 or 企业借款"),
    "66038900": ("3", "汇兑损益", "金额"),
    "66030090": ("4", "其他", "手续费"),
}
INTEREST_INCOME_GROUP = "2"

# --- Fixed values: column-name fragments that decide the type of an adjustment column --------
TEXT_FRAGMENTS = ("编码", "名称", "币种", "code", "name", "currency")
MONEY_FRAGMENTS = ("金额", "amount")

# --- Fixed values: adjustment sheet names -> kind ------------------------------------------
ADJUSTMENT_SHEETS = {
    "总账调整": GL,
    "工程类暂估调整": CONSTRUCTION,
    "返利调整": REBATE,
}
ADJUSTMENT_LEDGERS = {"应付账款": PAYABLE, "应收账款": RECEIVABLE}

# --- Fixed values: column headers of the adjustment template --------------------------------
ADJUSTMENT_HEADERS = {"编码": "party_code", "名称": "party_name", "币种": "currency", "调整金额": "amount"}

# --- Fixed values: published view names -> workpaper names ------------------------------------
VIEW_NAMES = {
    "应付账款明细表_空白行": "ap_blank",
    "杂费暂估": "misc_accrual",
    "预提费用": "accrued_expense",
    "应付账款明细表_temp": "ap_temp",
    "应付账款明细表": "ap_detail",
    "预付账款明细表": "prepaid_detail",
    "应收账款明细表": "ar_detail",
    "预收账款明细表": "advance_receipts",
    "其他应收款明细表": "other_receivable_detail",
    "其他应付款明细表": "other_payable_detail",
    "应付账款明细表-外币倒轧_temp": "ap_fx_temp",
    "应付账款明细表-外币倒轧": "ap_fx_detail",
    "应收账款明细表-外币倒轧": "ar_fx_detail",
    "应收账款明细表-外币倒轧_temp": "ar_fx_temp",
    "预付账款明细表-外币倒轧": "prepaid_fx_detail",
    "预收账款明细表-外币倒轧": "advance_fx_receipts",
    "应付账款明细表_调整后_temp": "ap_adj_temp",
    "应付账款明细表_调整后": "ap_adj_detail",
    "应付账款明细表-外币倒轧_调整后_temp": "ap_fx_adj_temp",
    "应付账款明细表-外币倒轧_调整后": "ap_fx_adj_detail",
    "预付账款明细表_调整后": "prepaid_adj_detail",
    "预付账款明细表-外币倒轧_调整后": "prepaid_fx_adj_detail",
    "应收账款明细表_调整后": "ar_adj_detail",
    "应收账款明细表-外币倒轧_调整后": "ar_fx_adj_detail",
    "预收账款明细表_调整后": "advance_adj_receipts",
    "预收账款明细表-外币倒轧_调整后": "advance_fx_adj_receipts",
    "无形资产明细表": "intangible_detail",
}

# --- Fixed values: display labels of workpaper columns ------------------------------------------
PAYABLE_LABELS = {
    "party_code": "编码",
    "party_name": "供应商名称",
    "tb_class": "试算分类",
    "nature": "款项性质",
    "opening": "期初余额",
    "increase": "本期增加",
    "decrease": "本期减少",
    "closing": "期末余额",
    "accrual": "暂估金额",
    "gl_adj": "总账调整暂估",
    "neg_reclass": "负数调整",
    "fx_adj": "汇率调整",
    "other_adj": "其他调整",
    "unaudited": "未审期末余额",
    "prepaid": "预付账款",
    "other_noncurrent": "其他非流动资产",
    "currency": "币种",
    "doc_amount": "原币金额",
    "doc_amount_pre": "原币金额_调整前",
    "doc_amount_post": "原币金额_调整后",
}
RECEIVABLE_LABELS = {
    "account_code": "科目代码",
    "account_name": "科目名称",
    "party_code": "客商代码",
    "party_name": "对方单位",
    "opening": "期初余额",
    "increase": "本期增加",
    "decrease": "本期减少",
    "closing": "期末余额",
    "rate": "汇率",
    "fx_adj": "汇率调整",
    "reclass": "重分类调整",
    "gl_adj": "总账调整",
    "other_adj": "其他调整",
    "reported": "报表金额",
    "currency": "币种",
    "doc_amount": "原币金额",
    "doc_amount_pre": "原币金额_调整前",
}
ADVANCE_LABELS = {
    "party_code": "客户编码",
    "party_name": "客户名称",
    "relation": "关联关系",
    "sales_region": "内/外销",
    "opening": "期初余额",
    "increase": "本期增加",
    "decrease": "本期减少",
    "closing": "期末余额",
    "fx_adj": "汇率调整",
    "gl_adj": "总账调整",
    "other_adj": "其他调整",
    "unaudited": "期末未审",
    "currency": "币种",
    "closing_doc": "期末余额（原币）",
    "contract_liab": "合同负债",
    "other_cur_liab": "其他流动负债",
}
OTHER_LEDGER_LABELS = {
    "party_code": "编码",
    "party_name": "供应商名称",
    "currency": "币种",
    "opening": "期初余额",
    "debit": "本期借方",
    "credit": "本期贷方",
    "closing": "期末余额",
    "closing_doc": "期末余额_原币",
    "account_name": "科目名称",
    "account_code": "科目代码",
    "opening_adj": "期初调整",
    "ent_reclass": "企业重分类调整（负数）",
    "ent_other": "企业其他调整",
    "audited_opening": "期初审定余额",
    "reported": "企业未审报表数",
    "closing_doc_reported": "期末余额_原币_未审",
}
INTANGIBLE_LABELS = {
    "asset_no": "现资产号",
    "asset_class": "类别",
    "asset_name": "资产描述",
    "in_service": "资本化日期",
    "opening_cost": "期初余额_原值",
    "opening_accum": "期初余额_累计",
    "charge": "计提折旧",
    "life_months": "摊销期限（月）",
    "purchase": "购置",
}
COST_LABELS = {
    "seq": "序号",
    "account_code": "编码",
    "account_name": "项目",
    **{f"p{i:02d}": label for i, label in enumerate(PERIODS, start=1)},
    "total": TOTAL_LABEL,
}
FINANCE_COST_LABELS = {
    "seq": "序号",
    "level1": "一级科目",
    "level2": "二级科目",
    "amount": "未审数合计",
    "total": TOTAL_LABEL,
}
