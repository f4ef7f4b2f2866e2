
W = "DECIMAL(38,2)"


def w(expression: str) -> str:
    return f"CAST({expression} AS {W})"


def z(expression: str) -> str:
    return f"coalesce({w(expression)}, 0)"


def _schedule(temp: str, control: str, doc: str) -> str:
    columns = (
        "party_code, party_name, tb_class, nature, opening, increase, decrease, closing, accrual, gl_adj, "
        "neg_reclass, fx_adj, other_adj, unaudited, currency, "
    )
    nulls = ", ".join(["NULL"] * 16)
    return f"""
SELECT {columns} {doc} AS doc_amount, 1 AS section FROM {temp}
UNION ALL SELECT {nulls}, 2
UNION ALL SELECT {columns} doc_amount, 3 FROM misc_accrual
UNION ALL SELECT {nulls}, 4
UNION ALL SELECT {columns} doc_amount, 5 FROM {control}
UNION ALL SELECT {columns} doc_amount, 6 FROM accrued_expense"""


def _control(temp: str, unaudited: str = "closing + accrual + gl_adj + neg_reclass + fx_adj") -> str:
    return f"""
SELECT party_code, party_name, tb_class, nature, opening, increase, decrease, closing, accrual, gl_adj, neg_reclass,
  fx_adj, other_adj, {w(unaudited)} AS unaudited, currency, doc_amount
FROM (
  SELECT account_code AS party_code, account_name AS party_name, '' AS tb_class, '' AS nature,
    {w('-lc_open')} AS opening, {w('0')} AS increase, {w('lc_close - lc_open')} AS decrease,
    {w('-lc_close')} AS closing,
    {w("CASE account_code WHEN '22026000' THEN lc_close ELSE 0 END")} AS accrual,
    {w("CASE account_code WHEN '22029000' THEN lc_close ELSE 0 END")} AS gl_adj,
    {w(f"CASE account_code WHEN '22029900' THEN (SELECT -sum(neg_reclass) FROM {temp}) ELSE 0 END")} AS neg_reclass,
    {w("CASE account_code WHEN '22028900' THEN lc_close ELSE 0 END")} AS fx_adj,
    {w('0')} AS other_adj, currency, {w('0')} AS doc_amount
  FROM trial_balance WHERE account_code LIKE '2202%' AND substr(account_code, 5, 1) > '0'
)"""


def _adjusted_payables(temp: str) -> str:
    overlays = "\n".join(
        f"  LEFT JOIN (SELECT party_code, currency, amount AS {kind} FROM adjustments "
        f"WHERE ledger = 'payable' AND kind = '{kind}') USING (party_code, currency)"
        for kind in ("gl", "construction", "rebate")
    )
    return f"""
SELECT party_code, party_name, tb_class, nature, opening, increase, decrease, closing, accrual, gl_adj,
  {w('CASE WHEN s < 0 THEN -s ELSE 0 END')} AS neg_reclass, fx_adj, other_adj,
  {w('s + CASE WHEN s < 0 THEN -s ELSE 0 END')} AS unaudited, currency,
  {w('CASE WHEN s + (CASE WHEN s < 0 THEN -s ELSE 0 END) = 0 THEN 0 ELSE doc_amount_pre END')} AS doc_amount,
  doc_amount_pre
FROM (
  SELECT *, {w('closing + accrual + fx_adj + gl_adj + other_adj')} AS s
  FROM (
    SELECT t.* REPLACE (
      {w('t.decrease + coalesce(construction, 0)')} AS decrease,
      {w('t.closing - coalesce(construction, 0)')} AS closing,
      {w('coalesce(construction, t.accrual)')} AS accrual,
      {w('coalesce(gl, t.gl_adj)')} AS gl_adj,
      {w('coalesce(rebate, t.other_adj)')} AS other_adj)
    FROM {temp} t
{overlays}
  )
)"""


def _adjusted_prepaid(temp: str) -> str:
    return f"""
SELECT party_code, party_name, tb_class, nature, -opening AS opening, -decrease AS increase,
  -increase AS decrease, -closing AS closing, {w('0')} AS neg_reclass, -accrual AS accrual, -fx_adj AS fx_adj,
  -other_adj AS other_adj, neg_reclass AS prepaid, {w('0')} AS other_noncurrent, currency,
  CASE currency WHEN 'CNY' THEN neg_reclass ELSE -doc_amount_pre END AS doc_amount
FROM {temp} WHERE neg_reclass > 0"""


def _adjusted_receivables(detail: str) -> str:
    return f"""
SELECT account_code, account_name, party_code, party_name, opening, increase, decrease, closing, fx_adj,
  {w('CASE WHEN total < 0 THEN -total ELSE 0 END')} AS reclass, gl_adj, other_adj,
  {w('total + CASE WHEN total < 0 THEN -total ELSE 0 END')} AS reported, currency,
  CASE WHEN total < 0 THEN 0 ELSE doc_amount END AS doc_amount
FROM (
  SELECT d.*, {z('g.amount')} AS gl_adj, {z('r.amount')} AS other_adj,
    {w('d.closing + d.fx_adj + coalesce(g.amount, 0) + coalesce(r.amount, 0)')} AS total
  FROM {detail} d
  LEFT JOIN (FROM adjustments WHERE ledger = 'receivable' AND kind = 'gl') g
    ON g.party_code = d.party_code AND g.currency = d.currency
  LEFT JOIN (FROM adjustments WHERE ledger = 'receivable' AND kind = 'rebate') r
    ON r.party_code = d.party_code AND r.currency = d.currency
)"""


def _advances(detail: str, doc: str = "doc_amount", adjusted: bool = False) -> str:
    more = "-gl_adj AS gl_adj, -other_adj AS other_adj," if adjusted else ""
    total = "-(closing + fx_adj + gl_adj + other_adj)" if adjusted else "-(closing + fx_adj)"
    return f"""
SELECT *, {w('unaudited - contract_liab')} AS other_cur_liab
FROM (
  SELECT party_code, party_name, '' AS relation, '' AS sales_region, -opening AS opening, decrease AS increase,
    increase AS decrease, -closing AS closing, -fx_adj AS fx_adj, {more} {w(total)} AS unaudited, currency,
    -{doc} AS closing_doc,
    CASE WHEN currency <> 'CNY' THEN {w(total)} ELSE {w(f'round({total} / 1.13, 2)')} END AS contract_liab
  FROM {detail} WHERE reclass > 0
)"""


def _other_schedule(mine: str, theirs: str) -> str:
    return f"""
SELECT party_code, party_name, currency, opening, debit, credit, closing, closing_doc, account_name, account_code,
  opening_adj, ent_reclass, {w('0')} AS ent_other, {w('opening + opening_adj')} AS audited_opening,
  {w('closing + ent_reclass')} AS reported, greatest(closing_doc, 0) AS closing_doc_reported, 1 AS section
FROM {mine}
UNION ALL SELECT {', '.join(['NULL'] * 16)}, 2
UNION ALL
SELECT party_code, party_name, currency, 0, debit, credit, 0, closing_doc, account_name, account_code, opening_adj,
  ent_reclass, 0, opening_adj, ent_reclass, greatest(-closing_doc, 0), 3
FROM {theirs} WHERE closing < 0 OR opening < 0"""


def _other_side(prefix: str, sign: str, flag: str, debit: str, credit: str) -> str:
    def balance(tag: str) -> str:
        return f"""(
    SELECT party_code, party_name, doc_currency AS currency, account_name, account_code,
      {w(f'{sign}sum(local_amount)')} AS amount, {w(f'{sign}sum(doc_amount)')} AS doc
    FROM open_items WHERE account_code LIKE '{prefix}%' AND period_tag = '{tag}'
    GROUP BY ALL HAVING sum(local_amount) <> 0
  )"""

    return f"""
SELECT *, {w(debit)} AS debit, {w(credit)} AS credit,
  {w('greatest(-opening, 0)')} AS opening_adj, {w('greatest(-closing, 0)')} AS ent_reclass
FROM (
  SELECT party_code, coalesce(o.party_name, c.party_name, v.party_name) AS party_name, currency, account_code,
    coalesce(o.account_name, c.account_name, v.account_name) AS account_name,
    {z('o.amount')} AS opening, {z('c.amount')} AS closing, {z('c.doc')} AS closing_doc, {z('v.increase')} AS increase
  FROM {balance('last')} o
  FULL JOIN {balance('this')} c USING (party_code, currency, account_code)
  FULL JOIN (
    SELECT * FROM other_movement WHERE account_code LIKE '{prefix}%'
  ) v USING (party_code, currency, account_code)
)"""


def _cost(area: str) -> str:
    labels = [f"{i}月" for i in range(1, 13)] + ["13期调整"]
    figures = ", ".join(
        f"{w(f'coalesce(sum(amount) FILTER (label = {chr(39)}{label}{chr(39)}), 0)')} AS p{i:02d}"
        for i, label in enumerate(labels, start=1)
    )
    names = [f"p{i:02d}" for i in range(1, 14)]
    sums = ", ".join(w(f"sum({n})") for n in [*names, "total"])
    return f"""
WITH matrix AS (
  SELECT *, {w(' + '.join(names))} AS total
  FROM (
    SELECT account_code, account_name, {figures}
    FROM (
      SELECT account_code, account_name, amount,
        CASE WHEN CAST(CAST(period AS DOUBLE) AS INTEGER) > 12 THEN '13期调整'
             ELSE CAST(CAST(period AS DOUBLE) AS INTEGER) || '月' END AS label
      FROM cost_postings WHERE func_area = '{area}' AND account_name <> 'temp'
    )
    GROUP BY account_code, account_name
  )
)
SELECT CAST(row_number() OVER (ORDER BY account_code, account_name) AS INTEGER) AS seq, account_code, account_name,
  {', '.join(names)}, total, 1 AS section
FROM matrix
UNION ALL SELECT {', '.join(['NULL'] * 17)}, 2
UNION ALL SELECT NULL, NULL, '合计', {sums}, 3 FROM matrix"""


_NAMES = "party_code, party_name, doc_currency AS currency"

WORKPAPERS = {
    # ------------------------------------------------------------------------------ payables
    "misc_accrual": f"""
SELECT '14010070' AS party_code, '材料采购（GR/IR）-杂费' AS party_name, '其他' AS tb_class, '' AS nature,
  {w('0')} AS opening, {w('0')} AS increase, {w('0')} AS decrease, {w('0')} AS closing,
  {w('sum(accrual_local)')} AS accrual, {w('0')} AS gl_adj, {w('0')} AS neg_reclass, {w('0')} AS fx_adj,
  {w('0')} AS other_adj, {w('sum(accrual_local)')} AS unaudited, currency, {w('sum(accrual_doc)')} AS doc_amount
FROM accruals WHERE misc_charge IS NOT NULL GROUP BY currency""",
    "accrued_expense": f"""
SELECT account_code AS party_code, account_name AS party_name, '' AS tb_class, '' AS nature,
  {w('-lc_open')} AS opening, {w('lc_credit')} AS increase, {w('lc_debit')} AS decrease, {w('-lc_close')} AS closing,
  {w('0')} AS accrual, {w('0')} AS gl_adj, {w('0')} AS neg_reclass, {w('0')} AS fx_adj, {w('0')} AS other_adj,
  {w('-lc_close')} AS unaudited, currency, {w('-fc_close')} AS doc_amount
FROM trial_balance WHERE account_code LIKE '2251%'""",
    "ap_items": "SELECT * FROM open_items WHERE account_name LIKE '%Accounts payable%' AND source_tag = 'VENDOR'",
    "ap_closing": f"""
SELECT {_NAMES}, {w('-sum(local_amount)')} AS closing, {w('-sum(doc_amount)')} AS closing_doc
FROM ap_items WHERE period_tag = 'this' GROUP BY party_code, party_name, doc_currency""",
    "ap_opening": f"""
SELECT {_NAMES}, {w('-sum(local_amount)')} AS opening
FROM ap_items WHERE period_tag = 'last' GROUP BY party_code, party_name, doc_currency""",
    "ap_increase": f"""
SELECT {_NAMES}, {w('-sum(local_amount)')} AS increase
FROM postings WHERE source_tag = 'VENDOR' AND account_code LIKE '2202%' AND doc_type IN ('OA', 'RE')
GROUP BY party_code, party_name, doc_currency""",
    "ap_accrual": f"""
SELECT vendor_code AS party_code, vendor_name AS party_name, currency, {w('sum(accrual_local)')} AS accrual,
  {w('sum(accrual_doc)')} AS accrual_doc
FROM accruals WHERE misc_charge IS NULL GROUP BY ALL HAVING sum(accrual_local) <> 0""",
    "ap_revaluation": f"""
SELECT party_code, currency, {w('-sum(posted_amount)')} AS fx_adj
FROM fx_revaluation WHERE gl_account LIKE '2202%' GROUP BY party_code, currency""",
    "ap_ledger": """
SELECT party_code, currency, coalesce(c.party_name, o.party_name, i.party_name) AS party_name, opening, closing,
  closing_doc, increase
FROM ap_closing c FULL JOIN ap_opening o USING (party_code, currency)
FULL JOIN ap_increase i USING (party_code, currency)""",
    "ap_temp": f"""
SELECT party_code, party_name, '' AS tb_class, '' AS nature, opening, increase,
  {w('opening + increase - closing')} AS decrease, closing, accrual, {w('0')} AS gl_adj,
  {w('greatest(-s, 0)')} AS neg_reclass, fx_adj, {w('0')} AS other_adj,
  {w('greatest(s, 0)')} AS unaudited, currency, doc_amount_pre,
  CASE WHEN s <= 0 THEN 0 ELSE doc_amount_pre END AS doc_amount_post
FROM (
  SELECT *, {w('closing + accrual + fx_adj')} AS s
  FROM (
    SELECT party_code, coalesce(l.party_name, a.party_name) AS party_name, currency, {z('opening')} AS opening,
      {z('increase')} AS increase, {z('closing')} AS closing, {z('accrual')} AS accrual, {z('fx_adj')} AS fx_adj,
      {w(f"{z('closing_doc')} + {z('accrual_doc')}")} AS doc_amount_pre
    FROM (SELECT * FROM ap_ledger LEFT JOIN ap_revaluation USING (party_code, currency)) l
    FULL JOIN ap_accrual a USING (party_code, currency)
  )
)""",
    "ap_control_rows": _control("ap_temp"),
    "ap_detail": _schedule("ap_temp", "ap_control_rows", "doc_amount_post"),
    "prepaid_detail": f"""
SELECT party_code, party_name, tb_class, nature, -closing AS closing, {w('0')} AS neg_reclass, -accrual AS accrual,
  -fx_adj AS fx_adj, -other_adj AS other_adj, neg_reclass AS prepaid, {w('0')} AS other_noncurrent, currency,
  CASE currency WHEN 'CNY' THEN neg_reclass ELSE -doc_amount_pre END AS doc_amount
FROM ap_temp WHERE neg_reclass > 0""",
    "ap_fx_temp": f"""
SELECT party_code, party_name, tb_class, nature, opening, increase, decrease, closing, accrual, gl_adj, neg_reclass,
  CASE WHEN currency <> 'CNY' THEN {w('restated - unaudited')} ELSE fx_adj END AS fx_adj, other_adj,
  CASE WHEN currency <> 'CNY' THEN restated ELSE unaudited END AS unaudited, currency,
  CASE WHEN (CASE WHEN currency <> 'CNY' THEN restated ELSE unaudited END) = 0 THEN 0 ELSE doc_amount_pre END
    AS doc_amount,
  doc_amount_pre
FROM (
  SELECT t.*, {w('round(doc_amount_pre * rate, 2)')} AS restated
  FROM ap_temp t LEFT JOIN fx_rates r ON r.currency = t.currency
)""",
    "ap_fx_detail": _schedule("ap_fx_temp", "ap_control_rows", "doc_amount"),
    "prepaid_fx_detail": f"""
SELECT party_code, party_name, tb_class, nature, -opening AS opening, -decrease AS increase, -increase AS decrease,
  -closing AS closing, neg_reclass AS prepaid, {w('0')} AS other_noncurrent, currency,
  CASE currency WHEN 'CNY' THEN neg_reclass ELSE -doc_amount_pre END AS doc_amount
FROM ap_fx_temp WHERE neg_reclass > 0""",
    "ap_adj_temp": _adjusted_payables("ap_temp"),
    "ap_adj_control": _control("ap_adj_temp", "0"),
    "ap_adj_detail": _schedule("ap_adj_temp", "ap_adj_control", "doc_amount"),
    "ap_fx_adj_temp": _adjusted_payables("ap_fx_temp"),
    "ap_fx_adj_control": _control("ap_fx_adj_temp", "0"),
    "ap_fx_adj_detail": _schedule("ap_fx_adj_temp", "ap_fx_adj_control", "doc_amount"),
    "prepaid_adj_detail": _adjusted_prepaid("ap_adj_temp"),
    "prepaid_fx_adj_detail": _adjusted_prepaid("ap_fx_adj_temp"),
    # --------------------------------------------------------------------------- receivables
    "ar_items": f"""
SELECT account_code, account_name, {_NAMES}, period_tag, local_amount, doc_amount
FROM open_items WHERE account_name LIKE '%Accounts receivable%'""",
    "ar_opening": f"""
SELECT account_code, account_name, party_code, party_name, currency, {w('sum(local_amount)')} AS opening
FROM ar_items WHERE period_tag = 'last' GROUP BY ALL""",
    "ar_closing": f"""
SELECT account_code, account_name, party_code, party_name, currency, {w('sum(local_amount)')} AS closing,
  {w('sum(doc_amount)')} AS closing_doc
FROM ar_items WHERE period_tag = 'this' GROUP BY ALL""",
    "ar_increase": f"""
SELECT CAST(CAST(account_code AS BIGINT) AS VARCHAR) AS account_code, account_name, {_NAMES},
  {w('sum(local_amount)')} AS increase
FROM postings WHERE account_name LIKE '%Accounts receivable%' AND doc_type = 'RV' GROUP BY ALL""",
    "ar_revaluation": f"""
SELECT gl_account AS account_code, party_code, currency, {w('sum(posted_amount)')} AS fx_adj
FROM fx_revaluation WHERE gl_account IN ('11220010', '11220030', '11220050') AND party_code IS NOT NULL GROUP BY ALL""",
    "ar_detail": f"""
SELECT account_code, account_name, party_code, party_name, opening, increase,
  {w('increase + coalesce(opening, 0) - closing')} AS decrease, closing, fx_adj,
  {w('greatest(-(closing + fx_adj), 0)')} AS reclass, reported, currency,
  CASE WHEN reported = 0 THEN 0 ELSE closing_doc END AS doc_amount
FROM (
  SELECT *, {w('closing + fx_adj + greatest(-closing, 0)')} AS reported
  FROM (
    SELECT account_code, account_name, party_code, party_name, currency, opening, {z('increase')} AS increase,
      {z('closing')} AS closing, {z('closing_doc')} AS closing_doc, {z('fx_adj')} AS fx_adj
    FROM (SELECT * FROM ar_opening LEFT JOIN ar_revaluation USING (account_code, party_code, currency))
    FULL JOIN ar_closing USING (account_code, account_name, party_code, party_name, currency)
    FULL JOIN ar_increase USING (account_code, account_name, party_code, party_name, currency)
  )
)""",
    "advance_receipts": _advances("ar_detail"),
    "ar_fx_temp": f"""
SELECT d.account_code, d.account_name, d.party_code, d.party_name, d.opening, d.increase, d.decrease, d.closing, r.rate,
  CASE WHEN d.currency <> 'CNY' THEN {w('d.doc_amount * r.rate - d.closing')} ELSE 0 END AS fx_adj,
  CASE WHEN d.currency <> 'CNY' THEN greatest(-{w('d.doc_amount * r.rate')}, 0) ELSE greatest(-d.closing, 0) END
    AS reclass,
  CASE WHEN d.currency <> 'CNY' THEN {w('d.doc_amount * r.rate')} ELSE greatest(d.closing, 0) END AS reported,
  d.currency, CASE WHEN d.reported < 0 THEN 0 ELSE d.doc_amount END AS doc_amount, d.doc_amount AS doc_amount_pre
FROM ar_detail d LEFT JOIN fx_rates r ON r.currency = d.currency""",
    "ar_fx_detail": "SELECT * EXCLUDE (doc_amount_pre) FROM ar_fx_temp",
    "advance_fx_receipts": _advances("ar_fx_temp", doc="doc_amount_pre"),
    "ar_adj_detail": _adjusted_receivables("ar_detail"),
    "ar_fx_adj_detail": _adjusted_receivables("ar_fx_detail"),
    "advance_adj_receipts": _advances("ar_adj_detail", adjusted=True),
    "advance_fx_adj_receipts": _advances("ar_adj_detail", adjusted=True),
    "advance_fx_adj_receipts_restated": _advances("ar_fx_adj_detail", adjusted=True),
    # -------------------------------------------------------------------------- other ledgers
    "cleared_documents": f"""
SELECT doc_no, {w('sum(local_amount)')} AS doc_total
FROM postings WHERE (account_code LIKE '1231%' OR account_code LIKE '2241%') AND doc_type = 'SA'
GROUP BY doc_no HAVING sum(local_amount) = 0""",
    "other_movement": f"""
SELECT party_code, party_name, doc_currency AS currency, account_code, account_name,
  {w("CASE WHEN account_code LIKE '2241%' THEN -sum(local_amount) ELSE sum(local_amount) END")} AS increase
FROM postings p
WHERE NOT EXISTS (SELECT 1 FROM cleared_documents c WHERE c.doc_no = p.doc_no)
  AND ((account_code LIKE '1231%' AND dc_flag = 'S') OR (account_code LIKE '2241%' AND dc_flag = 'H'))
GROUP BY party_code, party_name, doc_currency, account_code, account_name""",
    "other_receivable_ledger": _other_side("1231", "", "S", "increase", "opening + increase - closing"),
    "other_payable_ledger": _other_side("2241", "-", "H", "opening + increase - closing", "increase"),
    "other_receivable_detail": _other_schedule("other_receivable_ledger", "other_payable_ledger"),
    "other_payable_detail": _other_schedule("other_payable_ledger", "other_receivable_ledger"),
    # ------------------------------------------------------------------------ assets and costs
    "intangible_detail": f"""
SELECT a.asset_no,
  CASE asset_class WHEN 'Z800' THEN '土地' WHEN 'Z810' THEN '海域使用权' WHEN 'Z820' THEN '商标'
    WHEN 'Z830' THEN '软件' WHEN 'Z840' THEN '专利技术' WHEN 'Z850' THEN '非专利技术' WHEN 'Z860' THEN '特许权' END
    AS asset_class,
  asset_name, in_service, opening_cost, opening_accum, {w('closing_accum - opening_accum')} AS charge, life_months,
  purchase
FROM (
  SELECT asset_no, asset_class, asset_name, life_months, max(in_service) FILTER (period_tag = 'this') AS in_service,
    {w("max(cost) FILTER (period_tag = 'last')")} AS opening_cost,
    {w("max(abs(accum_dep)) FILTER (period_tag = 'last')")} AS opening_accum,
    {w("max(abs(accum_dep)) FILTER (period_tag = 'this')")} AS closing_accum
  FROM asset_register WHERE asset_class LIKE 'Z8%' GROUP BY asset_no, asset_class, asset_name, life_months
) a LEFT JOIN (
  SELECT asset_no, {w('sum(amount)')} AS purchase
  FROM raw_asset_postings WHERE gl_account LIKE '%1701%' AND reversal_of IS NULL GROUP BY asset_no
) b ON b.asset_no = a.asset_no""",
    "cost_detail_selling": _cost("Selling"),
    "cost_detail_admin": _cost("Admin"),
    "cost_detail_rnd": _cost("R&D"),
    "finance_cost": f"""
SELECT seq, level1, level2, {w("CASE WHEN seq = '2' THEN -sum(lc_close) ELSE sum(lc_close) END")} AS amount,
  {w("(SELECT sum(lc_close) FROM trial_balance WHERE account_name LIKE '%Finance cost%')")} AS total
FROM (
  SELECT lc_close,
    CASE account_code WHEN '66030030' THEN '1' WHEN '66030010' THEN '1' WHEN '66030070' THEN '2'
      WHEN '66038900' THEN '3' WHEN '66030090' THEN '4' ELSE account_name END AS seq,
    CASE account_code WHEN '66030030' THEN '利息支出' WHEN '66030010' THEN '利息支出' WHEN '66030070' THEN '减：利息收入'
      WHEN '66038900' THEN '汇兑损益' WHEN '66030090' THEN '其他' ELSE account_code END AS level1,
    CASE account_code WHEN '66030030' THEN '票据贴息' WHEN '66030010' THEN '银行贷款 or 企业借款'
      WHEN '66030070' THEN '金融机构存款 or 企业借款' WHEN '66038900' THEN '金额' WHEN '66030090' THEN '手续费'
      ELSE account_name END AS level2
  FROM trial_balance WHERE account_name LIKE '%Finance cost%'
) GROUP BY seq, level1, level2""",
    # ----------------------------------------------------------------------- sources and checks
    "contract_scan": """
SELECT CAST(o_custkey AS VARCHAR) AS party_code, CAST(o_orderkey AS VARCHAR) AS doc_no, o_orderstatus AS doc_type,
  CAST(o_totalprice AS DECIMAL(19,2)) AS local_amount
FROM orders""",
    "passthrough_scan": "SELECT * FROM supplier",
    "project_catalogue": """
SELECT DISTINCT field, value FROM (
  SELECT 'company_group' AS field, company_group AS value FROM projects
  UNION ALL SELECT 'company_name', company_name FROM projects
  UNION ALL SELECT 'project_year', project_year FROM projects
  UNION ALL SELECT 'project_month', project_month FROM projects
)""",
    "name_pairs": """
SELECT party_code, currency, closing, opening, increase, accrual,
  greatest(closing, 1)::BIGINT * greatest(opening, 1) * greatest(increase, 1) * greatest(accrual, 1) AS pairs
FROM (
  SELECT party_code, currency, (count(*) FILTER (s = 'c'))::INTEGER AS closing, (count(*) FILTER (s = 'o'))::INTEGER AS opening,
    (count(*) FILTER (s = 'i'))::INTEGER AS increase, (count(*) FILTER (s = 'a'))::INTEGER AS accrual
  FROM (
    SELECT 'c' AS s, party_code, currency FROM ap_closing UNION ALL SELECT 'o', party_code, currency FROM ap_opening
    UNION ALL SELECT 'i', party_code, currency FROM ap_increase UNION ALL SELECT 'a', party_code, currency FROM ap_accrual
  ) WHERE party_code IS NOT NULL AND currency IS NOT NULL GROUP BY ALL
) WHERE greatest(closing, 1)::BIGINT * greatest(opening, 1) * greatest(increase, 1) * greatest(accrual, 1) > 1""",
    "duplicate_party_names": """
SELECT source, party_code, currency, count(*) AS names
FROM (
  SELECT DISTINCT 'open_items' AS source, party_code, doc_currency AS currency, party_name FROM open_items
  UNION ALL SELECT DISTINCT 'postings', party_code, doc_currency, party_name FROM postings
  UNION ALL SELECT DISTINCT 'accruals', vendor_code, currency, vendor_name FROM accruals
) GROUP BY source, party_code, currency HAVING count(*) > 1""",
}
