"""The canonical tables of FIXTURES.md, part B, as DuckDB SQL."""


def _case(key: str, values: list[str]) -> str:
    arms = " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values[:-1]))
    return f"CASE ({key}) % {len(values)} {arms} ELSE {values[-1]} END"


def ccy(key: str) -> str:
    return _case(key, ["'CNY'", "'USD'", "'EUR'", "'JPY'", "'HKD'"])


def rate(key: str) -> str:
    return f"CAST({_case(key, ['1.0000', '7.1884', '7.5257', '0.0462', '0.9260'])} AS DECIMAL(19,4))"


def m(expression: str) -> str:
    return f"CAST({expression} AS DECIMAL(19,2))"


_CUSTOMER_ACCOUNT = (
    "CASE o_orderpriority WHEN '2-HIGH' THEN '11220030' WHEN '3-MEDIUM' THEN '11220050' "
    "WHEN '4-NOT SPECIFIED' THEN '12310100' ELSE '11220010' END"
)
_ACCOUNTS = [
    "'22026000'", "'22029000'", "'22029900'", "'22028900'", "'22510100'", "'22510200'", "'66030010'",
    "'66030030'", "'66030070'", "'66038900'", "'66030090'", "'22020100'", "'66031000'",
]

TABLES = {
    "vendor_lines": f"""
SELECT *, {m(f"doc_amount * {rate('l_orderkey')}")} AS local_amount
FROM (
  SELECT l_orderkey, l_linenumber, l_returnflag, s_nationkey,
    CASE WHEN l_linenumber % 4 = 0 THEN '22410100' ELSE '22021000' END AS account_code,
    CASE WHEN l_linenumber % 4 = 0 THEN 'Other payable' ELSE 'Accounts payable' END AS account_name,
    CAST(l_suppkey AS VARCHAR) AS party_code, s_name AS party_name, {ccy('l_orderkey')} AS doc_currency,
    CASE WHEN (l_suppkey + l_orderkey % 5) % 7 = 0 THEN 1 ELSE -1 END * {m('l_extendedprice')} AS doc_amount
  FROM lineitem JOIN supplier ON s_suppkey = l_suppkey
)""",
    "customer_lines": f"""
SELECT *, {m(f"doc_amount * {rate('o_custkey')}")} AS local_amount
FROM (
  SELECT o_orderkey, o_custkey, o_orderstatus, {_CUSTOMER_ACCOUNT} AS account_code,
    CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 'Other receivable' ELSE 'Accounts receivable' END
      AS account_name,
    CAST(o_custkey AS VARCHAR) AS party_code, c_name AS party_name, {ccy('o_custkey')} AS doc_currency,
    CASE WHEN o_custkey % 7 = 0 THEN -1 ELSE 1 END * {m('o_totalprice')} AS doc_amount
  FROM orders JOIN customer ON c_custkey = o_custkey
)""",
    "open_items": f"""
SELECT '1000' AS company_code, account_code, account_name, party_code, party_name, doc_currency,
  {m('doc_amount')} AS doc_amount, 'CNY' AS local_currency, local_amount,
  CASE WHEN o_orderstatus = 'F' THEN 'last' ELSE 'this' END AS period_tag, 'VENDOR' AS source_tag
FROM vendor_lines JOIN orders ON o_orderkey = l_orderkey
WHERE NOT (o_orderstatus <> 'F' AND s_nationkey IN (3, 8, 13, 19))
  AND NOT (o_orderstatus = 'F' AND s_nationkey IN (15, 18, 19))
UNION ALL
SELECT '1000', account_code, account_name, party_code, party_name, doc_currency, {m('doc_amount')}, 'CNY',
  local_amount, CASE WHEN o_orderstatus = 'F' THEN 'last' ELSE 'this' END, 'CUSTOMER'
FROM customer_lines""",
    "clearing_lines": f"""
SELECT o_orderkey, party_code, party_name, doc_currency, e.doc_type, e.account_code, e.account_name,
  {m('e.amount')} AS doc_amount, {m(f"e.amount * {rate('o_custkey')}")} AS local_amount
FROM (
  SELECT o_orderkey, o_custkey, CAST(o_custkey AS VARCHAR) AS party_code, c_name AS party_name,
    {ccy('o_custkey')} AS doc_currency, {m('o_totalprice')} AS total, month(o_orderdate) AS mon
  FROM orders JOIN customer ON c_custkey = o_custkey
) d JOIN (
  VALUES (12, 'SA', '12310100', 'Other receivable', 1, 0), (12, 'SA', '22410100', 'Other payable', -1, 0),
         (12, 'RV', '12310100', 'Other receivable', 0, 1), (11, 'SA', '12310100', 'Other receivable', 1, 0)
) v (mon, doc_type, account_code, account_name, share, fixed) USING (mon)
CROSS JOIN LATERAL (
  SELECT v.doc_type AS doc_type, v.account_code AS account_code, v.account_name AS account_name,
    {m('v.share * d.total + v.fixed')} AS amount
) e""",
    "postings": f"""
SELECT '1000' AS company_code, account_code, account_name, party_code, party_name, doc_currency,
  {m('doc_amount')} AS doc_amount, 'CNY' AS local_currency, local_amount,
  CASE WHEN doc_amount < 0 THEN 'H' ELSE 'S' END AS dc_flag, doc_type, doc_no,
  CAST(NULL AS VARCHAR) AS reversal_of, source_tag
FROM (
  SELECT account_code, account_name, party_code, party_name, doc_currency, doc_amount, local_amount,
    CASE l_returnflag WHEN 'N' THEN 'RE' WHEN 'A' THEN 'OA' ELSE 'KZ' END AS doc_type,
    'V' || l_orderkey AS doc_no, 'VENDOR' AS source_tag
  FROM vendor_lines
  UNION ALL
  SELECT account_code, account_name, party_code, party_name, doc_currency, doc_amount, local_amount,
    CASE WHEN o_orderstatus = 'O' THEN 'RV' ELSE 'DZ' END, 'C' || o_orderkey, 'CUSTOMER'
  FROM customer_lines
  UNION ALL
  SELECT account_code, account_name, party_code, party_name, doc_currency, doc_amount, local_amount,
    doc_type, 'SA' || o_orderkey, 'CUSTOMER'
  FROM clearing_lines
)""",
    "raw_accruals": f"""
SELECT CASE WHEN l_partkey % 97 <> 0 THEN '00' || lpad(CAST(l_suppkey AS VARCHAR), 8, '0') END AS vendor_code,
  CASE WHEN l_partkey % 97 <> 0 THEN s_name END AS vendor_name,
  CASE WHEN l_orderkey % 5 <> 0 THEN {ccy('l_orderkey')} END AS currency,
  '1000' AS company_code, CASE WHEN l_linenumber = 7 THEN 'freight' END AS misc_charge,
  {m(f"{m(m('l_extendedprice') + ' * 0.1')} * {rate('l_orderkey')}")} AS accrual_local,
  {m(m('l_extendedprice') + ' * 0.1')} AS accrual_doc
FROM lineitem JOIN supplier ON s_suppkey = l_suppkey
WHERE l_linestatus = 'O' AND l_returnflag = 'N'""",
    "accruals": """
SELECT ltrim(substr(coalesce(vendor_code, '00'), 3), '0') AS vendor_code, vendor_name,
  coalesce(currency, 'CNY') AS currency, company_code, misc_charge, accrual_local, accrual_doc
FROM raw_accruals""",
    "fx_revaluation": f"""
SELECT CAST(l_suppkey AS VARCHAR) AS party_code, '22021000' AS gl_account, {ccy('l_orderkey')} AS currency,
  {m(m('l_extendedprice') + ' * 0.01')} AS posted_amount
FROM lineitem WHERE l_linenumber = 1 AND {ccy('l_orderkey')} IN ('USD', 'EUR')
UNION ALL
SELECT CASE WHEN month(o_orderdate) <> 12 THEN CAST(o_custkey AS VARCHAR) END, {_CUSTOMER_ACCOUNT},
  {ccy('o_custkey')}, {m(m('o_totalprice') + ' * 0.01')}
FROM orders WHERE o_orderstatus = 'P' AND {ccy('o_custkey')} <> 'CNY'""",
    "fx_rates": """
SELECT currency_name, CAST(round(quoted / 100, 4) AS DECIMAL(19,4)) AS rate,
  CASE currency_name WHEN '美元' THEN 'USD' WHEN '欧元' THEN 'EUR' WHEN '日元' THEN 'JPY' WHEN '港元' THEN 'HKD' END
    AS currency
FROM (
  SELECT DISTINCT CAST(ts AS DATE) AS rate_date FROM events
) CROSS JOIN LATERAL (
  SELECT unnest(['美元', '欧元', '日元', '港元', 'unlisted']) AS currency_name,
    unnest([718.84 + 0.01 * day(rate_date), 752.57, 4.62, 92.60, 100.00]) AS quoted
)
WHERE rate_date = DATE '2024-01-15'""",
    "trial_balance": f"""
SELECT code AS account_code,
  CASE WHEN code LIKE '66%' THEN 'Finance cost ' ELSE 'Ledger account ' END || code AS account_name,
  CASE WHEN place % 2 = 0 THEN 'CNY' ELSE 'USD' END AS currency,
  {m('lc_open / 7')} AS fc_open, {m('lc_debit / 7')} AS fc_debit, {m('lc_credit / 7')} AS fc_credit,
  {m('lc_close / 7')} AS fc_close, lc_open, lc_debit, lc_credit, lc_close
FROM (
  SELECT place, {_case('place', _ACCOUNTS)} AS code, lc_open, lc_debit, lc_credit,
    {m('lc_open + lc_debit - lc_credit')} AS lc_close
  FROM (
    SELECT l_partkey % 13 AS place,
      {m(f"coalesce(sum({m('l_extendedprice')}) FILTER (l_returnflag = 'A'), 0)")} AS lc_open,
      {m(f"coalesce(sum({m('l_extendedprice')}) FILTER (l_returnflag = 'N'), 0)")} AS lc_debit,
      {m(f"coalesce(sum({m('l_extendedprice')}) FILTER (l_returnflag = 'R'), 0)")} AS lc_credit
    FROM lineitem GROUP BY 1
  )
)""",
    "assets": f"""
SELECT '1000' AS company_code, CAST(p_partkey AS VARCHAR) AS asset_no,
  CASE WHEN p_partkey % 4 = 3 THEN 'Z100' ELSE 'Z8' || (p_size % 9) || '0' END AS asset_class,
  p_name AS asset_name, p_type AS spec, (2000 + p_size % 20) || '-01-01' AS in_service,
  {m(m('p_retailprice') + ' * 100')} AS cost, {m('p_retailprice')} AS retail,
  p_size * 12 AS life_months, p_size AS used_months, (2000 + p_size % 20) || '-12-31' AS disposal_date, p_brand
FROM part""",
    "asset_register": f"""
SELECT company_code, asset_no, asset_class, asset_name, spec, in_service, cost, {m('retail * -12')} AS accum_dep,
  life_months, used_months, 'this' AS period_tag FROM assets WHERE p_brand <> 'Brand#2'
UNION ALL
SELECT company_code, asset_no, asset_class, asset_name, spec, in_service, cost, {m('retail * -10')},
  life_months, used_months, 'last' FROM assets WHERE p_brand <> 'Brand#1'""",
    "asset_scrapped": f"""
SELECT company_code, asset_no, asset_class, asset_name, spec, in_service, cost, {m('retail * -12')} AS accum_dep,
  life_months, used_months, disposal_date, 'this' AS period_tag FROM assets WHERE p_brand = 'Brand#2'
UNION ALL
SELECT company_code, asset_no, asset_class, asset_name, spec, in_service, cost, {m('retail * -10')},
  life_months, used_months, disposal_date, 'last' FROM assets WHERE p_brand = 'Brand#3'""",
    "raw_asset_postings": f"""
SELECT '1000' AS company_code, CAST(year(l_shipdate) AS INTEGER) AS fiscal_year,
  CAST(month(l_shipdate) AS INTEGER) AS period, CAST(CAST(l_shipdate AS DATE) AS VARCHAR) AS posting_date,
  'A' || l_orderkey AS doc_no, 'AA' AS doc_type,
  CASE WHEN l_linenumber % 3 = 0 THEN '17010100' ELSE '16010100' END AS gl_account, 'Asset account' AS gl_text,
  'S' AS dc_flag, 'CNY' AS currency, {m('l_extendedprice')} AS amount, CAST(NULL AS VARCHAR) AS text,
  CASE WHEN l_linestatus = 'F' AND l_linenumber = 6 THEN CAST(l_orderkey AS VARCHAR) END AS reversal_of,
  CAST(l_partkey AS VARCHAR) AS asset_no, 'T1' AS txn_code, 'MKPF' AS ref_proc,
  CAST(l_linenumber AS VARCHAR) AS txn_type
FROM lineitem""",
    "asset_postings": """
SELECT *, row_number() OVER (ORDER BY doc_no, fiscal_year, period, posting_date, gl_account, amount, asset_no,
  txn_type, reversal_of) - 1 AS id
FROM raw_asset_postings""",
    "cost_postings": f"""
SELECT CAST(CAST(l_shipdate AS DATE) AS VARCHAR) AS entry_date,
  CASE WHEN day(l_shipdate) > 28 THEN 13 + month(l_shipdate) % 4 ELSE month(l_shipdate) END
    || CASE WHEN l_linenumber = 1 THEN '.0' ELSE '' END AS period,
  'K' || l_orderkey AS doc_no, '6601' || lpad(CAST(l_partkey % 20 AS VARCHAR), 4, '0') AS account_code,
  'Expense 6601' || lpad(CAST(l_partkey % 20 AS VARCHAR), 4, '0') AS account_name,
  {m('l_extendedprice')} AS amount, CAST(NULL AS VARCHAR) AS text,
  CASE l_returnflag WHEN 'R' THEN 'Selling' WHEN 'A' THEN 'Admin' ELSE 'R&D' END AS func_area
FROM lineitem WHERE l_partkey % 101 <> 0""",
    "adjustment_lines": f"""
SELECT * FROM (
  SELECT CAST(l_suppkey AS VARCHAR) AS party_code,
    'Supplier#' || lpad(CAST(l_suppkey AS VARCHAR), 9, '0') AS party_name,
    CASE WHEN l_partkey % 101 <> 0 THEN {ccy('l_orderkey')} END AS currency,
    CAST({m('l_extendedprice')} * 0.05 AS DECIMAL(19,3)) AS raw_amount,
    CASE WHEN l_discount > 0.095 THEN 'construction' WHEN l_discount < 0.005 THEN 'rebate'
         WHEN l_tax > 0.075 THEN 'gl' END AS kind, 'payable' AS ledger
  FROM lineitem WHERE l_quantity >= 40
  UNION ALL
  SELECT CAST(o_custkey AS VARCHAR), 'Customer#' || lpad(CAST(o_custkey AS VARCHAR), 9, '0'), {ccy('o_custkey')},
    CAST({m('o_totalprice')} * -0.6 AS DECIMAL(19,3)),
    CASE month(o_orderdate) WHEN 6 THEN 'gl' WHEN 7 THEN 'rebate' END, 'receivable'
  FROM orders
) WHERE kind IS NOT NULL AND currency IS NOT NULL""",
    # Half-even rounding of thousandths to cents, in whole numbers.
    "adjustments": f"""
SELECT party_code, party_name, currency, {m('sum(cents) / 100')} AS amount, kind, ledger
FROM (
  SELECT *, sign(mills) * CASE WHEN abs(mills) % 10 > 5 OR (abs(mills) % 10 = 5 AND (abs(mills) // 10) % 2 = 1)
    THEN abs(mills) // 10 + 1 ELSE abs(mills) // 10 END AS cents
  FROM (SELECT *, CAST(raw_amount * 1000 AS BIGINT) AS mills FROM adjustment_lines)
)
GROUP BY party_code, party_name, currency, kind, ledger""",
    "projects": """
SELECT c_mktsegment AS company_group, n_name AS company_name, CAST(year(o_orderdate) AS VARCHAR) AS project_year,
  CAST(month(o_orderdate) AS VARCHAR) AS project_month
FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey""",
}
