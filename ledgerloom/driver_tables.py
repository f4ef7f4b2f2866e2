"""The canonical tables derived from the driver's order tables (see FIXTURES.md, part B).

Whole tables are read and every derivation is a Spark expression or join, so the work grows
with the tables. Schemas are declared, so opening a table starts no job.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping

from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgerloom import fixed_values as fv
from ledgerloom.rules import LedgerRules
from ledgerloom.schemas import conform
from ledgerloom.sources import clean, rates

RULES = LedgerRules(
    payable_pattern="Accounts payable", receivable_pattern="Accounts receivable", finance_pattern="Finance cost"
)
RATE_DATE = "2024-01-15"

_SCHEMAS = {
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
    "l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
}
TRIAL_BALANCE_ACCOUNTS = [
    "22026000", "22029000", "22029900", "22028900", "22510100", "22510200", "66030010", "66030030",
    "66030070", "66038900", "66030090", "22020100", "66031000",
]
_CURRENCY = "element_at(array('CNY', 'USD', 'EUR', 'JPY', 'HKD'), cast({key} % 5 as int) + 1)"
_RATE = "element_at(array(1.0000BD, 7.1884BD, 7.5257BD, 0.0462BD, 0.9260BD), cast({key} % 5 as int) + 1)"


def currency(key: str) -> str:
    return _CURRENCY.format(key=key)


def at_rate(value: str, key: str) -> str:
    return amount(f"{value} * cast({_RATE.format(key=key)} as decimal(19,4))")


def amount(value: str) -> str:
    return f"cast({value} as decimal(19,2))"


class DriverTables(Mapping):
    """Canonical tables by name, each built when first asked for."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self._built: dict[str, DataFrame] = {}

    def once(self, name: str, build: Callable[[DriverTables], DataFrame]) -> DataFrame:
        if name not in self._built:
            self._built[name] = build(self)
        return self._built[name]

    def raw(self, name: str) -> DataFrame:
        path = f"{self.folder}/{name}.parquet"
        return self.once(f"raw {name}", lambda t: t.spark.read.schema(_SCHEMAS[name]).parquet(path))

    def __getitem__(self, name: str) -> DataFrame:
        return self.once(name, _TABLES[name])

    def __iter__(self) -> Iterator[str]:
        return iter(_TABLES)

    def __len__(self) -> int:
        return len(_TABLES)


# --------------------------------------------------------------------------- ledger lines

_ITEM = (
    "'1000' AS company_code", "account_code", "account_name", "party_code", "party_name", "doc_currency",
    "doc_amount", "'CNY' AS local_currency", "local_amount",
)


def _vendor_lines(t: DriverTables) -> DataFrame:
    """One line per delivered item; a few vendors and currencies carry debits."""
    return (
        t.raw("lineitem").join(t.raw("supplier"), F.expr("l_suppkey = s_suppkey"))
        .selectExpr(
            "l_orderkey", "l_linenumber", "l_returnflag", "s_nationkey",
            "if(l_linenumber % 4 = 0, '22410100', '22021000') AS account_code",
            "if(l_linenumber % 4 = 0, 'Other payable', 'Accounts payable') AS account_name",
            "string(l_suppkey) AS party_code", "s_name AS party_name", f"{currency('l_orderkey')} AS doc_currency",
            f"{amount('if((l_suppkey + l_orderkey % 5) % 7 = 0, 1, -1) * l_extendedprice')} AS doc_amount",
        )
        .selectExpr("*", f"{at_rate('doc_amount', 'l_orderkey')} AS local_amount")
    )


_CUSTOMER_ACCOUNT = (
    "CASE o_orderpriority WHEN '2-HIGH' THEN '11220030' WHEN '3-MEDIUM' THEN '11220050' "
    "WHEN '4-NOT SPECIFIED' THEN '12310100' ELSE '11220010' END"
)


def _customer_orders(t: DriverTables) -> DataFrame:
    return t.raw("orders").join(t.raw("customer"), F.expr("o_custkey = c_custkey")).selectExpr(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", "o_totalprice", "o_orderdate",
        "string(o_custkey) AS party_code", "c_name AS party_name", f"{currency('o_custkey')} AS doc_currency",
    )


def _customer_lines(t: DriverTables) -> DataFrame:
    other = "o_orderpriority = '4-NOT SPECIFIED'"
    return (
        t.once("customer orders", _customer_orders)
        .selectExpr(
            "*", f"{_CUSTOMER_ACCOUNT} AS account_code",
            f"if({other}, 'Other receivable', 'Accounts receivable') AS account_name",
            f"{amount('if(o_custkey % 7 = 0, -1, 1) * o_totalprice')} AS doc_amount",
        )
        .selectExpr("*", f"{at_rate('doc_amount', 'o_custkey')} AS local_amount")
    )


def open_items(t: DriverTables) -> DataFrame:
    """Vendors of some nations have no closing items, of some no opening items."""
    tag = "if(o_orderstatus = 'F', 'last', 'this') AS period_tag"
    vendor = (
        t.once("vendor lines", _vendor_lines).join(t.raw("orders"), F.expr("l_orderkey = o_orderkey"))
        .where("NOT (s_nationkey IN (3, 8, 13, 19) AND o_orderstatus != 'F')")
        .where("NOT (s_nationkey IN (15, 18, 19) AND o_orderstatus = 'F')")
        .selectExpr(*_ITEM, tag, f"'{fv.VENDOR}' AS source_tag")
    )
    customer = t.once("customer lines", _customer_lines).selectExpr(*_ITEM, tag, f"'{fv.CUSTOMER}' AS source_tag")
    return clean.clean_open_items(vendor, customer)


def postings(t: DriverTables) -> DataFrame:
    def lines(df: DataFrame, doc_type: str, doc_no: str, source: str) -> DataFrame:
        return df.selectExpr(
            *_ITEM, "if(doc_amount < 0, 'H', 'S') AS dc_flag", f"{doc_type} AS doc_type", f"{doc_no} AS doc_no",
            "cast(NULL AS string) AS reversal_of", f"'{source}' AS source_tag",
        )

    vendor = lines(
        t.once("vendor lines", _vendor_lines), "CASE l_returnflag WHEN 'N' THEN 'RE' WHEN 'A' THEN 'OA' ELSE 'KZ' END",
        "'V' || l_orderkey", fv.VENDOR,
    )
    customer = lines(
        t.once("customer lines", _customer_lines), "if(o_orderstatus = 'O', 'RV', 'DZ')", "'C' || o_orderkey", fv.CUSTOMER
    )
    # Clearing entries of December net to zero; those of November stand alone.
    def entry(doc_type: str, account: str, name: str, value: str) -> str:
        return (
            f"struct('{doc_type}' AS doc_type, '{account}' AS account_code, '{name}' AS account_name, "
            f"{amount(value)} AS doc_amount)"
        )

    receivable = entry("SA", "12310100", "Other receivable", "o_totalprice")
    payable = entry("SA", "22410100", "Other payable", "-o_totalprice")
    fee = entry("RV", "12310100", "Other receivable", "1.00")
    clearing = (
        t.once("customer orders", _customer_orders)
        .selectExpr(
            "o_orderkey", "o_custkey", "party_code", "party_name", "doc_currency",
            f"""inline(CASE month(o_orderdate) WHEN 12 THEN array({receivable}, {payable}, {fee})
                       WHEN 11 THEN array({receivable}) END)""",
        )
        .selectExpr("*", f"{at_rate('doc_amount', 'o_custkey')} AS local_amount")
    )
    return clean.clean_postings(
        vendor, customer, lines(clearing, "doc_type", "'SA' || o_orderkey", fv.CUSTOMER)
    )


def raw_accruals(t: DriverTables) -> DataFrame:
    """Accruals as exported: padded vendor codes, gaps in codes and currencies."""
    doc = amount(f"{amount('l_extendedprice')} * 0.1")
    return (
        t.raw("lineitem").where("l_linestatus = 'O' AND l_returnflag = 'N'")
        .join(t.raw("supplier"), F.expr("l_suppkey = s_suppkey"))
        .selectExpr(
            "if(l_partkey % 97 = 0, NULL, '00' || lpad(string(l_suppkey), 8, '0')) AS vendor_code",
            "if(l_partkey % 97 = 0, NULL, s_name) AS vendor_name",
            f"if(l_orderkey % 5 = 0, NULL, {currency('l_orderkey')}) AS currency",
            "'1000' AS company_code", "if(l_linenumber = 7, 'freight', NULL) AS misc_charge",
            f"{at_rate(doc, 'l_orderkey')} AS accrual_local", f"{doc} AS accrual_doc",
        )
    )


def fx_revaluation(t: DriverTables) -> DataFrame:
    vendor = t.raw("lineitem").where(f"l_linenumber = 1 AND {currency('l_orderkey')} IN ('USD', 'EUR')").selectExpr(
        "string(l_suppkey) AS party_code", "'22021000' AS gl_account", f"{currency('l_orderkey')} AS currency",
        f"{amount('l_extendedprice')} * 0.01 AS posted_amount",
    )
    customer = t.raw("orders").where(f"o_orderstatus = 'P' AND {currency('o_custkey')} != 'CNY'").selectExpr(
        "if(month(o_orderdate) = 12, NULL, string(o_custkey)) AS party_code", f"{_CUSTOMER_ACCOUNT} AS gl_account",
        f"{currency('o_custkey')} AS currency", f"{amount('o_totalprice')} * 0.01 AS posted_amount",
    )
    return conform(vendor.unionByName(customer), "fx_revaluation")


def fx_rates_wide(t: DriverTables) -> DataFrame:
    """One row per day with a column per currency name, the last one without an ISO code."""
    return t.raw("events").selectExpr("date(ts) AS rate_date").distinct().selectExpr(
        "rate_date", "718.84 + 0.01 * day(rate_date) AS `美元`", "752.57 AS `欧元`", "4.62 AS `日元`",
        "92.60 AS `港元`", "100.00 AS unlisted",
    )


def raw_trial_balance(t: DriverTables) -> DataFrame:
    """One account per residue of the part number; the three flags give opening, debit and credit."""
    def of(flag: str) -> str:
        return amount(f"coalesce(sum({amount('l_extendedprice')}) FILTER (WHERE l_returnflag = '{flag}'), 0)")

    accounts = ", ".join(f"'{a}'" for a in TRIAL_BALANCE_ACCOUNTS)
    sums = t.raw("lineitem").groupBy(F.expr(f"l_partkey % {len(TRIAL_BALANCE_ACCOUNTS)}").alias("place")).agg(
        F.expr(of("A")).alias("lc_open"), F.expr(of("N")).alias("lc_debit"), F.expr(of("R")).alias("lc_credit")
    )
    return (
        sums.selectExpr(
            "*", f"element_at(array({accounts}), int(place) + 1) AS code",
            f"{amount('lc_open + lc_debit - lc_credit')} AS lc_close",
        )
        .selectExpr(
            "'10' || code AS account_code",
            "if(code LIKE '66%', 'Finance cost ', 'Ledger account ') || code AS account_name",
            "if(place % 2 = 0, 'CNY', 'USD') AS currency",
            *[f"{amount(f'lc_{c} / 7')} AS fc_{c}" for c in ("open", "debit", "credit", "close")],
            "lc_open", "lc_debit", "lc_credit", "lc_close",
        )
    )


# ------------------------------------------------------------------------- assets and costs

def _assets(t: DriverTables, which: str, depreciation: int, *more: str) -> DataFrame:
    return t.raw("part").where(which).selectExpr(
        "'1000' AS company_code", "string(p_partkey) AS asset_no",
        "if(p_partkey % 4 = 3, 'Z100', 'Z8' || (p_size % 9) || '0') AS asset_class",
        "p_name AS asset_name", "p_type AS spec", "(2000 + p_size % 20) || '-01-01' AS in_service",
        f"{amount('p_retailprice')} * 100 AS cost", f"{amount('p_retailprice')} * -{depreciation} AS accum_dep",
        "p_size * 12 AS life_months", "p_size AS used_months", *more,
    )


def asset_register(t: DriverTables) -> DataFrame:
    """Assets of one brand are new this year, those of another are gone."""
    return clean.clean_asset_register(
        _assets(t, "p_brand != 'Brand#2'", 12), _assets(t, "p_brand != 'Brand#1'", 10)
    )


def asset_scrapped(t: DriverTables) -> DataFrame:
    disposal = "(2000 + p_size % 20) || '-12-31' AS disposal_date"
    return clean.clean_asset_scrapped(
        _assets(t, "p_brand = 'Brand#2'", 12, disposal), _assets(t, "p_brand = 'Brand#3'", 10, disposal)
    )


def raw_asset_postings(t: DriverTables) -> DataFrame:
    return t.raw("lineitem").selectExpr(
        "'1000' AS company_code", "year(l_shipdate) AS fiscal_year", "month(l_shipdate) AS period",
        "string(date(l_shipdate)) AS posting_date", "'A' || l_orderkey AS doc_no", "'AA' AS doc_type",
        "if(l_linenumber % 3 = 0, '17010100', '16010100') AS gl_account", "'Asset account' AS gl_text",
        "'S' AS dc_flag", "'CNY' AS currency", f"{amount('l_extendedprice')} AS amount",
        "cast(NULL AS string) AS text",
        "if(l_linestatus = 'F' AND l_linenumber = 6, string(l_orderkey), NULL) AS reversal_of",
        "string(l_partkey) AS asset_no", "'T1' AS txn_code", "'MKPF' AS ref_proc", "string(l_linenumber) AS txn_type",
    )


def cost_postings(t: DriverTables) -> DataFrame:
    code = "'6601' || lpad(string(l_partkey % 20), 4, '0')"
    number = "if(day(l_shipdate) > 28, 13 + month(l_shipdate) % 4, month(l_shipdate))"
    return clean.clean_cost_postings(t.raw("lineitem").selectExpr(
        "string(date(l_shipdate)) AS entry_date", f"{number} || if(l_linenumber = 1, '.0', '') AS period",
        "'K' || l_orderkey AS doc_no", f"if(l_partkey % 101 = 0, NULL, {code}) AS account_code",
        f"'Expense ' || {code} AS account_name", f"{amount('l_extendedprice')} AS amount",
        "cast(NULL AS string) AS text",
        "CASE l_returnflag WHEN 'R' THEN 'Selling' WHEN 'A' THEN 'Admin' ELSE 'R&D' END AS func_area",
    ))


# ------------------------------------------------------------------------------ adjustments

def payable_sheets(t: DriverTables) -> DataFrame:
    """Large deliveries: with the highest discount, without discount, or with the highest tax."""
    return t.raw("lineitem").where("l_quantity >= 40").selectExpr(
        "string(l_suppkey) AS party_code", "'Supplier#' || lpad(string(l_suppkey), 9, '0') AS party_name",
        f"if(l_partkey % 101 = 0, NULL, {currency('l_orderkey')}) AS currency",
        f"cast({amount('l_extendedprice')} * 0.05 AS decimal(19,3)) AS amount",
        f"""CASE WHEN l_discount > 0.095 THEN '{fv.CONSTRUCTION}' WHEN l_discount < 0.005 THEN '{fv.REBATE}'
            WHEN l_tax > 0.075 THEN '{fv.GL}' END AS kind""",
    ).where("kind IS NOT NULL")


def receivable_sheets(t: DriverTables) -> DataFrame:
    """Orders of June and July."""
    return t.raw("orders").selectExpr(
        "string(o_custkey) AS party_code", "'Customer#' || lpad(string(o_custkey), 9, '0') AS party_name",
        f"{currency('o_custkey')} AS currency",
        f"cast({amount('o_totalprice')} * -0.6 AS decimal(19,3)) AS amount",
        f"CASE month(o_orderdate) WHEN 6 THEN '{fv.GL}' WHEN 7 THEN '{fv.REBATE}' END AS kind",
    ).where("kind IS NOT NULL")


def adjustments(t: DriverTables) -> DataFrame:
    payable = clean.load_adjustments(payable_sheets(t), fv.PAYABLE)
    receivable = clean.load_adjustments(receivable_sheets(t), fv.RECEIVABLE)
    return conform(payable.unionByName(receivable), "adjustments")


def projects(t: DriverTables) -> DataFrame:
    return (
        t.raw("orders").join(t.raw("customer"), F.expr("o_custkey = c_custkey"))
        .join(t.raw("nation"), F.expr("c_nationkey = n_nationkey"))
        .selectExpr(
            "c_mktsegment AS company_group", "n_name AS company_name",
            "string(year(o_orderdate)) AS project_year", "string(month(o_orderdate)) AS project_month",
        )
    )


_TABLES: dict[str, Callable[[DriverTables], DataFrame]] = {
    "open_items": open_items,
    "postings": postings,
    "accruals": lambda t: clean.clean_accruals(raw_accruals(t)),
    "fx_revaluation": fx_revaluation,
    "fx_rates": lambda t: rates.fx_rates_long(fx_rates_wide(t), RATE_DATE),
    "trial_balance": lambda t: clean.clean_trial_balance(raw_trial_balance(t)),
    "asset_register": asset_register,
    "asset_scrapped": asset_scrapped,
    # The row number is left to the query that shows it: no workpaper reads it.
    "asset_postings": raw_asset_postings,
    "cost_postings": cost_postings,
    "adjustments": adjustments,
    "projects": projects,
}
