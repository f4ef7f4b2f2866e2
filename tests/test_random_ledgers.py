"""Workpapers over random small ledgers, compared with the DuckDB statements over the same rows.

The ledgers are dense in what the driver's tables lack: missing keys, several names for one
code, amounts that cancel out, currencies without a rate, shared documents.
"""

import random
from decimal import Decimal

import duckdb
import pyarrow as pa
import pytest

from ledgerloom import Workpapers
from ledgerloom.driver_tables import RULES
from ledgerloom.plans.workpapers import BUILDERS
from ledgerloom.schemas import TABLES
from oracle import PARTS, _needed
from tests.compare import differences

ACCOUNTS = {
    "22021000": "Accounts payable", "22410100": "Other payable", "12310100": "Other receivable",
    "11220010": "Accounts receivable", "11220030": "Accounts receivable", "12310200": "Other receivable",
}
CANONICAL = (
    "open_items", "postings", "accruals", "fx_revaluation", "fx_rates", "trial_balance", "asset_register",
    "asset_postings", "cost_postings", "adjustments",
)
TRIAL_BALANCE = ["22026000", "22029000", "22029900", "22028900", "22510100", "22020100", "66030010", "66030070", "66031000"]


def ledger(seed: int) -> dict[str, list[dict]]:
    r = random.Random(seed)

    def amount():
        return Decimal(r.choice([-300, -100, -1, 0, 1, 100, 100, 250, 333])) / Decimal(r.choice([1, 1, 100]))

    def item():
        code = r.choice(list(ACCOUNTS))
        return dict(
            company_code="1", account_code=code, account_name=ACCOUNTS[code],
            party_code=r.choice(["A", "A", "B", "C", "D", None]), party_name=r.choice(["n1", "n1", "n1", "n2", None]),
            doc_currency=r.choice(["CNY", "USD", "EUR", "GBP", None]), doc_amount=amount(), local_currency="CNY",
            local_amount=amount(), source_tag=r.choice(["VENDOR", "VENDOR", "CUSTOMER"]),
        )

    def posting():
        row = item()
        if r.random() < 0.3 and row["account_code"].startswith("1122"):
            row["account_code"] = "00" + row["account_code"]
        return row | dict(
            dc_flag=r.choice(["S", "H"]), doc_type=r.choice(["RE", "OA", "KZ", "RV", "SA", "SA", None]),
            doc_no=r.choice(["d1", "d2", "d3", "d4", "d5", "d6", None]), reversal_of=None,
        )

    party = lambda: r.choice(["A", "B", "C", "D", "E", None])
    money = lambda: r.choice(["CNY", "USD", "EUR", "GBP", None])
    asset = lambda: r.choice(["1", "2", "3", "4"])
    return {
        "open_items": [item() | dict(period_tag=r.choice(["this", "last"])) for _ in range(90)],
        "postings": [posting() for _ in range(90)],
        "accruals": [dict(
            vendor_code=party(), vendor_name=r.choice(["n1", "n1", "n3", None]), currency=money(), company_code="1",
            misc_charge=r.choice([None, None, "freight"]), accrual_local=amount(), accrual_doc=amount(),
        ) for _ in range(30)],
        "fx_revaluation": [dict(
            party_code=party(), gl_account=r.choice(["22021000", "11220010", "11220030", "12310100"]), currency=money(),
            posted_amount=amount(),
        ) for _ in range(40)],
        "fx_rates": [
            dict(currency_name="dollar", rate=Decimal("7.1899"), currency="USD"),
            dict(currency_name="euro", rate=Decimal("7.5257"), currency="EUR"),
            dict(currency_name="none", rate=Decimal("1.0000"), currency=None),
        ],
        "trial_balance": [dict(
            account_code=code, account_name=("Finance cost " if code.startswith("66") else "Account ") + code,
            currency=r.choice(["CNY", "USD", None]),
            **{c: amount() for c in ("fc_open", "fc_debit", "fc_credit", "fc_close", "lc_open", "lc_debit", "lc_credit",
                                     "lc_close")},
        ) for code in TRIAL_BALANCE],
        "asset_register": [dict(
            company_code="1", asset_no=asset(), asset_class=r.choice(["Z800", "Z830", "Z870", "Z100"]),
            asset_name=r.choice(["x", "x", None]), spec="s", in_service=r.choice(["2020-01-01", "2021-01-01", None]),
            cost=amount(), accum_dep=amount(), life_months=r.choice([12, 24]), used_months=1,
            period_tag=r.choice(["this", "last"]),
        ) for _ in range(25)],
        "asset_postings": [dict(
            gl_account=r.choice(["17010100", "16010100", None]), amount=amount(), reversal_of=r.choice([None, None, "r"]),
            asset_no=r.choice([asset(), None]),
        ) for _ in range(20)],
        "cost_postings": [dict(
            period=r.choice(["1.0", "013", "16", "2", "12", None, "0"]), account_code=r.choice(["66010001", "66010002"]),
            account_name=r.choice(["e1", "e2", "temp", None]), amount=amount(), func_area=r.choice(["Selling", "Admin"]),
        ) for _ in range(40)],
        "adjustments": [dict(
            party_code=party(), party_name=r.choice(["n1", "n2"]), currency=money(), amount=amount(),
            kind=r.choice(["gl", "construction", "rebate"]), ledger=r.choice(["payable", "receivable"]),
        ) for _ in range(30)],
    }


@pytest.fixture(scope="module", params=[1, 2, 3])
def both(request, spark):
    con, frames = duckdb.connect(), {}
    rows = ledger(request.param)
    for table in CANONICAL:
        schema = TABLES[table]
        values = [{f.name: row.get(f.name) for f in schema.fields} for row in rows[table]]
        arrow = pa.Table.from_pylist(values, schema=pa.schema([
            (f.name, {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64()}.get(
                f.dataType.simpleString()) or pa.decimal128(f.dataType.precision, f.dataType.scale))
            for f in schema.fields
        ]))
        con.register(f"_{table}", arrow)
        con.execute(f"CREATE TABLE {table} AS SELECT * FROM _{table}")
        frames[table] = spark.createDataFrame(arrow)
    con.execute("CREATE VIEW raw_asset_postings AS SELECT * FROM asset_postings")
    return Workpapers(frames, RULES), con


def statement(name: str) -> str:
    parts: list[str] = []
    _needed(name, parts)
    known = {*CANONICAL, "raw_asset_postings"}
    from oracle.tables import TABLES as derived

    ctes = [f"{p} AS (\n{PARTS[p].strip()}\n)" for p in parts if p not in derived and p not in known]
    return f"WITH {', '.join(ctes)} SELECT * FROM {name}"


@pytest.mark.parametrize("name", [n for n in BUILDERS if n not in ("ap_blank", "other_ledger")])
def test_workpaper(name, both):
    papers, con = both
    assert differences(papers[name], con, statement(name)) == []


@pytest.mark.parametrize("area,name", [("Selling", "cost_detail_selling"), ("Admin", "cost_detail_admin")])
def test_cost_detail(area, name, both):
    papers, con = both
    assert differences(papers.cost_detail(area), con, statement(name)) == []


def test_finance_cost(both):
    papers, con = both
    assert differences(papers.finance_cost(), con, statement("finance_cost")) == []
