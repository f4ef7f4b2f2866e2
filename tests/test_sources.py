"""Contracts, readers, cleaning, rates, projects and sinks on small files."""

import csv
import random
import re
from datetime import date
from decimal import Decimal

import duckdb
import pytest
from pyspark.sql import functions as F

from ledgerloom import Workpapers, fixed_values as fv
from ledgerloom.plans import flows
from ledgerloom.plans.workpapers import BUILDERS, LABELS
from ledgerloom.schemas import TABLES
from ledgerloom.sources import clean, contracts, projects, rates, readers, sinks
from ledgerloom.sources.contracts import Contract

D = Decimal


def write_csv(folder, name, lines):
    path = folder / name
    path.write_text("\n".join(lines) + "\n", encoding="utf-8")
    return str(path)


VENDOR = "公司代码,总账科目,总账科目：长文本,供应商, 供应商科目：名称 1 ,凭证货币代码,凭证货币价值,公司代码货币代码,公司代码货币价值,多余"
CUSTOMER = "公司代码,总账科目,总账科目：短文本,客户,客户科目：姓名 1,凭证货币代码,凭证货币价值,公司代码货币代码,公司代码货币价值"
DOCUMENT = "借/贷标识,凭证类型,凭证编号,冲销关于"


def test_contract_scan_trims_selects_renames_and_types(spark, tmp_path):
    path = write_csv(tmp_path, "this.csv", [
        VENDOR, '1000,0022021000,应付账款,000042,"A, Ltd",CNY,-10.50,CNY,-10.50,x',
    ])
    df = readers.contract_scan(spark, f'"{path}"', contracts.ARAP_CONTRACTS["FBL1H_THIS"])
    assert df.columns == [
        "company_code", "account_code", "account_name", "party_code", "party_name", "doc_currency", "doc_amount",
        "local_currency", "local_amount",
    ]
    row = df.first()
    assert (row.account_code, row.party_code, row.party_name) == ("0022021000", "000042", "A, Ltd")
    assert row.local_amount == D("-10.50")
    assert df.schema["local_amount"].dataType.simpleString() == "decimal(19,2)"


def test_missing_required_column_is_named(spark, tmp_path):
    path = write_csv(tmp_path, "bad.csv", ["公司代码,总账科目", "1,2"])
    with pytest.raises(ValueError, match="供应商"):
        readers.contract_scan(spark, path, contracts.ARAP_CONTRACTS["FBL1H_THIS"])


def test_pass_through_keeps_every_column(spark, tmp_path):
    path = write_csv(tmp_path, "tb.csv", [" 科目代码 ,其他", "1022021000,z"])
    assert readers.contract_scan(spark, path, Contract()).columns == ["科目代码", "其他"]


def test_header_below_a_preamble(spark, tmp_path):
    folder = tmp_path / "fx.csv"
    folder.mkdir()
    for n in (1, 2):
        write_csv(folder, f"part{n}.csv", [
            *[f"title {i},x" for i in range(8)], "账户,总帐帐目,货币,记帐金额,备注",
            f'00{n},22021000,USD,{n}.25,"a,b"', f"{n},22021000,EUR,-{n}.00,", "",
        ])
    df = readers.contract_scan(spark, str(folder), contracts.ARAP_CONTRACTS["FOREIGN_CURRENCY"])
    assert sorted(map(tuple, df.collect())) == [
        ("001", "22021000", "USD", D("1.25")), ("002", "22021000", "USD", D("2.25")),
        ("1", "22021000", "EUR", D("-1.00")), ("2", "22021000", "EUR", D("-2.00")),
    ]


BREAKS = [
    ["k,text,amt", '1,"two\nlines",5.00', '2,"a ""quoted""\n\nword, with comma",6.00', "3,5\" pipe,7.00", '4,"",8.00', '"5","x\n",9.00'],
    ["title \"odd", "more,x", "amt,k,text", '1.50,11,"three\n""\nlines"', "2.50,12,plain", '3.50,13,"""\n"""'],
]


@pytest.mark.parametrize("block", [None, "3", "40"])
def test_quoted_cells_over_lines_and_blocks(spark, tmp_path, block):
    """Three files of other column orders and quoted line breaks; blocks of a byte and more cut lines and cells anywhere."""
    folder = tmp_path / "broken.csv"
    folder.mkdir()
    for n in (1, 2):
        write_csv(folder, f"a{n}.csv", [line.replace("1,", f"{n}1,", 1) if line.startswith("1,") else line for line in BREAKS[0]])
    if block:
        spark.conf.set("spark.sql.files.maxPartitionBytes", block)
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        rows = sorted(map(tuple, readers.read_raw(spark, str(folder)).select("k", "text", "amt").collect()), key=repr)
        same = [("2", 'a "quoted"\n\nword, with comma', "6.00"), ("3", '5" pipe', "7.00"), ("4", None, "8.00"), ("5", "x\n", "9.00")]
        assert rows == sorted([("11", "two\nlines", "5.00"), ("21", "two\nlines", "5.00"), *same, *same], key=repr)
        if block:  # the header is in a file's first block
            spark.conf.set("spark.sql.files.maxPartitionBytes", "85")
            spark.conf.set("spark.sql.files.openCostInBytes", "85")
        for header_row, above in ((2, []), (8, [f"title {i}" for i in range(6)])):
            other = tmp_path / f"below{header_row}.csv"
            other.mkdir()
            write_csv(other, "b.csv", above + BREAKS[1])
            write_csv(other, "c.csv", above + ["t", "t", "k,amt,text", '21,4.50,"x', 'y"'])
            rows = sorted(map(tuple, readers.read_raw(spark, str(other), header_row).select("k", "text", "amt").collect()))
            assert sorted(rows) == [("11", 'three\n"\nlines', "1.50"), ("12", "plain", "2.50"), ("13", '"\n"', "3.50"), ("21", "x\ny", "4.50")]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


@pytest.mark.parametrize("seed", range(4))
def test_records_are_those_of_a_plain_reader(spark, tmp_path, seed):
    rng = random.Random(seed)
    cell = lambda: "".join(rng.choice(["a", "b", '"', "\n", ",", " ", "é"]) for _ in range(rng.randint(1, 6))).strip() + "z"
    table = [[f"r{i}", cell(), cell()] for i in range(40)]
    path = tmp_path / "t.csv"
    with open(path, "w", newline="", encoding="utf-8") as file:
        writer = csv.writer(file, lineterminator="\n")
        writer.writerows([["k", "x", "y"], *table])
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        df = readers.read_raw(spark, str(path), positions=True)
        assert df.select("k", "x", "y").collect() and sorted(map(tuple, df.select("k", "x", "y").collect())) == sorted(map(tuple, table))
        assert [r.k for r in df.sort("_file", "_block", "_line").collect()] == [t[0] for t in table]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_preamble_only_in_the_first_block(spark, tmp_path):
    rows = [f"{i},22021000,USD,{i}.00" for i in range(3000)]
    path = write_csv(tmp_path, "fx.csv", [*["title"] * 8, "账户,总帐帐目,货币,记帐金额", *rows])
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        df = readers.contract_scan(spark, path, contracts.ARAP_CONTRACTS["FOREIGN_CURRENCY"])
        assert df.rdd.getNumPartitions() > 1
        assert df.select(F.count("*"), F.sum("posted_amount"), F.countDistinct("party_code")).first()[:] == (
            3000, D(sum(range(3000))), 3000)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_empty_source(spark):
    df = readers.contract_scan(spark, "empty", contracts.ARAP_CONTRACTS["FOREIGN_CURRENCY"])
    assert df.isEmpty() and df.schema == TABLES["fx_revaluation"]


def test_failing_source_is_reported_and_left_out(spark, tmp_path):
    good = write_csv(tmp_path, "tb.csv", ["科目代码", "1022"])
    frames, status = readers.load_sources(
        spark, {"TB": good, "FBL3H_THIS": str(tmp_path / "nowhere.csv")}, contracts.COST_CONTRACTS
    )
    assert set(frames) == {"TB"}
    assert {(r.source, r.ok) for r in status.collect()} == {("TB", True), ("FBL3H_THIS", False)}


def test_optional_source_with_a_table_turns_into_an_empty_frame(spark):
    frames, status = readers.load_sources(spark, {}, {"X": Contract("fx_revaluation", optional=True)})
    assert frames["X"].isEmpty() and not status.first().ok


def test_clean_accruals(spark):
    raw = spark.createDataFrame(
        [(None, None, "1.00"), ("00", "USD", "2.00"), ("0000000042", "EUR", "3.00"), ("0000120000", "CNY", "4.00")],
        "vendor_code string, currency string, accrual_local string",
    )
    assert [(r.vendor_code, r.currency) for r in clean.clean_accruals(raw).sort("accrual_local").collect()] == [
        ("", "CNY"), ("", "USD"), ("42", "EUR"), ("120000", "CNY"),
    ]


def test_clean_trial_balance_keeps_null_codes_and_other_columns(spark):
    raw = spark.createDataFrame([("1022021000", "1.5", "z"), (None, "2", "y")], "`科目代码` string, `本位货币期末` string, `备注` string")
    df = clean.clean_trial_balance(raw)
    assert df.columns == ["account_code", "lc_close", "备注"]
    assert {tuple(r) for r in df.collect()} == {("22021000", D("1.50"), "z"), (None, D("2.00"), "y")}


def test_items_without_account_are_dropped(spark):
    part = spark.createDataFrame([("22021000", "a"), (None, "b")], "account_code string, party_code string")
    assert clean.clean_open_items(clean.tagged(part, "this", "VENDOR")).count() == 1


def test_row_index_is_dense_and_ordered(spark):
    df = spark.range(0, 5000, 1, 7).selectExpr("pmod(id * 7919, 5000) AS k", "id % 3 AS g")
    rows = clean.row_index(df, ["k"]).sort("k").collect()
    assert [r.id for r in rows] == list(range(5000)) and [r.k for r in rows] == list(range(5000))


def test_adjustments_round_half_even_and_drop_incomplete_keys(spark):
    sheets = spark.createDataFrame(
        [("1", "n", "CNY", D("0.005"), "总账调整"), ("1", "n", "CNY", D("0.015"), "总账调整"),
         ("1", "n", None, D("9.000"), "总账调整"), ("2", None, "CNY", D("9.000"), "返利调整"),
         ("2", "n", "USD", D("-0.025"), "返利调整")],
        "party_code string, party_name string, currency string, amount decimal(19,3), kind string",
    )
    rows = clean.load_adjustments(sheets, "应付账款").collect()
    assert {(r.party_code, r.currency, r.kind, r.amount, r.ledger) for r in rows} == {
        ("1", "CNY", "gl", D("0.02"), "payable"), ("2", "USD", "rebate", D("-0.02"), "payable"),
    }


def test_other_adjustment_sheets_are_kept_line_by_line(spark):
    sheets = spark.createDataFrame(
        [(1, 2, 3, "1.239", "x"), (1, 2, 3, "1.00", "x")], "`资产编码` int, `名称` int, `序号` int, `金额` string, kind string"
    )
    df = clean.load_adjustments(sheets, "固定资产", amount="金额")
    assert df.count() == 2
    assert [f.dataType.simpleString() for f in df.schema.fields[:4]] == ["string", "string", "int", "decimal(19,2)"]


def test_adjustment_sheets_by_directory(spark, tmp_path):
    path = str(tmp_path / "sheets")
    df = spark.createDataFrame([("1", "n", "CNY", D("1.00"), "总账调整"), ("1", "n", "CNY", D("2.00"), "返利调整")],
                               "party_code string, party_name string, currency string, amount decimal(19,2), kind string")
    df.write.partitionBy("kind").parquet(path)
    assert {r.kind for r in readers.adjustment_sheets(spark, path).collect()} == {"总账调整", "返利调整"}


def test_rates_of_one_day(spark):
    wide = spark.createDataFrame(
        [(date(2024, 12, 30), D("700"), D("1"), D("5")), (date(2024, 12, 31), D("718.84500"), D("718.83500"), D("5"))],
        "rate_date date, `美元` decimal(19,6), `欧元` decimal(19,6), `其他` decimal(19,6)",
    )
    rows = {r.currency_name: (r.rate, r.currency) for r in rates.fx_rates_long(wide, "2024-12-31").collect()}
    assert rows == {"美元": (D("7.1884"), "USD"), "欧元": (D("7.1884"), "EUR"), "其他": (D("0.0500"), None)}
    assert rates.fx_rates_long(wide, "").isEmpty()
    assert rates.fx_rates_long(wide, "2025-01-01").isEmpty()


def test_rate_table_and_project_table_from_files(spark, tmp_path):
    wide = rates.read_rate_table(spark, write_csv(tmp_path, "r.csv", ["rate_date, 美元 ", "2024-12-31,718.84"]))
    assert rates.fx_rates_long(wide, "2024-12-31").first()[:] == ("美元", D("7.1884"), "USD")
    spark.createDataFrame([("g", "a", 2024, 12, "x")], [*projects.KEYS, "more"]).write.parquet(str(tmp_path / "p"))
    assert projects.read_projects(spark, str(tmp_path / "p")).first()[:] == ("g", "a", "2024", "12")


def test_currency_list_has_25_names():
    assert len(fv.CURRENCY_CODES) == 25 == len(set(fv.CURRENCY_CODES.values()))


def test_projects(spark, tmp_path):
    for name in ("g_a_2024_12.parquet", "g_b_2024_11.parquet", "other.txt"):
        (tmp_path / name).write_text("x")
    df = projects.projects_from_files(spark, str(tmp_path))
    assert {tuple(r) for r in df.collect()} == {("g", "a", "2024", "12"), ("g", "b", "2024", "11")}
    assert {tuple(r) for r in projects.project_catalogue(df).collect()} == {
        ("company_group", "g"), ("company_name", "a"), ("company_name", "b"), ("project_year", "2024"),
        ("project_month", "12"), ("project_month", "11"),
    }


def test_files_that_name_no_project_are_listed(spark, tmp_path):
    for name in ("g_a_2024_12.parquet", "g_a_b_2024_12.parquet", "other.txt"):
        (tmp_path / name).write_text("x")
    rejected = projects.rejected_project_files(spark, str(tmp_path)).collect()
    assert {r.path.split("/")[-1] for r in rejected} == {"g_a_b_2024_12.parquet", "other.txt"}


@pytest.mark.parametrize("header_row", [0, 2])
def test_each_csv_file_has_its_own_header(spark, tmp_path, header_row):
    folder = tmp_path / "two 件.csv"
    folder.mkdir()
    above = ["title,x"] * header_row
    write_csv(folder, "a.csv", [*above, 'acct,,"cur,rency",amt', "1,x,USD,5"])
    write_csv(folder, "b.csv", [*above, '"cur,rency",amt,acct', "EUR,6,2", "acct,7,3"])
    rows = readers.read_raw(spark, str(folder), header_row).select("acct", "_c1", "cur,rency", "amt").collect()
    assert {tuple(r) for r in rows} == {("1", "x", "USD", "5"), ("2", None, "EUR", "6"), ("3", None, "acct", "7")}
    with pytest.raises(ValueError, match="b.csv.*_c1"):
        readers.read_raw(spark, str(folder), header_row, ("acct", "_c1"))


def test_adjustments_from_the_published_template(spark, tmp_path):
    lines = [("1", "V1", "CNY", 1.005), ("1", "V1", "CNY", 2.0), ("2", None, "CNY", 9.0)]
    paths = {}
    for ledger, sheet in (("应付账款", "总账调整"), ("应收账款", "返利调整")):
        paths[ledger] = str(tmp_path / ledger)
        df = spark.createDataFrame(lines, "`编码` string, `名称` string, `币种` string, `调整金额` double")
        df.withColumn("kind", F.lit(sheet)).write.partitionBy("kind").parquet(paths[ledger])
    df = flows.build_adjustments(spark, paths)
    assert df.schema.simpleString() == TABLES["adjustments"].simpleString()
    flows.save_tables({"adjustments": df}, str(tmp_path / "saved"))
    back = flows.load_tables(spark, str(tmp_path / "saved"), ["adjustments"])["adjustments"]
    assert {(r.party_code, r.kind, r.ledger, str(r.amount)) for r in back.collect()} == {
        ("1", fv.GL, fv.PAYABLE, "3.00"), ("1", fv.REBATE, fv.RECEIVABLE, "3.00"),
    }
    with pytest.raises(ValueError, match="trade ledger"):
        flows.build_adjustments(spark, {"固定资产": "x"})


def test_table_per_project_is_replaced_alone(spark, tmp_path):
    path = str(tmp_path / "t")
    one = dict(company_group="g", company_name="a", project_year="2024", project_month="12")
    two = one | dict(company_name="b/:%")
    sinks.write_table(spark.range(3), path, one)
    sinks.write_table(spark.range(5), path, two)
    sinks.write_table(spark.range(1), path, one)
    assert sinks.read_table(spark, path, one).count() == 1
    assert sinks.read_table(spark, path, two).count() == 5
    sinks.write_table(spark.range(0), path, one)
    assert sinks.read_table(spark, path, one).isEmpty()
    every = sinks.read_table(spark, path).filter("company_name = 'b/:%'")
    assert every.count() == 5
    assert "PartitionFilters: [isnotnull" in every._jdf.queryExecution().executedPlan().toString()


def test_a_load_that_fails_keeps_the_last_one(spark, tmp_path):
    base, project = str(tmp_path / "db"), dict(company_group="g", company_name="a", project_year="2024", project_month="12")
    flows.save_tables({"a": spark.range(3), "b": spark.range(4)}, base, project)
    fails = spark.range(9).withColumn("id", F.when(F.col("id") == 8, F.raise_error(F.lit("half-way"))).otherwise(F.col("id")))
    with pytest.raises(Exception, match="half-way"):
        flows.save_tables({"a": spark.range(7), "b": fails}, base, project)
    assert [sinks.read_table(spark, f"{base}/{t}", project).count() for t in "ab"] == [3, 4]
    kept = [d.name for d in (tmp_path / "db" / "a").rglob("version=*")]
    flows.save_tables({"a": spark.range(7), "b": spark.range(0)}, base, project)
    assert [sinks.read_table(spark, f"{base}/{t}", project).count() for t in "ab"] == [7, 0]
    # Only the version that is read remains, also of the load that failed.
    assert len(kept) == 1 and [d.name for d in (tmp_path / "db" / "a").rglob("version=*")] != kept
    assert len(list((tmp_path / "db" / "a").rglob("version=*"))) == 1


def test_tables_of_other_programs_and_tables_without_projects(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "plain"))
    assert sinks.read_table(spark, str(tmp_path / "plain")).count() == 3
    path = str(tmp_path / "whole")
    for n in (5, 2):
        sinks.write_table(spark.range(n).withColumn("k", F.col("id") % 2), path, by=("k",))
    back = sinks.read_table(spark, path)
    assert back.count() == 2 and set(back.columns) == {"id", "k"}


def test_values_that_do_not_fit_are_counted_and_keep_the_load_out(spark, arap_paths, tmp_path):
    base = str(tmp_path / "db")
    tables, _ = flows.build_arap_tables(spark, arap_paths)
    flows.save_tables(tables, base)
    text = open(arap_paths["FBL1H_THIS"], encoding="utf-8").read().replace("40.00", '"1,234.50"')
    paths = arap_paths | {"FBL1H_THIS": write_csv(tmp_path, "bad.csv", text.splitlines())}
    trial = open(paths["TB"], encoding="utf-8").read().replace("-1.00", "minus one")
    paths["TB"] = write_csv(tmp_path, "bad_tb.csv", trial.splitlines())
    bad = readers.BadValues()
    tables, status = flows.build_arap_tables(spark, paths, bad=bad)
    assert status.filter("NOT ok").isEmpty()
    with pytest.raises(flows.BadLoad, match="FBL1H_THIS: 1 bad values in local_amount") as error:
        flows.save_tables(tables, base, bad=bad)
    wanted = [("FBL1H_THIS", "doc_amount", 1), ("FBL1H_THIS", "local_amount", 1), ("TB", "lc_open", 1)]
    assert sorted(error.value.rows) == wanted == sorted(map(tuple, bad.frame(spark).collect()))
    assert flows.load_tables(spark, base, ["open_items"])["open_items"].where("party_code = '2'").first().local_amount == D(40)
    good = readers.BadValues()
    tables, _ = flows.build_arap_tables(spark, arap_paths, bad=good)
    flows.save_tables(tables, base, bad=good)
    assert good.rows() == [] and flows.load_tables(spark, base, ["open_items"])["open_items"].count() == 6


def test_rows_are_numbered_in_source_order(spark, tmp_path):
    folder = str(tmp_path / "p")
    spark.range(0, 4000, 1, 4).selectExpr("pmod(id * 7919, 4000) AS k").write.parquet(folder)
    df = readers.numbered(readers.read_raw(spark, folder, positions=True))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan
    with duckdb.connect() as con:
        wanted = con.sql(f"SELECT k FROM read_parquet('{folder}/*.parquet', filename=true, file_row_number=true) ORDER BY filename, file_row_number").fetchall()
    assert [(r.k,) for r in df.sort("id").collect()] == wanted and [r.id for r in df.sort("id").collect()] == list(range(4000))
    path = write_csv(tmp_path, "t.csv", ["k", *[str(i * 7919 % 500) for i in range(500)]])
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        rows = readers.numbered(readers.read_raw(spark, path, positions=True)).sort("id").collect()
        assert [(r.id, r.k) for r in rows] == [(i, str(i * 7919 % 500)) for i in range(500)]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_a_file_that_names_no_project_is_a_row_of_the_same_result(spark, tmp_path):
    for name in ("g_a_2024_12.csv", "a_b_c_2024_12.csv", "g_b_2024.11_1.csv"):
        (tmp_path / name).write_text("x")
    rows = {r.path.split("/")[-1]: r[1:] for r in projects.project_files(spark, str(tmp_path)).collect()}
    assert rows == {
        "g_a_2024_12.csv": (True, "g", "a", "2024", "12"), "g_b_2024.11_1.csv": (True, "g", "b", "2024.11", "1"),
        "a_b_c_2024_12.csv": (False, None, None, None, None),
    }


def test_export_without_labels_is_in_the_published_order(spark, tmp_path):
    rows = [(s, k, f"p{p}") for s in (2, 1) for k in (3, 1, 2) for p in (2, 1)]
    df = spark.createDataFrame(rows, "section int, seq int, party_code string").repartition(4)
    sinks.export(df, str(tmp_path / "out"))
    lines = [x for f in sorted((tmp_path / "out").glob("part-*")) for x in list(csv.reader(f.open()))[1:]]
    assert [(int(a), int(b), c) for a, b, c in lines] == sorted(rows)
    sinks.export(spark.createDataFrame([(1,)], "other int"), str(tmp_path / "plain"), fmt="parquet")
    assert spark.read.parquet(str(tmp_path / "plain")).collect() == [(1,)]


def test_absent_workpapers_have_their_columns(spark, arap_paths):
    empty = Workpapers({})
    tables, _ = flows.build_arap_tables(spark, arap_paths)
    loaded = Workpapers({**tables, "adjustments": readers.empty(spark, "adjustments")})
    for name in ("ap_detail", "ar_fx_adj_detail", "other_payable_detail", "misc_accrual"):
        found = empty.read(spark, name)
        assert found.isEmpty() and found.schema.simpleString() == loaded[name].schema.simpleString()
    assert empty.read(spark, "无形资产明细表").columns[:3] == ["asset_no", "asset_class", "asset_name"]


def test_export_by_name_has_the_published_labels(spark, arap_paths, tmp_path):
    assert set(LABELS) <= set(BUILDERS) and set(LABELS) <= set(fv.VIEW_NAMES.values())
    # Every published workpaper that is no intermediate has labels.
    assert {v for k, v in fv.VIEW_NAMES.items() if "明细表" in k and not k.endswith(("_temp", "_空白行"))} == set(LABELS)
    tables, _ = flows.build_arap_tables(spark, arap_paths)
    papers = Workpapers(tables)
    papers.export("应收账款明细表", str(tmp_path / "ar"))
    papers.export("ap_temp", str(tmp_path / "temp"), "parquet")
    back = spark.read.csv(str(tmp_path / "ar"), header=True)
    assert back.columns == [v for k, v in fv.RECEIVABLE_LABELS.items() if k in papers["ar_detail"].columns]
    assert back.count() == papers["ar_detail"].count()
    assert spark.read.parquet(str(tmp_path / "temp")).columns == papers["ap_temp"].columns


def test_export_with_labels(spark, tmp_path):
    df = spark.createDataFrame([("b", 2, 2), ("a", 1, 1)], "party_code string, opening int, section int")
    sinks.export(df, str(tmp_path / "out"), {"party_code": "编码", "opening": "期初余额", "closing": "期末余额"})
    back = spark.read.csv(str(tmp_path / "out"), header=True)
    assert back.columns == ["编码", "期初余额"] and back.count() == 2


@pytest.fixture
def arap_paths(tmp_path):
    item = "1000,{acc},{name},{party},{pname},{ccy},{doc},CNY,{loc}"

    def vendor(party, loc, ccy="CNY", doc=None, acc="22021000", name="应付账款"):
        return item.format(acc=acc, name=name, party=party, pname=f"V{party}", ccy=ccy, doc=doc or loc, loc=loc)

    def customer(party, loc, acc="11220010", name="应收账款-货款"):
        return item.format(acc=acc, name=name, party=party, pname=f"C{party}", ccy="CNY", doc=loc, loc=loc)

    return {
        "FBL1H_THIS": write_csv(tmp_path, "v_this.csv", [
            VENDOR, vendor("1", "-100.00") + ",", vendor("2", "40.00") + ",", vendor("3", "-719.00", "USD", "-100.00") + ","]),
        "FBL1H_LAST": write_csv(tmp_path, "v_last.csv", [VENDOR, vendor("1", "-60.00") + ",", ",,,,,,,,,"]),
        "FBL1H_OCCUR": write_csv(tmp_path, "v_occ.csv", [
            VENDOR.replace(",多余", "," + DOCUMENT), vendor("1", "-70.00") + ",H,RE,v1,", vendor("1", "30.00") + ",S,KZ,v2,"]),
        "FBL5H_THIS": write_csv(tmp_path, "c_this.csv", [CUSTOMER, customer("9", "-113.00")]),
        "FBL5H_LAST": write_csv(tmp_path, "c_last.csv", [CUSTOMER, customer("9", "50.00")]),
        "FBL5H_OCCUR": write_csv(tmp_path, "c_occ.csv", [CUSTOMER + "," + DOCUMENT, customer("9", "7.00", "0011220010") + ",S,RV,c1,"]),
        "ZFI072N_THIS": write_csv(tmp_path, "acc.csv", [
            "供应商编码,供应商名称,币种,公司代码,杂费描述,结算金额,原币暂估金额", "0000000001,V1,,1000,,5.00,5.00",
            "0000000002,V2,,1000,freight,3.00,3.00"]),
        "FOREIGN_CURRENCY": "empty",
        "TB": write_csv(tmp_path, "tb.csv", [
            "科目代码,科目名称,货币代码,外币期初,外币借方,外币贷方,外币期末,本位币货币期初,本位货币借方,本位货币贷方,本位货币期末",
            "1022029900,负数,CNY,0,0,0,0,0,0,0,0", "1022510100,预提,CNY,0,0,0,-2,-1.00,4.00,5.00,-2.00"]),
    }


def test_ledger_load_to_schedule(spark, arap_paths, tmp_path, capsys):
    """From CSV exports to adjusted schedules, by way of saved tables."""
    wide = spark.createDataFrame([(date(2024, 12, 31), D("719.50"))], "rate_date date, `美元` decimal(19,6)")
    tables, status = flows.build_arap_tables(spark, arap_paths, "2024-12-31", wide)
    assert status.filter("NOT ok").isEmpty()
    project = dict(company_group="g", company_name="a", project_year="2024", project_month="12")
    flows.save_tables(tables, str(tmp_path / "db"), project)
    saved = flows.load_tables(spark, str(tmp_path / "db"), list(tables), project)
    saved["adjustments"] = readers.empty(spark, "adjustments")
    capsys.readouterr()
    Workpapers(saved)["ap_temp"].explain("formatted")
    plan = capsys.readouterr().out
    assert re.search(r"PartitionFilters: .*period_tag#\d+ IN \(", plan) and re.search(r"PartitionFilters: .*source_tag#\d+ = VENDOR", plan)
    assert "PushedFilters: [IsNotNull(account_name), StringContains(account_name,应付账款)]" in plan
    assert "StringStartsWith(account_code,2202), In(doc_type, [OA,RE])" in plan
    papers = Workpapers(saved, materialize=True)

    rows = {r.party_code: r for r in papers["应付账款明细表"].filter("section = 1").collect()}
    one, two, three = rows["1"], rows["2"], rows["3"]
    assert (one.opening, one.increase, one.decrease, one.closing, one.accrual, one.unaudited) == (
        D(60), D(70), D(30), D(100), D(5), D(105))
    assert (two.closing, two.neg_reclass, two.unaudited, two.doc_amount) == (D(-40), D(40), D(0), D(0))
    assert three.doc_amount == D(100)
    control = {r.party_code: r for r in papers["ap_detail"].filter("section in (3, 5, 6)").collect()}
    assert control["22029900"].neg_reclass == D(-40)
    assert control["22510100"].opening == D(1) and control["22510100"].doc_amount == D(2)
    assert control["14010070"].unaudited == D(3)

    ar = papers["ar_detail"].first()
    assert (ar.opening, ar.increase, ar.decrease, ar.closing, ar.reclass, ar.reported) == (
        D(50), D(7), D(170), D(-113), D(113), D(0))
    advance = papers["advance_receipts"].first()
    assert (advance.unaudited, advance.contract_liab, advance.other_cur_liab) == (D(113), D(100), D(13))

    # Nothing was revalued, so the adjusted pair is the restated one.
    detail, prepaid = papers.adjusted_ap()
    restated = {r.party_code: r for r in detail.filter("section = 1").collect()}["3"]
    # The restatement moves fx_adj; the adjusted total is built from closing and fx_adj.
    assert (restated.fx_adj, restated.unaudited) == (D("0.50"), D("719.50"))
    assert prepaid.first().prepaid == D(40)
    assert papers.adjusted_ar()[0].columns[4:8] == ["opening", "increase", "decrease", "closing"]


def test_schedule_without_a_trial_balance(spark, arap_paths):
    tables, status = flows.build_arap_tables(spark, {k: v for k, v in arap_paths.items() if k != "TB"})
    assert not {r.source: r.ok for r in status.collect()}["TB"]
    tables["adjustments"] = readers.empty(spark, "adjustments")
    rows = Workpapers(tables)["ap_detail"].collect()
    assert {"1", "3"} <= {r.party_code for r in rows}


def test_asset_cost_and_trial_balance_flows(spark, arap_paths, tmp_path):
    asset = "公司代码,主资产号,资产类别,固定资产名称,规格型号,开始使用日期,原值,累计折旧,折旧年限(月份),已折旧年限(月份)"
    scrap = asset + ",注销日期"
    posting = ("公司代码,财年,记帐期间,过帐日期,凭证编号,凭证类型,总账科目,总账科目：短文本,借/贷标识,公司代码货币代码,公司代码货币价值,"
               "文本,冲销关于,资产,事务代码,参考过程,事务类型")
    paths = {
        "ZFI022_THIS": write_csv(tmp_path, "a1.csv", [asset, "1,77,Z830,ERP,s,2020-01-01,100.00,-30.00,60,18"]),
        "ZFI022_LAST": write_csv(tmp_path, "a2.csv", [asset, "1,77,Z830,ERP,s,2020-01-01,100.00,-20.00,60,12"]),
        "ZFI022_THIS_SCRAP": write_csv(tmp_path, "a3.csv", [scrap]),
        "ZFI022_LAST_SCRAP": write_csv(tmp_path, "a4.csv", [scrap, "1,78,Z830,CRM,s,2019-01-01,9.00,-9.00,60,60,2023-05-01"]),
        "FBL3H_OCCUR": write_csv(tmp_path, "p.csv", [
            posting, "1,2024,1,2024-01-05,d2,AA,17010100,t,S,CNY,8.00,x,,77,T,R,1",
            "1,2024,1,2024-01-04,d1,AA,17010100,t,S,CNY,5.00,x,rev,77,T,R,1"]),
    }
    tables, status = flows.build_asset_tables(spark, paths)
    assert tables["trial_balance"].isEmpty()
    # Numbered in the order of the source, where d2 comes first.
    assert [r.id for r in tables["asset_postings"].sort("doc_no").collect()] == [1, 0]
    assert tables["asset_scrapped"].first().period_tag == "last"
    row = Workpapers(tables)["intangible_detail"].first()
    assert (row.asset_class, row.opening_cost, row.opening_accum, row.charge, row.purchase) == ("软件", D(100), D(20), D(10), D(8))

    cost = write_csv(tmp_path, "c.csv", [
        "输入日期,记帐期间,凭证编号,总账科目,总账科目：短文本,公司代码货币价值,文本,功能范围：文本",
        "2024-01-01,1.0,d,66010001,运费,1.25,,销售费用", "2024-01-01,14,d,66010001,运费,2.00,,销售费用",
        "2024-01-01,3,d,,运费,9.00,,销售费用"])
    tables, _ = flows.build_cost_tables(spark, {"FBL3H_THIS": cost, "TB": arap_paths["TB"]})
    rows = {r.section: r for r in Workpapers(tables).cost_detail("销售费用").collect()}
    assert (rows[1].p01, rows[1].p13, rows[1].p03, rows[1].total) == (D("1.25"), D(2), D(0), D("3.25"))
    assert rows[2].total is None and (rows[3].account_name, rows[3].total) == ("合计", D("3.25"))

    tables, _ = flows.build_trial_balance(spark, {"TB": arap_paths["TB"]})
    assert {r.account_code for r in tables["trial_balance"].collect()} == {"22029900", "22510100"}
    with pytest.raises(ValueError, match="TB"):
        flows.build_trial_balance(spark, {})


def test_registry(spark, arap_paths):
    tables, _ = flows.build_arap_tables(spark, arap_paths)
    papers = Workpapers(tables)
    with pytest.raises(KeyError):
        papers["no such workpaper"]
    with pytest.raises(KeyError):
        papers.read(spark, "no such workpaper")
    assert papers.read(spark, "无形资产明细表").isEmpty()
    names = papers.register_views()
    assert "ap_detail" in names and "intangible_detail" not in names
    assert spark.sql("SELECT count(*) FROM ar_detail").first()[0] == 1
    published = papers.register_views(published_names=True)
    assert spark.sql("SELECT count(*) FROM `应收账款明细表`").first()[0] == 1
    assert len(fv.VIEW_NAMES) == 27 and set(published) >= {"应付账款明细表", "其他应收款明细表"}
