"""Rule switches, the one-pass rollforward, invariants, and hand-worked rows."""

import re
from dataclasses import replace
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerloom import LedgerRules, Workpapers
from ledgerloom.driver_tables import RULES, DriverTables
from ledgerloom.functions.joins import full_outer, left_outer
from ledgerloom.operators.costs import period_label
from ledgerloom.sources.readers import empty

D = Decimal


@pytest.fixture(scope="module")
def tables(spark, folder):
    return DriverTables(spark, folder)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def items(spark, *values):
    """Open items from (account, name, party, party name, currency, doc, local, period)."""
    df = spark.createDataFrame(
        [(a, n, p, pn, c, D(doc), D(loc), t) for a, n, p, pn, c, doc, loc, t in values],
        "account_code string, account_name string, party_code string, party_name string, doc_currency string, "
        "doc_amount decimal(19,2), local_amount decimal(19,2), period_tag string",
    )
    return df.withColumn("source_tag", F.when(F.col("account_code").startswith("2"), "VENDOR").otherwise("CUSTOMER"))


def papers(spark, rules=None, **frames):
    names = ("open_items", "postings", "accruals", "fx_revaluation", "fx_rates", "trial_balance", "adjustments")
    return Workpapers({n: frames.get(n, empty(spark, n)) for n in names}, rules or LedgerRules())


def revaluation(spark, *values):
    return spark.createDataFrame(
        [(p, g, c, D(v)) for p, g, c, v in values],
        "party_code string, gl_account string, currency string, posted_amount decimal(19,2)",
    )


AP, AR = ("22021000", "应付账款"), ("11220010", "应收账款")


def test_names_in_the_key_change_nothing_where_names_are_unique(tables):
    # The accruals without a vendor share one code under two names; leave them out.
    named = dict(tables) | {"accruals": tables["accruals"].filter("vendor_code != ''")}
    pairing = Workpapers(named, RULES)["ap_temp"]
    by_name = Workpapers(named, replace(RULES, party_names_in_key=True))["ap_temp"]
    assert pairing.columns == by_name.columns
    assert rows(pairing) == rows(by_name)


def test_many_names_of_one_code(spark):
    """5,000 names would pair into 25 million rows; with names in the key each is one row."""
    names = [(*AP, "1", f"n{i}", "CNY", "-1", "-1", tag) for i in range(5000) for tag in ("this", "last")]
    many = items(spark, *names, (*AP, "2", None, "CNY", "-3", "-3", "this"), (*AP, "2", None, "CNY", "-4", "-4", "last"))
    w = papers(spark, replace(LedgerRules(), party_names_in_key=True), open_items=many, fx_revaluation=revaluation(spark, ("1", "22021000", "CNY", "2")))
    assert w["name_pairs"].first().pairs == 25_000_000
    found = w["ap_temp"]
    assert found.count() == 5001 and found.where("party_code = '1' AND closing = 1 AND opening = 1 AND fx_adj = -2").count() == 5000
    assert [(r.opening, r.closing) for r in found.where("party_code = '2'").collect()] == [(D(4), D(3))]


def test_two_rates_of_one_currency_are_an_error(spark):
    rate = spark.createDataFrame([("USD", D("7.1")), ("USD", D("7.2"))], "currency string, rate decimal(19,4)")
    w = papers(spark, fx_rates=rate, open_items=items(spark, (*AP, "1", "a", "USD", "-1", "-1", "this")))
    with pytest.raises(Exception, match="DUPLICATED_MAP_KEY"):
        w["ap_fx_temp"].collect()


def scans(df, tables):
    """How often a plan reads each table."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return {t: len(re.findall(rf"FileScan parquet [^\n]*/{t}\b", plan)) for t in tables}


def test_tables_are_read_once(spark, tables, tmp_path, request):
    request.addfinalizer(lambda: spark.conf.unset("spark.sql.maxMetadataStringLength"))
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    stored = {}
    for name in ("open_items", "postings", "accruals", "fx_revaluation", "fx_rates", "adjustments", "trial_balance"):
        tables[name].write.parquet(f"{tmp_path}/{name}")
        stored[name] = spark.read.parquet(f"{tmp_path}/{name}")
    w = Workpapers(stored, RULES)
    ledger = ("open_items", "postings", "accruals", "fx_revaluation")
    assert scans(w["ap_temp"], ledger) == dict.fromkeys(ledger, 1)
    assert scans(w["other_ledger"], ["open_items"]) == {"open_items": 1}
    adjusted = w["ap_fx_adj_temp"]
    assert scans(adjusted, [*ledger, "adjustments", "fx_rates"]) == dict.fromkeys([*ledger, "adjustments", "fx_rates"], 1)
    text = adjusted._jdf.queryExecution().executedPlan().toString()
    assert "FullOuter" not in text and not re.search(r"hashpartitioning\(currency#\d+, \d+\)", text)
    assert scans(w["ar_fx_adj_detail"], ["adjustments"]) == {"adjustments": 1}


def test_two_names_of_one_code_pair_up(spark):
    w = papers(spark, open_items=items(
        spark,
        (*AP, "1", "a", "CNY", "-1", "-1", "this"), (*AP, "1", "b", "CNY", "-2", "-2", "this"),
        (*AP, "1", "a", "CNY", "-4", "-4", "last"), (*AP, "1", "c", "CNY", "-8", "-8", "last"),
    ))
    found = {(r.party_name, r.opening, r.closing) for r in w["ap_temp"].collect()}
    assert found == {("a", D(4), D(1)), ("a", D(8), D(1)), ("b", D(4), D(2)), ("b", D(8), D(2))}
    assert w["duplicate_party_names"].first().names == 3


def test_party_in_one_period_only_and_revaluation_of_accruals(spark):
    accruals = spark.createDataFrame(
        [("7", "x", "USD", None, D("5"), D("1")), ("8", "y", "USD", None, D("5"), D("1")),
         ("8", "y", "USD", None, D("-5"), D("-1"))],
        "vendor_code string, vendor_name string, currency string, misc_charge string, accrual_local decimal(19,2), "
        "accrual_doc decimal(19,2)",
    )
    w = papers(
        spark, accruals=accruals, fx_revaluation=revaluation(spark, ("7", "22021000", "USD", "3"), ("1", "22021000", "CNY", "2")),
        open_items=items(spark, (*AP, "1", "a", "CNY", "-9", "-9", "last"), (*AP, "2", "b", "CNY", "-9", "-9", "this")),
    )
    found = {r.party_code: (r.opening, r.closing, r.decrease, r.accrual, r.fx_adj, r.unaudited) for r in w["ap_temp"].collect()}
    assert found == {
        "1": (D(9), D(0), D(9), D(0), D(-2), D(0)),
        "2": (D(0), D(9), D(-9), D(0), D(0), D(9)),
        "7": (D(0), D(0), D(0), D(5), D(0), D(5)),  # known from accruals only: no revaluation; 8 nets to 0
    }


def test_foreign_currency_without_rate(spark):
    w = papers(spark, open_items=items(
        spark, (*AP, "1", "a", "GBP", "-9", "-80", "this"), (*AP, "2", "b", None, "-9", "-80", "this"),
        (*AR, "3", "c", "GBP", "-9", "-80", "this"),
    ))
    found = {r.party_code: (r.fx_adj, r.unaudited) for r in w["ap_fx_temp"].collect()}
    assert found == {"1": (None, None), "2": (D(0), D(80))}
    ar = w["ar_fx_temp"].first()
    assert (ar.reclass, ar.reported, ar.rate) == (D(0), None, None)


def test_receivable_sign_test_with_and_without_revaluation(spark):
    frames = dict(
        open_items=items(spark, (*AR, "1", "a", "USD", "1", "5", "this"), (*AR, "1", "a", "USD", "1", "5", "last")),
        fx_revaluation=revaluation(spark, ("1", "11220010", "USD", "-7")),
    )
    plain = papers(spark, **frames)["ar_detail"].first()
    assert (plain.reclass, plain.reported) == (D(2), D(-2))
    strict = papers(spark, LedgerRules(receivable_sign_test_ignores_fx=False), **frames)["ar_detail"].first()
    assert (strict.reclass, strict.reported) == (D(2), D(0))


def test_control_row_switches(spark, tables):
    def control(rules, name):
        return {r.party_code: r for r in Workpapers(tables, rules)[name].filter("section = 5").collect()}

    plain, switched = control(RULES, "ap_adj_detail"), control(
        replace(RULES, adjusted_control_unaudited_zero=False), "ap_adj_detail")
    assert {r.unaudited for r in plain.values()} == {D(0)}
    one = switched["22029900"]
    assert one.unaudited == one.closing + one.accrual + one.gl_adj + one.neg_reclass + one.fx_adj
    w = Workpapers(tables, replace(RULES, fx_control_uses_plain_reclass=False))
    total = w["ap_fx_temp"].select(-F.sum("neg_reclass")).first()[0]
    assert {r.party_code: r.neg_reclass for r in w["ap_fx_detail"].filter("section = 5").collect()}["22029900"] == total


def test_cleared_documents_take_their_other_lines_along(spark):
    own, counter = ("12310100", "其他应收款"), ("22410100", "其他应付款")
    lines = [
        (*own, "1", "SA", "S", "d1", "10"), (*counter, "1", "SA", "H", "d1", "-10"), (*own, "1", "RV", "S", "d1", "1"),
        (*own, "2", "SA", "S", "d2", "7"), (*own, "3", "RV", "S", None, "5"), (*own, "3", "SA", "S", None, "0"),
        (*own, "4", "RV", "H", "d4", "-6"), (*counter, "5", "RE", "H", "d5", "-8"),
    ]
    postings = spark.createDataFrame(
        [(a, n, p, f"n{p}", "CNY", t, f, d, D(v)) for a, n, p, t, f, d, v in lines],
        "account_code string, account_name string, party_code string, party_name string, doc_currency string, "
        "doc_type string, dc_flag string, doc_no string, local_amount decimal(19,2)",
    )
    w = papers(spark, postings=postings)
    assert {(r.party_code, r.increase) for r in w["other_movement"].collect()} == {("2", D(7)), ("3", D(5)), ("5", D(8))}
    payable = {r.party_code: (r.debit, r.credit) for r in w["other_payable_detail"].filter("section = 1").collect()}
    assert payable == {"5": (D(8), D(8))}


def test_adjustment_repeats_over_accounts_of_a_party(spark):
    adjustments = spark.createDataFrame(
        [("1", "a", "CNY", D("-30"), "gl", "receivable")],
        "party_code string, party_name string, currency string, amount decimal(19,2), kind string, ledger string",
    )
    w = papers(spark, adjustments=adjustments, open_items=items(
        spark, (*AR, "1", "a", "CNY", "10", "10", "this"), ("11220030", "应收账款", "1", "a", "CNY", "50", "50", "this"),
    ))
    found = {r.account_code: (r.gl_adj, r.reclass, r.reported, r.doc_amount) for r in w["ar_adj_detail"].collect()}
    assert found == {"11220010": (D(-30), D(20), D(0), D(0)), "11220030": (D(-30), D(0), D(20), D(50))}


def test_period_labels(spark):
    df = spark.createDataFrame([("1.0",), ("013",), ("16",), (None,)], "p string")
    assert [r[0] for r in df.select(period_label(F.col("p"))).collect()] == ["1月", "13期调整", "13期调整", None]


def test_null_keys_match_nothing_and_lose_nothing(spark):
    left = spark.createDataFrame([("a", "n", 1), (None, "n", 2)], "k string, name string, x int")
    right = spark.createDataFrame([("a", "m", 3), (None, "n", 4), ("b", "m", 5)], "k string, name string, y int")
    assert rows(full_outer(left, right, ["k"], ["name"])) == sorted(
        [("a", "n", 1, 3), (None, "n", 2, None), (None, "n", None, 4), ("b", "m", None, 5)], key=repr)
    assert rows(left_outer(left, right.drop("name"), ["k"], ["k", "name"])) == sorted(
        [("a", "n", 1, 3), (None, "n", 2, None)], key=repr)


def test_invariants(tables):
    w = Workpapers(tables, RULES)
    ap, ar = w["ap_temp"], w["ar_detail"]
    assert ap.filter("opening + increase - decrease != closing OR unaudited < 0").isEmpty()
    assert ar.filter("coalesce(opening, 0) + increase - decrease != closing").isEmpty()
    assert w["ap_adj_temp"].filter("unaudited < 0").isEmpty()
    moved = ap.select(F.sum("neg_reclass")).first()[0]
    assert w["prepaid_detail"].select(F.sum("prepaid")).first()[0] == moved
    assert w["advance_receipts"].filter("contract_liab + other_cur_liab != unaudited").isEmpty()
    assert w["other_ledger"].filter(
        "if(account_code LIKE '2241%', opening + credit - debit, opening + debit - credit) != closing").isEmpty()


def test_materialized_intermediates_give_the_same_rows(tables):
    lazy, kept = Workpapers(tables, RULES), Workpapers(tables, RULES, materialize=True)
    for name in ("ap_fx_adj_detail", "other_payable_detail"):
        assert rows(lazy[name]) == rows(kept[name])


def test_control_totals_reuse_the_shuffles_of_the_schedule(spark, folder):
    """The scalar subquery must not scan the ledger a second time."""
    def scans(name):
        df = Workpapers(DriverTables(spark, folder), RULES)[name]
        df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan")[0]
        return plan.count("FileScan parquet"), plan.count("ReusedExchange")

    once, _ = scans("ap_temp")
    total, reused = scans("ap_detail")
    # Beyond the rollforward: miscellaneous accruals and the trial balance for two sections.
    assert reused > 0 and total <= once + 4
