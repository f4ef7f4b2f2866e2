"""Where rows run: NULL keys must not meet in one task."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions.joins import full_outer, left_outer, no_spread, null_spread
from ledgerloom.sources.rates import fx_rates_long, read_rate_table
from ledgerloom.sources.sinks import with_labels

PLAIN = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}


@pytest.fixture()
def plain(spark):
    before = {k: spark.conf.get(k) for k in PLAIN}
    for k, v in PLAIN.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.set(k, v)


def _largest_share(df):
    """Rows of the fullest task over the mean."""
    sizes = Counter(r[0] for r in df.select(F.spark_partition_id()).collect())
    return max(sizes.values()) / (sum(sizes.values()) / 8)


def _sides(spark, right_null):
    left = spark.range(20_000).selectExpr("if(id % 2 = 0, NULL, cast(id AS string)) AS k", "cast(id AS string) AS n", "id AS v")
    key = "if(id % 2 = 0, NULL, cast(id AS string))" if right_null else "cast(id AS string)"
    return left, spark.range(20_000).selectExpr(f"{key} AS k", "cast(id AS string) AS n", "id AS w")


@pytest.mark.parametrize("right_null", [True, False])
def test_joins_spread_null_keys(plain, right_null):
    left, right = _sides(plain, right_null)
    joined = left_outer(left, right.select("k", "w"), ["k"], ["n"])
    assert joined.count() == 20_000 and _largest_share(joined) < 2
    outer = full_outer(left, right, ["k"], ["n"])
    assert outer.count() == 30_000 and _largest_share(outer) < 2
    lines = left.selectExpr("*", null_spread(["k"], ["n"]))
    anti = lines.join(right.where("w < 10000").selectExpr("k", no_spread(["k"])), ["k", "_spread"], "left_anti")
    assert anti.count() == 15_000 and _largest_share(anti) < 2


def test_labelled_rows_are_in_order(spark):
    rows = [(1, f"a{i:05d}", i) for i in range(3000)] + [(2, "z", 0)]
    shuffled = spark.createDataFrame(rows, "section int, account_code string, amount long").repartition(7)
    labelled = with_labels(shuffled, {"account_code": "code", "amount": "amount"})
    assert [r.code for r in labelled.collect()] == [r[1] for r in rows]


def test_published_rate_heading(spark, tmp_path):
    path = str(tmp_path / "rates.csv")
    spark.createDataFrame([("2024-12-31", "718.84"), ("2024-12-30", "718.97")], "`日期` string, `美元` string").write.csv(path, header=True)
    assert [float(r.rate) for r in fx_rates_long(read_rate_table(spark, path), "2024-12-31").collect()] == [7.1884]
