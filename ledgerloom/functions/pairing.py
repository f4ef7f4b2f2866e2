"""Totals of several sources side by side, by grouping instead of a chain of full outer joins.

The published workpapers join per-party totals of each source by full outer joins on fewer columns than they are summed by:
a code with two names in one source and three in another gives six rows. Here the lines of all sources are summed in one
grouping, the totals of a key come together as one array for each source, and the arrays are exploded in turn. An array
without entries gives one NULL, so the rows are those of the joins.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ledgerloom.functions.columns import any_null, as_columns
from ledgerloom.functions.joins import left_outer

AMOUNT = "decimal(19,2)"


def lines(df: DataFrame, source: Column, columns: dict[str, Column | str], local: Column, doc: Column | None = None) -> DataFrame:
    """Lines of one table for `gathered`: keys and labels, the source of each line, an amount and a document amount."""
    missing = F.lit(None).cast(AMOUNT)
    amounts = {"local": local.cast(AMOUNT), "doc": missing if doc is None else doc.cast(AMOUNT)}
    return as_columns(df, {**columns, "source": source, **amounts})


def gathered(
    parts: list[DataFrame], keys: list[str], labels: list[str], kept: dict[str, Column | None], complete: list[str] | None = None
) -> DataFrame:
    """(keys, _apart, a column for each source): the totals of a key as arrays of structs (labels, local, doc).

    `kept` names the sources, each with a condition that its totals (`local`, `doc`) must meet. Lines are summed on the map
    side first, so a key with most of the lines is a few rows a task. A key with a NULL matches nothing: `_apart` keeps its
    totals alone and spreads them over tasks. It is '' for complete keys. `complete`: the keys that this holds for (all).
    """
    rows = reduce(DataFrame.unionByName, parts)
    totals = rows.groupBy(*keys, *labels, "source").agg(F.sum("local").alias("local"), F.sum("doc").alias("doc"))
    alone = F.to_json(F.struct("source", *labels), {"ignoreNullFields": "false"})
    totals = totals.withColumn("_apart", F.when(any_null(*(complete or keys)), alone).otherwise(F.lit("")))
    total = F.struct(*labels, "local", "doc")

    def of(source: str, condition: Column | None) -> Column:
        wanted = F.col("source") == source
        return F.collect_list(F.when(wanted if condition is None else wanted & condition, total)).alias(source)

    return totals.groupBy(*keys, "_apart").agg(*(of(*item) for item in kept.items()))


def paired(grouped: DataFrame, sources: list[str], labels: list[str]) -> DataFrame:
    """One row for each combination of the sources' totals; each label is that of the first source that has one.

    Each source becomes a struct column, NULL where a key has no total of it. Keys without any total are left out.
    """
    entries = reduce(lambda a, b: a + b, [F.size(s) for s in sources])
    rows = grouped.where(entries > 0)
    for source in sources:
        others = [c for c in rows.columns if c != source]
        rows = rows.select(*others, F.explode_outer(source).alias(source))
    return rows.withColumns({name: F.coalesce(*(F.col(s)[name] for s in sources)) for name in labels})


def overlaid(df: DataFrame, rows: DataFrame, keys: list[str], kinds: dict[str, str], by: list[str]) -> DataFrame:
    """`df` left-joined with each kind of `rows` (keys, kind, amount) in turn, by one join.

    The kinds of a key come together as one row of arrays and are exploded after the join, so an amount that is there twice
    repeats its rows, as separate joins do. `kinds` names the new column of each kind. NULL keys of `df` are spread by `by`.
    """
    arrays = [F.collect_list(F.when(F.col("kind") == kind, F.struct("amount"))).alias(name) for kind, name in kinds.items()]
    rows = rows.where(F.col("kind").isin(*kinds)).groupBy(*keys).agg(*arrays)
    joined = left_outer(df, rows, keys, by=by)
    for name in kinds.values():
        others = [c for c in joined.columns if c != name]
        joined = joined.select(*others, F.explode_outer(name).alias(name))
    return joined.withColumns({name: F.col(name)["amount"] for name in kinds.values()})
