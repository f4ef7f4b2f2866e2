"""Comparison of a Spark result with its DuckDB statement, value by value and type by type."""

from __future__ import annotations

from collections import Counter
from decimal import Decimal

import duckdb

DRIVER_TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in DRIVER_TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet')")
    return con


def _plain(value):
    if isinstance(value, float):
        return round(value, 6)
    if isinstance(value, Decimal):
        return value.normalize() + 0
    return value


def _rows(table) -> Counter:
    columns = sorted(table.column_names)
    lists = [[_plain(v) for v in table.column(c).to_pylist()] for c in columns]
    return Counter(zip(*lists)) if lists else Counter()


def differences(spark_df, con: duckdb.DuckDBPyConnection, sql: str) -> list[str]:
    """What differs, in words; empty when the results agree."""
    mine, theirs = spark_df.toArrow(), con.sql(sql).to_arrow_table()
    found = []
    if sorted(mine.column_names) != sorted(theirs.column_names):
        return [f"columns {sorted(mine.column_names)} and {sorted(theirs.column_names)}"]
    for column in mine.column_names:
        a, b = mine.schema.field(column).type, theirs.schema.field(column).type
        if str(a).replace("large_", "") != str(b).replace("large_", ""):
            found.append(f"type of {column}: {a} and {b}")
    left, right = _rows(mine), _rows(theirs)
    if left != right:
        order = sorted(mine.column_names)
        found.append(f"{mine.num_rows} and {theirs.num_rows} rows, columns {order}")
        found += [f"only Spark: {r}" for r in list((left - right))[:3]]
        found += [f"only DuckDB: {r}" for r in list((right - left))[:3]]
    return found
