"""Joins of per-party totals.

Every side here is already aggregated to one row per key and name, so what is shuffled
grows with the number of parties, not with the number of ledger lines. No side is
force-broadcast: Spark broadcasts a side when its size is below
`spark.sql.autoBroadcastJoinThreshold` and sorts and merges otherwise.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

NULL_KEY_BUCKETS = 256


def null_spread(keys: list[str], by: list[str]) -> str:
    """SQL for `_spread`: 0 for a complete key, a hash bucket for a key with a NULL.

    NULL keys match nothing, yet they would all hash to one task. Joining on this bucket
    as well leaves the matches unchanged and spreads the NULL rows. The 0 is computed (a
    remainder by 1): the optimizer would take a literal out of the join and shuffle keys.
    """
    incomplete = " OR ".join(f"{k} IS NULL" for k in keys)
    return f"cast(pmod(xxhash64({', '.join(by)}), if({incomplete}, {NULL_KEY_BUCKETS}, 1)) AS int) AS _spread"


def no_spread(keys: list[str]) -> str:
    """SQL for the `_spread` of a side whose rows with a NULL key don't matter: always 0, but computed."""
    return f"cast(pmod(xxhash64({', '.join(keys)}), 1) AS int) AS _spread"


def full_outer(left: DataFrame, right: DataFrame, keys: list[str], labels: list[str]) -> DataFrame:
    """Full outer join on `keys`; each label takes the left value, then the right one.

    Keys with several labels per side pair up, as the published workpapers do.
    """
    taken = {*keys, *labels}
    mine = [c for c in left.columns if c not in taken]
    theirs = [c for c in right.columns if c not in taken]
    spread = null_spread(keys, [*keys, *labels])
    renamed = [f"{name} AS _right_{name}" for name in labels]
    joined = left.selectExpr("*", spread).join(
        right.selectExpr(*keys, *renamed, *theirs, spread), [*keys, "_spread"], "full_outer"
    )
    return joined.selectExpr(
        *keys, *[f"coalesce({name}, _right_{name}) AS {name}" for name in labels], *mine, *theirs
    )


def left_outer(left: DataFrame, right: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """Left outer join on `keys`, with NULL-key rows of the left side spread by `by`."""
    complete = right.where(" AND ".join(f"{k} IS NOT NULL" for k in keys)).selectExpr("*", no_spread(keys))
    return left.selectExpr("*", null_spread(keys, by)).join(complete, [*keys, "_spread"], "left").drop("_spread")
