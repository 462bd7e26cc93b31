"""Keyset pages: rows strictly after a cursor in a total order, and whether more follow."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

DEFAULT_LIMIT, MOST = 100, 1000


def after(order: list[tuple[str, bool]], cursor: dict) -> Column:
    """The rows strictly after the cursor. order: (column, ascending); expanded column by column, so that the leading
    comparison can be pushed to the scan."""
    cases, equal = [], []
    for name, up in order:
        c, v = F.col(name), F.lit(cursor[name])
        cases.append(reduce(Column.__and__, [*equal, c > v if up else c < v]))
        equal.append(c == v)
    bound = F.col(order[0][0]) >= F.lit(cursor[order[0][0]]) if order[0][1] else F.col(order[0][0]) <= F.lit(cursor[order[0][0]])
    return bound & reduce(Column.__or__, cases)


def page(rows: DataFrame, order: list[tuple[str, bool]], limit: int = DEFAULT_LIMIT, cursor: dict | None = None) -> DataFrame:
    """At most limit rows and has_more on each of them; limit is 1 to 1000, anything else raises ValueError.

    limit + 1 rows are taken by one top-k; only those reach the single task that tells has_more. Rows with a null in an
    ordering column never follow a cursor; without one they come last.
    """
    if not 1 <= limit <= MOST:
        raise ValueError(f"limit must be from 1 to {MOST}")
    if cursor is not None:
        rows = rows.where(after(order, cursor))
    keys = [F.col(n).asc_nulls_last() if up else F.col(n).desc_nulls_last() for n, up in order]
    top = rows.orderBy(*keys).limit(limit + 1)
    top = top.withColumn("_at", F.row_number().over(W.partitionBy(F.lit(0)).orderBy(*keys))).withColumn("has_more", F.count(F.lit(1)).over(W.partitionBy(F.lit(0))) > limit)
    return top.where(F.col("_at") <= limit).drop("_at")
