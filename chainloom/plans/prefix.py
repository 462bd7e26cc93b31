"""Running aggregates over one global order, without one task that sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def running_max(rows: DataFrame, order: str, value: Column, step: int = 4096) -> DataFrame:
    """Adds `ordinal` (0, 1, ... in the order) and `top`, the largest value - ordinal so far.

    order is an integer column without repeats. Its range is cut into spans of `step`; each span is numbered and scanned
    alone, and only one row a span goes through a global window, twice.
    """
    rows = rows.withColumn("_span", F.floor(F.col(order) / step))
    mine = W.partitionBy("_span").orderBy(order)
    sizes = rows.groupBy("_span").agg(F.count(F.lit(1)).alias("_n"))
    whole = W.partitionBy(F.lit(0)).orderBy("_span").rowsBetween(W.unboundedPreceding, -1)
    sizes = sizes.select("_span", F.coalesce(F.sum("_n").over(whole), F.lit(0)).alias("_before"))
    rows = rows.join(sizes, "_span").withColumn("ordinal", F.col("_before") + F.row_number().over(mine) - 1).withColumn("_v", value - F.col("ordinal"))
    tops = rows.groupBy("_span").agg(F.max("_v").alias("_m")).select("_span", F.max("_m").over(whole).alias("_earlier"))
    return rows.join(tops, "_span").withColumn("top", F.greatest(F.max("_v").over(mine.rowsBetween(W.unboundedPreceding, 0)), F.col("_earlier"))).drop("_span", "_before", "_v", "_earlier")
