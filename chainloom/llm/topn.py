"""Top N items within every group (problem 2)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from chainloom.functions.normalise import norm_address

SUBGROUPS = 64


def top_n(items: DataFrame, group: Column, score: Column, item: Column, n: int = 10, subgroups: int = SUBGROUPS) -> DataFrame:
    """(grp, rnk, item, score): the n items of highest score of every group, ties in the order of the items.

    Rows with null group or item, or null, NaN or infinite score don't count; an item counts once per group with its
    highest score. A group with fewer items gives them all; an empty input gives no row. The items of a group are hashed
    into subgroups; each subgroup keeps its n best, and the at most n * subgroups survivors of a group are ranked again.
    One exchange by (group, subgroup) serves the repeated items and the first ranking; only survivors travel after it.
    """
    rows = items.select(group.alias("grp"), item.alias("item"), score.cast("double").alias("score"))
    rows = rows.where(F.col("grp").isNotNull() & F.col("item").isNotNull() & ~F.isnan("score") & (F.abs("score") < float("inf")))
    rows = rows.withColumn("sub", F.pmod(F.xxhash64("item"), F.lit(subgroups))).repartition("grp", "sub")
    best = rows.groupBy("grp", "sub", "item").agg(F.max("score").alias("score"))
    order = [F.col("score").desc(), F.col("item").asc()]
    rank = lambda df, *keys: df.withColumn("rnk", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("rnk") <= n)
    return rank(rank(best, "grp", "sub").drop("rnk"), "grp").select("grp", F.col("rnk").cast("bigint").alias("rnk"), "item", "score")


def richest(richlist: DataFrame, n: int = 10) -> DataFrame:
    """(day, rnk, address, balance) of the n addresses of highest balance per date."""
    t = top_n(richlist, F.col("date").cast("string"), F.col("balance"), norm_address(F.col("address")), n)
    return t.select(F.col("grp").alias("day"), "rnk", F.col("item").alias("address"), F.col("score").alias("balance"))
