"""The pN_ queries of this package, each with its SQL where there is one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from chainloom.llm import consolidate, leaks, mixing, stuffing, topn
from chainloom.queries import sql
from chainloom.sources.tables import table


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return topn.richest(table(spark, d, "daily_richlist")).select("day", "rnk", "address")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return consolidate.linked_addresses(table(spark, d, "union_find"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leaked_passages(table(spark, d, "documents"), table(spark, d, "eval_item"))


def p8_items(spark: SparkSession, d: str) -> DataFrame:
    """Which items leaked: into how many documents, and the longest run of words."""
    items = table(spark, d, "eval_item")
    found = leaks.leaks(table(spark, d, "documents"), items).where(F.col("run_words") >= leaks.WINDOW)
    found = found.groupBy("item_id").agg(F.countDistinct("doc_id").alias("documents"), F.max("run_words").alias("longest_run"))
    return found.join(items.select("item_id", "benchmark", "split").dropDuplicates(["item_id"]), "item_id").select("item_id", "benchmark", "split", "documents", "longest_run")


def p8_near(spark: SparkSession, d: str) -> DataFrame:
    """Pairs with at least one window like one of an item: equal ones (exact, the longest run in run_words) or only near
    ones, with the largest size of such windows and the best similarity at any size."""
    found = leaks.leaks(table(spark, d, "documents"), table(spark, d, "eval_item"))
    pairs = found.groupBy("doc_id", "item_id").agg(F.max("size").alias("size"), F.max("similarity").alias("similarity"), F.max("run_words").alias("run_words"))
    return pairs.select("doc_id", "item_id", (F.col("run_words") >= leaks.WINDOW).alias("exact"), "size", "similarity", "run_words")


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_target"))


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.shares(p9_mix(spark, d), table(spark, d, "mix_target"))


def p9_whole_mix(spark: SparkSession, d: str) -> DataFrame:
    """A mix of as many tokens as all named sources hold: sources that run out fall short of their weights."""
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_target"), whole=True)


def p9_whole_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.shares(p9_whole_mix(spark, d), table(spark, d, "mix_target"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return stuffing.stuffed_pages(table(spark, d, "documents"))


SQL = {
    "p2_found": f"""WITH r AS (SELECT CAST(date AS VARCHAR) AS day, {sql.address("address")} AS address, max(balance) AS b FROM daily_richlist
  WHERE date IS NOT NULL AND balance IS NOT NULL AND NOT isnan(balance) AND NOT isinf(balance) GROUP BY ALL)
SELECT day, CAST(row_number() OVER (PARTITION BY day ORDER BY b DESC, address) AS BIGINT) AS rnk, address FROM r WHERE address IS NOT NULL
QUALIFY rnk <= 10""",
    "p3_found": f"""WITH RECURSIVE p AS (SELECT {sql.address("address")} AS a, {sql.address("parent")} AS b FROM union_find),
e AS (SELECT a, b FROM p WHERE a <> b UNION SELECT b, a FROM p WHERE a <> b),
r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT a AS address, least(a, min(b)) AS group_id FROM r GROUP BY a""",
}
QUERIES = {f.__name__: f for f in (p2_found, p3_found, p8_found, p8_items, p8_near, p9_mix, p9_shares, p9_whole_mix, p9_whole_shares, p10_found)}
