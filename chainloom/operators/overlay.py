"""The newest blocks and the unconfirmed transactions laid over the stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

HOT_BLOCKS = 10


def overlay(hot: DataFrame, cold: DataFrame, key: list[str]) -> DataFrame:
    """The hot rows, and the cold ones whose key isn't hot."""
    return hot.unionByName(cold.join(hot.select(*key).distinct(), key, "left_anti"), allowMissingColumns=True)


def split_hot(rows: DataFrame, depth: int = HOT_BLOCKS) -> tuple[DataFrame, DataFrame]:
    """(rows of the newest `depth` heights, older rows) of anything with a height."""
    tip = rows.agg((F.max("height") - depth).alias("_below"))
    marked = rows.join(F.broadcast(tip))  # one row
    return marked.where("height > _below").drop("_below"), marked.where("height <= _below").drop("_below")


def double_spent(inputs: DataFrame) -> DataFrame:
    """(spending_txid) of unconfirmed transactions that lost an output to one that arrived later.

    inputs: (spending_txid, arrived, txid, n). Of transactions arriving at the same time the larger id counts as later.
    """
    last = inputs.groupBy("txid", "n").agg(F.max(F.struct("arrived", "spending_txid"))["spending_txid"].alias("winner"), F.count(F.lit(1)).alias("k")).where("k > 1")
    return inputs.join(last, ["txid", "n"]).where("spending_txid <> winner").select("spending_txid").distinct()


def unconfirmed(transactions: DataFrame, confirmed: DataFrame, inputs: DataFrame) -> DataFrame:
    """The transactions(txid, ...) neither confirmed(txid) nor double spent."""
    gone = confirmed.select("txid").unionByName(double_spent(inputs).select(F.col("spending_txid").alias("txid"))).distinct()
    return transactions.join(gone, "txid", "left_anti")


def pool_totals(pool: DataFrame) -> DataFrame:
    """(total_fees_sats, tx_count) of pool(txid, fee_sats)."""
    return pool.agg(F.coalesce(F.sum("fee_sats"), F.lit(0)).alias("total_fees_sats"), F.countDistinct("txid").alias("tx_count"))


def pool_by_address(changes: DataFrame) -> DataFrame:
    """(address, tx_count, change_sats) of unconfirmed changes(address, txid, delta_sats)."""
    return changes.groupBy("address").agg(F.countDistinct("txid").alias("tx_count"), F.sum("delta_sats").alias("change_sats"))


def input_details(inputs: DataFrame, hot_outputs: DataFrame, stored_outputs: DataFrame) -> DataFrame:
    """inputs(txid, n, ...) with address and value_sats of the output they spend, hot ones first; null if in neither. Of
    differing copies of an output the one of the largest address and value counts."""
    one = lambda df, to: df.groupBy("txid", "n").agg(F.max(F.struct("address", "value_sats")).alias(to))
    h, s = one(hot_outputs, "_hot"), one(stored_outputs, "_stored")
    j = inputs.join(h, ["txid", "n"], "left").join(s, ["txid", "n"], "left").withColumn("_d", F.coalesce("_hot", "_stored"))
    return j.select(*inputs.columns, "_d.address", "_d.value_sats")


def chain_events(known: DataFrame, now: DataFrame, deepest: int = HOT_BLOCKS) -> DataFrame:
    """(type, hash, height, step) that turn the known chain into the present one, both (height, hash) of their top blocks:
    deletes from the top down, then adds upwards. ValueError if more than `deepest` known blocks would go."""
    gone = known.join(now, ["height", "hash"], "left_anti").select(F.lit("delete").alias("type"), "hash", "height", (-F.col("height")).cast("bigint").alias("_o"), F.lit(0).alias("_g"))
    new = now.join(known, ["height", "hash"], "left_anti").select(F.lit("add").alias("type"), "hash", "height", F.col("height").cast("bigint").alias("_o"), F.lit(1).alias("_g"))
    if len(gone.limit(deepest + 1).take(deepest + 1)) > deepest:
        raise ValueError(f"reorganisation deeper than {deepest} blocks")
    return gone.unionByName(new).orderBy("_g", "_o").drop("_g", "_o")
