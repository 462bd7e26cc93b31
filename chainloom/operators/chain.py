"""Blocks to transactions, outputs and inputs; inputs to the outputs they spend; fees and address changes.

Working tables, money in satoshis:
tx(txid, height, tx_n, ts, is_coinbase), txo(txid, n, value_sats, addresses), txi(spending_txid, spending_index, txid, n).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from chainloom.functions.normalise import sats
from chainloom.plans.prefix import running_max
from chainloom.plans.shared import Shared


@dataclass
class Chain:
    tx: DataFrame
    txo: DataFrame
    txi: DataFrame
    #: What spent_outputs gives, where it is known already.
    spent: DataFrame | None = None


def block_times(blocks: DataFrame, after_ms: int = 0) -> DataFrame:
    """(height, time_ms) of blocks(height, time in seconds), one row a height: moved up to be strictly increasing.

    t(i) is time * 1000 if that is later than t(i - 1), else t(i - 1) + 1; in closed form the running maximum of
    time * 1000 - i, plus i, and at least after_ms + i + 1, where after_ms is the time of the block before the first one.
    """
    one = blocks.where("height is not null and time is not null").groupBy("height").agg(F.min("time").alias("time"))
    t = running_max(one, "height", F.col("time") * 1000)
    return t.select("height", (F.greatest(F.col("top"), F.lit(after_ms + 1)) + F.col("ordinal")).alias("time_ms"))


def flatten(blocks: DataFrame, after_ms: int = 0) -> Chain:
    """Working tables of nested blocks. The first transaction of a block is its coinbase and has no inputs."""
    times = block_times(blocks, after_ms)
    t = blocks.select("height", F.posexplode("tx").alias("tx_n", "t"))
    tx = t.select(F.col("t.txid").alias("txid"), "height", "tx_n", (F.col("tx_n") == 0).alias("is_coinbase"), F.col("t.size").alias("size"), F.col("t.version").alias("version"), F.col("t.locktime").alias("locktime"), F.size("t.vin").alias("input_count"), F.size("t.vout").alias("output_count"))
    tx = tx.join(times.select("height", F.timestamp_millis("time_ms").alias("ts")), "height")
    txo = t.select(F.col("t.txid").alias("txid"), "height", "tx_n", F.explode("t.vout").alias("o")).select("txid", "height", "tx_n", F.col("o.n").alias("n"), sats(F.col("o.value")).alias("value_sats"), F.col("o.scriptPubKey.addresses").alias("addresses"))
    txi = t.where("tx_n <> 0").select(F.col("t.txid").alias("spending_txid"), "height", "tx_n", F.posexplode("t.vin").alias("spending_index", "i")).select("spending_txid", "height", "tx_n", "spending_index", F.col("i.txid").alias("txid"), F.col("i.vout").alias("n"))
    return Chain(tx, txo, txi)


def single_address(addresses: Column) -> Column:
    """The address of an output that has exactly one, else null."""
    return F.when(F.size(addresses) == 1, F.get(addresses, F.lit(0)))


def first_address(addresses: Column) -> Column:
    return F.when(F.size(addresses) > 0, F.get(addresses, F.lit(0)))


def latest(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The last row a key, as an upsert leaves it."""
    return rows.withColumn("_r", F.row_number().over(W.partitionBy(*key).orderBy(*(F.col(c).desc_nulls_last() for c in order)))).where("_r = 1").drop("_r")


def spent_outputs(c: Chain) -> DataFrame:
    """(spending_txid, spending_index, txid, n, value_sats, addresses) of every input; nulls where its output is unknown.

    Where blocks repeat a txid, an input spends the latest output confirmed before it. That is an as-of join by one sort of
    both sides together inside (txid, n): a join on equal names would pair every input with every output of its name.
    """
    if c.spent is not None:
        return c.spent
    if "height" in c.txo.columns and "height" in c.txi.columns:
        key = ["spending_txid", "height", "spending_index", "txid", "n"]
        # A struct a column tells an output with a null from an input, and columns nobody asks for aren't shuffled.
        made = c.txo.where("txid is not null and n is not null").select("txid", "n", "height", "tx_n", F.struct("value_sats").alias("_v"), F.struct("addresses").alias("_a"))
        # Ordered by name where they are made, so that names that many blocks repeat take little room in the exchange.
        both = c.txi.select(*key, "tx_n").unionByName(made, allowMissingColumns=True).sortWithinPartitions("txid", "n")
        # An input (no _v) comes before the outputs of its own transaction; of outputs of one place the largest counts.
        w = W.partitionBy("txid", "n").orderBy("height", "tx_n", "_v").rowsBetween(W.unboundedPreceding, 0)
        j = both.withColumns({x: F.last(x, ignorenulls=True).over(w) for x in ("_v", "_a")} | {"_asks": F.col("_v").isNull()}).where("_asks")
        # Inputs of one key are of one height; the one furthest back in the block sees the latest output.
        latest_of = lambda x: F.max_by(x, F.coalesce("tx_n", F.lit(-1)))
        j = j.groupBy(*key).agg(latest_of(F.col("_v.value_sats")).alias("value_sats"), latest_of(F.col("_a.addresses")).alias("addresses"))
        return j.select("spending_txid", "spending_index", "txid", "n", "value_sats", "addresses", "height")
    return c.txi.join(c.txo.select("txid", "n", "value_sats", "addresses"), ["txid", "n"], "left").select("spending_txid", "spending_index", "txid", "n", "value_sats", "addresses")


def resolved(c: Chain) -> Chain:
    """The same ledger with its spent outputs written once, for operators that need them several times."""
    return Chain(c.tx, c.txo, c.txi, Shared(c.tx.sparkSession, "spent").table(spent_outputs(c)))


def spent_markers(c: Chain) -> DataFrame:
    """(txid, n, spending_txid, spending_index) of every output; nulls where it is unspent."""
    return c.txo.select("txid", "n").join(c.txi.select("txid", "n", "spending_txid", "spending_index"), ["txid", "n"], "left")


def _key(c: Chain) -> list[str]:
    """What names a transaction: its txid, with its height where blocks may repeat a txid."""
    return ["txid", "height"] if "height" in c.txo.columns else ["txid"]


def fees(c: Chain) -> DataFrame:
    """(txid[, height], fee_sats, input_count, output_count): inputs less outputs over all of them, 0 for a coinbase, null if
    an input's output is unknown."""
    key = _key(c)
    spent = spent_outputs(c).drop("txid").withColumnRenamed("spending_txid", "txid")
    ins = spent.groupBy(*key).agg(F.sum("value_sats").alias("in_sats"), F.count(F.lit(1)).alias("input_count"), F.count("value_sats").alias("known"))
    outs = c.txo.groupBy(*key).agg(F.sum("value_sats").alias("out_sats"), F.count(F.lit(1)).alias("output_count"))
    n = lambda x: F.coalesce(x, F.lit(0))
    fee = F.when(F.col("is_coinbase"), F.lit(0)).when(n("known") == n("input_count"), n("in_sats") - n("out_sats"))
    return c.tx.select(*key, "is_coinbase").join(outs, key, "left").join(ins, key, "left").select(*key, fee.cast("bigint").alias("fee_sats"), n("input_count").alias("input_count"), n("output_count").alias("output_count"))


def address_deltas(c: Chain, address=single_address) -> DataFrame:
    """(txid, height, tx_n, ts, address, delta_sats): what each transaction adds to each address, zero included.

    address picks the address of an output: the only one for balances, the first one for clusters.
    """
    key = _key(c)
    plus = c.txo.select(*key, address(F.col("addresses")).alias("address"), F.col("value_sats").alias("v"))
    minus = spent_outputs(c).drop("txid").withColumnRenamed("spending_txid", "txid").select(*key, address(F.col("addresses")).alias("address"), (-F.col("value_sats")).alias("v"))
    sums = plus.unionByName(minus).where("address is not null").groupBy(*key, "address").agg(F.sum("v").alias("delta_sats"))
    return sums.join(c.tx.select("txid", "height", "tx_n", "ts"), key).select("txid", "height", "tx_n", "ts", "address", "delta_sats")


def block_deltas(deltas: DataFrame) -> DataFrame:
    """(address, ts, delta_sats): one row an address and block."""
    return deltas.groupBy("address", "ts").agg(F.sum("delta_sats").alias("delta_sats"))
