"""The serving tables of a ledger, each derived from block documents, and how they are stored."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, functions as F

from chainloom.functions.normalise import bin_of
from chainloom.operators import balances as B, chain as C, clusters as K
from chainloom.sources.blocks import headers

DAY_MS = 86_400_000


@dataclass(frozen=True)
class Layout:
    """Columns by which a table is split into folders and sorted inside its files."""

    split: list[str] = field(default_factory=list)
    order: list[str] = field(default_factory=list)


#: Keys as the lookups use them. Days are folders, so a day's list is one pruned scan; hash bins are plain columns.
LAYOUTS = {
    "block": Layout(order=["hash"]),
    "longest_chain": Layout(order=["height"]),
    "confirmed_transaction": Layout(order=["height", "tx_n"]),
    "transaction": Layout(order=["txid"]),
    "transaction_input": Layout(order=["spending_txid", "spending_index"]),
    "transaction_output": Layout(order=["txid", "n"]),
    "address_transaction": Layout(order=["address", "timestamp", "height", "tx_n"]),
    "address_balance": Layout(order=["address", "timestamp"]),
    "ohlc": Layout(order=["address", "timestamp"]),
    "daily_richlist": Layout(["date"], ["bin", "balance_sats", "address"]),
    "daily_top_gainers": Layout(["date"], ["bin", "change_sats", "address"]),
    "daily_top_losers": Layout(["date"], ["bin", "change_sats", "address"]),
    "union_find": Layout(order=["address"]),
    "cluster_address": Layout(order=["cluster_id", "address"]),
    "cluster_transaction": Layout(order=["cluster_id", "timestamp", "height", "tx_n"]),
    "cluster_details": Layout(order=["bin", "cluster_id"]),
    "cluster_daily_balance_change": Layout(["date"], ["bin", "cluster_id"]),
}


def _last(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """One row a key, as the last upsert leaves it: an aggregate, combined before the shuffle."""
    rest = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_v")).select(*key, "_v.*")


def serving_tables(blocks: DataFrame, clusters: bool = True) -> dict[str, DataFrame]:
    """All tables of LAYOUTS by name, amounts in satoshis, from block documents (see sources.blocks.BLOCK).

    Of several blocks of a height the one of the largest hash counts as written last; of a transaction, input or output that
    several blocks repeat, the one of the highest block. clusters=False leaves out the five
    cluster tables, which need an iterative operator and run as soon as this is called.
    """
    c = C.flatten(blocks)
    deltas = C.address_deltas(c)
    per_block = C.block_deltas(deltas)
    candle = B.candles(per_block)
    binned = lambda df: df.withColumnRenamed("day", "date").withColumn("bin", bin_of(F.col("address"), 20))
    ins = blocks.select("height", F.explode("tx").alias("t")).select("height", F.col("t.txid").alias("spending_txid"), F.posexplode("t.vin").alias("spending_index", "i")).select("height", "spending_txid", "spending_index", "i.txid", "i.vout", "i.coinbase", "i.sequence", F.col("i.scriptSig").alias("scriptsig"))
    outs = blocks.select("height", F.explode("tx").alias("t")).select("height", F.col("t.txid").alias("txid"), F.explode("t.vout").alias("o")).select("height", "txid", F.col("o.n").alias("n"), C.sats(F.col("o.value")).alias("value_sats"), F.col("o.scriptPubKey").alias("scriptpubkey"))
    spent = _last(c.txi.select("txid", "n", "height", "tx_n", "spending_txid", "spending_index"), ["txid", "n"], ["height", "tx_n"]).drop("height", "tx_n")
    outs = _last(outs, ["txid", "n"], ["height"]).drop("height").join(spent, ["txid", "n"], "left")
    tables = {
        "block": headers(blocks),
        "longest_chain": blocks.groupBy("height").agg(F.max("hash").alias("hash")),
        "confirmed_transaction": c.tx.select("height", "tx_n", "txid"),
        "transaction": C.latest(c.tx.select("txid", "height", "tx_n", "size", "version", "locktime", "input_count", "output_count").join(C.fees(c).select("txid", "height", "fee_sats"), ["txid", "height"]), ["txid"], ["height", "tx_n"]),
        "transaction_input": _last(ins, ["spending_txid", "spending_index"], ["height"]).drop("height"),
        "transaction_output": outs,
        "address_transaction": deltas.select("address", F.col("ts").alias("timestamp"), "height", "tx_n", F.col("delta_sats").alias("change_sats")),
        "address_balance": B.running_balances(per_block).select("address", F.col("ts").alias("timestamp"), "balance_sats"),
        "ohlc": candle.select("address", F.lit(DAY_MS).alias("interval"), F.col("day").cast("timestamp").alias("timestamp"), "open", "high", "low", "close"),
        "daily_richlist": binned(B.rich_list(per_block)),
        "daily_top_gainers": binned(B.gainers(candle)),
        "daily_top_losers": binned(B.losers(candle)),
    }
    if clusters:
        members = K.cluster_addresses(c)
        ctx = K.cluster_transactions(c, members)
        of_cluster = lambda df: df.withColumn("bin", bin_of(F.col("cluster_id"), 100))
        tables |= {
            "union_find": members.select("address", F.when(F.col("cluster_id") != F.col("address"), F.col("cluster_id")).alias("parent")),
            "cluster_address": members.select("cluster_id", "address"),
            "cluster_transaction": ctx.withColumnRenamed("ts", "timestamp"),
            "cluster_details": of_cluster(K.cluster_balances(ctx).select("cluster_id", "balance_sats")),
            "cluster_daily_balance_change": of_cluster(K.cluster_days(ctx).withColumnRenamed("day", "date")),
        }
    return tables


def views(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The three derived lists: daily cluster gainers and losers, and the cluster rich list."""
    days, details = tables["cluster_daily_balance_change"], tables["cluster_details"]
    return {"daily_top_cluster_gainers": days.where("change_sats > 0"), "daily_top_cluster_losers": days.where("change_sats < 0"), "cluster_richlist": details.where("balance_sats > 0")}


def write_tables(tables: dict[str, DataFrame], root: str) -> None:
    """Each table as parquet under root, replacing what is there; sorted as LAYOUTS says, so that lookups skip row groups."""
    for name, df in tables.items():
        layout = LAYOUTS.get(name, Layout())
        if layout.split:
            df = df.repartition(*layout.split, *[c for c in ("bin",) if c in df.columns])
        elif layout.order:
            df = df.repartitionByRange(layout.order[0])
        if keys := [*layout.split, *layout.order]:
            df = df.sortWithinPartitions(*keys)
        w = df.write.mode("overwrite")
        (w.partitionBy(*layout.split) if layout.split else w).parquet(f"{root}/{name}")
