"""The newest blocks and the pool of unconfirmed transactions, and the lookups that see them before the stored tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from chainloom.operators import balances as B, chain as C
from chainloom.operators.overlay import input_details, overlay, pool_totals
from chainloom.plans.paging import DEFAULT_LIMIT, page


@dataclass
class Pool:
    """tx(txid, arrived), inputs(spending_txid, spending_index, txid, n), outputs(txid, n, address, value_sats), each row
    once; unconfirmed and not double spent (see overlay.unconfirmed)."""

    tx: DataFrame
    inputs: DataFrame
    outputs: DataFrame


@dataclass
class Live:
    """The pool, the newest blocks (hot), and of the stored tables: outputs(txid, n, address, value_sats),
    address_transaction(address, ts, height, tx_n, change_sats), address_balance(address, ts, balance_sats),
    confirmed(height, tx_n, txid)."""

    pool: Pool
    hot: C.Chain
    outputs: DataFrame
    address_transaction: DataFrame
    address_balance: DataFrame
    confirmed: DataFrame


def _flat(txo: DataFrame) -> DataFrame:
    return txo.select("txid", "n", C.single_address(F.col("addresses")).alias("address"), "value_sats")


def pool_inputs(v: Live) -> DataFrame:
    """(spending_txid, txid, n, address, value_sats): what the pool spends, from the pool, the newest blocks or the store."""
    fresh = overlay(v.pool.outputs.select("txid", "n", "address", "value_sats"), _flat(v.hot.txo), ["txid", "n"])
    return input_details(v.pool.inputs.select("spending_txid", "txid", "n"), fresh, v.outputs)


def pool_details(v: Live) -> DataFrame:
    """(txid, arrived, fee_sats, input_count, output_count); the fee is null if something spent is unknown."""
    ins = pool_inputs(v).groupBy(F.col("spending_txid").alias("txid")).agg(F.sum("value_sats").alias("i"), F.count(F.lit(1)).alias("input_count"), F.count("value_sats").alias("known"))
    outs = v.pool.outputs.groupBy("txid").agg(F.sum("value_sats").alias("o"), F.count(F.lit(1)).alias("output_count"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    fee = F.when(zero("known") == zero("input_count"), zero("i") - zero("o"))
    return v.pool.tx.join(ins, "txid", "left").join(outs, "txid", "left").select("txid", "arrived", fee.cast("bigint").alias("fee_sats"), zero("input_count").alias("input_count"), zero("output_count").alias("output_count"))


def pool_deltas(v: Live) -> DataFrame:
    """(txid, arrived, address, delta_sats) of every unconfirmed transaction and address it pays or spends from."""
    minus = pool_inputs(v).select(F.col("spending_txid").alias("txid"), "address", (-F.col("value_sats")).alias("v"))
    rows = v.pool.outputs.select("txid", "address", F.col("value_sats").alias("v")).unionByName(minus).where("address is not null")
    return rows.groupBy("txid", "address").agg(F.sum("v").alias("delta_sats")).join(v.pool.tx.select("txid", "arrived"), "txid").select("txid", "arrived", "address", "delta_sats")


def pool_page(v: Live, limit: int = DEFAULT_LIMIT, cursor: dict | None = None) -> DataFrame:
    """(arrived, txid, fee_sats, input_count, output_count, has_more) in the order of arrival, with each transaction's
    details; only the page is joined to them."""
    top = page(v.pool.tx.select("arrived", "txid"), [("arrived", True), ("txid", True)], limit, cursor)
    return top.join(pool_details(v).drop("arrived"), "txid")


def pool_totals_of(v: Live) -> DataFrame:
    """(total_fees_sats, tx_count) of the pool."""
    return pool_totals(pool_details(v))


def address_pool_page(v: Live, address: str, limit: int = DEFAULT_LIMIT, cursor: dict | None = None) -> DataFrame:
    """(arrived, txid, delta_sats, has_more) of an address' unconfirmed transactions in the order of arrival."""
    rows = pool_deltas(v).where(F.col("address") == address).select("arrived", "txid", "delta_sats")
    return page(rows, [("arrived", True), ("txid", True)], limit, cursor)


def transactions_of(v: Live, rows: DataFrame) -> DataFrame:
    """rows(txid, ...) with state ('pool', 'hot', 'stored' or null) and, where confirmed, height and tx_n; the pool first,
    then the newest blocks, then the store. Of several stored places the highest."""
    place = lambda df, state: df.select("txid", F.struct(F.lit(state).alias("state"), F.col("height").cast("int").alias("height"), F.col("tx_n").cast("int").alias("tx_n")).alias(state))
    pool = place(v.pool.tx.select("txid", F.lit(None).alias("height"), F.lit(None).alias("tx_n")), "pool")
    last = lambda df: df.groupBy("txid").agg(F.max(F.struct("height", "tx_n")).alias("p")).select("txid", "p.height", "p.tx_n")
    out = rows.join(pool, "txid", "left").join(place(last(v.hot.tx), "hot"), "txid", "left").join(place(last(v.confirmed), "stored"), "txid", "left")
    return out.withColumn("_p", F.coalesce("pool", "hot", "stored")).select(*rows.columns, "_p.state", "_p.height", "_p.tx_n")


def hot_spent(v: Live) -> DataFrame:
    """(spending_txid, height, txid, n, address, value_sats): what the newest blocks spend, from themselves or the store."""
    ins = v.hot.txi.join(v.hot.tx.select(F.col("txid").alias("spending_txid"), "height"), "spending_txid") if "height" not in v.hot.txi.columns else v.hot.txi
    return input_details(ins.select("spending_txid", "height", "txid", "n"), _flat(v.hot.txo), v.outputs)


def hot_deltas(v: Live) -> DataFrame:
    """(address, ts, height, tx_n, change_sats) of the newest blocks."""
    plus = _flat(v.hot.txo).select("txid", "address", F.col("value_sats").alias("v"))
    minus = hot_spent(v).select(F.col("spending_txid").alias("txid"), "address", (-F.col("value_sats")).alias("v"))
    sums = plus.unionByName(minus).where("address is not null").groupBy("txid", "address").agg(F.sum("v").alias("change_sats"))
    return sums.join(v.hot.tx.select("txid", "ts", "height", "tx_n"), "txid").select("address", "ts", "height", "tx_n", "change_sats")


def hot_balances(v: Live) -> DataFrame:
    """(address, ts, balance_sats) after each of the newest blocks: their running sums on the last stored balance."""
    per_block = hot_deltas(v).groupBy("address", "ts").agg(F.sum("change_sats").alias("delta_sats"))
    ends = v.address_balance.groupBy("address").agg(F.max_by("balance_sats", "ts").alias("_stored"))
    b = B.running_balances(per_block).join(ends, "address", "left")
    return b.select("address", "ts", (F.col("balance_sats") + F.coalesce("_stored", F.lit(0))).alias("balance_sats"))


def address_transactions(v: Live, address: str, limit: int = DEFAULT_LIMIT, cursor: dict | None = None) -> DataFrame:
    """(ts, height, tx_n, change_sats, balance_after_sats, has_more), newest first: the newest blocks, then the store; a
    stored row that is in a newest block counts once."""
    mine = lambda df: df.where(F.col("address") == address)
    rows = overlay(mine(hot_deltas(v)), mine(v.address_transaction), ["height", "tx_n"])
    top = page(rows.select("ts", "height", "tx_n", "change_sats"), [("ts", False), ("height", False), ("tx_n", False)], limit, cursor)
    after = overlay(mine(hot_balances(v)), mine(v.address_balance), ["ts"]).select("ts", F.col("balance_sats").alias("balance_after_sats"))
    return top.join(after, "ts", "left")


def address_balances(v: Live, address: str, limit: int = DEFAULT_LIMIT, cursor: dict | None = None) -> DataFrame:
    """(ts, balance_sats, has_more), newest first, over the newest blocks and the store."""
    mine = lambda df: df.where(F.col("address") == address)
    return page(overlay(mine(hot_balances(v)), mine(v.address_balance), ["ts"]).select("ts", "balance_sats"), [("ts", False)], limit, cursor)


def block_transactions(v: Live, height: int, limit: int = DEFAULT_LIMIT, cursor: dict | None = None) -> DataFrame:
    """(tx_n, txid, has_more) of a block: a slice of a newest one, else of the stored one."""
    at = lambda df: df.where(F.col("height") == height).select("height", "tx_n", "txid")
    return page(overlay(at(v.hot.tx), at(v.confirmed), ["height", "tx_n"]).select("tx_n", "txid"), [("tx_n", True)], limit, cursor)
