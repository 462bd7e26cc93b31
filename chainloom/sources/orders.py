"""Orders and line items read as a small ledger, and events as balance changes: fixtures for the ledger operators.

An order is a transaction, all orders of a date are a block, the first of them its coinbase. A line item is an output; a
transaction that isn't a coinbase spends all outputs of its customer's previous order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from chainloom.operators.balances import running_balances
from chainloom.operators.chain import Chain, address_deltas, block_deltas, single_address
from chainloom.operators.live import Live, Pool
from chainloom.sources.tables import table


def orders_chain(spark: SparkSession, d: str) -> Chain:
    o, l = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate"), table(spark, d, "lineitem")
    # As many rows as there are dates.
    heights = o.select("o_orderdate").distinct().withColumn("height", F.row_number().over(W.partitionBy(F.lit(0)).orderBy("o_orderdate")) - 1)
    tx = o.join(heights, "o_orderdate").select(F.col("o_orderkey").alias("txid"), "o_custkey", "height", (F.row_number().over(W.partitionBy("o_orderdate").orderBy("o_orderkey")) - 1).alias("tx_n"), F.col("o_orderdate").cast("timestamp").alias("ts"))
    tx = tx.withColumn("is_coinbase", F.col("tx_n") == 0).withColumn("prev", F.lag("txid").over(W.partitionBy("o_custkey").orderBy("height", "txid")))
    lines = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
    n = F.row_number().over(W.partitionBy("l_orderkey").orderBy(*lines)) - 1
    value = F.floor(F.col("l_quantity") * 100_000_000 + F.lit(0.5)).cast("bigint")
    txo = l.withColumn("n", n).join(o, l.l_orderkey == o.o_orderkey).select(F.col("o_orderkey").alias("txid"), "n", value.alias("value_sats"), F.array(F.concat(F.lit("c"), F.col("o_custkey"), F.lit("-"), F.col("l_suppkey") % 4)).alias("addresses"))
    txi = tx.where("tx_n <> 0 and prev is not null").select(F.col("txid").alias("spending_txid"), F.col("prev").alias("txid")).join(txo.select("txid", "n"), "txid").select("spending_txid", F.col("n").alias("spending_index"), "txid", "n")
    return Chain(tx.select("txid", "height", "tx_n", "ts", "is_coinbase"), txo, txi)


def order_blocks(spark: SparkSession, d: str) -> DataFrame:
    """The same ledger as nested block documents, one a date, in the schema of sources.blocks.BLOCK as far as it is used.

    Only what differs between documents is shuffled, once by order, by customer and by date; the rest is added to whole
    blocks. Line items alike in the sorted columns give the same output, so their order among themselves needs no others.
    """
    o = table(spark, d, "orders").where("o_orderdate is not null").select(F.col("o_orderkey").alias("txid"), F.col("o_custkey").alias("cust"), F.col("o_orderdate").alias("date"))
    # As many rows as there are dates.
    heights = o.select("date").distinct().withColumn("height", F.row_number().over(W.partitionBy(F.lit(0)).orderBy("date")) - 1)
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("txid"), F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity").alias("line"))
    lines = lines.groupBy("txid").agg(F.sort_array(F.collect_list("line")).alias("lines"))
    value = lambda x: F.floor(x.l_quantity * 100_000_000 + F.lit(0.5)).cast("bigint") / 100_000_000
    t = o.join(lines, "txid", "left").select("txid", "cust", "date", F.transform("lines", value).alias("values"), F.transform("lines", lambda x: (x.l_suppkey % 4).cast("tinyint")).alias("parts"))
    before = W.partitionBy("cust").orderBy("date", "txid")
    t = t.withColumns({"prev": F.lag("txid").over(before), "spends": F.coalesce(F.lag(F.size("values")).over(before), F.lit(0))})
    b = t.groupBy("date").agg(F.sort_array(F.collect_list(F.struct("txid", "cust", "prev", "spends", "values", "parts"))).alias("tx")).join(heights, "date")
    text = lambda x: x.cast("string")
    spend = lambda x, n: F.struct(F.lit(None).cast("string").alias("coinbase"), F.lit(0).cast("bigint").alias("sequence"), text(x.prev).alias("txid"), n.alias("vout"))
    ins = lambda x: F.transform(F.sequence(F.lit(1), x.spends), lambda n: spend(x, n - 1))
    addresses = lambda x, part: F.array(F.concat(F.lit("c"), x.cust, F.lit("-"), part)).alias("addresses")
    script = lambda x, part: F.struct(F.lit("").alias("asm"), F.lit("").alias("hex"), F.lit(1).alias("reqSigs"), F.lit("pubkeyhash").alias("type"), addresses(x, part)).alias("scriptPubKey")
    pay = lambda x: lambda v, n: F.struct(v.alias("value"), n.alias("n"), script(x, F.get(x.parts, n)))
    vin, vout = lambda x, k: F.when((k > 0) & (x.spends > 0), ins(x)).otherwise(F.array()), lambda x: F.coalesce(F.transform(x["values"], pay(x)), F.array())
    whole = lambda x, k: F.struct(text(x.txid).alias("txid"), F.lit(250).alias("size"), F.lit(1).cast("bigint").alias("version"), F.lit(0).cast("bigint").alias("locktime"), vin(x, k).alias("vin"), vout(x).alias("vout"))
    return b.select(F.concat(F.lit("b"), "height").alias("hash"), "height", F.unix_seconds(F.col("date").cast("timestamp")).alias("time"), F.transform("tx", whole).alias("tx"))


def order_live(spark: SparkSession, d: str, pool_heights: int = 3, hot_heights: int = 10) -> Live:
    """The newest dates read as a pool of unconfirmed transactions, those before as newest blocks, all others as stored.
    Coinbases of the pool's dates don't exist."""
    c = orders_chain(spark, d)
    tip = F.broadcast(c.tx.agg(F.max("height").alias("tip")))  # one row
    tx = c.tx.join(tip).withColumn("age", F.col("tip") - F.col("height")).where(f"not (age < {pool_heights} and tx_n = 0)")
    cut = lambda where: tx.where(where).select("txid", "height", "tx_n", "ts", "is_coinbase")
    pool, hot, cold = cut(f"age < {pool_heights}"), cut(f"age >= {pool_heights} and age < {pool_heights + hot_heights}"), cut(f"age >= {pool_heights + hot_heights}")
    of = lambda df, t, k: df.join(t.select(F.col("txid").alias(k)), k, "left_semi")
    flat = lambda df: df.select("txid", "n", single_address(F.col("addresses")).alias("address"), "value_sats")
    arrived = pool.select("txid", (F.unix_seconds("ts") + F.col("tx_n")).alias("arrived"))
    fresh = Pool(arrived, of(c.txi, pool, "spending_txid"), flat(of(c.txo, pool, "txid")))
    stored = Chain(cold, of(c.txo, cold, "txid"), of(c.txi, cold, "spending_txid"))
    deltas = address_deltas(stored)
    return Live(fresh, Chain(hot, of(c.txo, hot, "txid"), of(c.txi, hot, "spending_txid")), flat(stored.txo), deltas.select("address", "ts", "height", "tx_n", F.col("delta_sats").alias("change_sats")),
                running_balances(block_deltas(deltas)).select("address", "ts", "balance_sats"), cold.select("height", "tx_n", "txid"))


def event_deltas(spark: SparkSession, d: str) -> DataFrame:
    """(address, ts, delta_sats); purchases and errors take, all else gives."""
    e = table(spark, d, "events")
    v = F.floor(F.col("value") * 100_000_000 + F.lit(0.5)).cast("bigint")
    return e.select(F.concat(F.lit("u"), "user_id").alias("address"), F.col("ts").cast("timestamp").alias("ts"), F.when(F.col("event_type").isin("purchase", "error"), -v).otherwise(v).alias("delta_sats"))
