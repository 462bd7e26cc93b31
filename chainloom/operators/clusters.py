"""Wallet clusters: addresses that sign together are taken for one owner."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from chainloom.functions.normalise import bin_of
from chainloom.operators.chain import Chain, address_deltas, first_address, spent_outputs
from chainloom.plans.shared import Shared


def mixing_transactions(c: Chain) -> DataFrame:
    """(txid) of transactions that look like coin mixing: at least two different input addresses, and one amount paid to
    two different addresses. First addresses count."""
    return _mixing(spent_outputs(c), c.txo)


def _mixing(spent: DataFrame, outputs: DataFrame) -> DataFrame:
    ins = spent.select(F.col("spending_txid").alias("txid"), first_address(F.col("addresses")).alias("a")).where("a is not null").groupBy("txid").agg(F.min("a").alias("x"), F.max("a").alias("y")).where("x <> y")
    outs = outputs.select("txid", "value_sats", first_address(F.col("addresses")).alias("a")).where("a is not null").groupBy("txid", "value_sats").agg(F.min("a").alias("x"), F.max("a").alias("y")).where("x <> y").select("txid").distinct()
    return ins.select("txid").join(outs, "txid", "left_semi")


def cospend_edges(c: Chain) -> DataFrame:
    """(a, b), a < b: of each transaction that isn't mixing, its smallest input address with each other one."""
    return edges_of(spent_outputs(c), c.txo)


def edges_of(spent: DataFrame, outputs: DataFrame) -> DataFrame:
    """cospend_edges of spent outputs (see chain.spent_outputs) and the outputs of the same transactions."""
    ins = spent.select(F.col("spending_txid").alias("txid"), first_address(F.col("addresses")).alias("b")).where("b is not null").distinct()
    ins = ins.join(_mixing(spent, outputs), "txid", "left_anti")
    low = ins.groupBy("txid").agg(F.min("b").alias("a"))
    return ins.join(low, "txid").where("a <> b").select("a", "b").distinct()


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(address, cluster_id) of all nodes(address): the smallest address linked to it by edges(a, b), itself if none.

    Alternating stars: in a large star every node links its larger neighbours to its smallest one, in a small star its
    smaller neighbours and itself; both keep the components and shrink every component to a star around its smallest
    node. Neighbourhoods are joined with their minimum, never gathered. Each round is written to the shared folder.
    """
    shared = Shared(nodes.sparkSession, "clusters")
    e, c = shared.write(edges.select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).where("lo < hi").distinct())
    before, sign = -1, None
    while c["rows"]:
        both = e.select(F.col("lo").alias("u"), F.col("hi").alias("v")).unionByName(e.select(F.col("hi").alias("u"), F.col("lo").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("m").alias("lo"), F.col("v").alias("hi")).where("lo < hi").distinct()
        large = shared.table(large)
        small = large.groupBy("hi").agg(F.min("lo").alias("m"))
        links = large.join(small, "hi").select("m", F.col("lo").alias("x")).unionByName(small.select("m", F.col("hi").alias("x")))
        new, c = shared.write(links.where("m < x").select(F.col("m").alias("lo"), F.col("x").alias("hi")).distinct(), h=F.pmod(F.xxhash64("lo", "hi"), F.lit(1 << 30)))
        shared.forget(e, large)
        e = new
        if (before, sign) == (c["rows"], c["h"]):
            break
        before, sign = c["rows"], c["h"]
    return nodes.join(e.select(F.col("hi").alias("address"), F.col("lo").alias("cluster_id")), "address", "left").select("address", F.coalesce("cluster_id", "address").alias("cluster_id"))


def cluster_addresses(c: Chain) -> DataFrame:
    """(address, cluster_id) of every first address of any output."""
    nodes = c.txo.select(first_address(F.col("addresses")).alias("address")).where("address is not null").distinct()
    return components(nodes, cospend_edges(c))


def cluster_transactions(c: Chain, members: DataFrame) -> DataFrame:
    """(cluster_id, ts, height, tx_n, change_sats)."""
    d = address_deltas(c, first_address).join(members, "address")
    return d.groupBy("cluster_id", "ts", "height", "tx_n").agg(F.sum("delta_sats").alias("change_sats"))


def cluster_balances(transactions: DataFrame) -> DataFrame:
    """(cluster_id, balance_sats, transactions)."""
    return transactions.groupBy("cluster_id").agg(F.sum("change_sats").alias("balance_sats"), F.count(F.lit(1)).alias("transactions"))


def cluster_days(transactions: DataFrame) -> DataFrame:
    """(cluster_id, day, change_sats)."""
    day = F.date_from_unix_date(F.floor(F.unix_seconds("ts") / 86400).cast("int"))
    return transactions.groupBy("cluster_id", day.alias("day")).agg(F.sum("change_sats").alias("change_sats"))


def cluster_sizes(members: DataFrame) -> DataFrame:
    return members.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("addresses"), F.first(bin_of(F.col("cluster_id"), 100)).alias("bin"))


def merge_clusters(members: DataFrame, edges: DataFrame) -> DataFrame:
    """Members after new edges: only the clusters that an edge touches are joined, the others keep their id."""
    of = members.select(F.col("address").alias("x"), F.col("cluster_id").alias("c"))
    named = edges.join(of, F.col("a") == F.col("x"), "left").select(F.coalesce("c", "a").alias("a"), "b").join(of, F.col("b") == F.col("x"), "left").select("a", F.coalesce("c", "b").alias("b"))
    ids = named.select(F.col("a").alias("address")).unionByName(named.select(F.col("b").alias("address"))).distinct()
    moved = components(ids, named).select(F.col("address").alias("cluster_id"), F.col("cluster_id").alias("to"))
    fresh = ids.join(members.select(F.col("cluster_id").alias("address")).distinct(), "address", "left_anti").select("address", F.col("address").alias("cluster_id"))
    return members.unionByName(fresh).join(moved, "cluster_id", "left").select("address", F.coalesce("to", "cluster_id").alias("cluster_id"))
