"""Pairwise matches to groups (problem 3)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from chainloom.functions.normalise import norm_address
from chainloom.plans.shared import Shared


def _jump(pointers: DataFrame) -> DataFrame:
    """Every pointer (node, label) moved on to where its label points, if it points anywhere."""
    to = pointers.select(F.col("node").alias("at"), F.col("label").alias("next"))
    return pointers.join(to, F.col("label") == F.col("at"), "left").select("node", F.coalesce("next", "label").alias("label"), F.col("next").isNotNull().alias("moved"))


def _settle(shared: Shared, pointers: DataFrame) -> DataFrame:
    """Jumps until no label changes, each jump halving the distance to the end; written each time."""
    moved = 1
    while moved:
        new, c = shared.write(_jump(pointers), moved=F.col("moved"))
        shared.forget(pointers)
        pointers, moved = new, c["moved"]
    return pointers.drop("moved")


def consolidate(pairs: DataFrame, a: Column, b: Column) -> DataFrame:
    """(node, group_id) for every node linked to another one, directly or by way of others; group_id is the smallest.

    Pairs with a null side and pairs of a node with itself link nothing; repeated pairs and either direction are the
    same. An empty input gives no rows.
    Each round propagates minimum labels across the edges (a map-side combined minimum, so a node with a third of the
    edges is no hot task), shortens the resulting pointers by jumping, and replaces both ends of each edge by their
    labels; edges whose ends agree vanish. A node that got a smaller label never occurs again, so the pointers of all
    rounds together are one row a node and the edges shrink from round to round. Once no edge is left, no label can
    change any more; the pointers of all rounds are then jumped to their ends. Every round is written to the shared
    folder. The joins keep all edges on the left, where the adaptive skew join splits the edges of a hot node.
    """
    shared = Shared(pairs.sparkSession, "groups")
    edges = pairs.select(a.alias("x"), b.alias("y")).where("x is not null and y is not null and x <> y")
    edges, c = shared.write(edges.select(F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v")).distinct())
    pointers: list[DataFrame] = []
    while c["rows"]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        hook = both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("label")).where("label < node")
        hook = _settle(shared, shared.table(hook))
        pointers.append(hook)
        end = lambda name: hook.select(F.col("node").alias(f"{name}_node"), F.col("label").alias(f"{name}_label"))
        new = edges.join(end("u"), F.col("u") == F.col("u_node"), "left").join(end("v"), F.col("v") == F.col("v_node"), "left")
        new = new.select(F.coalesce("u_label", "u").alias("x"), F.coalesce("v_label", "v").alias("y")).where("x <> y")
        new, c = shared.write(new.select(F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v")).distinct())
        shared.forget(edges)
        edges = new
    if not pointers:
        return edges.select(F.col("u").alias("node"), F.col("v").alias("group_id"))
    labels = _settle(shared, shared.table(reduce(DataFrame.unionByName, pointers)))
    roots = labels.select(F.col("label").alias("node"), "label").distinct()
    return labels.unionByName(roots).select("node", F.col("label").alias("group_id"))


def linked_addresses(union_find: DataFrame) -> DataFrame:
    """(address, group_id) of the pairs (address, parent)."""
    g = consolidate(union_find, norm_address(F.col("address")), norm_address(F.col("parent")))
    return g.select(F.col("node").alias("address"), "group_id")
