"""Parent-child rows to full hierarchies by heavy-path decomposition (problem 1).

The forest is cut into heavy chains: every node continues in its child of largest subtree. A path from the root is
then a short list of chain segments (at most log2 of the tree's size), and the descendants of a node are one interval
of a numbering in which every chain is contiguous. No list grows with the depth of the tree.
Everything is found in a number of rounds logarithmic in the depth, each a few equi-joins on one row per node.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from chainloom.plans.shared import Shared

#: The children of one parent are numbered in parts of about so many, so that no task numbers all children of a hot parent.
SIBLINGS = 1000
#: Positions of one numbering that meet in a task when descendants are looked up by interval.
SPAN = 4096


def parent_links(rows: DataFrame, node: Column, parent: Column) -> DataFrame:
    """(node, parent), one row a node: rows without node don't count, a copy with a parent wins over one without, and of
    copies with differing parents the smallest parent."""
    return rows.select(node.alias("node"), parent.alias("parent")).where("node is not null").groupBy("node").agg(F.min("parent").alias("parent"))


def lift(shared: Shared, start: DataFrame, sizes: bool) -> DataFrame:
    """Pointer doubling. start: (node, up), up null at a top. Gives (node, up, top, dist[, size]) with up still not null
    for those that never reach a top.

    After round k, up is the 2^k-th ancestor, or null if there is none: then top and dist are final. size counts the
    nodes at most 2^k - 1 steps below, since each node adds its own count to its 2^k-th ancestor. A round that finishes
    no node proves that the rest runs into cycles, for the depths of nodes leave no gap.
    """
    state, c = shared.write(
        start.select("node", "up", F.coalesce("up", "node").alias("top"), F.when(F.col("up").isNull(), 0).otherwise(1).cast("bigint").alias("dist"), F.lit(1).cast("bigint").alias("size")),
        active=F.col("up").isNotNull(),
    )
    active = c["active"]
    while active:
        act, done = state.where("up is not null"), state.where("up is null")
        at = state.select(F.col("node").alias("at"), F.col("up").alias("next"), F.col("top").alias("at_top"), F.col("dist").alias("more"))
        moved = act.join(at, F.col("up") == F.col("at")).select("node", F.col("next").alias("up"), F.col("at_top").alias("top"), (F.col("dist") + F.col("more")).alias("dist"), "size")
        new = moved.unionByName(done)
        if sizes:  # one aggregate instead of a join: the row of a node, and what is added to its size
            added = act.select(F.col("up").alias("node"), *(F.lit(None).cast(new.schema[k].dataType).alias(k) for k in ("up", "top", "dist")), "size")
            new = new.unionByName(added).groupBy("node").agg(*(F.max(k).alias(k) for k in ("up", "top", "dist")), F.sum("size").alias("size"))
        new, c = shared.write(new, active=F.col("up").isNotNull())
        shared.forget(state)
        state, before, active = new, active, c["active"]
        if active == before:
            break
    return state


def ends_of(links: DataFrame) -> DataFrame:
    """(node, root) of links(node, parent), node unique: the root of each node, or the smallest node of the cycle that its
    path runs into. Only pointer doubling, for callers that need neither paths nor descendants."""
    shared = Shared(links.sparkSession, "ends")
    links = shared.table(links.select("node", "parent"))
    known = links.select(F.col("node").alias("up"))
    start = shared.table(links.where("parent is not null").join(known, F.col("parent") == F.col("up"), "left").select("node", "up").unionByName(links.where("parent is null").select("node", F.col("parent").alias("up"))))
    ends = lift(shared, start, sizes=False)
    lost, c = shared.write(ends.where("up is not null").select("node").join(start, "node"))
    out = ends.where("up is null").select("node", F.col("top").alias("root"))
    return out.unionByName(_cycles(shared, lost, c["rows"]).select("node", F.col("smallest").alias("root"))) if c["rows"] else out


def _cycles(shared: Shared, links: DataFrame, count: int) -> DataFrame:
    """(node, smallest), numbers: of nodes whose paths never end, the smallest node of the cycle the path runs into."""
    state = shared.table(links.select("node", F.col("up"), F.col("node").alias("low")))
    reach = 1
    while reach < count:
        new = state
        for _ in range(2):
            at = new.select(F.col("node").alias("at"), F.col("up").alias("next"), F.col("low").alias("at_low"))
            new = new.join(at, F.col("up") == F.col("at")).select("node", F.col("next").alias("up"), F.least("low", "at_low").alias("low"))
        new = shared.table(new)
        shared.forget(state)
        state, reach = new, reach * 4
    at = state.select(F.col("node").alias("at"), F.col("low").alias("smallest"))
    return state.join(at, F.col("up") == F.col("at")).select("node", "smallest")


def hierarchy(links: DataFrame) -> DataFrame:
    """One row per node of links(node, parent), node unique and not null:

    node, parent (null unless it is a node), root, depth, descendants (their number), chain (its number), pos (in the
    chain), path array<struct<chain, last>> (from the root: each chain, and the position up to which it is on the
    path), first, last (the node's descendants are the nodes of the same root with first < their first <= last).
    A node whose path never reaches a root has depth -1, as root the smallest node of the cycle its path runs into, and
    null in all later columns. A node naming itself is a cycle of one. Empty input gives no rows.

    Nodes are numbered in their order first, so that all rounds move numbers instead of names.
    """
    shared = Shared(links.sparkSession, "hierarchy")
    names = shared.table(links.select("node").orderBy("node").select(F.monotonically_increasing_id().alias("id"), F.col("node").alias("name")))
    links = links.join(names, F.col("node") == F.col("name")).select("id", "parent")
    up = names.select(F.col("id").alias("up"), F.col("name").alias("known"))
    links = shared.table(links.where("parent is not null").join(up, F.col("parent") == F.col("known"), "left").select(F.col("id").alias("node"), "up").unionByName(links.where("parent is null").select(F.col("id").alias("node"), F.lit(None).cast("bigint").alias("up"))))
    depths = lift(shared, links, sizes=True)
    lost, c = shared.write(depths.where("up is not null").select("node").join(links, "node"))
    cyclic = _cycles(shared, lost, c["rows"]) if c["rows"] else None

    tree = shared.table(depths.where("up is null").select("node", F.col("dist").alias("depth"), "size").join(links.withColumnRenamed("up", "parent"), "node"))
    # The heavy child of each parent, smallest name on ties; the others hang off as tops of their own chains.
    kids = tree.where("parent is not null").groupBy("parent").agg(F.min(F.struct((-F.col("size")).alias("s"), F.col("node").alias("n"))).alias("h"), F.count(F.lit(1)).alias("kids"))
    heavy = shared.table(kids.select(F.col("parent").alias("of"), F.col("h.n").alias("heavy"), (-F.col("h.s")).alias("heavy_size"), "kids"))
    tree = tree.join(heavy.select(F.col("heavy").alias("node"), F.lit(True).alias("is_heavy")), "node", "left")
    tree = shared.table(tree.withColumn("is_heavy", F.coalesce("is_heavy", F.lit(False))))
    placed = lift(shared, tree.select("node", F.when(F.col("is_heavy"), F.col("parent")).alias("up")), sizes=False)
    tree = shared.table(tree.join(placed.select("node", F.col("top").alias("chain"), F.col("dist").alias("pos")), "node"))

    # Chains hang off a node of another chain. In the numbering, the heavy child follows its parent at once; then come
    # the subtrees of the other children, by part and name.
    light = tree.where("not is_heavy and parent is not null").select("node", "parent", "size").join(heavy.select(F.col("of").alias("parent"), "heavy_size", "kids"), "parent")
    light = light.withColumn("part", F.pmod(F.xxhash64("node"), 1 + F.floor(F.col("kids") / SIBLINGS)))
    parts = light.groupBy("parent", "part").agg(F.sum("size").alias("part_size"))
    before = F.sum("part_size").over(W.partitionBy("parent").orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    parts = parts.select("parent", "part", F.coalesce(before, F.lit(0)).alias("ahead"))
    earlier = F.coalesce(F.sum("size").over(W.partitionBy("parent", "part").orderBy("node").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    light = light.withColumn("earlier", earlier).join(parts, ["parent", "part"]).select("node", "parent", (F.col("heavy_size") + 1 + F.col("earlier") + F.col("ahead")).alias("shift"))
    on = tree.select(F.col("node").alias("parent"), F.col("chain").alias("on_chain"), F.col("pos").alias("on_pos"))
    hung = light.join(on, "parent").select("node", F.col("on_chain").alias("up"), (F.col("on_pos") + F.col("shift")).alias("start"), F.array(F.struct(F.col("on_chain").alias("chain"), F.col("on_pos").alias("last"))).alias("path"))
    tops = tree.where("parent is null").select("node", F.lit(None).cast("bigint").alias("up"), F.lit(0).cast("bigint").alias("start"), F.array().cast("array<struct<chain:bigint,last:bigint>>").alias("path"))
    chains = _concatenate(shared, hung.unionByName(tops))

    own = F.struct(F.col("chain").alias("chain"), F.col("pos").alias("last"))
    out = tree.join(chains.select(F.col("node").alias("chain"), "start", "path"), "chain").withColumn("path", F.concat("path", F.array(own)))
    # A chain has the number of its top; the top of the first chain on a path is the root.
    out = out.select(
        "node", "parent", F.col("path")[0]["chain"].alias("root"), "depth", (F.col("size") - 1).alias("descendants"), "chain", "pos", "path", (F.col("start") + F.col("pos")).alias("first"), (F.col("start") + F.col("pos") + F.col("size") - 1).alias("last")
    )
    if cyclic is not None:
        out = out.unionByName(lost.join(cyclic, "node").select("node", F.col("up").alias("parent"), F.col("smallest").alias("root"), F.lit(-1).cast("bigint").alias("depth")), allowMissingColumns=True)
    of = lambda c: names.select(F.col("id").alias(c), F.col("name").alias(f"{c}_name"))
    out = out.join(of("node"), "node").join(of("root"), "root")
    out = out.where("parent is not null").join(of("parent"), "parent").unionByName(out.where("parent is null").withColumn("parent_name", F.lit(None).cast("string")))
    return out.select(*(F.col(f"{c}_name").alias(c) for c in ("node", "parent", "root")), "depth", "descendants", "chain", "pos", "path", "first", "last")


def _concatenate(shared: Shared, chains: DataFrame) -> DataFrame:
    """Starts summed and segments concatenated from the tree's top chain down to each chain, by pointer doubling."""
    state, c = shared.write(chains, active=F.col("up").isNotNull())
    while c["active"]:
        at = state.select(F.col("node").alias("at"), F.col("up").alias("next"), F.col("start").alias("at_start"), F.col("path").alias("at_path"))
        act = state.where("up is not null").join(at, F.col("up") == F.col("at"))
        moved = act.select("node", F.col("next").alias("up"), (F.col("start") + F.col("at_start")).alias("start"), F.concat("at_path", "path").alias("path"))
        new, c = shared.write(moved.unionByName(state.where("up is null")), active=F.col("up").isNotNull())
        shared.forget(state)
        state = new
    return state


def path_nodes(tree: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, step, ancestor): the nodes on the paths of wanted(node), itself included, expanded from the segments."""
    segments = tree.join(wanted.select("node").distinct(), "node", "left_semi").select("node", F.explode("path").alias("s")).select("node", "s.chain", F.col("s.last").alias("upto"))
    on = tree.select("chain", "pos", F.col("node").alias("ancestor"), F.col("depth").alias("step"))
    return segments.join(on, "chain").where("pos <= upto").select("node", "step", "ancestor")


def descendants_of(tree: DataFrame, wanted: DataFrame, span: int = SPAN) -> DataFrame:
    """(node, descendant) of wanted(node), from the intervals.

    The numbering of each root is cut into spans, and an interval asks for those it touches: of the pairs that the join on
    (root, span) makes, only some in the first and last span of an interval aren't descendants, also where all nodes have
    one root.
    """
    asked = tree.join(wanted.select("node").distinct(), "node", "left_semi").where("last > first").select("node", "root", F.col("first").alias("lo"), F.col("last").alias("hi"))
    at = lambda c: F.floor(F.col(c) / span)
    asked = asked.withColumn("span", F.explode(F.sequence(at("lo"), at("hi"))))
    below = tree.where("depth >= 0").select("root", "first", F.col("node").alias("descendant"), at("first").alias("span"))
    return asked.join(below, ["root", "span"]).where("first > lo and first <= hi").select("node", "descendant")
