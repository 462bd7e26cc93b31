"""References to records that do not exist (problem 7).

The foreign keys followed, child to parent: block to its predecessor, confirmed transaction to a block of its height,
inputs and outputs to their confirmed transaction, an input to the output it spends, a spent output to the input that
spends it. A reference is a direct orphan if its target is missing, and an inherited one if its target exists but is an
orphan itself.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from chainloom.functions.normalise import norm_hash
from chainloom.operators.hierarchy import lift
from chainloom.plans.shared import Shared

#: Semi-joins between two written rounds.
LEVELS_A_ROUND = 4


def missing(refs: DataFrame, targets: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of refs whose keys no row of targets has; a null in a key equals nothing.

    Rows with a null key skip the join (they would all hash to one task). A hot key among refs is split by the
    adaptive skew join, which an anti join allows on its left.
    """
    full = " and ".join(f"{k} is not null" for k in keys)
    return refs.where(full).join(targets.select(*keys).where(full), keys, "left_anti").unionByName(refs.where(f"not ({full})"))


def short_key(c: Column) -> Column:
    """A hash in half its size: a mark and the bytes that the digits stand for, or a mark and the text of any other key."""
    h = norm_hash(c)
    whole = (F.length(h) % 2 == 0) & F.unhex(h).isNotNull()
    return F.when(whole, F.concat(F.lit(b"\0"), F.unhex(h))).otherwise(F.concat(F.lit(b"\1"), F.encode(h, "UTF-8")))


def key_text(c: Column) -> Column:
    rest = F.substring(c, 2, 1 << 30)
    return F.when(F.substring(c, 1, 1) == F.lit(b"\0"), F.lower(F.hex(rest))).otherwise(F.decode(rest, "UTF-8"))


def cascade(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(id) of all records that are orphans: seeds(id), and whatever refers to one by edges(up, down), to a fixpoint.

    A record with a single reference that can matter shares the fate of its parent. Such chains are contracted first, by
    pointer doubling in rounds logarithmic in their length; the rest is a frontier of new orphans carried down by
    semi-joins until none is new, LEVELS_A_ROUND steps a written round. Records that refer to themselves or to each other
    end in the fixpoint like all others. Ids are numbers and not null; edges and seeds may hold repeated rows.
    """
    spark = edges.sparkSession
    shared = Shared(spark, "cascade")
    seeds, s = shared.write(seeds.select("id").distinct())
    # Records that are orphans already, and references to records that can't become one, need not be followed.
    open_ = edges.where("up <> down").distinct().join(seeds, F.col("down") == F.col("id"), "left_anti")
    open_ = shared.table(open_)
    able = seeds.unionByName(open_.select(F.col("down").alias("id"))).distinct()
    open_, c = shared.write(open_.join(able, F.col("up") == F.col("id"), "left_semi"))
    if not c["rows"] or not s["rows"]:
        return seeds
    parents = shared.table(open_.groupBy("down").agg(F.min("up").alias("up"), F.count(F.lit(1)).alias("n")))
    single = parents.where("n = 1").select(F.col("down").alias("node"), "up")
    through = single.select(F.col("node").alias("p"))
    start = single.join(through, F.col("up") == F.col("p"), "left").select("node", F.col("p").alias("up"))
    ends = lift(shared, start, sizes=False).where("up is null").select("node", "top")
    # A chain that never ends is a ring of records that refer to each other alone: no orphan can reach it.
    anchors = shared.table(ends.join(single.select(F.col("node").alias("top"), F.col("up").alias("anchor")), "top").select("node", "anchor"))
    core = open_.join(parents.where("n > 1").select("down"), "down", "left_semi")
    chained = core.join(single.select(F.col("node").alias("up")), "up", "left_semi").join(anchors.withColumnRenamed("node", "up"), "up").select(F.col("anchor").alias("up"), "down")
    core, c = shared.write(core.join(single.select(F.col("node").alias("up")), "up", "left_anti").select("up", "down").unionByName(chained).distinct())
    frontier, seen = seeds, [seeds]
    while c["rows"]:
        steps = [frontier]
        for _ in range(LEVELS_A_ROUND):
            steps.append(core.join(steps[-1], F.col("up") == F.col("id"), "left_semi").select(F.col("down").alias("id")).distinct())
        fresh = reduce(DataFrame.unionByName, steps[1:]).distinct()
        frontier, counts = shared.write(fresh.join(reduce(DataFrame.unionByName, seen), "id", "left_anti"))
        if not counts["rows"]:
            break
        seen.append(frontier)
    known = reduce(DataFrame.unionByName, seen)
    return shared.table(known.unionByName(anchors.join(known, F.col("anchor") == F.col("id"), "left_semi").select(F.col("node").alias("id"))))


@dataclass
class Records:
    """The records by number: names(id, key); inputs(sid, spending_index, ref, tid, n), ref where it names an output;
    outputs(tid, n, sid, spending_index), sid where it is marked as spent; confirmed(id, height)."""

    names: DataFrame
    inputs: DataFrame
    outputs: DataFrame
    confirmed: DataFrame | None


def encode(shared: Shared, inputs: DataFrame, outputs: DataFrame, transactions: DataFrame | None = None) -> Records:
    """Every txid gets a number once, so that all later joins move numbers. Each distinct record is kept once.

    Without transactions only what inputs refer to is needed: outputs that no input's txid names are left out, and by what
    the others are marked as spent.
    """
    named = (F.col("coinbase").isNull()) & F.col("txid").isNotNull()
    i = inputs.select(short_key(F.col("spending_txid")).alias("s"), F.col("spending_index").cast("bigint").alias("spending_index"), F.when(named, short_key(F.col("txid"))).alias("t"), F.when(named, F.col("vout").cast("bigint")).alias("n"))
    o = outputs.select(short_key(F.col("txid")).alias("t"), F.col("n").cast("bigint").alias("n"), short_key(F.col("spending_txid")).alias("s"), F.col("spending_index").cast("bigint").alias("spending_index"))
    both = lambda df: df.select(F.explode(F.array("s", "t")).alias("key"))
    keys = both(i.where("t is not null"))
    if transactions is not None:
        c = transactions.select(short_key(F.col("txid")).alias("t"), F.col("height").cast("bigint").alias("height"))
        keys = both(i).unionByName(both(o)).unionByName(c.select(F.col("t").alias("key")))
    names = shared.table(keys.where("key is not null").distinct().select(F.monotonically_increasing_id().alias("id"), "key"))
    of = lambda key, to: names.select(F.col("id").alias(to), F.col("key").alias(key))

    def numbered(df: DataFrame, key: str, to: str) -> DataFrame:
        """A null key gets a value of its own, matching nothing, so that all null keys don't meet in one task."""
        rest = [x for x in df.columns if x != key]
        own = F.coalesce(key, F.concat(F.lit(b"\2"), F.xxhash64(*rest).cast("string").cast("binary")))
        return df.withColumn(key, own).join(of(key, to), key, "left").drop(key)

    if transactions is None:
        i = numbered(i.where("t is not null"), "s", "sid").join(of("t", "tid"), "t").select("sid", "spending_index", F.lit(True).alias("ref"), "tid", "n")
        return Records(names, shared.table(i.distinct()), shared.table(o.select("t", "n").join(of("t", "tid"), "t").select("tid", "n").distinct()), None)
    i = numbered(numbered(i, "s", "sid"), "t", "tid").select("sid", "spending_index", F.col("tid").isNotNull().alias("ref"), "tid", "n")
    o = numbered(numbered(o, "t", "tid"), "s", "sid").select("tid", "n", "sid", "spending_index")
    c = numbered(c, "t", "id").where("id is not null").select("id", "height").distinct()
    return Records(names, shared.table(i.distinct()), shared.table(o.distinct()), shared.table(c))


def orphans(inputs: DataFrame, outputs: DataFrame) -> DataFrame:
    """(spending_txid, spending_index, txid, n, direct, inherited) of every input that is an orphan, each distinct reference
    once: direct if its output is missing, inherited if it spends an output of a transaction with an orphaned input.

    Inputs with a coinbase or without a txid refer to nothing. An output that is stored later than its spender exists.
    Empty tables have no orphans of their own; inputs all are if there are no outputs. Extra columns are ignored.
    """
    shared = Shared(inputs.sparkSession, "orphans")
    r = encode(shared, inputs, outputs)
    refs = r.inputs.where("ref")
    direct = shared.table(missing(refs, r.outputs, ["tid", "n"]))
    gone = cascade(refs.where("sid is not null").select(F.col("tid").alias("up"), F.col("sid").alias("down")), direct.where("sid is not null").select(F.col("sid").alias("id")))
    gone = gone.select(F.col("id").alias("tid"), F.lit(True).alias("inherited"))
    both = direct.withColumn("direct", F.lit(True)).join(gone, "tid", "left")
    # Inputs whose output exists are the others; what they spend decides about them.
    have = r.outputs.where("tid is not null and n is not null").select("tid", "n").distinct()
    only = refs.join(gone, "tid").join(have, ["tid", "n"], "left_semi").withColumn("direct", F.lit(False))
    cols = ["sid", "spending_index", "tid", "n", "direct", F.coalesce("inherited", F.lit(False)).alias("inherited")]
    found = both.select(*cols).unionByName(only.select(*cols))
    of = lambda i, t: r.names.select(F.col("id").alias(i), key_text(F.col("key")).alias(t))
    return found.join(of("sid", "spending_txid"), "sid", "left").join(of("tid", "txid"), "tid").select("spending_txid", "spending_index", "txid", "n", "direct", "inherited")


def _month(seconds: str) -> Column:
    return F.date_format(F.date_from_unix_date(F.floor(F.col(seconds) / 86400).cast("int")), "yyyy-MM")


def block_orphans(shared: Shared, blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows(id, prev, height, period), orphans(id)) of blocks by number; id is null for a row without hash, prev where no
    predecessor is named or none of that name exists, which `dangling` tells apart."""
    b = blocks.select(short_key(F.col("hash")).alias("h"), short_key(F.col("previousblockhash")).alias("p"), F.col("height").cast("bigint").alias("height"), _month("time").alias("period"))
    names = shared.table(b.select("h").where("h is not null").distinct().select(F.monotonically_increasing_id().alias("id"), "h"))
    rows = b.where("h is not null").join(names, "h").unionByName(b.where("h is null").withColumn("id", F.lit(None).cast("bigint")))
    rows = rows.join(names.select(F.col("id").alias("prev"), F.col("h").alias("p")), "p", "left").select("id", "prev", F.col("p").isNotNull().alias("named"), "p", "height", "period")
    rows = shared.table(rows)
    known = rows.where("id is not null and named")
    gone = cascade(known.where("prev is not null").select(F.col("prev").alias("up"), F.col("id").alias("down")), known.where("prev is null").select("id"))
    return rows, gone


def report(inputs: DataFrame, outputs: DataFrame, transactions: DataFrame, blocks: DataFrame) -> DataFrame:
    """(tbl, refers_to, period, refs, direct, inherited) of every foreign key; period is the month (UTC) of the row's block,
    null where that is unknown. direct and inherited exclude each other.

    A block is an orphan if its predecessor is missing or an orphan, and so on down the chain. A confirmed transaction is
    one if there is no block of its height, or none that isn't an orphan. A transaction is one if it has no sound confirmed
    row, or an input that spends a missing output or one of an orphaned transaction; its inputs and outputs share that.
    A marker of a spent output is direct if that input is missing, inherited if its transaction is an orphan.
    """
    shared = Shared(inputs.sparkSession, "orphans")
    rows, gone_blocks = block_orphans(shared, blocks)
    flag = lambda df, name, to: df.select(F.col("id").alias(name), F.lit(True).alias(to))
    heights = rows.where("height is not null").join(flag(gone_blocks, "id", "bad"), "id", "left").groupBy("height").agg(F.max(F.col("bad").isNull()).alias("sound"), F.min("period").alias("period"))
    heights = shared.table(heights)

    r = encode(shared, inputs, outputs, transactions)
    held = shared.table(r.confirmed.where("height is not null").join(heights, "height", "left").select("id", "height", "sound", "period").unionByName(r.confirmed.where("height is null").select("id", "height", F.lit(True).alias("sound"), F.lit(None).cast("string").alias("period"))))
    refs = r.inputs.where("ref")
    targets = r.outputs.where("tid is not null and n is not null").select("tid", "n").distinct().withColumn("there", F.lit(True))
    refs = shared.table(refs.join(targets, ["tid", "n"], "left").select("sid", "tid", F.col("there").isNull().alias("direct")))
    known = held.groupBy("id").agg(F.max(F.coalesce("sound", F.lit(False))).alias("sound"), F.min("period").alias("period"))
    known = shared.table(known)
    seeds = r.names.select("id").join(known.where("sound").select("id"), "id", "left_anti").unionByName(refs.where("direct and sid is not null").select(F.col("sid").alias("id")))
    gone = cascade(refs.where("not direct and sid is not null").select(F.col("tid").alias("up"), F.col("sid").alias("down")), seeds)
    tx = known.select("id", "period", F.lit(True).alias("there")).join(flag(gone, "id", "bad"), "id", "full").select("id", "period", F.coalesce("there", F.lit(False)).alias("there"), F.coalesce("bad", F.lit(False)).alias("bad"))
    tx = shared.table(tx)
    of = lambda name: tx.select(F.col("id").alias(name), "period", "there", "bad")
    bad = tx.where("bad").select("id")

    def counted(tbl: str, to: str, per: DataFrame) -> DataFrame:
        sums = [F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c) for c in ("refs", "direct", "inherited")]
        return per.groupBy("period").agg(*sums).select(F.lit(tbl).alias("tbl"), F.lit(to).alias("refers_to"), "period", *("refs", "direct", "inherited")).where("refs > 0")

    def flagged(df: DataFrame, by: str) -> DataFrame:
        """Sums of references by their transaction first, then by its period."""
        n = lambda c: F.sum(F.col(c).cast("int")).alias(c)
        sums = df.groupBy(by).agg(F.count(F.lit(1)).alias("refs"), n("direct"), n("inherited"))
        return sums.join(of(by).select(by, "period"), by, "left")

    def belonging(df: DataFrame, by: str) -> DataFrame:
        """References to the transaction `by` that a record is part of."""
        sums = df.groupBy(by).agg(F.count(F.lit(1)).alias("refs")).join(of(by), by, "left")
        there, gone_ = F.coalesce("there", F.lit(False)), F.coalesce("bad", F.lit(False))
        return sums.select("period", "refs", F.when(~there, F.col("refs")).alias("direct"), F.when(there & gone_, F.col("refs")).alias("inherited"))

    spent = refs.join(flag(bad, "tid", "bad"), "tid", "left").select("sid", "direct", (~F.col("direct") & F.col("bad").isNotNull()).alias("inherited"))
    marks = r.outputs.where("sid is not null")
    spenders = r.inputs.where("sid is not null and spending_index is not null").select("sid", "spending_index").distinct().withColumn("there", F.lit(True))
    marks = marks.join(spenders, ["sid", "spending_index"], "left").join(flag(bad, "sid", "bad"), "sid", "left").select("tid", F.col("there").isNull().alias("direct"), (F.col("there").isNotNull() & F.col("bad").isNotNull()).alias("inherited"))
    confirmed = held.where("height is not null").select("period", F.lit(1).alias("refs"), F.col("sound").isNull().cast("int").alias("direct"), F.coalesce(~F.col("sound"), F.lit(False)).cast("int").alias("inherited"), "id")
    chain = rows.where("id is not null and named").groupBy("id", "p", "prev").agg(F.min("period").alias("period"))
    chain = chain.join(flag(gone_blocks, "prev", "bad"), "prev", "left").select("period", F.lit(1).alias("refs"), F.col("prev").isNull().cast("int").alias("direct"), F.col("bad").isNotNull().cast("int").alias("inherited"))
    tables = [
        counted("transaction_input", "transaction_output", flagged(spent, "sid")),
        counted("transaction_input", "confirmed_transaction", belonging(r.inputs.where("sid is not null").select("sid", "spending_index").distinct(), "sid")),
        counted("transaction_output", "transaction_input", flagged(marks, "tid")),
        counted("transaction_output", "confirmed_transaction", belonging(r.outputs.where("tid is not null").select("tid", "n").distinct(), "tid")),
        counted("confirmed_transaction", "block", confirmed.drop("period").join(of("id").select("id", "period"), "id", "left").drop("id")),
        counted("block", "block", chain),
    ]
    return reduce(DataFrame.unionByName, tables)
