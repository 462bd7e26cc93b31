"""Sources combined to target weights (problem 9)."""

from __future__ import annotations

import base64
import math
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, Window as W, functions as F

from chainloom.functions.normalise import norm_word
from chainloom.llm.words import spread
from chainloom.plans.shared import Shared

#: The vocabulary whose tokens are counted, as ranks of byte sequences, and its fixed pattern of pieces.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The most sources that a mix may name: their totals and targets are held by the driver.
MOST_SOURCES = 100_000
#: Rows of one part of an order; a source's order and the merged one are cut into parts of about so many rows.
ROWS_A_PART = 20_000
#: The largest vocabulary in bytes that is sent to the workers.
MOST_BYTES = 1 << 26


@dataclass
class Target:
    weight: float
    repeats: int


def read_targets(mix: DataFrame) -> dict[str, Target]:
    """Targets by source name, trimmed and lower-cased. Rows of one name add up, with the largest max_repeats; rows
    without name or with a weight or max_repeats that is null, NaN or not above zero ask for nothing."""
    rows = mix.select(norm_word(F.col("source")).alias("source"), F.col("weight").cast("double").alias("weight"), F.col("max_repeats").cast("int").alias("repeats")).where("source is not null and weight > 0 and not isnan(weight) and repeats > 0")
    rows = rows.groupBy("source").agg(F.sum("weight").alias("weight"), F.max("repeats").alias("repeats")).limit(MOST_SOURCES + 1).collect()
    if len(rows) > MOST_SOURCES:
        raise ValueError(f"a mix may name {MOST_SOURCES} sources")
    return {r.source: Target(r.weight, r.repeats) for r in rows}


def _counter(held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, held.value.splitlines())}
        coder = tiktoken.Encoding("sizes", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={})
        for b in batches:
            n = [len(coder.encode_ordinary(t.as_py())) for t in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64())], ["doc_id", "source", "tokens"])

    return run


def token_sizes(documents: DataFrame, sources: list[str], vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, source, tokens) of the documents of the named sources that have a text of at least one token.

    The driver reads the vocabulary and broadcasts it, so that the workers need no file; it is at most MOST_BYTES large.
    """
    spark = documents.sparkSession
    with open(vocabulary, "rb") as f:
        ranks = f.read(MOST_BYTES + 1)
    if len(ranks) > MOST_BYTES:
        raise ValueError(f"the vocabulary has more than {MOST_BYTES} bytes")
    docs = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), norm_word(F.col("source")).alias("source"), F.col("text").cast("string").alias("text"))
    named = F.broadcast(spark.createDataFrame([(s,) for s in sources], "source string"))  # at most MOST_SOURCES rows
    docs = docs.where(F.col("text").isNotNull() & F.col("doc_id").isNotNull()).join(named, "source", "left_semi").select("doc_id", "source", "text")
    return spread(docs).mapInArrow(_counter(spark.sparkContext.broadcast(ranks)), "doc_id bigint, source string, tokens bigint").where("tokens > 0")


def horizon(sizes: dict[str, int], targets: dict[str, Target], budget: int | None) -> tuple[dict[str, float], int, float]:
    """(share of each source that has tokens, budget, virtual time at which the budget is spent).

    Without a budget, the largest one at which every such source still meets its share. Beyond it, sources run out and
    the others go on.
    """
    own = {s: t.weight for s, t in targets.items() if sizes.get(s)}
    share = {s: w / sum(own.values()) for s, w in own.items()}
    ends = sorted((sizes[s] * targets[s].repeats / p, p, sizes[s] * targets[s].repeats) for s, p in share.items())
    if not ends:
        return {}, 0, 0.0
    if budget is None:
        return share, math.floor(ends[0][0] * (1 + 1e-12)), ends[0][0]
    left, gone = 1.0, 0
    for end, p, most in ends:
        if gone + left * end >= budget:
            return share, budget, (budget - gone) / left
        left, gone = left - p, gone + most
    return share, budget, ends[-1][0]


def _ahead(rows: DataFrame, group: list[str], part: str, order: list[str]) -> DataFrame:
    """Adds `ahead`: the tokens of the rows before each row in its group's order, of which `part` is the coarse one.

    Two steps, so that no task sorts a whole group: sums of the parts, then a running sum inside each part.
    """
    sums = rows.groupBy(*group, part).agg(F.sum("tokens").alias("of_part"))
    before = F.coalesce(F.sum("of_part").over(W.partitionBy(*group).orderBy(part).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select(*group, part, before.alias("before"))
    inside = F.coalesce(F.sum("tokens").over(W.partitionBy(*group, part).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("inside", inside).join(sums, [*group, part]).withColumn("ahead", F.col("before") + F.col("inside")).drop("before", "inside")


def mix(documents: DataFrame, targets: DataFrame, budget: int | None = None, seed: int = 7, vocabulary: str = VOCABULARY, whole: bool = False) -> DataFrame:
    """(doc_id, source, copy, tokens, finish, upto): the mix in its order, upto being the tokens up to and with each row.

    Weighted fair queueing: the documents of each source are shuffled by a hash of seed and doc_id and queued, the whole
    queue again for each further copy up to max_repeats; a document's virtual finish time is the tokens of its source up
    to its end, divided by the source's share. All queues are merged by finish time, range-sorted and cut where the total
    would exceed the budget (see horizon; whole takes as budget the tokens of all sources that the targets name). The weights of sources without any token are left to the others. No row is
    gathered on the driver but the totals of the sources; a source with most of the rows is summed in parts of ROWS_A_PART.
    """
    want = read_targets(targets)
    shared = Shared(documents.sparkSession, "mix")
    sizes, c = shared.write(token_sizes(documents, list(want), vocabulary).withColumn("key", F.xxhash64(F.lit(seed), "doc_id")))
    sums = sizes.groupBy("source").agg(F.sum("tokens").alias("n"), F.max("tokens").alias("longest")).collect()
    totals = {r.source: r.n for r in sums}
    share, budget, end = horizon(totals, want, sum(n or 0 for n in totals.values()) if whole else budget)
    if not share:
        return sizes.select("doc_id", "source", F.lit(0).alias("copy"), "tokens", F.lit(0.0).alias("finish"), F.lit(0).cast("bigint").alias("upto")).limit(0)
    # The documents under way at the horizon may end after it; the budget decides which of them are taken.
    end += max(r.longest / share[r.source] for r in sums if r.source in share)
    parts = 1 + c["rows"] // ROWS_A_PART
    # By the bits of the hash, so that parts follow each other as their keys do.
    part = F.floor((F.col("key").cast("double") + 2.0**63) / 2.0**64 * parts)
    queue = _ahead(sizes.withColumn("part", part), ["source"], "part", ["key", "doc_id"])
    per_source = sizes.sparkSession.createDataFrame([(s, totals[s], p, want[s].repeats) for s, p in share.items()], "source string, whole bigint, p double, most int")
    queue = queue.join(F.broadcast(per_source), "source")  # at most MOST_SOURCES rows
    # Copy c of a document ends at c whole queues and its own end; those that end too late to be taken aren't made.
    span = F.floor((F.lit(end * (1 + 1e-9)) * F.col("p") - F.col("ahead") - F.col("tokens")) / F.col("whole")).cast("int")
    queue = queue.withColumn("last", F.least(span, F.col("most") - 1)).where("last >= 0")
    queue = queue.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("last"))))
    queue = queue.withColumn("finish", (F.col("copy") * F.col("whole") + F.col("ahead") + F.col("tokens")) / F.col("p"))
    merged, c = shared.write(queue.select("doc_id", "source", "copy", "tokens", "finish", F.lit(0).alias("all")))
    slices = 1 + c["rows"] // ROWS_A_PART
    merged = _ahead(merged.withColumn("slice", F.least(F.floor(F.col("finish") * (slices / end)), F.lit(slices))), ["all"], "slice", ["finish", "source", "doc_id", "copy"])
    merged = merged.withColumn("upto", F.col("ahead") + F.col("tokens")).where(F.col("upto") <= budget)
    return merged.select("doc_id", "source", "copy", "tokens", "finish", "upto").orderBy("finish", "source", "doc_id", "copy")


def shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, tokens, share, documents, rows): what the mix holds of every source that the targets name,
    in percent; target_share is its weight among all weights, also where a source has no documents."""
    want = read_targets(targets)
    whole = sum(t.weight for t in want.values())
    spark = mixed.sparkSession
    wanted = spark.createDataFrame([(s, 100 * t.weight / whole) for s, t in want.items()], "source string, target_share double")
    got = mixed.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.countDistinct("doc_id").alias("documents"), F.count(F.lit(1)).alias("rows"))
    sums = wanted.join(got, "source", "left").fillna(0, ["tokens", "documents", "rows"])
    total = F.sum("tokens").over(W.partitionBy(F.lit(0)))
    return sums.select("source", "target_share", "tokens", F.coalesce(100 * F.col("tokens") / F.when(total > 0, total), F.lit(0.0)).alias("share"), "documents", "rows")
