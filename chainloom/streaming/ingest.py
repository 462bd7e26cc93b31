"""Continuous ingestion: blocks to stored ledger tables and wallet clusters, balance changes to daily sums."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import IntegerType, StructField, StructType

from chainloom.operators import chain as C, clusters as K
from chainloom.operators.hierarchy import ends_of, parent_links
from chainloom.plans.shared import Shared, present, remove

#: Folders by which the unspent outputs of a compacted store are split.
BUCKETS = 256
POINTERS = StructType().add("address", "string").add("parent", "string")


@dataclass
class LedgerStore:
    """Ledger tables under one folder, one subfolder a batch. A batch that runs again overwrites what it wrote before, so
    each block counts once after any restart. Blocks must come in the order of their heights, as block files and nodes give
    them. Lost blocks are retracted by height: what was written for them before no longer counts.

    clusters keeps wallet clusters as well; their joins can't be undone, so only final blocks may be written then.
    sinks=False resolves the inputs of every batch and stores nothing.
    """

    spark: SparkSession
    root: str
    clusters: bool = False
    sinks: bool = True

    def read(self, name: str, schema: StructType, above: int = -1, upto: int | None = None) -> DataFrame:
        """The rows of a set (tx, txo, txi, spent, address_delta) that count, of all batches or those above and up to one."""
        at = f"{self.root}/{name}"
        if not present(self.spark, at):
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(StructType([*schema.fields, StructField("batch", IntegerType())])).parquet(at).where(F.col("batch") > above)
        if upto is not None:
            rows = rows.where(F.col("batch") <= upto)
        if "height" in schema.names and present(self.spark, f"{self.root}/lost"):
            # One row a lost height.
            lost = self.spark.read.schema("height int, batch int").parquet(f"{self.root}/lost").groupBy(F.col("height").alias("_h")).agg(F.max("batch").alias("_b"))
            rows = rows.join(lost, (F.col("height") == F.col("_h")) & (F.col("batch") < F.col("_b")), "left_anti")
        return rows.drop("batch")

    def _put(self, df: DataFrame, name: str, batch: int) -> DataFrame:
        """Writes the rows of a batch and gives them back as a table."""
        at = f"{self.root}/{name}/batch={batch}"
        df.write.mode("overwrite").parquet(at)
        return self.spark.read.schema(df.schema).parquet(at)

    def apply(self, events: DataFrame, blocks: DataFrame, batch: int) -> None:
        """A batch of chain events(type, hash, height): the heights of deletes are retracted, the blocks of adds written."""
        lost = events.where("type = 'delete'").select(F.col("height").cast("integer").alias("height")).distinct()
        self._put(lost, "lost", batch)
        self.write(blocks.join(events.where("type = 'add'").select("hash"), "hash", "left_semi"), batch)

    def write(self, blocks: DataFrame, batch: int) -> None:
        """Outputs may be spent years later, so inputs are resolved against all outputs that were unspent at the last
        compaction and those stored since; the batch's own inputs are the small side of that join."""
        c = C.flatten(blocks, self.last_time(batch))
        if not self.sinks:
            C.spent_outputs(c).write.format("noop").mode("overwrite").save()
            return
        tx, txo, txi = (self._put(getattr(c, name), name, batch) for name in ("tx", "txo", "txi"))
        spent = self._put(C.spent_outputs(C.Chain(tx, self.spendable(txo.schema, batch), txi)), "spent", batch)
        deltas = C.address_deltas(C.Chain(tx, txo, txi, spent))
        self._put(deltas, "address_delta", batch)
        if self.clusters:
            self._join_clusters(txo, spent, batch)

    def _compacted(self) -> int:
        """The batch up to which outputs were compacted, -1 before the first time."""
        at = f"{self.root}/compacted"
        return self.spark.read.schema("upto int").json(at).agg(F.max("upto")).first()[0] if present(self.spark, at) else -1

    def spendable(self, schema: StructType, batch: int | None = None) -> DataFrame:
        """The outputs that an input of a batch may name."""
        done = self._compacted()
        later = self.read("txo", schema, above=done, upto=batch)
        return later if done < 0 else self.spark.read.schema(schema).parquet(f"{self.root}/unspent-{done}").drop("bucket").unionByName(later)

    def compact(self, upto: int, schema: StructType) -> None:
        """Writes the outputs of the batches up to `upto` that none of them spends, split by txid, and forgets the set before,
        so that a batch costs what is unspent and not the whole history. The blocks of these batches must be final."""
        done = self._compacted()
        gone = self.read("spent", StructType().add("txid", "string").add("n", "integer").add("height", "integer"), above=done, upto=upto).select("txid", "n").distinct()
        left = self.spendable(schema, upto).join(gone, ["txid", "n"], "left_anti")
        left = left.withColumn("bucket", F.pmod(F.xxhash64("txid"), F.lit(BUCKETS)).cast("integer")).repartition("bucket").sortWithinPartitions("bucket", "txid")
        left.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.root}/unspent-{upto}")
        self.spark.range(1).select(F.lit(upto).alias("upto")).write.mode("append").json(f"{self.root}/compacted")
        if 0 <= done < upto:
            remove(self.spark, f"{self.root}/unspent-{done}")

    def _join_clusters(self, outputs: DataFrame, spent: DataFrame, batch: int) -> None:
        """Appends pointers(address, parent): new addresses, and roots of clusters that an edge of this batch joins to one of
        a smaller root. Only the addresses of the batch are followed to their roots."""
        shared = Shared(self.spark, "upkeep")
        edges = shared.table(K.edges_of(spent, outputs))
        seen = outputs.select(C.first_address(F.col("addresses")).alias("address")).where("address is not null")
        asked = seen.unionByName(edges.select(F.col("a").alias("address"))).unionByName(edges.select(F.col("b").alias("address"))).distinct()
        at = resolve(shared, asked, self.read("pointers", POINTERS, upto=batch - 1))
        root = lambda k: at.select(F.col("address").alias(k), F.col("root").alias(f"{k}_root"))
        named = edges.join(root("a"), "a").join(root("b"), "b").select(F.col("a_root").alias("a"), F.col("b_root").alias("b")).where("a <> b")
        to = K.components(at.select(F.col("root").alias("address")).distinct(), named)
        moved = to.where("cluster_id <> address").select("address", F.col("cluster_id").alias("parent"))
        fresh = at.where("not known").select("address").join(moved.select("address"), "address", "left_anti").withColumn("parent", F.lit(None).cast("string"))
        self._put(moved.unionByName(fresh), "pointers", batch)

    def wallets(self) -> DataFrame:
        """(address, cluster_id) of all addresses seen; the id is the smallest address of the cluster."""
        ends = ends_of(parent_links(self.read("pointers", POINTERS), F.col("address"), F.col("parent")))
        return ends.select(F.col("node").alias("address"), F.col("root").alias("cluster_id"))

    def last_time(self, batch: int) -> int:
        """Milliseconds of the last block of the batches before, 0 at first. Empty batches are passed over."""
        tx = self.read("tx", StructType().add("height", "integer").add("ts", "timestamp"), upto=batch - 1)
        return tx.agg(F.max(F.unix_millis("ts"))).first()[0] or 0

    def start(self, stream: DataFrame, checkpoint: str, once: bool = False) -> StreamingQuery:
        w = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda df, n: self.write(df, n))
        return (w.trigger(availableNow=True) if once else w).start()


def resolve(shared: Shared, asked: DataFrame, pointers: DataFrame) -> DataFrame:
    """(address, root, known) of asked(address): the end of each one's pointers(address, parent), and whether it has a row
    there. An address has several rows if it was a root at first; the one with a parent counts."""
    state = asked.select("address", F.col("address").alias("root"), F.lit(None).cast("boolean").alias("known"))
    while True:
        at = state.select(F.col("root").alias("_r")).distinct()
        step = pointers.join(at, F.col("address") == F.col("_r"), "left_semi").groupBy(F.col("address").alias("_r")).agg(F.max("parent").alias("_p")).withColumn("_k", F.lit(True))
        state = state.join(step, F.col("root") == F.col("_r"), "left")
        state = state.select("address", F.coalesce("_p", "root").alias("root"), F.coalesce("known", "_k", F.lit(False)).alias("known"), F.col("_p").isNotNull().alias("moved"))
        state, c = shared.write(state, moved=F.col("moved"))
        state = state.drop("moved")
        if not c["moved"]:
            return state


def daily_changes(changes: DataFrame, lateness: str = "0 seconds") -> DataFrame:
    """(address, day, sum_sats, n_rows) of a stream of (address, ts, delta_sats); a day is emitted once it has ended.

    State is one sum an address and open day. Rows later than `lateness` behind the newest time are dropped.
    """
    c = changes.withWatermark("ts", lateness).groupBy("address", F.window("ts", "1 day")).agg(F.sum("delta_sats").alias("sum_sats"), F.count(F.lit(1)).alias("n_rows"))
    return c.select("address", F.date_from_unix_date(F.floor(F.unix_seconds("window.start") / 86400).cast("integer")).alias("day"), "sum_sats", "n_rows")
