"""A table rebuilt from a feed of inserts, updates and deletes (problem 5).

As in a table format with equality deletes, inserted rows and delete keys are appended to files of their own, each with
the sequence number of its event; nothing that is stored is ever rewritten. Readers keep an inserted row unless a delete
key of a higher sequence number names it, whatever order the batches came in.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from chainloom.functions.normalise import norm_hash, norm_word
from chainloom.plans.shared import Shared, present

#: The sequence number of an event without one: it counts as the earliest.
FIRST = -(2**63)
#: The sets of files and their columns. by_height: an add replaces what its height held before. by_row: a delete removes
#: just this hash.
SETS = {"inserts": "height bigint, hash string, seq bigint", "by_height": "height bigint, seq bigint", "by_row": "height bigint, hash string, seq bigint"}


def valid_events(feed: DataFrame) -> DataFrame:
    """(event_seq, type, hash, height) of adds and deletes with hash and height, each once, in one spelling.

    Arrival order and arrival time are ignored.
    """
    e = feed.select(F.col("event_seq").cast("bigint").alias("event_seq"), norm_word(F.col("type")).alias("type"), norm_hash(F.col("hash")).alias("hash"), F.col("height").cast("bigint").alias("height"))
    return e.where(F.col("type").isin("add", "delete") & F.col("hash").isNotNull() & F.col("height").isNotNull()).distinct()


@dataclass
class EqualityDeletes:
    """The files of one table under a folder that all executors share: a subfolder for each of SETS, in it one a batch."""

    spark: SparkSession
    root: str

    def append(self, feed: DataFrame, batch: int) -> None:
        """Adds the events of a feed, without reading what is stored. A batch that is appended again replaces itself."""
        e = Shared(self.spark, "feed").table(valid_events(feed).withColumn("seq", F.coalesce("event_seq", F.lit(FIRST))))
        adds = e.where("type = 'add'")
        # An add is an insert and a delete key for its height: by_height keeps one key a height and batch, the last.
        for name, rows in {"inserts": adds, "by_height": adds.groupBy("height").agg(F.max("seq").alias("seq")), "by_row": e.where("type = 'delete'")}.items():
            names = [c.split()[0] for c in SETS[name].split(", ")]
            rows.select(*names).sortWithinPartitions("height").write.mode("overwrite").parquet(f"{self.root}/{name}/batch-{batch}")

    def files(self, name: str) -> DataFrame:
        """The rows of one set over all batches; none if nothing was appended. Heights are sorted inside the files, so that a
        condition on height skips row groups."""
        if not present(self.spark, f"{self.root}/{name}"):
            return self.spark.createDataFrame([], SETS[name])
        return self.spark.read.schema(SETS[name]).option("recursiveFileLookup", "true").parquet(f"{self.root}/{name}")

    def read(self) -> DataFrame:
        """(height, hash) now valid: the inserts that no delete key of a higher sequence number names.

        Events that were delivered in several batches collapse by map-side combined maxima, one row a key, before the
        anti-joins, so that a hot height is one row there. Two adds of one height under one sequence number contradict
        each other; the smaller hash is kept.
        """
        last = lambda name, *key: self.files(name).groupBy(*key).agg(F.max("seq").alias("seq"))
        i, h, r = last("inserts", "height", "hash").alias("i"), last("by_height", "height").alias("h"), last("by_row", "height", "hash").alias("r")
        live = i.join(h, (F.col("i.height") == F.col("h.height")) & (F.col("h.seq") > F.col("i.seq")), "left_anti")
        live = live.join(r, (F.col("i.height") == F.col("r.height")) & (F.col("i.hash") == F.col("r.hash")) & (F.col("r.seq") > F.col("i.seq")), "left_anti")
        return live.groupBy("height").agg(F.min("hash").alias("hash"))

    def counts(self) -> DataFrame:
        """(height, n_events): the different events of every height."""
        events = self.files("inserts").withColumn("add", F.lit(True)).unionByName(self.files("by_row").withColumn("add", F.lit(False)))
        return events.distinct().groupBy("height").agg(F.count(F.lit(1)).alias("n_events"))

    def state(self) -> DataFrame:
        """(height, hash, n_events) of every height with an event; hash is empty where the height now is."""
        return self.counts().join(self.read(), "height", "left").select("height", F.coalesce("hash", F.lit("")).alias("hash"), "n_events")


def current_state(feed: DataFrame, *more: DataFrame) -> DataFrame:
    """(height, hash, n_events) of every height with a valid event of the feeds, each appended as a batch of its own.

    Rows without type, hash or height have no effect; events without event_seq count as the earliest. An empty feed gives
    no rows. Columns other than event_seq, type, hash and height are ignored.
    """
    table = EqualityDeletes(feed.sparkSession, Shared(feed.sparkSession, "deletes").root)
    for n, f in enumerate((feed, *more)):
        table.append(f, n)
    return table.state()
