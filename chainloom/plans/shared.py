"""Tables written between the rounds of iterative operators.

They lie in the folder all executors share, so that a lost executor costs a task and no lineage. Parquet rather
than an RDD checkpoint: it is written once, columns can be pruned, and its size is known to the optimizer.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

_own: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; a temporary folder only where that is unset and the master is local."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at
    sc = spark.sparkContext
    if not sc.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="chainloom-"))
    return sc._jsc.sc().getCheckpointDir().get()


def present(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def _sweep() -> None:
    for spark, path in _own:
        try:
            remove(spark, path)
        except Exception:  # noqa: BLE001  the JVM may be gone already
            pass


atexit.register(_sweep)


class Shared:
    """A folder of one operator run. write() evaluates a frame and gives it back as a table; forget() deletes one."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.n = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", 0
        self.paths: dict[int, str] = {}
        _own.append((spark, self.root))

    def write(self, df: DataFrame, **counts: Column) -> tuple[DataFrame, dict[str, int]]:
        """The table and the named counts, taken while writing."""
        path, self.n = f"{self.root}/{self.n}", self.n + 1
        schema, seen = df.schema, Observation()
        df = df.observe(seen, F.count(F.lit(1)).alias("rows"), *(F.coalesce(F.sum(c.cast("bigint")), F.lit(0)).alias(k) for k, c in counts.items()))
        df.write.parquet(path)
        out = self.spark.read.schema(schema).parquet(path)
        self.paths[id(out)] = path
        return out, dict(seen.get)

    def table(self, df: DataFrame) -> DataFrame:
        return self.write(df)[0]

    def forget(self, *tables: DataFrame) -> None:
        for t in tables:
            if path := self.paths.pop(id(t), None):
                remove(self.spark, path)
