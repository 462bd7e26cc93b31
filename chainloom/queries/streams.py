"""Streaming queries, run over the stored tables as far as they go, with the SQL of the batch result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from chainloom.plans.shared import Shared
from chainloom.queries.ledger import EVENTS
from chainloom.sources.tables import table
from chainloom.streaming.ingest import daily_changes


def t5_daily_changes(spark: SparkSession, d: str) -> DataFrame:
    """Days that ended before the newest event, summed by a stream."""
    root = Shared(spark, "stream").root  # removed when the driver ends
    events = table(spark, d, "events")
    e = spark.readStream.schema(events.schema).parquet(f"{d}/events.parque[t]")
    v = F.floor(F.col("value") * 100_000_000 + F.lit(0.5)).cast("bigint")
    e = e.select(F.concat(F.lit("u"), "user_id").alias("address"), F.col("ts").cast("timestamp").alias("ts"), F.when(F.col("event_type").isin("purchase", "error"), -v).otherwise(v).alias("delta_sats"))
    q = daily_changes(e).writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/checkpoint").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    out = spark.read.schema("address string, day date, sum_sats bigint, n_rows bigint").parquet(f"{root}/out")
    return out.withColumn("day", F.col("day").cast("string"))


QUERIES = {"t5_daily_changes": t5_daily_changes}
SQL = {"t5_daily_changes": "WITH" + EVENTS + """ SELECT address, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, CAST(sum(d) AS BIGINT) AS sum_sats, count(*) AS n_rows FROM e
WHERE CAST(ts AS DATE) < (SELECT CAST(max(ts) AS DATE) FROM events) GROUP BY ALL"""}
