"""Totals over trailing periods for every entity and day (problem 6)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from chainloom.functions.normalise import day_text
from chainloom.operators.ledger import ledger_rows
from chainloom.plans.shared import Shared

#: Daily totals per partition of the exploded stage; each becomes up to `long` output rows there.
CELLS_A_PARTITION = 40_000
MOST_PARTITIONS = 100_000


def rolling_totals(changes: DataFrame, short: int = 7, long: int = 30, last_day: int | None = None, cells_a_partition: int = CELLS_A_PARTITION) -> DataFrame:
    """(address, day, total_short, total_long, rows_short, rows_long), sats, for every day of every address.

    The days of an address run from its first active day to the last day of the data (or last_day, days since 1970, if
    that is later), and at least to long - 1 days after its own last one; before and after, both totals are zero. Each
    daily total is exploded onto the days it influences, and the calendar of each address is joined to them: its rows
    carry no amount and meet the exploded totals of their (address, day) in the one aggregate that adds them, an outer
    join without a shuffle. Days that nothing influences get zeros. An empty input gives no row.

    The daily totals are written once; their number sizes the partitioning by address, inside which the exploded totals
    and the calendar are made and meet. An address has at most one daily total a day there, so its share is bounded by
    the calendar whatever share of the rows it holds.
    """
    shared = Shared(changes.sparkSession, "rolling")
    cells, c = shared.write(ledger_rows(changes).groupBy("address", "day", "salt").agg(F.sum("sats").alias("sats"), F.count(F.lit(1)).alias("n")))
    parts = max(-(-c["rows"] // cells_a_partition), int(changes.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    daily = cells.repartition(min(MOST_PARTITIONS, parts), "address").groupBy("address", "day").agg(F.sum("sats").alias("sats"), F.sum("n").alias("n"))
    end = cells.agg(F.greatest(F.max("day"), F.lit(last_day).cast("int")).alias("end"))
    spread = daily.select("address", "day", "sats", "n", F.explode(F.sequence(F.lit(0), F.lit(long - 1))).alias("k"))
    spread = spread.select("address", (F.col("day") + F.col("k")).alias("day"), "k", "sats", "n")
    spans = daily.groupBy("address").agg(F.min("day").alias("lo"), F.max("day").alias("hi")).join(F.broadcast(end))  # one row
    calendar = spans.select("address", F.explode(F.sequence("lo", F.greatest("end", F.col("hi") + (long - 1)))).alias("day"))
    recent = lambda c, k: F.coalesce(F.sum(F.when(F.col("k") < k, F.col(c))), F.lit(0))
    return spread.unionByName(calendar, allowMissingColumns=True).groupBy("address", "day").agg(
        recent("sats", short).alias("total_short"), recent("sats", long).alias("total_long"), recent("n", short).alias("rows_short"), recent("n", long).alias("rows_long")
    )


def with_averages(totals: DataFrame, short: int = 7, long: int = 30) -> DataFrame:
    """Adds the averages a calendar day, in sats."""
    return totals.select("address", day_text(F.col("day")).alias("day"), "total_short", "total_long", (F.col("total_short") / short).alias("average_short"), (F.col("total_long") / long).alias("average_long"), "rows_short", "rows_long")


def rebounds(changes: DataFrame, gain_sats: int = 1_000_000_000, loss_sats: int = -10_000_000_000) -> DataFrame:
    """(address, day) whose trailing week gained at least gain_sats while the trailing 30 days lost to loss_sats or below."""
    t = rolling_totals(changes)
    return t.where((F.col("total_short") >= gain_sats) & (F.col("total_long") <= loss_sats)).select("address", day_text(F.col("day")).alias("day"))
