"""Balances, daily candles, gainers and losers, rich lists. Input: (address, ts, delta_sats), one row an address and time.

Nothing sorts all rows of an address in one task: rows are ordered inside (address, day) and days inside an address, so
that a task gets at most the times of one day, or one row a day, of an address, whatever share of all rows it holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

RICH_SATS = 10_000_000_000


def utc_day(ts: Column) -> Column:
    return F.date_from_unix_date(F.floor(F.unix_seconds(ts) / 86400).cast("int"))


def _in_day(rows: DataFrame, day: str) -> DataFrame:
    """rows with _sum, the sum of the changes of the day up to and with each row."""
    w = W.partitionBy("address", day).orderBy("ts").rowsBetween(W.unboundedPreceding, 0)
    return rows.repartition("address", day).withColumn("_sum", F.sum("delta_sats").over(w))


def _carried(per_day: DataFrame, day: str, of_day: str) -> DataFrame:
    """per_day with _before, the sum of of_day over the earlier days of the address."""
    w = W.partitionBy("address").orderBy(day).rowsBetween(W.unboundedPreceding, -1)
    return per_day.withColumn("_before", F.coalesce(F.sum(of_day).over(w), F.lit(0)))


def running_balances(deltas: DataFrame) -> DataFrame:
    """(address, ts, delta_sats, balance_sats): the balance after each time of an address.

    Two sums: of the days before, and inside the day. A null amount changes nothing; a null address is one of its own.
    """
    rows = deltas.select("address", "ts", "delta_sats", utc_day(F.col("ts")).alias("_day"))
    sums = _carried(rows.groupBy("address", "_day").agg(F.sum("delta_sats").alias("_all")), "_day", "_all")
    sums = sums.select(F.col("address").alias("_a"), F.col("_day").alias("_d"), "_before")
    on = F.col("address").eqNullSafe(F.col("_a")) & F.col("_day").eqNullSafe(F.col("_d"))
    return _in_day(rows, "_day").join(sums, on).select("address", "ts", "delta_sats", (F.col("_before") + F.coalesce("_sum", F.lit(0))).alias("balance_sats"))


def days(deltas: DataFrame) -> DataFrame:
    """(address, day, open, high, low, close), sats: one row an address and active day.

    open is the balance before the first time of the day, close after the last; high and low include open. Days are UTC.
    The course of a day is found from the sums inside it and moved by the balance it opens with.
    """
    rows = _in_day(deltas.select("address", "ts", "delta_sats", utc_day(F.col("ts")).alias("day")), "day")
    d = rows.groupBy("address", "day").agg(F.sum("delta_sats").alias("_all"), F.max("_sum").alias("_top"), F.min("_sum").alias("_low"))
    d = _carried(d, "day", "_all")
    moved = lambda c: F.col("_before") + F.coalesce(c, F.lit(0))
    return d.select("address", "day", F.col("_before").alias("open"), moved(F.greatest(F.col("_top"), F.lit(0))).alias("high"), moved(F.least(F.col("_low"), F.lit(0))).alias("low"), moved(F.col("_all")).alias("close"))


def _open_day(deltas: DataFrame) -> DataFrame:
    """(_open): the first day that hasn't ended by the latest time of the data. One row."""
    return F.broadcast(deltas.agg(F.date_from_unix_date(F.floor((F.unix_millis(F.max("ts")) + 1) / 86_400_000).cast("int")).alias("_open")))


def complete(per_day: DataFrame, deltas: DataFrame) -> DataFrame:
    """Only days that ended by the latest time of the data."""
    return per_day.join(_open_day(deltas), F.col("day") < F.col("_open")).drop("_open")


def candles(deltas: DataFrame) -> DataFrame:
    return complete(days(deltas), deltas)


def gainers(candle: DataFrame) -> DataFrame:
    """(day, address, change_sats) of days with a gain."""
    return candle.select("day", "address", (F.col("close") - F.col("open")).alias("change_sats")).where("change_sats > 0")


def losers(candle: DataFrame) -> DataFrame:
    return candle.select("day", "address", (F.col("close") - F.col("open")).alias("change_sats")).where("change_sats < 0")


def rich_list(deltas: DataFrame, above_sats: int = RICH_SATS) -> DataFrame:
    """(day, address, balance_sats, change_sats) at the end of every day on which an address holds more than above_sats.

    Idle days carry the balance on, with change 0, up to the last complete day. Rows below the bound are dropped before
    days are exploded. An address has one row a day here, so its next active day is found in one task.
    """
    d = days(deltas).withColumn("next", F.lead("day").over(W.partitionBy("address").orderBy("day"))).where(F.col("close") > above_sats)
    d = d.join(_open_day(deltas)).withColumn("until", F.date_sub(F.least(F.coalesce("next", "_open"), "_open"), 1)).where("until >= day")
    d = d.select("address", "day", F.col("close").alias("balance_sats"), (F.col("close") - F.col("open")).alias("change"), F.explode(F.sequence("day", "until")).alias("at"))
    return d.select(F.col("at").alias("day"), "address", "balance_sats", F.when(F.col("at") == F.col("day"), F.col("change")).otherwise(F.lit(0)).alias("change_sats"))


def balance_before(asked: DataFrame, balances: DataFrame) -> DataFrame:
    """asked(address, ts) with balance_sats, the latest one before ts, null if there is none: an as-of join by one sort of
    both sides together inside a day, and the last balance of the days before where the day has none yet."""
    both = balances.select("address", "ts", "balance_sats", F.lit(1).alias("_k")).unionByName(asked.select("address", "ts", F.lit(0).alias("_k")), allowMissingColumns=True)
    both = both.withColumn("_day", utc_day(F.col("ts"))).repartition("address", "_day")
    ends = both.groupBy("address", "_day").agg(F.max_by("balance_sats", F.when(F.col("_k") == 1, F.col("ts"))).alias("_end"))
    w = W.partitionBy("address").orderBy("_day").rowsBetween(W.unboundedPreceding, -1)
    ends = ends.select(F.col("address").alias("_a"), F.col("_day").alias("_d"), F.last("_end", ignorenulls=True).over(w).alias("_carried"))
    w = W.partitionBy("address", "_day").orderBy("ts", "_k").rowsBetween(W.unboundedPreceding, 0)
    at = both.withColumn("_b", F.last("balance_sats", ignorenulls=True).over(w)).where("_k = 0")
    on = F.col("address").eqNullSafe(F.col("_a")) & F.col("_day").eqNullSafe(F.col("_d"))
    return at.join(ends, on).select("address", "ts", F.coalesce("_b", "_carried").alias("balance_sats"))
