"""Rows of the address ledger in their clean form."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from chainloom.functions.normalise import epoch_day, norm_address, sats

#: Parts into which the rows of one address and day are dealt, so that no task gets all rows of a hot key.
SALTS = 16


def ledger_rows(changes: DataFrame, salts: int = SALTS) -> DataFrame:
    """(address, day, salt, timestamp, height, tx_n, sats), each key (address, timestamp, height, tx_n) once.

    changes needs address, timestamp, balance_change, height, tx_n; other columns are ignored. Rows without
    address, timestamp or amount (NaN and infinite amounts are none) don't count; height and tx_n may be null, null
    then equals null. Of copies with differing amounts the largest wins. The rows of a key lie in one partition of
    hash(address, day, salt), and the salt is taken from the rest of the key: copies meet, hot addresses and hot
    address-days are spread.
    """
    rows = changes.select(
        norm_address(F.col("address")).alias("address"), epoch_day(changes, "timestamp").alias("day"), "timestamp", "height", "tx_n",
        sats(F.col("balance_change")).alias("sats"),
    ).where("address is not null and timestamp is not null and sats is not null")
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("timestamp", "height", "tx_n"), F.lit(salts)).cast("int"))
    return rows.repartition("address", "day", "salt").groupBy("address", "day", "salt", "timestamp", "height", "tx_n").agg(F.max("sats").alias("sats"))
