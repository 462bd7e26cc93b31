"""Per-key results where a few keys hold most of the rows (problem 4)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from chainloom.functions.normalise import day_text, epoch_day, norm_address, sats
from chainloom.plans.shared import Shared

#: Keys with more than one in so many of the rows are dealt into several parts; there can't be more such keys.
HOT = 4096
#: Rows that a worker adds at once, and the keys and days of one block of accumulators.
CHUNK, KEYS, DAYS = 1 << 18, 64, 16
#: Blocks of accumulators that are dense in memory at once.
DENSE = 2048
BLOCKS = "block bigint, days int, slot array<int>, n_rows array<bigint>, sum_sats array<bigint>"


def _sums(codes: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
    """Exact integer sums by code. bincount adds doubles, so the two halves of the values are added apart."""
    high, low = values >> 32, values & 0xFFFFFFFF
    add = lambda v: np.bincount(codes, weights=v, minlength=size).astype(np.int64)
    return (add(high) << 32) + add(low)


def _lists(values: np.ndarray, ends: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, kind))


def _emit(block: np.ndarray, days: np.ndarray, of: np.ndarray, slot: np.ndarray, n: np.ndarray, sums: np.ndarray) -> pa.RecordBatch:
    """Blocks as rows; of tells, in order, which block a slot belongs to."""
    ends = np.searchsorted(of, np.arange(len(block) + 1))
    return pa.RecordBatch.from_arrays([pa.array(block, pa.int64()), pa.array(days, pa.int32()), _lists(slot, ends, pa.int32()), _lists(n, ends, pa.int64()), _lists(sums, ends, pa.int64())], ["block", "days", "slot", "n_rows", "sum_sats"])


def _accumulate(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows added into dense blocks of KEYS x DAYS slots, of which those in use leave the worker; and one block a day
    (block -1) with the totals over all keys."""
    t = pa.Table.from_batches(parts)
    key, day, value = (t[c].to_numpy() for c in ("id", "day", "sats"))
    days, at = np.unique(day, return_inverse=True)
    ones = np.arange(len(days) + 1)
    yield _emit(np.full(len(days), -1), days, ones[:-1], np.zeros(len(days)), np.bincount(at), _sums(at, value, len(days)))
    span = np.int64(1 << 20)
    blocks, of = np.unique((key // KEYS) * span + day // DAYS + span // 2, return_inverse=True)
    slot = of * (KEYS * DAYS) + (key % KEYS) * DAYS + day % DAYS
    order = np.argsort(of, kind="stable") if len(blocks) > DENSE else None
    for first in range(0, len(blocks), DENSE):
        last = min(first + DENSE, len(blocks))
        use = slice(None) if order is None else order[np.searchsorted(of, first, sorter=order) : np.searchsorted(of, last, sorter=order)]
        codes, size = slot[use] - first * KEYS * DAYS, (last - first) * KEYS * DAYS
        n = np.bincount(codes, minlength=size)
        used, sums = np.flatnonzero(n), _sums(codes, value[use], size)
        yield _emit(blocks[first:last] // span, blocks[first:last] % span - span // 2, used // (KEYS * DAYS), used % (KEYS * DAYS), n[used], sums[used])


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kept, rows = [], 0
    for b in batches:
        kept, rows = [*kept, b], rows + b.num_rows
        if rows >= CHUNK:
            yield from _accumulate(kept)
            kept, rows = [], 0
    if rows:
        yield from _accumulate(kept)


def daily_cells(shared: Shared, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cells, keys): cells(id, day, n_rows, sum_sats) of every key and day, and of every day over all keys (id null); keys
    (id, address). Day is in days since 1970.

    One dictionary numbers all addresses; it is counted with map-side combining and written. The rows take their number
    by a join on (address, part), where an address with more than one in HOT of the rows has as many parts as it has such
    shares: at most HOT addresses do, so the list of them is small enough to broadcast, and no part is larger than the
    others. The same exchange drops the copies of a row. Equal splits then add their rows into dense blocks of
    accumulators (bincount), and the blocks of all splits are added by (block, slot); only numbers travel there.
    """
    raw = changes.select(norm_address(F.col("address")).alias("address"), epoch_day(changes, "timestamp").alias("day"), "timestamp", "height", "tx_n", sats(F.col("balance_change")).alias("sats"))
    raw = raw.where("address is not null and timestamp is not null and sats is not null")
    counted = raw.groupBy("address").agg(F.count(F.lit(1)).alias("rows")).select(F.monotonically_increasing_id().alias("id"), "address", "rows")
    keys, c = shared.write(counted, total=F.col("rows"))
    share = max(1, c["total"] // HOT)
    parts = F.ceil(F.col("rows") / share).cast("int")
    hot = F.broadcast(keys.where(F.col("rows") > share).select("address", parts.alias("parts")))  # at most HOT rows
    rows = raw.join(hot, "address", "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64("timestamp", "height", "tx_n"), "parts"), F.lit(0)).cast("int")).drop("parts")
    rows = rows.repartition("address", "part").groupBy("address", "part", "timestamp", "day", "height", "tx_n").agg(F.max("sats").alias("sats"))
    numbered = keys.select("address", "id", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    blocks = rows.join(numbered, ["address", "part"]).select("id", "day", "sats").mapInArrow(_split, BLOCKS)
    slots = blocks.repartition("block", "days").select("block", "days", F.explode(F.arrays_zip("slot", "n_rows", "sum_sats")).alias("s"))
    slots = slots.groupBy("block", "days", "s.slot").agg(F.sum("s.n_rows").alias("n_rows"), F.sum("s.sum_sats").alias("sum_sats"))
    of_all = F.col("block") == -1
    number, day = F.col("block") * KEYS + F.floor(F.col("slot") / DAYS), F.col("days") * DAYS + F.col("slot") % DAYS
    return slots.select(F.when(~of_all, number).alias("id"), F.when(of_all, F.col("days")).otherwise(day).alias("day"), "n_rows", "sum_sats"), keys.select("id", "address")


def address_day_sums(changes: DataFrame) -> DataFrame:
    """(address, day text, n_rows, sum_sats) of every address and day.

    changes needs address, timestamp, balance_change, height, tx_n; other columns are ignored. Rows without address,
    timestamp or amount (NaN and infinite amounts are none) don't count; height and tx_n may be null, null then equals
    null. Of copies of a row with differing amounts the largest counts. An empty input gives no row.
    """
    cells, keys = daily_cells(Shared(changes.sparkSession, "heavy"), changes)
    return cells.where("id is not null").join(keys, "id").select("address", day_text(F.col("day")).alias("day"), "n_rows", "sum_sats")


def heavy_losing_days(changes: DataFrame, min_rows: int = 5, min_percent: int = 4) -> DataFrame:
    """(address, day): address-days of at least min_rows rows and min_percent of the day's rows whose sum is below zero."""
    shared = Shared(changes.sparkSession, "heavy")
    cells, keys = daily_cells(shared, changes)
    cells = shared.table(cells.where((F.col("n_rows") >= min_rows) & (F.col("sum_sats") < 0) | F.col("id").isNull()))
    totals = cells.where("id is null").select("day", F.col("n_rows").alias("of_day"))
    found = cells.where("id is not null").join(totals, "day").where(F.col("n_rows") * 100 >= F.col("of_day") * min_percent)
    return found.join(keys, "id").select("address", day_text(F.col("day")).alias("day"))
