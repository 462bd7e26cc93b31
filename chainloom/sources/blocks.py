"""Block documents (getblock with full transactions) as JSON lines, in batch or as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

#: Fields of a block document; unknown ones are ignored, missing ones are null.
BLOCK = """hash string, size int, height int, version int, versionHex string, merkleroot string, time bigint, mediantime bigint,
nonce bigint, bits string, difficulty decimal(38,18), chainwork string, previousblockhash string,
tx array<struct<txid: string, size: int, version: bigint, locktime: bigint,
  vin: array<struct<coinbase: string, sequence: bigint, txid: string, vout: int, scriptSig: struct<asm: string, hex: string>>>,
  vout: array<struct<value: double, n: int, scriptPubKey: struct<asm: string, hex: string, reqSigs: int, type: string, addresses: array<string>>>>>>"""


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(BLOCK).json(path)


def stream_blocks(spark: SparkSession, path: str, files_per_trigger: int = 200) -> DataFrame:
    """New files of the folder as a stream; files_per_trigger limits how far a batch runs ahead of the sinks."""
    return spark.readStream.schema(BLOCK).option("maxFilesPerTrigger", files_per_trigger).json(path)


def headers(blocks: DataFrame) -> DataFrame:
    return blocks.select("hash", "height", "version", "versionHex", "merkleroot", "time", "mediantime", "nonce", "bits", "difficulty", "chainwork", "previousblockhash", "size", F.size("tx").alias("tx_count"))


def final_blocks(blocks: DataFrame, confirmations: int = 5) -> DataFrame:
    """Blocks with at least so many blocks above them."""
    tip = blocks.agg((F.max("height") - confirmations).alias("final"))
    return blocks.join(F.broadcast(tip), F.col("height") <= F.col("final")).drop("final")  # one row
