"""Blocks from nodes by JSON-RPC, as a Spark data source: spark.read.format("node_blocks").

Options: urls (separated by blanks), user, password, start and end (heights, end excluded), confirmations (default 5),
blocks_per_partition (default 100). Rows: (height int, block string), the block as JSON for sources.blocks.BLOCK.
A call is tried on the node with the fewest failures; a failing node is left alone for ten seconds.
"""

from __future__ import annotations

import base64
import json
import time
import urllib.request

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader

from chainloom.sources.blocks import BLOCK

SCHEMA = "height int, block string"
REST_SECONDS = 10


class Nodes:
    def __init__(self, urls: list[str], user: str = "", password: str = "", tries: int = 5):
        self.urls, self.tries = urls, tries
        self.banned, self.used = dict.fromkeys(urls, 0.0), dict.fromkeys(urls, 0)
        self.auth = "Basic " + base64.b64encode(f"{user}:{password}".encode()).decode()

    def call(self, method: str, *params):
        body = json.dumps({"jsonrpc": "1.0", "id": 0, "method": method, "params": list(params)}).encode()
        last: Exception | None = None
        for _ in range(max(self.tries, len(self.urls))):
            url = min(self.urls, key=lambda u: (max(0.0, self.banned[u] - time.monotonic()), self.used[u]))
            self.used[url] += 1
            try:
                r = urllib.request.Request(url, body, {"Content-Type": "application/json", "Authorization": self.auth})
                with urllib.request.urlopen(r, timeout=60) as f:
                    answer = json.load(f)
                if answer.get("error"):
                    raise ValueError(answer["error"])
                return answer["result"]
            except (OSError, ValueError) as e:
                last, self.banned[url] = e, time.monotonic() + REST_SECONDS
        raise RuntimeError(f"{method} failed on all nodes") from last

    def hash(self, height: int) -> str:
        return self.call("getblockhash", height)

    def header(self, hash_: str) -> dict:
        return self.call("getblockheader", hash_)

    def block(self, height: int) -> tuple[int, str]:
        return height, json.dumps(self.call("getblock", self.hash(height), 2))

    def pool(self, verbose: bool = False):
        """The txids of the pool; if verbose, what the node knows of each."""
        return self.call("getrawmempool", verbose)

    def transaction(self, txid: str, tries: int = 1, wait: float = 0.1) -> str | None:
        """A transaction as JSON; null if the node doesn't have it after so many tries."""
        for k in range(tries):
            try:
                return json.dumps(self.call("getrawtransaction", txid, 1))
            except RuntimeError:
                time.sleep(wait if k + 1 < tries else 0)
        return None


def _nodes(options: dict) -> Nodes:
    return Nodes(options["urls"].split(), options.get("user", ""), options.get("password", ""))


class _Span(InputPartition):
    def __init__(self, start: int, end: int):
        self.start, self.end = start, end


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = dict(options)

    def partitions(self) -> list[_Span]:
        o = self.options
        end = int(o["end"]) if "end" in o else _nodes(o).call("getblockcount") - int(o.get("confirmations", 5)) + 1
        step = int(o.get("blocks_per_partition", 100))
        return [_Span(a, min(a + step, end)) for a in range(int(o.get("start", 0)), end, step)]

    def read(self, span: _Span):
        nodes = _nodes(self.options)
        yield from map(nodes.block, range(span.start, span.end))


class _Stream(SimpleDataSourceStreamReader):
    """Heights as they become final, a bounded number a batch."""

    def __init__(self, options: dict):
        self.options = dict(options)

    def initialOffset(self) -> dict:
        return {"next": int(self.options.get("start", 0))}

    def read(self, start: dict):
        nodes, o = _nodes(self.options), self.options
        end = min(nodes.call("getblockcount") - int(o.get("confirmations", 5)) + 1, start["next"] + int(o.get("blocks_per_partition", 100)))
        return iter([nodes.block(h) for h in range(start["next"], end)]), {"next": max(end, start["next"])}

    def readBetweenOffsets(self, start: dict, end: dict):
        nodes = _nodes(self.options)
        return iter([nodes.block(h) for h in range(start["next"], end["next"])])


class NodeBlocks(DataSource):
    @classmethod
    def name(cls) -> str:
        return "node_blocks"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return _Stream(self.options)


class _Events(SimpleDataSourceStreamReader):
    """What turns the chain seen so far into the present one. The offset holds the top of that chain, so that a batch can be
    repeated from its two offsets alone."""

    def __init__(self, options: dict):
        self.options = dict(options)
        self.deepest = int(options.get("deepest", 10))

    def initialOffset(self) -> dict:
        return {"chain": []}

    def read(self, start: dict):
        nodes, known = _nodes(self.options), {h: x for h, x in start["chain"]}
        first = max(known) + 1 if known else int(self.options.get("start", 0))
        tip = nodes.call("getblockcount")
        chain = dict(known)
        # Down from the top of what is known to the last block that is still there.
        for height in sorted(known, reverse=True):
            if height <= tip and nodes.hash(height) == known[height]:
                break
            del chain[height]
        if known and not chain and min(known) > int(self.options.get("start", 0)):
            raise ValueError(f"reorganisation deeper than {len(known)} blocks")
        for height in range(max(chain) + 1 if chain else min(first, min(known, default=first)), min(tip, first + self.deepest - 1) + 1):
            chain[height] = nodes.hash(height)
        top = [[h, chain[h]] for h in sorted(chain)[-2 * self.deepest :]]
        return iter(_difference(start["chain"], top)), {"chain": top}

    def readBetweenOffsets(self, start: dict, end: dict):
        return iter(_difference(start["chain"], end["chain"]))


def _difference(before: list, after: list) -> list[tuple]:
    """(type, hash, height): deletes from the top down, then adds upwards. Both lists are tops of chains; what lies below the
    lower end of the later one has stayed."""
    old, new, low = {tuple(x) for x in before}, {tuple(x) for x in after}, min((h for h, _ in after), default=0)
    gone = sorted((x for x in old - new if x[0] >= low), reverse=True)
    return [("delete", x, h) for h, x in gone] + [("add", x, h) for h, x in sorted(new - old)]


class NodeEvents(DataSource):
    """Format "node_events": rows (type, hash, height) of added and lost blocks. Options as for node_blocks, and deepest: the
    deepest reorganisation that is followed, and the most new blocks of a batch (default 10)."""

    @classmethod
    def name(cls) -> str:
        return "node_events"

    def schema(self) -> str:
        return "type string, hash string, height int"

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return _Events(self.options)


class _Part(InputPartition):
    def __init__(self, txids: list[str]):
        self.txids = txids


class _PoolReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = dict(options)

    def partitions(self) -> list[_Part]:
        ids, step = _nodes(self.options).pool(), int(self.options.get("transactions_per_partition", 1000))
        return [_Part(ids[k : k + step]) for k in range(0, len(ids), step)]

    def read(self, part: _Part):
        nodes = _nodes(self.options)
        for txid in part.txids:
            if (t := nodes.transaction(txid)) is not None:
                yield txid, t


class NodePool(DataSource):
    """Format "node_pool": rows (txid, transaction as JSON) of the unconfirmed transactions that the node has now."""

    @classmethod
    def name(cls) -> str:
        return "node_pool"

    def schema(self) -> str:
        return "txid string, transaction string"

    def reader(self, schema) -> DataSourceReader:
        return _PoolReader(self.options)


def announced_transactions(txids: DataFrame, known: DataFrame, options: dict, tries: int = 100) -> DataFrame:
    """(txid, transaction) of announced txids(txid) that aren't known(txid) yet, fetched from a node with so many tries 0.1
    seconds apart; those the node doesn't have are left out."""
    def fetch(batches):
        nodes = _nodes(options)
        for b in batches:
            got = [(t, x) for t in b.column(0).to_pylist() if (x := nodes.transaction(t, tries)) is not None]
            yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in got], pa.string()), pa.array([x for _, x in got], pa.string())], ["txid", "transaction"])

    fresh = txids.select("txid").where("txid is not null").distinct().join(known.select("txid"), "txid", "left_anti")
    return fresh.mapInArrow(fetch, "txid string, transaction string")


def event_blocks(events: DataFrame, options: dict) -> DataFrame:
    """Events(type, hash, height) with the block of each added hash as JSON, null for lost ones."""
    def fetch(batches):
        nodes = _nodes(options)
        for b in batches:
            blocks = [json.dumps(nodes.call("getblock", h, 2)) if t == "add" else None for t, h in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(blocks, pa.string())], ["type", "hash", "height", "block"])

    return events.select("type", "hash", "height").mapInArrow(fetch, "type string, hash string, height int, block string")


def coin_changes(before: DataFrame, now: DataFrame) -> DataFrame:
    """(name, change): coins of available_coins rows whose endpoints are new, gone or changed, so that their streams are to be
    started, stopped or started again."""
    ends = lambda df, to: df.where("name is not null").groupBy("name").agg(F.max(F.concat_ws(" ", F.coalesce("rpc_urls", F.array()), F.coalesce("zmq_addresses", F.array()))).alias(to))
    both = ends(before, "old").join(ends(now, "new"), "name", "full")
    change = F.when(F.col("old").isNull(), "start").when(F.col("new").isNull(), "stop").when(F.col("old") != F.col("new"), "restart")
    return both.select("name", change.alias("change")).where("change is not null")


def parse_blocks(rows: DataFrame) -> DataFrame:
    """Block documents of (height, block) rows."""
    return rows.select(F.from_json("block", BLOCK).alias("b")).select("b.*")


def parse_announcements(frames: DataFrame) -> DataFrame:
    """(type, txid) of message frames(topic binary, body binary) of the topic hashtx."""
    return frames.where(F.col("topic").cast("string") == "hashtx").select(F.lit("hashtx").alias("type"), F.lower(F.hex("body")).alias("txid"))
