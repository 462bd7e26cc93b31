"""Hand-made edge cases of the ledger operators."""

import json
import math
import os
import threading
from datetime import UTC, date, datetime, timedelta
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

from chainloom.functions.normalise import bin_of, java_hash, norm_address, norm_hash, sats
from chainloom.operators import api, balances as B, chain as C, clusters as K, overlay as V, serving
from chainloom.plans.paging import page
from chainloom.plans.shared import shared_dir
from chainloom.sources import node
from chainloom.sources.blocks import BLOCK, final_blocks, headers, read_blocks, stream_blocks
from chainloom.streaming.ingest import LedgerStore

DAY = 1_325_376_000


def out(n, value, *addresses):
    return {"n": n, "value": value, "scriptPubKey": {"asm": "", "hex": "", "addresses": list(addresses) or None}}


def vin(txid=None, vout=None):
    return {"txid": txid, "vout": vout, "coinbase": None if txid else "03", "sequence": 1}


def tx(txid, ins, outs):
    return {"txid": txid, "size": 1, "version": 1, "locktime": 0, "vin": ins, "vout": outs, "unknown": 1}


def block(height, time, *txs):
    return {"hash": f"h{height}", "height": height, "time": time, "previousblockhash": f"h{height - 1}", "tx": list(txs), "extra": {"a": 1}}


BLOCKS = [
    block(0, DAY, tx("c0", [vin()], [out(0, 150, "A")])),
    block(1, DAY, tx("c1", [vin()], [out(0, 50, "M"), out(1, 1), out(2, 2, "X", "Y")]), tx("t1", [vin("c0", 0)], [out(0, 60, "B"), out(1, 89.5, "A")]), tx("t2", [vin("t1", 0)], [out(0, 60, "B")])),
    block(2, DAY - 100, tx("c1", [vin()], [out(0, 51, "M")]), tx("t3", [vin("t1", 1), vin("t2", 0)], [out(0, 70, "C"), out(1, 70, "D")])),
    block(3, DAY + 90_000, tx("c3", [vin()], [out(0, 1, "M")]), tx("t4", [vin("c1", 0), vin("nowhere", 3)], [out(0, 50, "E")])),
]


@pytest.fixture(scope="module")
def blocks(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("blocks")
    for b in BLOCKS:
        f = d / f"{b['height']}.json"
        f.write_text(json.dumps(b) + "\n")
        os.utime(f, (DAY + b["height"] * 60,) * 2)  # files come in the order of their times
    return str(d)


def test_normalise(spark):
    df = spark.createDataFrame([(" 0XAb\n", " VX1Qa\t", 0.1), ("", "  ", -2.5e-8), (None, "Ab ", float("nan")), ("0x", None, math.inf), ("zz", "b", 1e300)], "h string, a string, v double")
    got = [tuple(r) for r in df.select(norm_hash(F.col("h")), norm_address(F.col("a")), sats(F.col("v"))).collect()]
    assert got == [("ab", "vx1qa", 10_000_000), (None, None, -2), (None, "Ab", None), (None, None, None), ("zz", "b", None)]


def test_string_hash(spark):
    def by_rule(s):
        h = 0
        for ch in s:
            h = (h * 31 + ord(ch)) & 0xFFFFFFFF
        return h - (1 << 32) if h >= 1 << 31 else h

    words = ["", "a", "polygenelubricants", "1BoatSLRHtKNngkdXEeobR76b53LETtpyT"]
    got = spark.createDataFrame([(w,) for w in words], "w string").select(java_hash(F.col("w")), bin_of(F.col("w"), 100)).collect()
    assert [tuple(r) for r in got] == [(by_rule(w), abs(by_rule(w)) % 100) for w in words]


def test_times_strictly_increase(spark, blocks):
    t = {x.height: x.time_ms for x in C.block_times(read_blocks(spark, blocks)).collect()}
    assert t == {0: DAY * 1000, 1: DAY * 1000 + 1, 2: DAY * 1000 + 2, 3: (DAY + 90_000) * 1000}


def test_times_across_spans(spark):
    import random

    r = random.Random(4)
    raw = [(h * 3, r.randrange(10_000)) for h in range(9000)]
    got = {x.height: x.time_ms for x in C.block_times(spark.createDataFrame(raw, "height int, time bigint")).collect()}
    last = 0
    for h, s in raw:
        last = s * 1000 if s * 1000 > last else last + 1
        assert got[h] == last


def test_inputs_fees_and_deltas(spark, blocks):
    c = C.flatten(read_blocks(spark, blocks))
    spent = {(x.spending_txid, x.spending_index): (x.value_sats, x.addresses) for x in C.spent_outputs(c).collect()}
    assert spent["t2", 0] == (6_000_000_000, ["B"])  # of the same block
    assert spent["t4", 0] == (5_100_000_000, ["M"])  # the later of two outputs of one name
    assert spent["t4", 1] == (None, None)
    fees = {}
    for x in C.fees(c).collect():
        fees.setdefault(x.txid, set()).add(x.fee_sats)
    assert fees["c0"] == {0} and fees["t1"] == {50_000_000} and fees["t4"] == {None}
    deltas = {(x.txid, x.address): x.delta_sats for x in C.address_deltas(c).collect() if x.txid[0] == "t"}
    assert deltas["t2", "B"] == 0 and deltas["t1", "A"] == 8_950_000_000 - 15_000_000_000
    m = {x.height: x.delta_sats for x in C.address_deltas(c).collect() if x.address == "M"}
    assert (m[1], m[2]) == (5_000_000_000, 5_100_000_000)  # both blocks name their transaction c1
    assert not [x for x in C.address_deltas(c).collect() if x.address in ("X", "Y")]
    first = {x.address for x in C.address_deltas(c, C.first_address).collect()}
    assert "X" in first and "Y" not in first


def test_headers_and_finality(spark, blocks):
    h = {x.height: x.tx_count for x in headers(read_blocks(spark, blocks)).collect()}
    assert h == {0: 1, 1: 3, 2: 2, 3: 2}
    assert {x.height for x in final_blocks(read_blocks(spark, blocks), 2).collect()} == {0, 1}


def deltas(spark, *rows):
    return spark.createDataFrame([(a, datetime.fromtimestamp(DAY, UTC) + timedelta(days=d, hours=h), int(v * 1e8)) for a, d, h, v in rows], "address string, ts timestamp, delta_sats bigint")


def test_candles_and_rich_list(spark):
    d = deltas(spark, ("a", 0, 1, 100), ("a", 0, 2, 50), ("a", 0, 3, -20), ("b", 0, 4, 100), ("c", 0, 4, 100.00000001), ("a", 4, 1, -120), ("z", 6, 1, 1))
    k = {(x.address, x.day): (x.open, x.high, x.low, x.close) for x in B.candles(d).collect()}
    assert k["a", date(2012, 1, 1)] == (0, 150 * 10**8, 0, 130 * 10**8)
    assert ("z", date(2012, 1, 7)) not in k
    rich = sorted((x.address, x.day.day, x.balance_sats, x.change_sats) for x in B.rich_list(d).collect())
    assert [r[:2] for r in rich if r[0] == "a"] == [("a", n) for n in (1, 2, 3, 4)]
    assert [r[3] for r in rich if r[0] == "a"] == [130 * 10**8, 0, 0, 0]
    assert not [r for r in rich if r[0] == "b"] and len([r for r in rich if r[0] == "c"]) == 6
    assert {(x.address, x.day.day) for x in B.losers(B.candles(d)).collect()} == {("a", 5)}
    asked = spark.createDataFrame([("a", datetime(2012, 1, 1, 2, tzinfo=UTC)), ("a", datetime(2011, 1, 1, tzinfo=UTC))], "address string, ts timestamp")
    assert sorted((x.balance_sats or -1) for x in B.balance_before(asked, B.running_balances(d)).collect()) == [-1, 100 * 10**8]


def test_clusters(spark):
    def chain(txs):
        t = spark.createDataFrame([(n, i, 1, datetime(2012, 1, 1, tzinfo=UTC), False) for i, n in enumerate(txs)], "txid string, height int, tx_n int, ts timestamp, is_coinbase boolean")
        src = [(f"src-{a}", 0, 5, [a]) for x in txs.values() for a in x[0]]
        outs = src + [(n, i, v, [a]) for n, x in txs.items() for i, (a, v) in enumerate(x[1])]
        ins = [(n, i, f"src-{a}", 0) for n, x in txs.items() for i, a in enumerate(x[0])]
        return C.Chain(t, spark.createDataFrame(outs, "txid string, n int, value_sats bigint, addresses array<string>").distinct(), spark.createDataFrame(ins, "spending_txid string, spending_index int, txid string, n int"))

    c = chain({"m": (["A", "B"], [("C", 3), ("D", 3)]), "n": (["E", "F"], [("G", 3), ("G", 3)]), "o": (["F", "H"], [("I", 1)]), "p": (["H", "J"], [("I", 2)])})
    assert [x.txid for x in K.mixing_transactions(c).collect()] == ["m"]
    ids = {x.address: x.cluster_id for x in K.cluster_addresses(c).collect()}
    assert ids == {"A": "A", "B": "B", "C": "C", "D": "D", "E": "E", "F": "E", "G": "G", "H": "E", "J": "E", "I": "I"}
    old = spark.createDataFrame(list(ids.items()), "address string, cluster_id string")
    new = spark.createDataFrame([("J", "A"), ("Q", "R")], "a string, b string")
    got = {x.address: x.cluster_id for x in K.merge_clusters(old, new).collect()}
    assert got == ids | dict.fromkeys("AEFHJ", "A") | {"Q": "Q", "R": "Q"}


def test_components_of_a_long_path(spark):
    e = spark.createDataFrame([(f"{i:03d}", f"{i + 1:03d}") for i in range(150)], "a string, b string")
    nodes = spark.createDataFrame([(f"{i:03d}",) for i in range(160)], "address string")
    ids = {x.address: x.cluster_id for x in K.components(nodes, e).collect()}
    assert all(ids[f"{i:03d}"] == ("000" if i <= 150 else f"{i:03d}") for i in range(160))


def test_pages(spark):
    df = spark.createDataFrame([(i // 4, f"k{i % 4}", i) for i in range(30)], "a int, b string, has_more int")
    df = df.drop("has_more")
    order, seen, cursor = [("a", False), ("b", True)], [], None
    while True:
        got = page(df, order, 7, cursor).collect()
        seen += [(x.a, x.b) for x in got]
        if not got[0].has_more:
            break
        cursor = {"a": got[-1].a, "b": got[-1].b}
    assert seen == sorted([(i // 4, f"k{i % 4}") for i in range(30)], key=lambda x: (-x[0], x[1]))
    assert page(df, order, 1).count() == 1 and page(df, order, 1000).count() == 30
    for bad in (0, 1001):
        with pytest.raises(ValueError):
            page(df, order, bad)
    assert page(df.limit(0), order, 5).count() == 0


def test_overlay_and_pool(spark):
    i = spark.createDataFrame([("x", 1, "o", 0), ("y", 2, "o", 0), ("z", 1, "p", 0), ("z", 1, "p", 1)], "spending_txid string, arrived int, txid string, n int")
    assert [r.spending_txid for r in V.double_spent(i).collect()] == ["x"]
    pool = spark.createDataFrame([("x", 5), ("y", 6), ("z", 7)], "txid string, fee_sats bigint")
    left = V.unconfirmed(pool, spark.createDataFrame([("z",)], "txid string"), i)
    assert [r.txid for r in left.collect()] == ["y"]
    assert tuple(V.pool_totals(left).first()) == (6, 1) and tuple(V.pool_totals(left.limit(0)).first()) == (0, 0)
    hot = spark.createDataFrame([("o", 0, "H", 1)], "txid string, n int, address string, value_sats bigint")
    cold = spark.createDataFrame([("o", 0, "C", 2), ("p", 0, "C", 3)], "txid string, n int, address string, value_sats bigint")
    got = {(r.txid, r.n): (r.address, r.value_sats) for r in V.input_details(i.select("txid", "n").distinct(), hot, cold).collect()}
    assert got == {("o", 0): ("H", 1), ("p", 0): ("C", 3), ("p", 1): (None, None)}


def test_reorganisation(spark):
    known = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "height int, hash string")
    now = spark.createDataFrame([(1, "a"), (2, "x"), (3, "y"), (4, "z")], "height int, hash string")
    events = V.chain_events(known, now).collect()
    assert [(e.type, e.hash) for e in events] == [("delete", "c"), ("delete", "b"), ("add", "x"), ("add", "y"), ("add", "z")]
    with pytest.raises(ValueError):
        V.chain_events(known, now, deepest=1)
    old, new = V.split_hot(now, 2)
    assert {r.height for r in old.collect()} == {3, 4} and {r.height for r in new.collect()} == {1, 2}


def test_coins(spark):
    c = spark.createDataFrame([("Bitcoin ", 0, "BTC", "k"), (None, 1, "X", "k"), ("Dash", 5, "DASH", "d")], "name string, bip44_index int, bip44_symbol string, key_space string")
    assert {x.name for x in api.coins(c).collect()} == {"Bitcoin", "Dash"} and api.coins(c, "Dash").first().bip44_index == 5


def test_stream_equals_batch(spark, blocks, tmp_path):
    store = LedgerStore(spark, str(tmp_path / "store"))
    q = store.start(stream_blocks(spark, blocks, 1), str(tmp_path / "checkpoint"), once=True)
    q.awaitTermination()
    c = C.flatten(read_blocks(spark, blocks))
    want = C.address_deltas(C.Chain(c.tx, c.txo, c.txi))
    got = store.read("address_delta", want.select("txid", "address", "delta_sats", "height", "tx_n", "ts").schema)
    key = lambda df: sorted((x.txid, x.address, x.delta_sats) for x in df.where("txid like 't%'").collect())
    assert key(got) == key(want)
    times = {x.height: x.ts for x in store.read("tx", c.tx.schema).collect()}
    assert times == {x.height: x.ts for x in c.tx.collect()}
    again = sorted(key(got))
    store.write(read_blocks(spark, f"{blocks}/3.json"), 3)
    assert key(store.read("address_delta", got.schema)) == again


def test_lost_blocks_are_retracted(spark, blocks, tmp_path):
    store, docs = LedgerStore(spark, str(tmp_path / "store")), read_blocks(spark, blocks)
    event = lambda *rows: spark.createDataFrame(list(rows), "type string, hash string, height int")
    store.apply(event(*(("add", f"h{k}", k) for k in range(4))), docs, 0)
    other = docs.where("height = 3").withColumns({"hash": F.lit("x3"), "tx": F.expr("slice(tx, 1, 1)")})
    for _ in range(2):
        store.apply(event(("delete", "h3", 3), ("add", "x3", 3), ("add", "gone", 9)), other, 1)
    store.apply(event(), docs.limit(0), 2)
    got = {(x.txid, x.height) for x in store.read("tx", C.flatten(docs).tx.schema).collect()}
    assert got == {(t["txid"], b["height"]) for b in BLOCKS for t in b["tx"]} - {("t4", 3)}
    assert not [x for x in store.read("address_delta", C.address_deltas(C.flatten(docs)).schema).collect() if x.txid == "t4"]
    assert store.last_time(3) == store.last_time(2)  # over an empty batch


def test_compacted_outputs_and_clusters_of_the_stream(spark, blocks, tmp_path):
    plain, kept = LedgerStore(spark, str(tmp_path / "a"), clusters=True), LedgerStore(spark, str(tmp_path / "b"), clusters=True)
    docs = read_blocks(spark, blocks)
    c = C.flatten(docs)
    for k in range(4):
        for s in (plain, kept):
            s.write(docs.where(F.col("height") == k), k)
        if k in (1, 2):
            kept.compact(k, c.txo.schema)
    left = {(x.txid, x.n) for x in kept.spendable(c.txo.schema).collect()}
    assert left == {("c1", 0), ("c1", 1), ("c1", 2), ("t3", 0), ("t3", 1), ("c3", 0), ("t4", 0)}
    key = lambda s: sorted((x.spending_txid, x.spending_index, x.value_sats) for x in s.read("spent", C.spent_outputs(c).schema).collect())
    assert key(plain) == key(kept) and len(key(kept)) == 6
    want = {x.address: x.cluster_id for x in K.cluster_addresses(c).collect()}
    assert {x.address: x.cluster_id for x in kept.wallets().collect()} == want
    nothing = LedgerStore(spark, str(tmp_path / "none"), sinks=False)
    nothing.write(docs, 0)
    assert not (tmp_path / "none").exists()


def test_clusters_grow_with_the_stream(spark, tmp_path):
    from chainloom.streaming.ingest import POINTERS

    store = LedgerStore(spark, str(tmp_path), clusters=True)
    outs = lambda *rows: spark.createDataFrame([(t, 0, v, [a]) for t, a, v in rows], "txid string, n int, value_sats bigint, addresses array<string>")
    ins = lambda *rows: spark.createDataFrame([(t, 0, "p", 0, 1, [a]) for t, a in rows], "spending_txid string, spending_index int, txid string, n int, value_sats bigint, addresses array<string>")
    batches = [(outs(("m", "A", 1), ("n", "Z", 2)), ins(("q", "B"), ("q", "C"))), (outs(("o", "Z", 3)), ins(("r", "C"), ("r", "Z"), ("s", "D"), ("s", "E"))), (outs(("u", "F", 4)), ins(("v", "A"), ("v", "E"), ("w", "D"), ("w", "B"))), (outs(("u", "F", 4)).limit(0), ins(("w", "D")).limit(0))]
    for k, (o, i) in enumerate(batches):
        for _ in range(2):
            store._join_clusters(o, i, k)
    assert {x.address: x.cluster_id for x in store.wallets().collect()} == dict.fromkeys("ABCDEZ", "A") | {"F": "F"}
    assert store.read("pointers", POINTERS).count() > 0


class _Node(BaseHTTPRequestHandler):
    def do_POST(self):
        ask = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        by = {"getblockcount": lambda: 8, "getblockhash": lambda h: f"h{h}", "getblock": lambda h, v: BLOCKS[int(h[1:])],
              "getblockheader": lambda h: {"hash": h}, "getrawmempool": lambda verbose: ["p1", "p2", "gone"], "getrawtransaction": lambda t, v: {"txid": t} if t != "gone" else None}
        body = json.dumps({"result": by[ask["method"]](*ask["params"]), "error": None}).encode()
        self.send_response(200)
        self.end_headers()
        self.wfile.write(body)

    def log_message(self, *_):
        pass


def test_node_source(spark, tmp_path):
    server = HTTPServer(("127.0.0.1", 0), _Node)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    urls = f"http://127.0.0.1:1/ http://127.0.0.1:{server.server_port}/"
    spark.dataSource.register(node.NodeBlocks)
    df = spark.read.format("node_blocks").option("urls", urls).option("blocks_per_partition", 2).load()
    assert df.rdd.getNumPartitions() == 2
    got = node.parse_blocks(df)
    assert sorted(x.hash for x in got.collect()) == ["h0", "h1", "h2", "h3"]
    assert got.schema == spark.createDataFrame([], BLOCK).schema
    stream = spark.readStream.format("node_blocks").option("urls", urls).option("blocks_per_partition", 3).load()
    q = stream.writeStream.format("memory").queryName("node").option("checkpointLocation", str(tmp_path)).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(x.height for x in spark.table("node").collect()) == [0, 1, 2, 3]
    server.shutdown()
    frames = spark.createDataFrame([(b"hashtx", bytes([0xAB, 1])), (b"other", b"x")], "topic binary, body binary")
    assert [tuple(r) for r in node.parse_announcements(frames).collect()] == [("hashtx", "ab01")]


def test_node_events_and_pool(spark):
    chain = [f"a{k}" for k in range(12)]

    class Node(_Node):
        def do_POST(self):
            ask = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            known = {"getblockcount": lambda: len(chain) - 1, "getblockhash": lambda h: chain[h], "getblock": lambda h, v: {"hash": h}, "getrawmempool": lambda verbose: ["p1", "p2", "gone"], "getblockheader": lambda h: {"hash": h}}
            known["getrawtransaction"] = lambda t, v: {"txid": t}
            missing = ask["params"][:1] == ["gone"]
            body = json.dumps({"result": None if missing else known[ask["method"]](*ask["params"]), "error": "none" if missing else None}).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body)

    server = HTTPServer(("127.0.0.1", 0), Node)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    options = {"urls": f"http://127.0.0.1:{server.server_port}/", "deepest": "5"}
    source, at, seen = node._Events(options), {"chain": []}, []
    for _ in range(4):
        rows, end = source.read(at)
        assert list(source.readBetweenOffsets(at, end)) == (rows := list(rows))
        seen, at = seen + rows, end
    assert [x[1] for x in seen] == chain and {x[0] for x in seen} == {"add"}
    chain[9:] = ["b9", "b10"]
    rows, end = source.read(at)
    assert list(rows) == [("delete", "a11", 11), ("delete", "a10", 10), ("delete", "a9", 9), ("add", "b9", 9), ("add", "b10", 10)]
    assert list(source.read(end)[0]) == []
    chain[:] = [f"c{k}" for k in range(30)]
    with pytest.raises(ValueError):
        source.read(end)
    spark.dataSource.register(node.NodePool)
    spark.dataSource.register(node.NodeEvents)
    pool = spark.read.format("node_pool").options(**options).option("transactions_per_partition", 2).load()
    assert {x.txid: json.loads(x.transaction) for x in pool.collect()} == {"p1": {"txid": "p1"}, "p2": {"txid": "p2"}}
    asked = spark.createDataFrame([("p1",), ("p2",), ("p2",), (None,), ("gone",)], "txid string")
    got = node.announced_transactions(asked, spark.createDataFrame([("p1",)], "txid string"), options, tries=2)
    assert [x.txid for x in got.collect()] == ["p2"]
    events = spark.createDataFrame([("delete", "a1", 1), ("add", "b1", 1)], "type string, hash string, height int")
    assert {x.hash: x.block for x in node.event_blocks(events, options).collect()} == {"a1": None, "b1": '{"hash": "b1"}'}
    assert node._nodes(options).header("b1") == {"hash": "b1"}
    server.shutdown()


def test_coin_changes(spark):
    coins = lambda *rows: spark.createDataFrame(list(rows), "name string, rpc_urls array<string>, zmq_addresses array<string>")
    before, now = coins(("a", ["u"], ["z"]), ("b", ["u"], None), ("c", None, None), (None, ["x"], None)), coins(("a", ["u"], ["z"]), ("b", ["v"], None), ("d", ["u"], None))
    assert {x.name: x.change for x in node.coin_changes(before, now).collect()} == {"b": "restart", "c": "stop", "d": "start"}


def test_shared_folder(spark):
    assert shared_dir(spark) == shared_dir(spark)


def test_serving_tables(spark, blocks, tmp_path):
    t = serving.serving_tables(read_blocks(spark, blocks))
    assert set(t) == set(serving.LAYOUTS)
    serving.write_tables(t | serving.views(t), str(tmp_path))
    read = lambda name: spark.read.parquet(f"{tmp_path}/{name}")
    assert {x.hash: x.tx_count for x in read("block").collect()} == {"h0": 1, "h1": 3, "h2": 2, "h3": 2}
    fee = {x.txid: (x.height, x.fee_sats, x.input_count) for x in read("transaction").collect()}
    assert fee["t1"] == (1, 50_000_000, 1) and fee["c1"] == (2, 0, 1) and fee["t4"] == (3, None, 2)
    spent = {(x.txid, x.n): x.spending_txid for x in read("transaction_output").collect()}
    assert spent["t1", 0] == "t2" and spent["t3", 0] is None
    assert read("transaction_input").where("coinbase is not null").count() == 3
    balance = {}
    for x in sorted(read("address_balance").collect(), key=lambda x: x.timestamp):
        balance[x.address] = x.balance_sats
    assert balance["A"] == 0 and balance["C"] == 7_000_000_000 and balance["B"] == 0
    clusters = {x.address: x.cluster_id for x in read("cluster_address").collect()}
    assert (clusters["A"], clusters["B"], clusters["X"]) == ("A", "B", "X")  # t3 pays one amount to two addresses
    total = read("cluster_transaction").agg(F.sum("change_sats")).first()[0]
    assert total == read("cluster_details").agg(F.sum("balance_sats")).first()[0]
    assert read("cluster_richlist").where("balance_sats <= 0").count() == 0
    assert read("daily_top_gainers").where("change_sats <= 0").count() == 0
