"""The core problem operators against brute force and on edge cases: nulls, ties, copies, empty tables, clashing names."""

import random
from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from chainloom.operators import changefeed, heavy_keys, hierarchy, orphans, rolling

LEDGER = "address string, timestamp timestamp, balance_change double, height int, tx_n int, day string, salt int, sats string, n_rows string"


def ledger(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "y", "z") for r in rows], LEDGER)


def at(day, second=0):
    return datetime(2012, 1, 1, tzinfo=UTC) + timedelta(days=day, seconds=second)


def brute_tree(links):
    parents = {n: p for n, p in links.items()}
    out = {}
    for n in parents:
        path, v = [n], parents[n]
        while v in parents and v not in path:
            path.append(v)
            v = parents[v]
        if v in parents:
            ring = path[path.index(v):]
            out[n] = (min(ring), -1, None)
        else:
            out[n] = (path[-1], len(path) - 1, path[::-1])
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_hierarchy_against_brute_force(spark, seed):
    r = random.Random(seed)
    names = [f"n{i:03d}" for i in range(90)]
    r.shuffle(names)
    links = {n: (names[max(0, i - r.choice([1, 1, 1, 5, 20]))] if i > 3 else None) for i, n in enumerate(names)}
    links |= {"star": None} | {f"leaf{i}": "star" for i in range(30)}
    links |= {"c1": "c2", "c2": "c3", "c3": "c1", "t1": "c2", "t2": "t1", "self": "self", "lost": "nowhere"}
    df = spark.createDataFrame([(n, p) for n, p in links.items()], "node string, parent string")
    tree = hierarchy.hierarchy(df)
    want = brute_tree(links)
    got = {x.node: x for x in tree.collect()}
    assert set(got) == set(links)
    below = {n: {m for m, (_, _, p) in want.items() if p and n in p and m != n} for n in links}
    for n, (root, depth, path) in want.items():
        assert (got[n].root, got[n].depth) == (root, depth), n
        if path:
            assert got[n].descendants == len(below[n])
            assert {m for m, g in got.items() if g.root == root and g.depth >= 0 and got[n].first < g.first <= got[n].last} == below[n]
            assert sum(s["last"] + 1 for s in got[n].path) == depth + 1
            assert len(got[n].path) <= 8
    asked = spark.createDataFrame([(n,) for n in list(links)[::9]], "node string")
    paths = {}
    for x in sorted(hierarchy.path_nodes(tree, asked).collect(), key=lambda x: x.step):
        paths.setdefault(x.node, []).append(x.ancestor)
    assert paths == {n: want[n][2] for n in list(links)[::9] if want[n][2]}
    got_below = {}
    for x in hierarchy.descendants_of(tree, asked).collect():
        got_below.setdefault(x.node, set()).add(x.descendant)
    assert got_below == {n: below[n] for n in list(links)[::9] if below[n]}


def test_hierarchy_copies_nulls_and_empty(spark):
    raw = spark.createDataFrame([("a", None, "1"), ("a", "b", "2"), ("b", None, "3"), (None, "b", "4"), ("a", "c", "5")], "node string, parent string, root string")
    links = hierarchy.parent_links(raw, F.col("node"), F.col("parent"))
    assert {x.node: x.parent for x in links.collect()} == {"a": "b", "b": None}
    assert hierarchy.hierarchy(links.limit(0)).count() == 0


def test_heavy_keys(spark):
    r = random.Random(5)
    data = [(r.choice(["hot"] * 6 + ["a", "b", " a\t", "VX1Q", "vx1q"]), at(r.randrange(3), i), r.choice([1.5, -2.25, 0.00000001, -1e-8, float("nan"), None]), i, r.choice([0, None])) for i in range(800)]
    data += data[:100] + [(None, at(0), 1.0, 1, 1), ("", at(0), 1.0, 1, 1), ("a", None, 1.0, 1, 1), ("big", at(0), 8.9e10, 1, 1), ("inf", at(0), float("inf"), 1, 1)]
    keys, want = {}, {}
    for a, t, v, h, n in data:
        a = (a or "").strip()
        a = a.lower() if a.lower().startswith("vx1") else a
        if a and t and v is not None and v == v and v != float("inf"):
            keys[a, t, h, n] = round(v * 1e8)
    for (a, t, _, _), v in keys.items():
        k = (a, t.strftime("%Y-%m-%d"))
        want[k] = (want.get(k, (0, 0))[0] + 1, want.get(k, (0, 0))[1] + v)
    got = {(x.address, x.day): (x.n_rows, x.sum_sats) for x in heavy_keys.address_day_sums(ledger(spark, data)).collect()}
    assert got == want
    total = {}
    for (_, d), (n, _) in want.items():
        total[d] = total.get(d, 0) + n
    cases = {(a, d) for (a, d), (n, s) in want.items() if n >= 5 and n * 25 >= total[d] and s < 0}
    assert {(x.address, x.day) for x in heavy_keys.heavy_losing_days(ledger(spark, data)).collect()} == cases
    assert heavy_keys.address_day_sums(ledger(spark, [])).count() == 0
    assert heavy_keys.heavy_losing_days(ledger(spark, [])).count() == 0


def test_large_sums_are_exact(spark):
    data = [("a", at(0, i), 21_000_000.00000001, i, 0) for i in range(50)]
    assert heavy_keys.address_day_sums(ledger(spark, data)).first().sum_sats == 50 * round(21_000_000.00000001 * 1e8)
    import numpy as np

    v = np.array([2**62 // 64 + 1, -(2**61) // 64 - 3, 7, -1] * 16, np.int64)
    assert heavy_keys._sums(np.zeros(64, np.int64), v, 1)[0] == v.sum()


def test_rolling_against_brute_force(spark):
    r = random.Random(9)
    data = [(r.choice("ab"), at(r.choice([0, 1, 3, 9, 50, 51, 120]), i), float(r.randrange(-50, 50)), i, 0) for i in range(60)] + [("a", at(200), 1.0, 0, 0)]
    data += data[:7]
    daily = {}
    for a, t, v, *_ in set(data):
        k = a, (t - at(0)).days
        daily[k] = (daily.get(k, (0, 0))[0] + round(v * 1e8), daily.get(k, (0, 0))[1] + 1)
    want = {}
    for a in "ab":
        days = sorted(d for x, d in daily if x == a)
        for d in range(days[0], max(days[-1] + 29, max(d for _, d in daily)) + 1):
            s = [(daily.get((a, e), (0, 0)), e) for e in range(d - 29, d + 1)]
            want[a, str(at(d).date())] = (sum(v for (v, _), e in s if e > d - 7), sum(v for (v, _), _ in s), sum(n for (_, n), e in s if e > d - 7), sum(n for (_, n), _ in s))
    out = rolling.with_averages(rolling.rolling_totals(ledger(spark, data))).collect()
    assert {(x.address, x.day): (x.total_short, x.total_long, x.rows_short, x.rows_long) for x in out} == want
    assert all(abs(x.average_short * 7 - x.total_short) < 1e-3 and abs(x.average_long * 30 - x.total_long) < 1e-3 for x in out)
    assert rolling.rolling_totals(ledger(spark, [])).count() == 0
    last = rolling.rolling_totals(ledger(spark, [("z", at(0), 1.0, 1, 1)]), last_day=15340 + 100)
    assert last.count() == 101


EVENT = "event_seq bigint, type string, hash string, height int, seq string, n_events string"


def feed(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], EVENT)


def test_change_feed_against_replay(spark):
    r = random.Random(3)
    events = [(i, r.choice(["add", "ADD ", "delete", "heartbeat", None]), r.choice(["a", "0xA", "b", "c", None, ""]), r.choice([1, 2, 3, None])) for i in range(120)]
    live, seen = {}, {}
    for s, t, h, n in events:
        t, h = (t or "").strip().lower(), (h or "").lower().removeprefix("0x")
        if t in ("add", "delete") and h and n is not None:
            seen[n] = seen.get(n, 0) + 1
            if t == "add":
                live[n] = h
            elif live.get(n) == h:
                live[n] = ""
    sent = events + events[10:40]
    r.shuffle(sent)
    got = {x.height: (x.hash, x.n_events) for x in changefeed.current_state(feed(spark, sent)).collect()}
    assert got == {n: (live.get(n, ""), k) for n, k in seen.items()}
    assert changefeed.current_state(feed(spark, [])).count() == 0


def test_change_feed_ties_and_missing_sequence(spark):
    got = changefeed.current_state(feed(spark, [(None, "add", "z", 1), (5, "add", "b", 2), (5, "add", "a", 2)])).collect()
    assert {(x.height, x.hash) for x in got} == {(1, "z"), (2, "a")}


def test_batches_of_files(spark, tmp_path):
    t = changefeed.EqualityDeletes(spark, str(tmp_path / "t"))
    state = lambda: {x.height: (x.hash, x.n_events) for x in t.state().collect()}
    assert state() == {}
    t.append(feed(spark, [(5, "add", "b", 1), (9, "add", "c", 2), (9, "add", "c", 2)]), 0)
    assert state() == {1: ("b", 1), 2: ("c", 1)}
    before = {p: p.stat().st_mtime_ns for p in tmp_path.rglob("*.parquet")}
    t.append(feed(spark, [(4, "add", "a", 1), (9, "add", "c", 2), (10, "delete", "c", 2), (3, "delete", "b", 1)]), 1)  # late, repeated
    assert state() == {1: ("b", 3), 2: ("", 2)}
    assert before.items() <= {p: p.stat().st_mtime_ns for p in tmp_path.rglob("*.parquet")}.items()  # nothing was rewritten
    t.append(feed(spark, [(11, "add", "d", 2)]), 2)
    t.append(feed(spark, [(11, "add", "d", 2)]), 2)
    t.append(feed(spark, []), 3)
    assert state() == {1: ("b", 3), 2: ("d", 3)}


INPUT = "spending_txid string, spending_index int, txid string, vout int, coinbase string, n string, level string"
OUTPUT = "txid string, n int, id string, spending_txid string, spending_index int"


def test_direct_orphans(spark):
    ins = [("t1", 0, "gone", 0, None), ("0xT1", 0, "GONE", 0, None), ("t2", 0, "t1", 0, None), ("t3", 0, "t2", 0, None), ("t4", 0, "ok", 0, None), ("t5", 0, None, 0, None), ("t6", 0, "ok", None, None), ("t7", 0, "gone", 0, "03ff"), ("t8", 0, "t8", 0, None), (None, 1, "gone", 9, None)]
    outs = [("t1", 0), ("t2", 0), ("OK ", 0), ("t8", 0), (None, 0), ("t9", None)]
    i = spark.createDataFrame([(*x, "a", "b") for x in ins], INPUT)
    o = spark.createDataFrame([(*x, "q", None, None) for x in outs], OUTPUT)
    found = orphans.orphans(i, o).collect()
    assert {(x.spending_txid, x.spending_index) for x in found if x.direct} == {("t1", 0), ("t6", 0), (None, 1)}
    assert {x.spending_txid for x in found if x.inherited} == {"t2", "t3"} and len(found) == 5
    assert orphans.orphans(i.limit(0), o).count() == 0
    assert orphans.orphans(i, o.limit(0)).where("direct").count() == 7  # t1 once, t2, t3, t4, t6, t8 and the one without a txid


def test_keys_keep_every_spelling(spark):
    texts = ["ab", "0AB", "abc", "0abc", "zz", "a b", "00", "0x00", "", None, "ÿ", "ab" * 40]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(orphans.norm_hash(F.col("t")).alias("h"), orphans.short_key(F.col("t")).alias("k"))
    got = got.select("h", "k", orphans.key_text(F.col("k")).alias("back")).collect()
    assert all(r.h == r.back for r in got) and len({bytes(r.k) for r in got if r.k}) == len({r.h for r in got if r.h})


def test_orphan_flags(spark):
    ins = [("t1", 0, "gone", 0, None), ("t2", 0, "t1", 0, None), ("t2", 1, "t1", 7, None), ("t3", 0, "t2", 0, None), ("t4", 0, "ok", 0, None), ("T3 ", 0, "t2", 0, None)]
    i = spark.createDataFrame([(*x, "a", "b") for x in ins], INPUT)
    o = spark.createDataFrame([("t1", 0, "q", None, None), ("t2", 0, "q", None, None), ("ok", 0, "q", None, None)], OUTPUT)
    got = sorted((x.spending_txid, x.spending_index, x.direct, x.inherited) for x in orphans.orphans(i, o).collect())
    assert got == [("t1", 0, True, False), ("t2", 0, False, True), ("t2", 1, True, True), ("t3", 0, False, True)]
    assert orphans.orphans(i.limit(0), o).count() == 0


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_cascade_against_brute_force(spark, seed):
    r = random.Random(seed)
    edges = {(k, k + 1) for k in range(60)} | {(r.randrange(200), r.randrange(100, 260)) for _ in range(120)} | {(300, 301), (301, 302), (302, 300), (302, 303), (400, 400)}
    seeds = {0} if seed == 1 else {r.randrange(150) for _ in range(4)}
    bad, fresh = set(seeds), set(seeds)
    while fresh:
        fresh = {b for a, b in edges if a in fresh} - bad
        bad |= fresh
    e = spark.createDataFrame([*edges, *list(edges)[:20]], "up bigint, down bigint")
    s = spark.createDataFrame([(x,) for x in [*seeds, *seeds]], "id bigint")
    got = [x.id for x in orphans.cascade(e, s).collect()]
    assert sorted(got) == sorted(bad)
    assert orphans.cascade(e, s.limit(0)).count() == 0 and orphans.cascade(e.limit(0), s).count() == len(seeds)


def test_report_of_small_tables(spark):
    i = spark.createDataFrame([("a1", 0, "nowhere", 0, None, "", ""), ("a2", 0, "a1", 0, None, "", ""), ("a3", 0, None, None, "03", "", ""), ("a4", 0, "a3", 0, None, "", "")], INPUT)
    o = spark.createDataFrame([("a1", 0, "", "a2", 0), ("a2", 0, "", "a9", 0), ("a3", 0, "", "a4", 0), ("a4", 0, "", None, None)], OUTPUT)
    t = spark.createDataFrame([(1, 1, "a1"), (1, 2, "a2"), (2, 0, "a3"), (7, 0, "a4")], "height int, tx_n int, txid string")
    b = spark.createDataFrame([("b0", None, 0, 1), ("b1", "b0", 1, 1), ("b2", "b1", 2, 1), ("c8", "gone", 8, 1), ("c9", "c8", 9, 1), ("d", "d", None, None)], "hash string, previousblockhash string, height int, time bigint")
    got = {(x.tbl, x.refers_to, x.period): (x.refs, x.direct, x.inherited) for x in orphans.report(i, o, t, b).collect()}
    m = "1970-01"
    assert got == {
        ("transaction_input", "transaction_output", m): (2, 1, 1), ("transaction_input", "transaction_output", None): (1, 0, 0),
        ("transaction_input", "confirmed_transaction", m): (3, 0, 2), ("transaction_input", "confirmed_transaction", None): (1, 0, 1),
        ("transaction_output", "transaction_input", m): (3, 1, 2), ("transaction_output", "confirmed_transaction", m): (3, 0, 2), ("transaction_output", "confirmed_transaction", None): (1, 0, 1),
        ("confirmed_transaction", "block", m): (3, 0, 0), ("confirmed_transaction", "block", None): (1, 1, 0),
        ("block", "block", m): (4, 1, 1), ("block", "block", None): (1, 0, 0),
    }
    assert orphans.report(*(x.limit(0) for x in (i, o, t, b))).count() == 0
