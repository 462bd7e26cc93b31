"""The operators of chainloom.llm against brute force and on edge cases."""

import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from chainloom.llm import consolidate, leaks, mixing, queries, stuffing, topn
from chainloom.llm.words import words
from tests.oracle import DATA, same

WITH_SQL = [(n, f, queries.SQL[n]) for n, f in queries.QUERIES.items() if n in queries.SQL]


@pytest.mark.parametrize("name,query,sql", WITH_SQL, ids=[x[0] for x in WITH_SQL])
def test_against_sql(spark, name, query, sql):
    same(spark, name, query, sql)


def test_top_n(spark):
    r = random.Random(2)
    data = [(r.choice(["hot"] * 20 + ["cold", None]), f"i{r.randrange(400)}", r.choice([1.0, 2.0, float(r.randrange(50)), float("nan"), float("inf"), None])) for _ in range(3000)]
    data += [("few", "b", 1.0), ("few", "a", 1.0), ("few", "a", 0.5), ("few", None, 9.0)]
    best = defaultdict(dict)
    for g, i, s in data:
        if g and i and s is not None and s == s and abs(s) != float("inf"):
            best[g][i] = max(s, best[g].get(i, s))
    want = {(g, k + 1, i, s) for g, v in best.items() for k, (i, s) in enumerate(sorted(v.items(), key=lambda x: (-x[1], x[0]))[:10])}
    df = spark.createDataFrame([(*x, 1, "x") for x in data], "g string, i string, s double, rnk int, grp string")
    got = topn.top_n(df, F.col("g"), F.col("s"), F.col("i"))
    assert {tuple(x) for x in got.collect()} == want
    assert topn.top_n(df.limit(0), F.col("g"), F.col("s"), F.col("i")).count() == 0


def groups(pairs):
    up = {}

    def find(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        if a is not None and b is not None and a != b:
            x, y = find(a), find(b)
            up[max(x, y)] = min(x, y)
    return {x: find(x) for x in up}


@pytest.mark.parametrize("seed", [1, 2])
def test_consolidation(spark, seed):
    r = random.Random(seed)
    path = [f"p{i:03d}" for i in range(200)]
    r.shuffle(path)
    pairs = list(zip(path, path[1:])) + [(f"s{i}", "star") for i in range(100)] + [(f"r{r.randrange(80)}", f"r{r.randrange(80)}") for _ in range(70)]
    pairs += pairs[:20] + [(b, a) for a, b in pairs[:20]] + [("alone", None), (None, "alone"), ("me", "me")]
    r.shuffle(pairs)
    df = spark.createDataFrame([(*x, "z") for x in pairs], "a string, b string, label string")
    assert {x.node: x.group_id for x in consolidate.consolidate(df, F.col("a"), F.col("b")).collect()} == groups(pairs)
    assert consolidate.consolidate(df, F.col("a"), F.col("b")).count() == len(groups(pairs))


def test_consolidation_of_nothing(spark):
    df = spark.createDataFrame([("a", "a"), (None, "b")], "a string, b string")
    assert consolidate.consolidate(df, F.col("a"), F.col("b")).count() == 0
    assert consolidate.consolidate(df.limit(0), F.col("a"), F.col("b")).count() == 0


def test_words():
    assert words("Ａb-\nc <i>d</i>e​f _g-h\n­1.5") == ["abc", "d", "ef", "g", "h", "1", "5"]
    assert words(None) == words("") == words(" \n") == []


def test_simhash_and_blocks_find_all_near_fingerprints():
    r = np.random.default_rng(1)
    f = r.integers(0, 2**63, 500, dtype=np.uint64)
    for n in (1, 2, 5, 11):
        bits = (f[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)
        want = [(bits[i : i + n].sum(axis=0) > n // 2) for i in range(len(f) - n + 1)]
        got = leaks.simhash(f, n)
        assert all(((int(g) >> b) & 1) == w[b] for g, w in zip(got[::37], want[::37]) for b in range(64))
    for radius in (0, 2, 5, 14):
        x = leaks.Blocks(r.integers(0, 2**63, 90, dtype=np.uint64), radius)
        flipped = [x.prints ^ np.uint64(sum(1 << int(b) for b in r.choice(64, k, replace=False))) for k in (0, 1, radius, radius + 1)]
        prints = np.concatenate([*flipped, r.integers(0, 2**63, 300, dtype=np.uint64)])
        p, w = x.near(prints)
        near = np.bitwise_count(prints[:, None] ^ x.prints[None, :]) <= radius
        assert set(zip(p.tolist(), w.tolist())) == set(zip(*(v.tolist() for v in np.nonzero(near)))) and len(p) >= 180


def changed(r, w):
    """Words with some of them replaced, left out or put in, mostly at the ends."""
    w = list(w)
    for _ in range(r.choice([1, 1, 2, 3])):
        at = r.choice([0, 1, len(w) - 1, len(w) - 2, r.randrange(len(w))])
        w[at : at + r.choice([0, 1, 1])] = [f"new{r.randrange(99)}"] * r.choice([0, 1, 1])
    return w


def test_recall_of_the_fingerprints():
    """Of all windows of similarity 0.8 or more by brute force, at least 0.9 have fingerprints within the radius."""
    from collections import Counter

    r = random.Random(3)
    items = [(i, [f"w{r.randrange(400)}" for _ in range(r.randrange(50, 130))]) for i in range(40)]
    x = leaks.Index(items, 12, 0.8)
    assert [w.size for w in x.sizes] == [12, 24, 48, 96]
    texts = [["pad"] * 3 + changed(r, w) + ["pad"] * 3 for _ in range(12) for _, w in items]
    e = leaks.Encoded(texts)
    f = leaks.shingles(e)
    hits = np.concatenate([[0], np.cumsum(x.bits[(f & np.uint64(len(x.bits) - 1)).astype(np.int64)])])
    five = lambda w: [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
    flat = [w for _, ws in items for w in ws]
    for w in x.sizes:
        got = set(zip(*(v.tolist() for v in leaks.alike(e, f, hits, w, x, 0.8)[1:3])))
        bags, where = [Counter(five(flat[a : a + w.size])) for a in w.at.tolist()], defaultdict(list)
        for k, b in enumerate(bags):
            for s in b:
                where[s].append(k)
        want, n = set(), w.size - 4
        for d, t in enumerate(texts):
            s = five(t)
            for p in range(len(t) - w.size + 1):
                mine = Counter(s[p : p + n])
                for k in {k for g in mine for k in where.get(g, ())}:
                    same = (mine & bags[k]).total()
                    if same / (2 * n - same) >= 0.8:
                        want.add((int(e.offsets[d]) + p, k))
        assert got <= want and len(want) > 100
        equal = {(p, k) for p, k in want if w.size == 12}
        assert equal <= got
        assert len(got) >= 0.9 * len(want), (w.size, len(got) / len(want))
        print(w.size, len(got) / len(want), len(want))


def test_weighted_similarity():
    a, b = np.array([[1, 1, 2, 3], [1, 2, 3, 4]], np.uint64), np.array([[1, 2, 2, 3], [4, 3, 2, 1]], np.uint64)
    assert leaks.similarity(a, b).tolist() == [3 / 5, 1.0]


def test_leaks_against_brute_force(spark):
    r = random.Random(7)
    vocabulary = [f"word{i}" for i in range(30)]
    text = lambda n: [r.choice(vocabulary) for _ in range(n)]
    items = [(i, " ".join(text(25)), " ".join(text(8))) for i in range(12)] + [(50, "too short", None), (51, None, None), (None, "x", "y"), (60, *(t := (" ".join(text(20)), "why"))), (61, *t)]
    docs = []
    for k in range(150):
        body = text(60)
        if k % 3 == 0:
            source = words(items[k % 12][1]) + words(items[k % 12][2])
            at, n = r.randrange(10), r.randrange(10, 16)
            body[20 : 20 + n] = source[at : at + n]
        sep = r.choice([" ", "\n", " <b>, ", "​ "])
        docs.append((k, sep.join(w.upper() if r.random() < 0.3 else w for w in body), "q"))
    docs += [(900, None, "q"), (901, "", "q"), (902, t[0] + " " + t[1], "q"), (903, " ".join(text(20_000)), "q")]
    runs = defaultdict(set)
    for i, p, q in items:
        w = words(p) + words(q)
        for k in range(len(w) - 11):
            if i is not None:
                runs[tuple(w[k : k + 12])].add(i)
    want = {(d, i) for d, t, _ in docs for w in [words(t)] for k in range(len(w) - 11) for i in runs.get(tuple(w[k : k + 12]), ())}
    df, it = spark.createDataFrame(docs, "doc_id bigint, text string, item_id string"), spark.createDataFrame(items, "item_id bigint, passage string, question string")
    assert {(x.doc_id, x.item_id) for x in leaks.leaked_passages(df, it).collect()} == want and len(want) > 10
    whole = leaks.leaks(df, it).where("doc_id = 902 and item_id = 60 and size = 12").first()
    assert (whole.run_words, whole.windows, whole.similarity) == (21, 10, 1.0)
    assert leaks.leaked_passages(df.limit(0), it).count() == 0 and leaks.leaked_passages(df, it.limit(0)).count() == 0


def test_leaks_in_passes(spark, monkeypatch):
    df, it = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/eval_item.parquet")
    key = lambda f: sorted((x.doc_id, x.item_id) for x in f.collect())
    one = key(leaks.leaked_passages(df, it))
    monkeypatch.setattr(leaks, "CHARS_A_PASS", 60_000)
    assert key(leaks.leaked_passages(df, it)) == one and one


DOCS = "doc_id bigint, text string, source string, tokens string, copy string"


def test_mix_meets_weights_and_caps(spark):
    r = random.Random(1)
    docs = [(i, "word " * r.randrange(1, 60), r.choice(["big"] * 8 + [" BIG", "small", "Small"]), "x", "y") for i in range(1500)]
    docs += [(5000, None, "big", "x", "y"), (5001, "", "big", "x", "y"), (5002, "a", None, "x", "y"), (5003, "a", "other", "x", "y")]
    df = spark.createDataFrame(docs, DOCS)
    targets = spark.createDataFrame([("big", 50.0, 1), ("Small", 40.0, 3), ("none", 10.0, 5), (None, 1.0, 1), ("bad", float("nan"), 1), ("zero", 0.0, 1)], "source string, weight double, max_repeats int")
    m = mixing.mix(df, targets)
    rows = m.collect()
    got = {x.source: x for x in mixing.shares(m, targets).collect()}
    assert abs(got["big"].share - 100 * 5 / 9) < 1 and abs(got["small"].share - 100 * 4 / 9) < 1
    assert got["none"].share == 0 and got["none"].target_share == 10.0
    uses = defaultdict(int)
    for x in rows:
        uses[x.doc_id, x.source] += 1
    assert max(n for (_, s), n in uses.items() if s == "big") == 1 and max(n for (_, s), n in uses.items() if s == "small") <= 3
    total = 0
    for x in rows:
        total += x.tokens
        assert x.upto == total
    assert [x.finish for x in rows] == sorted(x.finish for x in rows)
    sizes = {x.source: x.n for x in mixing.token_sizes(df, ["big", "small"]).groupBy("source").agg(F.sum("tokens").alias("n")).collect()}
    best = min(sizes["big"] / (5 / 9), 3 * sizes["small"] / (4 / 9))
    assert best - 200 <= total <= best
    assert [tuple(x) for x in mixing.mix(df, targets).collect()] == [tuple(x) for x in rows]


def test_mix_with_a_budget_and_without_documents(spark):
    docs = [(i, "one two three", "a" if i < 900 else "b", "", "") for i in range(1000)]
    df, t = spark.createDataFrame(docs, DOCS), spark.createDataFrame([("a", 1.0, 1), ("b", 1.0, 2)], "source string, weight double, max_repeats int")
    small = {x.source: x.tokens for x in mixing.shares(mixing.mix(df, t, budget=300), t).collect()}
    assert small["a"] + small["b"] in range(294, 301) and abs(small["a"] - small["b"]) <= 6
    n = mixing.token_sizes(df, ["a"]).first().tokens
    beyond = {x.source: x.tokens for x in mixing.shares(mixing.mix(df, t, budget=800 * n), t).collect()}
    assert beyond["b"] == 200 * n and abs(beyond["a"] - 600 * n) <= n
    everything = {x.source: x.tokens for x in mixing.shares(mixing.mix(df, t, budget=10**9), t).collect()}
    assert everything == {"a": 900 * n, "b": 200 * n}
    assert mixing.mix(df.limit(0), t).count() == 0 and mixing.mix(df, t.limit(0)).count() == 0


def test_horizon():
    t = {"a": mixing.Target(3.0, 1), "b": mixing.Target(1.0, 2)}
    assert mixing.horizon({"a": 30, "b": 100}, t, None) == ({"a": 0.75, "b": 0.25}, 40, 40.0)
    assert mixing.horizon({"a": 30, "b": 100}, t, 60)[2] == 120.0
    assert mixing.horizon({}, t, None) == ({}, 0, 0.0)


PROSE = {
    "en": "We moved the query server to a small machine and it scans all of the old scripts every hour, although nobody had asked for that. If the peer list looks odd, you should read it twice and wait until the node is done. ",
    "de": "Wenn der Knoten die Gebühr nicht kennt, sollte man eine Weile warten und das Protokoll noch einmal lesen. Bei hoher Last ist es besser, mit der Sicherung zu beginnen und auf die nächste Höhe zu achten. ",
    "es": "Si el nodo no conoce la comisión, conviene esperar un poco y leer otra vez el registro de la noche. Con mucha carga es mejor que la copia empiece antes, porque nadie sabe bien cuándo llega el siguiente bloque. ",
    "fr": "Si le nœud ne connaît pas les frais, il faut attendre un peu et lire encore une fois le journal de la nuit. Sous forte charge, il vaut mieux que la sauvegarde commence avant, car on ne sait pas quand vient le bloc. ",
}
STUFFED = {
    "keywords": "Cheap wallet airdrop promo code cheap wallet. Promo code airdrop airdrop cheap wallet? Airdrop promo code cheap wallet promo code. ",
    "words": "buy no coins free kyc buy buy coins free no kyc bonus coins no bonus free buy kyc coins bonus no free buy coins kyc bonus ",
    "spanish": "bot de trading | minería en la nube | cartera | mejor casa de cambio | bot de trading | cadena | minería en la nube | cartera | ",
    "links": "\n".join(f"https://shop.name{i}.example/low-fees?ref={i}" for i in range(12)) + "\n",
    "anchors": "\n".join(f"* [fast payout](www.name{i}.test/{i})" for i in range(12)) + "\n",
    "html": " ".join(f'<a href="https://name{i}.test/">promo code</a><br>' for i in range(12)),
    "tags": "\n".join(f"{p}{w}" for p in ("tag:", "keyword: ", "tags=", "rel:") for w in ("cold store", "gift card", "airdrop")) + "\n",
    "hash tags": "#airdrop#nokyc12#giftcard#airdrop #coldstorage#nokyc #airdrop#giftcard #nokyc\n",
    "places": "\n".join(f"cloud mining {n}" for n in ("Galan", "Verud", "Oster", "Quinor", "Huleb", "Nolan", "Tamor", "Celik")) + "\n",
    "products": "Key Q4 black sale\nBoard Z85 sand free shipping\nCable P76 graphite new\nBoard Q11 black sale\nKey X65 black in stock\nCable P4 sand sale\n",
}
SENTENCES = [
    "Read this page for the list of fees, then compare each of them with the key.", "They moved it to an older machine, so that late rows can still arrive.",
    "If your wallet does not know the block, look at the node first.", "Half of these were lost in the night, and nobody noticed until Monday.",
    "You should not trust what it says after a restart.", "It took us four days to find out why the queue had been empty.",
    "Between the two of them we found one that the index hides.", "Nothing in here is older than the last release, which is why it costs more.",
]
OTHER = {
    "log": "\n".join(f"12:{i:02d}:43 INFO indexer height={i}736495 peers=9 ok" for i in range(20)),
    "records": "\n".join(f'{{"height": {i}849079, "fee": 0.0003110, "label": "change output"}}' for i in range(20)),
    "hashes": "\n".join(f"{i}8500  {i:02d}" + "ab12cd34" * 8 + "  193" for i in range(20)),
    "code": "\n".join(f"{{ block(height: {i}5938) {{ hash time transactions(limit: 154) {{ txid fee }} }} }}" for i in range(20)),
    "annotated": "\n".join(f"https://name{i}.example/7 : {t}" for i, t in enumerate(SENTENCES)),
    "questions": "\n".join(f"Q: What does a {w} row mean?\nA: {t}" for w, t in zip(("stale", "fresh", "quiet", "idle", "late", "open"), SENTENCES)),
    "changes": "## 1.2.5\n- We moved the list to the other machine.\n- The node is faster, but it reads all of the rows.\n\n## 1.2.4\n- That was not the best of ideas.\n",
    "short": "Regards,\nTamor",
    "one": "Balance",
}


def shares(*texts):
    return stuffing.stuffed_shares([stuffing.Page(t) for t in texts], [None] * len(texts))[:2]


def test_stuffing_is_told_from_other_matter():
    for name, t in STUFFED.items():
        for _, prose in PROSE.items():
            most, least = shares(prose + "\n" + t * (1 + 1500 // len(t)))[1][0], shares(prose * 8 + "\n" + t)[1][0]
            assert most[stuffing.USUAL] > 0.6, name
            assert least[stuffing.USUAL] < 0.5, name
    for name, t in OTHER.items():
        assert shares(t)[1][0][stuffing.USUAL] < 0.5, name
    for lang, t in PROSE.items():
        got, share = shares(t * 3, t)
        assert got == [lang, lang] and share.max() < 0.2, lang


def test_texts_do_not_affect_each_other():
    texts = [*STUFFED.values(), None, "", " \n ", *OTHER.values(), *PROSE.values(), "​", "x" * 50_000, "<p></p>", "a " * 30_000]
    together = shares(*texts)
    for i, t in enumerate(texts):
        lang, share = shares(t)
        assert lang[0] == together[0][i] and np.allclose(share[0], together[1][i]), t[:40]
    assert (together[1][[texts.index(x) for x in (None, "", " \n ")]] == 0).all()


def test_stuffed_pages(spark):
    rows = [(i, t * 4, None) for i, t in enumerate(STUFFED.values())] + [(100 + i, t, "xx") for i, t in enumerate([*OTHER.values(), *PROSE.values()])] + [(200, None, "en"), (201, "", None)]
    df = spark.createDataFrame([(*r, 1.0, "z") for r in rows], "doc_id bigint, text string, lang string, share double, stated string")
    assert {x.doc_id for x in stuffing.stuffed_pages(df).collect()} == set(range(len(STUFFED)))
    assert stuffing.stuffing(df).count() == len(rows)
    assert stuffing.stuffed_pages(df.limit(0)).count() == 0


def test_queries_run(spark):
    for name in ("p8_items", "p9_shares", "p10_found"):
        assert queries.QUERIES[name](spark, DATA).count() > 0
