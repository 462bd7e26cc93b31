"""Queries of the ledger operators over the fixtures of sources.orders, each with its SQL."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession, functions as F

from chainloom.functions.normalise import bin_of
from chainloom.operators import api as A, balances as B, chain as C, clusters as K, live as L, overlay as V
from chainloom.plans.paging import page
from chainloom.plans.shared import Shared
from chainloom.sources.orders import event_deltas, order_blocks, order_live, orders_chain
from chainloom.sources.tables import table

FIXTURE = """
tx AS (SELECT *, lag(txid) OVER (PARTITION BY cust ORDER BY height, txid) AS prev FROM (
  SELECT o_orderkey AS txid, o_custkey AS cust, CAST(dense_rank() OVER (ORDER BY o_orderdate) - 1 AS INTEGER) AS height,
         CAST(row_number() OVER (PARTITION BY o_orderdate ORDER BY o_orderkey) - 1 AS INTEGER) AS tx_n, o_orderdate AS ts FROM orders)),
txo AS (SELECT l_orderkey AS txid, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) - 1 AS INTEGER) AS n,
         CAST(floor(l_quantity * 1e8 + 0.5) AS BIGINT) AS v, 'c' || o_custkey || '-' || (l_suppkey % 4) AS a FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
spent AS (SELECT tx.txid AS stx, o.n AS si, o.txid, o.n, o.v, o.a FROM tx JOIN txo o ON o.txid = tx.prev WHERE tx.tx_n <> 0),
delta AS (SELECT t.txid, t.height, t.tx_n, t.ts, d.a, CAST(sum(d.v) AS BIGINT) AS v FROM (SELECT txid, a, v FROM txo UNION ALL SELECT stx, a, -v FROM spent) d JOIN tx t ON t.txid = d.txid GROUP BY ALL)"""
MIXED = """, cj AS (SELECT stx AS txid FROM spent GROUP BY stx HAVING min(a) <> max(a) INTERSECT SELECT txid FROM (SELECT txid, v FROM txo GROUP BY txid, v HAVING min(a) <> max(a))),
edge AS (SELECT DISTINCT m.a AS a, s.a AS b FROM spent s JOIN (SELECT stx, min(a) AS a FROM spent GROUP BY stx) m ON m.stx = s.stx WHERE s.a <> m.a AND s.stx NOT IN (SELECT txid FROM cj))"""
COMPONENTS = MIXED + """, sym AS (SELECT a, b FROM edge UNION SELECT b, a FROM edge),
reach AS (SELECT a, b FROM sym UNION SELECT r.a, s.b FROM reach r JOIN sym s ON r.b = s.a),
member AS (SELECT n.a AS address, least(n.a, coalesce(min(r.b), n.a)) AS cluster_id FROM (SELECT DISTINCT a FROM txo) n LEFT JOIN reach r ON r.a = n.a GROUP BY n.a),
ctx AS (SELECT m.cluster_id, d.ts, d.height, d.tx_n, CAST(sum(d.v) AS BIGINT) AS change_sats FROM delta d JOIN member m ON m.address = d.a GROUP BY ALL),
cday AS (SELECT cluster_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, CAST(sum(change_sats) AS BIGINT) AS change_sats FROM ctx GROUP BY ALL)"""
EVENTS = """
e AS (SELECT 'u' || user_id AS address, ts, CASE WHEN event_type IN ('purchase', 'error') THEN -1 ELSE 1 END * CAST(floor(value * 1e8 + 0.5) AS BIGINT) AS d FROM events),
bal AS (SELECT address, ts, d, CAST(sum(d) OVER (PARTITION BY address ORDER BY ts ROWS UNBOUNDED PRECEDING) AS BIGINT) AS b FROM e),
ohlc AS (SELECT address, CAST(ts AS DATE) AS day, arg_min(b - d, ts) AS open, max(greatest(b, b - d)) AS high, min(least(b, b - d)) AS low, arg_max(b, ts) AS close FROM bal GROUP BY ALL),
done AS (SELECT CAST((SELECT max(ts) FROM events) + INTERVAL 1 MILLISECOND AS DATE) AS open_day),
candle AS (SELECT ohlc.* FROM ohlc, done WHERE day < open_day),
rich AS (SELECT CAST(unnest(generate_series(CAST(day AS TIMESTAMP), CAST(until AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS on_, address, day, close, close - open AS change FROM (
  SELECT *, least(coalesce(lead(day) OVER (PARTITION BY address ORDER BY day), open_day), open_day) - 1 AS until FROM ohlc, done) WHERE close > 10000000000 AND until >= day)"""


def _page_sql(body: str, columns: str, order: str, limit: int, where: str = "TRUE") -> str:
    return f"""{body}, pick AS (SELECT * FROM ({columns}) WHERE {where} ORDER BY {order} LIMIT {limit + 1})
SELECT * EXCLUDE (at_), (SELECT count(*) FROM pick) > {limit} AS has_more FROM (SELECT *, row_number() OVER (ORDER BY {order}) AS at_ FROM pick) WHERE at_ <= {limit}"""


QUERIES: dict = {}
SQL: dict[str, str] = {}


def _add(name: str, run, sql: str | None) -> None:
    QUERIES[name] = run
    if sql:
        SQL[name] = sql


def _texts(df: DataFrame) -> DataFrame:
    """Dates as text, the same in both engines."""
    return df.withColumns({c: F.col(c).cast("string") for c, kind in df.dtypes if kind == "date"})


def _chain(name: str, run, sql: str) -> None:
    _add(name, lambda spark, d: _texts(run(orders_chain(spark, d))), "WITH RECURSIVE" + FIXTURE + sql)


def _events(name: str, run, sql: str) -> None:
    _add(name, lambda spark, d: _texts(run(event_deltas(spark, d))), "WITH" + EVENTS + sql)


def _flat(c: C.Chain, df: DataFrame) -> DataFrame:
    return df.withColumn("address", C.single_address(F.col("addresses"))).drop("addresses")


def _blocks(name: str, run, sql: str) -> None:
    """Queries over nested block documents, with txids as text."""
    _add(name, lambda spark, d: _texts(run(C.flatten(order_blocks(spark, d)))), "WITH RECURSIVE" + FIXTURE + sql)


_T = "CAST({0} AS VARCHAR) AS {1}".format
def _ctx(c: C.Chain) -> DataFrame:
    c = C.resolved(c)
    return K.cluster_transactions(c, K.cluster_addresses(c))


_blocks("proj1_transactions", lambda c: c.tx.drop("version", "locktime"), f""" SELECT {_T("tx.txid", "txid")}, height, tx_n, ts, tx_n = 0 AS is_coinbase, 250 AS size,
CAST((SELECT count(*) FROM txo p WHERE tx_n <> 0 AND p.txid = tx.prev) AS INTEGER) AS input_count, CAST((SELECT count(*) FROM txo o WHERE o.txid = tx.txid) AS INTEGER) AS output_count FROM tx""")
_blocks("proj2_outputs", lambda c: _flat(c, c.txo), f" SELECT {_T('txo.txid', 'txid')}, height, tx_n, n, v AS value_sats, a AS address FROM txo JOIN tx ON tx.txid = txo.txid")
_blocks("proj3_input_pointers", lambda c: c.txi, f" SELECT {_T('stx', 'spending_txid')}, height, tx_n, si AS spending_index, {_T('spent.txid', 'txid')}, n FROM spent JOIN tx ON tx.txid = spent.stx")
_blocks("j1_spent_outputs_of_blocks", lambda c: _flat(c, C.spent_outputs(c)), f" SELECT {_T('stx', 'spending_txid')}, height, si AS spending_index, {_T('spent.txid', 'txid')}, n, v AS value_sats, a AS address FROM spent JOIN tx ON tx.txid = spent.stx")
_blocks("j3_fees_of_blocks", C.fees, f""" SELECT {_T("t.txid", "txid")}, t.height, CASE WHEN t.tx_n = 0 THEN 0 ELSE coalesce(i.v, 0) - coalesce(o.v, 0) END::BIGINT AS fee_sats, coalesce(i.k, 0)::BIGINT AS input_count, coalesce(o.k, 0)::BIGINT AS output_count
FROM tx t LEFT JOIN (SELECT stx, sum(v) AS v, count(*) AS k FROM spent GROUP BY stx) i ON i.stx = t.txid LEFT JOIN (SELECT txid, sum(v) AS v, count(*) AS k FROM txo GROUP BY txid) o ON o.txid = t.txid""")


def _latest_outputs(c: C.Chain) -> DataFrame:
    """Every transaction named by its address' customer instead, so that blocks repeat txids: which output an input spends
    is then decided by heights."""
    named = lambda df, *names: df.withColumns({n: F.concat(F.lit("t"), F.pmod(F.col(n).cast("bigint"), F.lit(97))) for n in names})
    again = C.Chain(named(c.tx, "txid"), named(c.txo, "txid"), named(c.txi, "spending_txid", "txid"))
    return _flat(again, C.spent_outputs(again)).groupBy("spending_txid", "height", "txid", "n").agg(F.max("value_sats").alias("value_sats"), F.count(F.lit(1)).alias("inputs")).select("spending_txid", "height", "txid", "n", F.col("value_sats").cast("string").alias("value_sats"))


_blocks("j1_latest_outputs", _latest_outputs, """, made AS (SELECT 't' || (txo.txid % 97) AS txid, n, height, tx_n, v FROM txo JOIN tx ON tx.txid = txo.txid),
ask AS (SELECT 't' || (stx % 97) AS s, tx.height, tx.tx_n, si, 't' || (spent.txid % 97) AS txid, n FROM spent JOIN tx ON tx.txid = spent.stx),
got AS (SELECT s, a.height, si, a.txid, a.n, arg_max(m.v, (m.height, m.tx_n)) AS v FROM ask a LEFT JOIN made m ON m.txid = a.txid AND m.n = a.n AND (m.height < a.height OR m.height = a.height AND m.tx_n < a.tx_n) GROUP BY ALL)
SELECT s AS spending_txid, height, txid, n, CAST(max(v) AS VARCHAR) AS value_sats FROM got GROUP BY s, height, txid, n""")
_chain("j1_spent_outputs", lambda c: _flat(c, C.spent_outputs(c)), " SELECT stx AS spending_txid, si AS spending_index, txid, n, v AS value_sats, a AS address FROM spent")
_chain("j4_spent_marker", lambda c: C.spent_markers(c).withColumns({k: F.col(k).cast("string") for k in ("spending_txid", "spending_index")}), " SELECT o.txid, o.n, CAST(s.stx AS VARCHAR) AS spending_txid, CAST(s.si AS VARCHAR) AS spending_index FROM txo o LEFT JOIN spent s ON s.txid = o.txid AND s.n = o.n")
_chain("a1_address_deltas", C.address_deltas, " SELECT txid, height, tx_n, ts, a AS address, v AS delta_sats FROM delta")
_chain("a3_block_deltas", lambda c: C.block_deltas(C.address_deltas(c)), " SELECT a AS address, ts, CAST(sum(v) AS BIGINT) AS delta_sats FROM delta GROUP BY a, ts")
_chain("a4_fees", C.fees, """ SELECT t.txid, CASE WHEN t.tx_n = 0 THEN 0 ELSE coalesce(i.v, 0) - coalesce(o.v, 0) END::BIGINT AS fee_sats, coalesce(i.k, 0)::BIGINT AS input_count, coalesce(o.k, 0)::BIGINT AS output_count
FROM tx t LEFT JOIN (SELECT stx, sum(v) AS v, count(*) AS k FROM spent GROUP BY stx) i ON i.stx = t.txid LEFT JOIN (SELECT txid, sum(v) AS v, count(*) AS k FROM txo GROUP BY txid) o ON o.txid = t.txid""")
_chain("w2_chain_balances", lambda c: B.running_balances(C.block_deltas(C.address_deltas(c))), """, bd AS (SELECT a AS address, ts, CAST(sum(v) AS BIGINT) AS d FROM delta GROUP BY a, ts)
SELECT address, ts, d AS delta_sats, CAST(sum(d) OVER (PARTITION BY address ORDER BY ts) AS BIGINT) AS balance_sats FROM bd""")
_chain("c2_mixing_transactions", K.mixing_transactions, MIXED + " SELECT txid FROM cj")
_chain("c1_cospend_edges", K.cospend_edges, MIXED + " SELECT a, b FROM edge")
_chain("c6_cluster_addresses", K.cluster_addresses, COMPONENTS + " SELECT address, cluster_id FROM member")
_chain("a10_cluster_transactions", _ctx, COMPONENTS + " SELECT * FROM ctx")
_chain("a11_cluster_balances", lambda c: K.cluster_balances(_ctx(c)), COMPONENTS + " SELECT cluster_id, CAST(sum(change_sats) AS BIGINT) AS balance_sats, count(*) AS transactions FROM ctx GROUP BY cluster_id")
_chain("a12_cluster_days", lambda c: K.cluster_days(_ctx(c)), COMPONENTS + " SELECT * FROM cday")
_HASH = "abs(list_reduce(list_prepend(0::BIGINT, list_transform(string_split({0}, ''), lambda x: unicode(x)::BIGINT)), lambda h, c: (((h * 31 + c + 2147483648) % 4294967296 + 4294967296) % 4294967296) - 2147483648))"
_chain("a14_cluster_sizes", lambda c: K.cluster_sizes(K.cluster_addresses(c)), COMPONENTS + f" SELECT cluster_id, count(*) AS addresses, CAST(any_value({_HASH.format('cluster_id')}) % 100 AS TINYINT) AS bin FROM member GROUP BY cluster_id")
_stored: dict[tuple, A.ClusterStore] = {}


def _cluster_store(spark: SparkSession, d: str) -> A.ClusterStore:
    """The cluster tables, written once a session and sorted by what lookups ask for."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _stored:
        shared, c = Shared(spark, "cluster-store"), C.resolved(orders_chain(spark, d))
        put = lambda df, *order: shared.table(df.repartitionByRange(*order).sortWithinPartitions(*order))
        members = put(K.cluster_addresses(c), "cluster_id", "address")
        ctx = put(K.cluster_transactions(c, members), "cluster_id", "ts")
        _stored[key] = A.ClusterStore(members, ctx, put(K.cluster_balances(ctx), "cluster_id"), put(_texts(K.cluster_days(ctx)), "day", "change_sats"), put(c.tx.select("height", "tx_n", "txid"), "height", "tx_n"))
    return _stored[key]


def _clusters(name: str, run, sql: str) -> None:
    _add(name, lambda spark, d: run(_cluster_store(spark, d)), sql)


#: Of all clusters the one with the most transactions, and the day with the most changes; of several the smallest.
_ASKED = COMPONENTS + """, big AS (SELECT cluster_id AS id FROM ctx GROUP BY cluster_id ORDER BY count(*) DESC, cluster_id LIMIT 1), busy AS (SELECT day FROM cday GROUP BY day ORDER BY count(*) DESC, day LIMIT 1)"""
_WITH = "WITH RECURSIVE" + FIXTURE + _ASKED


def _big(c: A.ClusterStore) -> str:
    return c.transactions.groupBy("cluster_id").count().orderBy(F.col("count").desc(), "cluster_id").first()[0]


def _busy(c: A.ClusterStore) -> str:
    return c.days.groupBy("day").count().orderBy(F.col("count").desc(), "day").first()[0]


_clusters("g13_cluster_richlist", lambda c: A.cluster_rich_list(c, 50, {"balance_sats": 30_000_000_000, "cluster_id": "c5"}),
          _page_sql(_WITH, "SELECT CAST(sum(change_sats) AS BIGINT) AS balance_sats, cluster_id FROM ctx GROUP BY cluster_id HAVING sum(change_sats) > 0", "balance_sats DESC, cluster_id DESC", 50, "(balance_sats < 30000000000 OR balance_sats = 30000000000 AND cluster_id < 'c5')"))
_clusters("g18_cluster_gainers", lambda c: A.cluster_gainers(c, _busy(c), 10), _page_sql(_WITH, "SELECT change_sats, cluster_id FROM cday WHERE day = (SELECT day FROM busy) AND change_sats > 0", "change_sats DESC, cluster_id DESC", 10))
_clusters("g19_cluster_losers", lambda c: A.cluster_losers(c, _busy(c), 10, {"change_sats": -10_000_000_000_000, "cluster_id": ""}), _page_sql(_WITH, "SELECT change_sats, cluster_id FROM cday WHERE day = (SELECT day FROM busy) AND change_sats < 0", "change_sats, cluster_id", 10, "change_sats > -10000000000000"))
_clusters("g28_cluster_txs", lambda c: A.cluster_transactions(c, _big(c), 7), _page_sql(_WITH, "SELECT ts, height, tx_n, change_sats FROM ctx WHERE cluster_id = (SELECT id FROM big)", "ts DESC, height DESC, tx_n DESC", 7))
_clusters("g29_cluster_addresses", lambda c: A.cluster_addresses(c.members, _big(c), 2), _page_sql(_WITH, "SELECT address, cluster_id FROM member WHERE cluster_id = (SELECT id FROM big)", "address", 2))
_clusters("g30_cluster_days", lambda c: A.cluster_days(c, _big(c), 5, {"day": "1992-06-01"}), _page_sql(_WITH, "SELECT day, change_sats FROM cday WHERE cluster_id = (SELECT id FROM big)", "day", 5, "day > '1992-06-01'"))
_clusters("g31_cluster_details", lambda c: A.cluster_details(c, _big(c)), _WITH + " SELECT cluster_id, CAST(sum(change_sats) AS BIGINT) AS balance_sats, count(*) AS transactions FROM ctx WHERE cluster_id = (SELECT id FROM big) GROUP BY cluster_id")
_clusters("g32_cluster_confirmed", lambda c: A.confirmed_of(c, c.transactions), _WITH + " SELECT ctx.*, tx.txid FROM ctx LEFT JOIN tx ON tx.height = ctx.height AND tx.tx_n = ctx.tx_n")

LIVE = """, tip AS (SELECT max(height) AS tip FROM tx),
vis AS (SELECT tx.*, tip - height AS age FROM tx, tip WHERE NOT (tip - height < 3 AND tx_n = 0)),
pool AS (SELECT txid, CAST(epoch(ts) AS BIGINT) + tx_n AS arrived FROM vis WHERE age < 3),
pin AS (SELECT s.stx AS txid, CASE WHEN v.txid IS NOT NULL THEN s.v END AS v, CASE WHEN v.txid IS NOT NULL THEN s.a END AS a FROM spent s JOIN pool p ON p.txid = s.stx LEFT JOIN vis v ON v.txid = s.txid),
det AS (SELECT p.txid, p.arrived, CASE WHEN count(i.v) = count(i.txid) THEN CAST(coalesce(sum(i.v), 0) - any_value(coalesce(o.v, 0)) AS BIGINT) END AS fee_sats, count(i.txid) AS input_count, any_value(coalesce(o.k, 0)) AS output_count
  FROM pool p LEFT JOIN pin i ON i.txid = p.txid LEFT JOIN (SELECT txid, sum(v) AS v, count(*) AS k FROM txo GROUP BY txid) o ON o.txid = p.txid GROUP BY p.txid, p.arrived),
pdel AS (SELECT x.txid, p.arrived, x.a AS address, CAST(sum(x.v) AS BIGINT) AS delta_sats FROM (SELECT txid, a, v FROM txo UNION ALL SELECT txid, a, -v FROM pin) x JOIN pool p ON p.txid = x.txid WHERE x.a IS NOT NULL GROUP BY ALL),
conf AS (SELECT d.a AS address, d.ts, d.height, d.tx_n, d.v AS change_sats, v.age FROM delta d JOIN vis v ON v.txid = d.txid WHERE v.age >= 3),
cbal AS (SELECT address, ts, CAST(sum(sum(change_sats)) OVER (PARTITION BY address ORDER BY ts) AS BIGINT) AS balance_sats, min(age) AS age FROM conf GROUP BY address, ts),
asked AS (SELECT address FROM pdel GROUP BY address ORDER BY count(*) DESC, address LIMIT 1),
warm AS (SELECT address FROM conf WHERE age < 13 GROUP BY address ORDER BY (SELECT count(*) FROM conf c WHERE c.address = conf.address) DESC, address LIMIT 1)"""


_lives: dict[tuple, L.Live] = {}


def _live_store(spark: SparkSession, d: str) -> L.Live:
    """The pool, the newest blocks and the stored tables, written once a session and sorted by what lookups ask for."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _lives:
        shared, v = Shared(spark, "live-store"), order_live(spark, d)
        put = lambda df, *order: shared.table(df.repartitionByRange(*order).sortWithinPartitions(*order))
        pool, hot = L.Pool(*map(shared.table, (v.pool.tx, v.pool.inputs, v.pool.outputs))), C.Chain(*map(shared.table, (v.hot.tx, v.hot.txo, v.hot.txi)))
        _lives[key] = L.Live(pool, hot, put(v.outputs, "txid", "n"), put(v.address_transaction, "address", "ts"), put(v.address_balance, "address", "ts"), put(v.confirmed, "height", "tx_n"))
    return _lives[key]


def _live(name: str, run, sql: str) -> None:
    _add(name, lambda spark, d: _texts(run(_live_store(spark, d))), "WITH RECURSIVE" + FIXTURE + LIVE + sql)


def _live_page(name: str, run, *page: object) -> None:
    _add(name, lambda spark, d: run(_live_store(spark, d)), _page_sql("WITH RECURSIVE" + FIXTURE + LIVE, *page))


def _asked(v: L.Live) -> str:
    return L.pool_deltas(v).groupBy("address").count().orderBy(F.col("count").desc(), "address").first()[0]


def _warm(v: L.Live) -> str:
    """Of the addresses in the newest blocks the one with the most transactions."""
    every = L.hot_deltas(v).select("address", F.lit(1).alias("hot")).unionByName(v.address_transaction.select("address", F.lit(0).alias("hot")))
    return every.groupBy("address").agg(F.max("hot").alias("hot"), F.count(F.lit(1)).alias("n")).where("hot = 1").orderBy(F.col("n").desc(), "address").first()[0]


_text_of = lambda df, *names: df.withColumns({n: F.col(n).cast("string") for n in names})
_live("g4_mempool", L.pool_totals_of, " SELECT CAST(coalesce(sum(fee_sats), 0) AS BIGINT) AS total_fees_sats, count(*) AS tx_count FROM det")
_live("a18_pool_details", lambda v: _text_of(L.pool_details(v), "fee_sats"), " SELECT txid, arrived, CAST(fee_sats AS VARCHAR) AS fee_sats, input_count, output_count FROM det")
_live("a18_pool_deltas", L.pool_deltas, " SELECT * FROM pdel")
_live("a19_hot_deltas", L.hot_deltas, " SELECT address, ts, height, tx_n, change_sats FROM conf WHERE age < 13")
_live("a19_hot_balances", L.hot_balances, " SELECT address, ts, balance_sats FROM cbal WHERE age < 13")
_live_page("g45_pool_page", lambda v: _text_of(L.pool_page(v, 5), "fee_sats"), "SELECT arrived, txid, CAST(fee_sats AS VARCHAR) AS fee_sats, input_count, output_count FROM det", "arrived, txid", 5)
_live_page("g22_address_pool_page", lambda v: L.address_pool_page(v, _asked(v), 5), "SELECT arrived, txid, delta_sats FROM pdel WHERE address = (SELECT address FROM asked)", "arrived, txid", 5)
_live("g46_pool_transactions", lambda v: _text_of(L.transactions_of(v, v.pool.inputs.select("spending_txid", "txid")), "state", "height", "tx_n"), """ SELECT s.stx AS spending_txid, s.txid, CASE WHEN v.age < 3 THEN 'pool' WHEN v.age < 13 THEN 'hot' WHEN v.age IS NOT NULL THEN 'stored' END AS state,
CASE WHEN v.age >= 3 THEN CAST(v.height AS VARCHAR) END AS height, CASE WHEN v.age >= 3 THEN CAST(v.tx_n AS VARCHAR) END AS tx_n FROM spent s JOIN pool p ON p.txid = s.stx LEFT JOIN vis v ON v.txid = s.txid""")
_live("g47_address_pool_transactions", lambda v: L.transactions_of(v, L.pool_deltas(v).select("txid", "address")).select("txid", "address", "state"), " SELECT txid, address, 'pool' AS state FROM pdel")
_live_page("l6_address_transactions", lambda v: L.address_transactions(v, _warm(v), 6), "SELECT c.ts, c.height, c.tx_n, c.change_sats, b.balance_sats AS balance_after_sats FROM conf c JOIN cbal b ON b.address = c.address AND b.ts = c.ts WHERE c.address = (SELECT address FROM warm)", "ts DESC, height DESC, tx_n DESC", 6)
_live_page("l6_address_balances", lambda v: L.address_balances(v, _warm(v), 6), "SELECT ts, balance_sats FROM cbal WHERE address = (SELECT address FROM warm)", "ts DESC", 6)
_live_page("l5_hot_block_slice", lambda v: L.block_transactions(v, v.hot.tx.agg(F.max("height")).first()[0], 2, {"tx_n": 0}), "SELECT tx_n, txid FROM vis WHERE height = (SELECT tip - 3 FROM tip)", "tx_n", 2, "tx_n > 0")
_events("w2_running_balances", B.running_balances, " SELECT address, ts, d AS delta_sats, b AS balance_sats FROM bal")
_events("w3_candles", B.candles, " SELECT address, CAST(day AS VARCHAR) AS day, CAST(open AS BIGINT) AS open, CAST(high AS BIGINT) AS high, CAST(low AS BIGINT) AS low, CAST(close AS BIGINT) AS close FROM candle")
_events("a7_gainers", lambda e: B.gainers(B.candles(e)), " SELECT CAST(day AS VARCHAR) AS day, address, CAST(close - open AS BIGINT) AS change_sats FROM candle WHERE close > open")
_events("a7_losers", lambda e: B.losers(B.candles(e)), " SELECT CAST(day AS VARCHAR) AS day, address, CAST(close - open AS BIGINT) AS change_sats FROM candle WHERE close < open")
_events("w4_rich_list", B.rich_list, " SELECT CAST(on_ AS VARCHAR) AS day, address, CAST(close AS BIGINT) AS balance_sats, CAST(CASE WHEN on_ = day THEN change ELSE 0 END AS BIGINT) AS change_sats FROM rich")
_events("g16_gainers_page", lambda e: page(B.gainers(B.candles(e)).select("change_sats", "address", "day"), [("change_sats", False), ("address", False), ("day", False)], 100),
        _page_sql("", "SELECT CAST(close - open AS BIGINT) AS change_sats, address, CAST(day AS VARCHAR) AS day FROM candle WHERE close > open", "change_sats DESC, address DESC, day DESC", 100))
_events("g17_losers_page", lambda e: page(B.losers(B.candles(e)).select("change_sats", "address", "day"), [("change_sats", True), ("address", True), ("day", True)], 100, {"change_sats": -50_000_000_000, "address": "u2", "day": date(1970, 1, 1)}),
        _page_sql("", "SELECT CAST(close - open AS BIGINT) AS change_sats, address, CAST(day AS VARCHAR) AS day FROM candle WHERE close < open", "change_sats, address, day", 100, "(change_sats, address, day) > (-50000000000, 'u2', '1970-01-01')"))
_events("g21_candles_page", lambda e: page(B.candles(e).where("address = 'u1'"), [("day", True)], 10), _page_sql("", "SELECT address, CAST(day AS VARCHAR) AS day, CAST(open AS BIGINT) AS open, CAST(high AS BIGINT) AS high, CAST(low AS BIGINT) AS low, CAST(close AS BIGINT) AS close FROM candle WHERE address = 'u1'", "day", 10))
_events("g26_balances_page", lambda e: page(B.running_balances(e).where("address = 'u1'").select("ts", "balance_sats"), [("ts", False)], 25), _page_sql("", "SELECT ts, b AS balance_sats FROM bal WHERE address = 'u1'", "ts DESC", 25))
_events("a17_unconfirmed_by_address", lambda e: V.pool_by_address(e.withColumn("txid", F.col("ts"))), " SELECT address, count(DISTINCT ts) AS tx_count, CAST(sum(d) AS BIGINT) AS change_sats FROM e GROUP BY address")
_add("a15_mempool_totals", lambda s, d: V.pool_totals(table(s, d, "events").select(F.col("event_id").alias("txid"), F.floor(F.col("value") * 1e8 + 0.5).cast("bigint").alias("fee_sats"))),
     "SELECT CAST(sum(CAST(floor(value * 1e8 + 0.5) AS BIGINT)) AS BIGINT) AS total_fees_sats, count(DISTINCT event_id) AS tx_count FROM events")


def j6_asof_balance(spark: SparkSession, d: str) -> DataFrame:
    """Balances at noon of every active day."""
    e = event_deltas(spark, d)
    noon = e.select("address", (F.date_trunc("day", "ts") + F.expr("interval 12 hours")).alias("ts")).distinct()
    return B.balance_before(noon, B.running_balances(e)).withColumn("balance_sats", F.col("balance_sats").cast("string"))


def j8_double_spent(spark: SparkSession, d: str) -> DataFrame:
    o, l = table(spark, d, "orders"), table(spark, d, "lineitem")
    i = l.join(o, l.l_orderkey == o.o_orderkey).select(F.col("o_orderkey").alias("spending_txid"), F.col("o_orderdate").alias("arrived"), F.col("l_partkey").alias("txid"), F.col("l_suppkey").alias("n"))
    return V.double_spent(i)


def j9_overlay(spark: SparkSession, d: str) -> DataFrame:
    hot, cold = V.split_hot(orders_chain(spark, d).tx)
    stale = hot.withColumn("tx_n", F.lit(-1)).unionByName(cold)
    return V.overlay(hot, stale, ["txid"])


def c15_bins(spark: SparkSession, d: str) -> DataFrame:
    a = orders_chain(spark, d).txo.select(C.single_address(F.col("addresses")).alias("address")).distinct()
    return a.select("address", bin_of(F.col("address"), 20).alias("bin20"), bin_of(F.col("address"), 100).alias("bin100"))


_add("j6_asof_balance", j6_asof_balance, "WITH" + EVENTS + """, noon AS (SELECT DISTINCT address, date_trunc('day', ts) + INTERVAL 12 HOUR AS ts FROM e)
SELECT n.address, n.ts, CAST(b.b AS VARCHAR) AS balance_sats FROM noon n ASOF LEFT JOIN bal b ON b.address = n.address AND b.ts < n.ts""")
_add("j8_double_spent", j8_double_spent, """WITH i AS (SELECT o_orderkey AS s, o_orderdate AS t, l_partkey AS p, l_suppkey AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
r AS (SELECT *, dense_rank() OVER (PARTITION BY p, n ORDER BY t DESC, s DESC) AS k FROM i) SELECT DISTINCT s AS spending_txid FROM r WHERE k > 1""")
_add("j9_overlay", j9_overlay, "WITH" + FIXTURE + " SELECT txid, height, tx_n, ts, tx_n = 0 AS is_coinbase FROM tx")
_add("c15_bins", c15_bins, "WITH" + FIXTURE + f" SELECT a AS address, CAST({_HASH.format('a')} % 20 AS TINYINT) AS bin20, CAST({_HASH.format('a')} % 100 AS TINYINT) AS bin100 FROM (SELECT DISTINCT a FROM txo)")
