"""Queries of the lookup functions over the serving tables, each with its SQL. Arguments are taken from the data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from chainloom.operators import api as A, chain
from chainloom.queries import sql
from chainloom.queries.ledger import _page_sql
from chainloom.sources.tables import table

_H, _A = sql.hash_, sql.address
BLOCK_COLUMNS = "height version versionhex merkleroot time mediantime nonce bits difficulty chainwork previousblockhash size tx_count".split()


def _S(c: str) -> str:
    return f"CASE WHEN NOT isnan({c}) AND abs({c}) < 9e10 THEN {sql.sats(c)} END"


def _one(name: str, table: str, key: dict[str, str], rest: dict[str, str]) -> str:
    """One copy a key: the one with the fewest nulls, then the largest text."""
    columns = ", ".join(f"{e} AS {c}" for c, e in (key | rest).items())
    filled = " + ".join(f"CAST({c} IS NOT NULL AS INTEGER)" for c in rest)
    text = "concat_ws('|', " + ", ".join(f"coalesce(CAST({c} AS VARCHAR), '')" for c in rest) + ")"
    known = " AND ".join(f"{c} IS NOT NULL" for c in key)
    return f"{name} AS (SELECT * FROM (SELECT {columns} FROM {table}) WHERE {known} QUALIFY row_number() OVER (PARTITION BY {', '.join(key)} ORDER BY {filled} DESC, {text} DESC) = 1)"


STORE = f"""
ev AS (SELECT DISTINCT event_seq AS s, {sql.word("type")} AS t, {_H("hash")} AS h, height FROM chain_event),
ok AS (SELECT * FROM ev WHERE t IN ('add', 'delete') AND h IS NOT NULL AND height IS NOT NULL),
top AS (SELECT height, max(s) AS s, arg_max(h, s) AS h FROM ok WHERE t = 'add' GROUP BY height),
lc AS (SELECT height, h AS hash FROM top WHERE NOT EXISTS (SELECT 1 FROM ok WHERE ok.t = 'delete' AND ok.height = top.height AND ok.h = top.h AND ok.s > top.s)),
{_one("b", "block", {"hash": _H("hash")}, {**{c: c for c in BLOCK_COLUMNS}, "previousblockhash": _H("previousblockhash")})},
{_one("ct", "confirmed_transaction", {"height": "height", "tx_n": "tx_n"}, {"txid": _H("txid")})},
{_one("ti", "transaction_input", {"spending_txid": _H("spending_txid"), "spending_index": "spending_index"}, {"txid": _H("txid"), "vout": "vout", "coinbase": "coinbase", "sequence": "sequence", "asm": "scriptsig.asm", "hex": "scriptsig.hex"})},
{_one("tu", "transaction_output", {"txid": _H("txid"), "n": "n"}, {"value_sats": _S("value"), "type": "scriptpubkey.type", "addresses": "coalesce(array_to_string(scriptpubkey.addresses, ','), '')", "spending_txid": _H("spending_txid"), "spending_index": "spending_index"})},
{_one("at_", "address_transaction", {"address": _A("address"), '"timestamp"': '"timestamp"', "height": "height", "tx_n": "tx_n"}, {"change_sats": _S("balance_change")})},
hot AS (SELECT arg_max(address, (n, address)) AS address FROM (SELECT address, count(*) AS n FROM at_ GROUP BY address)),
r AS (SELECT day, address, balance_sats, change_sats FROM (
  SELECT CAST(date AS VARCHAR) AS day, {_A("address")} AS address, CASE WHEN NOT isnan(balance) AND abs(balance) < 9e10 THEN {sql.sats("balance")} END AS balance_sats, CASE WHEN NOT isnan(balance_change) THEN {sql.sats("balance_change")} END AS change_sats FROM daily_richlist WHERE date IS NOT NULL)
  WHERE address IS NOT NULL AND balance_sats IS NOT NULL QUALIFY row_number() OVER (PARTITION BY day, address ORDER BY balance_sats DESC, change_sats DESC NULLS LAST) = 1),
tf AS (SELECT ct.txid, ct.height, ct.tx_n, coalesce(i.k, 0)::BIGINT AS input_count, coalesce(o.k, 0)::BIGINT AS output_count,
  CAST(CASE WHEN tx_n = 0 THEN 0 WHEN i.known = i.k AND coalesce(o.known, 0) = coalesce(o.k, 0) THEN i.v - coalesce(o.v, 0) END AS BIGINT) AS fee_sats
  FROM ct LEFT JOIN (SELECT ti.spending_txid AS txid, count(*) AS k, sum(o.value_sats) AS v, count(o.value_sats) AS known FROM ti LEFT JOIN tu o ON o.txid = ti.txid AND o.n = ti.vout WHERE coinbase IS NULL GROUP BY 1) i ON i.txid = ct.txid
  LEFT JOIN (SELECT txid, count(*) AS k, sum(value_sats) AS v, count(value_sats) AS known FROM tu GROUP BY 1) o ON o.txid = ct.txid),
dc AS (SELECT address, CAST("timestamp" AT TIME ZONE 'UTC' AS DATE) AS d, CAST(sum(change_sats) AS BIGINT) AS change_sats FROM at_ WHERE change_sats IS NOT NULL GROUP BY ALL),
day_change AS (SELECT CAST(d AS VARCHAR) AS day, address, change_sats FROM dc WHERE d < (SELECT CAST(max("timestamp") AT TIME ZONE 'UTC' + INTERVAL 1 MILLISECOND AS DATE) FROM at_ WHERE change_sats IS NOT NULL)),
h0 AS (SELECT min(height) AS height FROM ct), one AS (SELECT arg_max(spending_txid, (n, spending_txid)) AS txid FROM (SELECT spending_txid, count(*) AS n FROM ti GROUP BY 1))"""

DAY = "2012-01-18"
QUERIES: dict = {}
SQL: dict[str, str] = {}


def _add(name: str, run, text: str, page: tuple | None = None) -> None:
    """page: columns, order, limit and condition of a page's SQL."""
    QUERIES[name] = lambda spark, d: run(A.open_store(spark, d))
    SQL[name] = _page_sql("WITH" + STORE, text, *page) if page else "WITH" + STORE + " " + text


_arguments: dict[tuple, object] = {}


def _once(s: A.Store, name: str, find) -> object:
    """An argument of a lookup, found once in a store: the queries measure lookups, not the search for what to look up."""
    key = (id(s), name)
    if key not in _arguments:
        _arguments[key] = find()
    return _arguments[key]


def _least_height(s: A.Store) -> int:
    return _once(s, "height", lambda: s.confirmed_transaction.agg(F.min("height")).first()[0])


def _busiest(df: DataFrame, key: str) -> str:
    return df.groupBy(key).count().orderBy(F.col("count").desc(), F.col(key).desc()).first()[0]


def _spender(s: A.Store) -> str:
    return _once(s, "spender", lambda: _busiest(s.transaction_input, "spending_txid"))


def _address(s: A.Store) -> str:
    return _once(s, "address", lambda: _busiest(s.address_transaction, "address"))


def _text(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.col(n).cast("string") for n in names})


def _millis(df: DataFrame) -> DataFrame:
    return df.withColumn("time_ms", F.unix_millis("timestamp")).drop("timestamp")


_BLOCK = ["hash", "height", "time", "previousblockhash", "size", "tx_count"]
_NUMBERS = ["height", "time", "size", "tx_count"]
_add("g6_transaction", lambda s: A.transaction(s, _spender(s)), "SELECT * FROM tf WHERE txid = (SELECT txid FROM one) ORDER BY height DESC, tx_n DESC LIMIT 1")
_add("g7_transaction_input", lambda s: A.transaction_input(s, _spender(s), 0).select("spending_txid", "spending_index", "txid", "vout", "sequence"), "SELECT spending_txid, spending_index, txid, vout, sequence FROM ti WHERE spending_txid = (SELECT txid FROM one) AND spending_index = 0")
_add("g8_transaction_output", lambda s: A.transaction_output(s, _spender(s), 0).select("txid", "n", "value_sats", "addresses"), "SELECT txid, n, value_sats, addresses FROM tu WHERE txid = (SELECT txid FROM one) AND n = 0")
_add("g9_confirmed_transaction", lambda s: A.confirmed_transaction(s, _least_height(s), 1), "SELECT * FROM ct WHERE height = (SELECT height FROM h0) AND tx_n = 1")
_add("g10_blocks_page", lambda s: A.blocks(s, 50, {"height": 100_000_000}), "SELECT height, hash FROM lc", ("height DESC", 50, "height < 100000000"))
_add("g11_block_by_height", lambda s: A.block_by_height(s, _least_height(s)), "SELECT height, hash FROM lc WHERE height = (SELECT height FROM h0)")
_add("g12_block", lambda s: A.block_details(s, A.block_by_height(s, _least_height(s)).select("hash")).select(_BLOCK), f"SELECT {', '.join(_BLOCK)} FROM b WHERE hash = (SELECT hash FROM lc WHERE height = (SELECT height FROM h0))")
_add("g15_richlist_page", lambda s: A.rich_list(s, DAY, 100, {"balance_sats": 100_000_000_000, "change_sats": 0, "address": ""}), f"SELECT balance_sats, change_sats, address FROM r WHERE day = '{DAY}'", ("balance_sats DESC, change_sats DESC NULLS LAST, address DESC", 100, "(balance_sats < 100000000000 OR balance_sats = 100000000000 AND (change_sats < 0 OR change_sats = 0 AND address < ''))"))
_add("g16_day_gainers_page", lambda s: A.day_gainers(s, DAY, 100), f"SELECT change_sats, address FROM day_change WHERE day = '{DAY}' AND change_sats > 0", ("change_sats DESC, address DESC", 100))
_add("g17_day_losers_page", lambda s: A.day_losers(s, DAY, 100), f"SELECT change_sats, address FROM day_change WHERE day = '{DAY}' AND change_sats < 0", ("change_sats, address", 100))
_add("g20_wallets", A.wallets, "SELECT NULL LIMIT 0")
_add("g25_address_transactions", lambda s: _millis(A.with_balance_after(A.address_transactions(s, a := _address(s), 100), A.address_balances(s, a))),
     "SELECT epoch_ms(t.\"timestamp\") AS time_ms, t.height, t.tx_n, t.change_sats, (SELECT CAST(sum(u.change_sats) AS BIGINT) FROM at_ u WHERE u.address = t.address AND u.\"timestamp\" <= t.\"timestamp\") AS balance_after_sats FROM at_ t WHERE address = (SELECT address FROM hot) AND change_sats IS NOT NULL", ('time_ms DESC, height DESC, tx_n DESC', 100))
_add("g26_address_balances", lambda s: _millis(A.address_balances(s, _address(s))),
     "SELECT epoch_ms(\"timestamp\") AS time_ms, CAST(sum(sum(change_sats)) OVER (ORDER BY \"timestamp\") AS BIGINT) AS balance_sats FROM at_ WHERE address = (SELECT address FROM hot) AND change_sats IS NOT NULL GROUP BY \"timestamp\"")
_add("g27_address_confirmed", lambda s: s.address_transaction.join(s.confirmed_transaction, ["height", "tx_n"]).select("address", "height", "tx_n", "txid"), "SELECT a.address, a.height, a.tx_n, ct.txid FROM at_ a JOIN ct ON ct.height = a.height AND ct.tx_n = a.tx_n")
_add("g33_chain_blocks", lambda s: A.block_details(s, s.longest_chain.select("hash")).select("hash", "previousblockhash"), "SELECT b.hash, previousblockhash FROM b JOIN lc ON lc.hash = b.hash")
_add("g34_block_transactions_page", lambda s: A.block_transactions(s, _least_height(s), 2), "SELECT height, tx_n, txid FROM ct WHERE height = (SELECT height FROM h0)", ("tx_n", 2))
_add("g37_transaction_blocks", lambda s: A.transaction_blocks(s, s.confirmed_transaction), "SELECT ct.height, tx_n, txid, hash FROM ct LEFT JOIN lc ON lc.height = ct.height")
_add("g36_transaction_details", lambda s: _text(A.transaction_details(s), "fee_sats"), "SELECT * REPLACE (CAST(fee_sats AS VARCHAR) AS fee_sats) FROM tf")
_PLACE = ["height", "tx_n", "input_count", "output_count", "fee_sats"]
_BEST = "(SELECT * FROM tf WHERE txid IS NOT NULL QUALIFY row_number() OVER (PARTITION BY txid ORDER BY height DESC, tx_n DESC) = 1)"
_TEXTS = ", ".join(f"CAST(x.{c} AS VARCHAR) AS {c}" for c in _PLACE)
_add("g41_input_transactions", lambda s: _text(A.of_transaction(s, s.transaction_input.select("spending_txid", "spending_index"), "spending_txid"), *_PLACE), f"SELECT spending_txid, spending_index, {_TEXTS} FROM ti LEFT JOIN {_BEST} x ON x.txid = ti.spending_txid")
_add("g43_output_transactions", lambda s: _text(A.of_transaction(s, s.transaction_output.select(F.col("txid").alias("of"), "n"), "of"), *_PLACE), f"SELECT tu.txid AS of, n, {_TEXTS} FROM tu LEFT JOIN {_BEST} x ON x.txid = tu.txid")
_add("g38_inputs_page", lambda s: A.inputs(s, _spender(s), 5, {"spending_index": 0}).select("spending_txid", "spending_index", "txid", "vout", "has_more"), "SELECT spending_txid, spending_index, txid, vout FROM ti WHERE spending_txid = (SELECT txid FROM one)", ("spending_index", 5, "spending_index > 0"))
_add("g39_outputs_page", lambda s: A.outputs(s, _spender(s), 5).select("txid", "n", "value_sats", "addresses", "has_more"), "SELECT txid, n, value_sats, addresses FROM tu WHERE txid = (SELECT txid FROM one)", ("n", 5))
_add("g40_spent_outputs", lambda s: _text(A.spent_output(s, s.transaction_input.where("coinbase is null")), "n", "value_sats"), "SELECT ti.spending_txid, ti.spending_index, ti.txid, CAST(vout AS VARCHAR) AS n, CAST(value_sats AS VARCHAR) AS value_sats, addresses FROM ti LEFT JOIN tu ON tu.txid = ti.txid AND tu.n = ti.vout WHERE coinbase IS NULL")
_add("g42_spending_inputs", lambda s: _text(A.spending_input(s, s.transaction_output), "spending_index", "sequence"), "SELECT tu.txid, tu.n, ti.spending_txid, CAST(ti.spending_index AS VARCHAR) AS spending_index, CAST(sequence AS VARCHAR) AS sequence FROM tu LEFT JOIN ti ON ti.txid = tu.txid AND ti.vout = tu.n")
SQL["g20_wallets"] = f"""WITH RECURSIVE u AS (SELECT {_A("address")} AS node, min({_A("parent")}) AS parent FROM union_find GROUP BY 1),
l AS (SELECT a.node, b.node AS parent FROM u a LEFT JOIN u b ON b.node = a.parent AND a.parent <> a.node WHERE a.node IS NOT NULL),
tree AS (SELECT node, node AS root FROM l WHERE parent IS NULL UNION ALL SELECT l.node, t.root FROM tree t JOIN l ON l.parent = t.node),
lost AS (SELECT * FROM l WHERE node NOT IN (SELECT node FROM tree)),
walk AS (SELECT node, parent AS cur FROM lost UNION SELECT w.node, x.parent FROM walk w JOIN lost x ON x.node = w.cur),
ring AS (SELECT node FROM walk WHERE node = cur)
SELECT node AS address, root AS cluster_id FROM tree UNION ALL SELECT w.node, min(ring.node) FROM walk w JOIN ring ON ring.node = w.cur GROUP BY w.node"""


def w1_block_times(spark: SparkSession, d: str) -> DataFrame:
    return chain.block_times(table(spark, d, "block"))


def sink_k1_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Every block with a hash, its key; missing fields are null. Numbers as text, so that nulls compare."""
    return _text(A.open_store(spark, d).block.select(_BLOCK), *_NUMBERS)


def s1_final_heights(spark: SparkSession, d: str) -> DataFrame:
    from chainloom.sources.blocks import final_blocks

    return final_blocks(A.open_store(spark, d).longest_chain)


QUERIES |= {f.__name__: f for f in (w1_block_times, sink_k1_blocks, s1_final_heights)}
SQL["w1_block_times"] = """WITH o AS (SELECT height, min(time) AS t FROM block WHERE height IS NOT NULL AND time IS NOT NULL GROUP BY height),
n AS (SELECT *, row_number() OVER (ORDER BY height) - 1 AS i FROM o)
SELECT height, CAST(greatest(max(t * 1000 - i) OVER (ORDER BY height), 1) + i AS BIGINT) AS time_ms FROM n"""
SQL["sink_k1_blocks"] = "WITH" + STORE + f" SELECT {', '.join(f'CAST({c} AS VARCHAR) AS {c}' if c in _NUMBERS else c for c in _BLOCK)} FROM b"
SQL["s1_final_heights"] = "WITH" + STORE + " SELECT height, hash FROM lc WHERE height <= (SELECT max(height) FROM lc) - 5"
