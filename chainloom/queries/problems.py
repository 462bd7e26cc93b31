"""The pN_ queries of the core operators, each with its SQL where there is one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from chainloom.functions.normalise import norm_address, norm_hash
from chainloom.operators import changefeed, heavy_keys, hierarchy, orphans, rolling
from chainloom.queries import sql
from chainloom.sources.tables import table


def _links(spark: SparkSession, d: str) -> DataFrame:
    """Both tables as one forest; names are kept apart by the table's name in front, and an address naming itself has no parent."""
    b = hierarchy.parent_links(table(spark, d, "block"), norm_hash(F.col("hash")), norm_hash(F.col("previousblockhash")))
    u = table(spark, d, "union_find")
    a, p = norm_address(F.col("address")), norm_address(F.col("parent"))
    u = hierarchy.parent_links(u, a, F.when(a != p, p))
    named = lambda df, tbl: df.select(*(F.concat(F.lit(f"{tbl}:"), F.col(c)).alias(c) for c in ("node", "parent")))
    return named(b, "block").unionByName(named(u, "union_find"))


def _bare(c: str):
    return F.substring_index(F.col(c), ":", -1)


def p1_tree(spark: SparkSession, d: str) -> DataFrame:
    """The number of descendants is the length of their interval."""
    t = hierarchy.hierarchy(_links(spark, d))
    return t.select(F.substring_index("node", ":", 1).alias("tbl"), _bare("node").alias("node"), _bare("root").alias("root"), "depth", F.coalesce(F.col("last") - F.col("first"), F.lit(-1)).alias("descendants"))


def p1_paths(spark: SparkSession, d: str) -> DataFrame:
    """Every node with its path segments and the interval of its descendants; hierarchy says how they are read."""
    t = hierarchy.hierarchy(_links(spark, d))
    return t.select(F.substring_index("node", ":", 1).alias("tbl"), *(_bare(c).alias(c) for c in ("node", "parent", "root")), "depth", "descendants", "chain", "pos", "path", "first", "last")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Depths are read off the path segments; cycles have none."""
    t = hierarchy.hierarchy(_links(spark, d))
    steps = F.aggregate("path", F.lit(-1).cast("bigint"), lambda n, s: n + s["last"] + 1)
    t = t.withColumn("depth", F.coalesce(steps, F.col("depth")))
    return t.where("depth > 12 or depth = -1").select(F.substring_index("node", ":", 1).alias("tbl"), _bare("node").alias("node"), _bare("root").alias("root"), "depth")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return heavy_keys.heavy_losing_days(table(spark, d, "address_transaction"))


def p4_daily_sums(spark: SparkSession, d: str) -> DataFrame:
    return heavy_keys.address_day_sums(table(spark, d, "address_transaction"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return changefeed.current_state(table(spark, d, "chain_event")).where("n_events >= 2").select("height", "hash")


def p5_state(spark: SparkSession, d: str) -> DataFrame:
    return changefeed.current_state(table(spark, d, "chain_event"))


def p5_batches(spark: SparkSession, d: str) -> DataFrame:
    """The state after two batches: what had arrived by the middle of the time covered, and the rest."""
    feed = table(spark, d, "chain_event")
    seconds = F.unix_seconds(F.col("observed_at").cast("timestamp"))
    middle = F.broadcast(feed.agg(((F.min(seconds) + F.max(seconds)) / 2).alias("_middle")))  # one row
    early = F.coalesce(seconds <= F.col("_middle"), F.lit(True))
    marked = feed.join(middle)
    return changefeed.current_state(marked.where(early), marked.where(~early))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return rolling.rebounds(table(spark, d, "address_transaction"))


def p6_rolling(spark: SparkSession, d: str) -> DataFrame:
    return rolling.with_averages(rolling.rolling_totals(table(spark, d, "address_transaction")))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    o = orphans.orphans(table(spark, d, "transaction_input"), table(spark, d, "transaction_output"))
    return o.where("direct").select("spending_txid", "spending_index").distinct()


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    return orphans.report(*(table(spark, d, t) for t in ("transaction_input", "transaction_output", "confirmed_transaction", "block")))


_TREE = f"""WITH RECURSIVE rows_ AS (
  SELECT 'block' AS tbl, {sql.hash_("hash")} AS node, {sql.hash_("previousblockhash")} AS parent FROM block
  UNION ALL SELECT 'union_find', {sql.address("address")}, {sql.address("parent")} FROM union_find),
one AS (SELECT tbl, node, min(CASE WHEN tbl = 'block' OR parent <> node THEN parent END) AS parent FROM rows_ WHERE node IS NOT NULL GROUP BY tbl, node),
link AS (SELECT a.tbl, a.node, b.node AS parent FROM one a LEFT JOIN one b ON a.tbl = b.tbl AND a.parent = b.node),
tree AS (SELECT tbl, node, node AS root, 0 AS depth FROM link WHERE parent IS NULL
  UNION ALL SELECT l.tbl, l.node, t.root, t.depth + 1 FROM tree t JOIN link l ON l.tbl = t.tbl AND l.parent = t.node),
lost AS (SELECT * FROM link l WHERE NOT EXISTS (SELECT 1 FROM tree t WHERE t.tbl = l.tbl AND t.node = l.node)),
walk AS (SELECT tbl, node, parent AS cur FROM lost UNION SELECT w.tbl, w.node, l.parent FROM walk w JOIN lost l ON l.tbl = w.tbl AND l.node = w.cur),
ring AS (SELECT tbl, node FROM walk WHERE node = cur),
cyc AS (SELECT w.tbl, w.node, min(r.node) AS root, -1 AS depth FROM walk w JOIN ring r ON r.tbl = w.tbl AND r.node = w.cur GROUP BY w.tbl, w.node)
"""

_ROLLING = f"""WITH {sql.CELLS},
span AS (SELECT address, min(day) AS lo, greatest(max(day) + 29, (SELECT max(day) FROM cells)) AS hi FROM cells GROUP BY address),
grid AS (SELECT address, CAST(unnest(generate_series(CAST(lo AS TIMESTAMP), CAST(hi AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS day FROM span),
t AS (SELECT g.address, g.day, sum(CASE WHEN c.day > g.day - 7 THEN c.s ELSE 0 END) AS s7, sum(coalesce(c.s, 0)) AS s30,
        sum(CASE WHEN c.day > g.day - 7 THEN c.n ELSE 0 END) AS n7, sum(coalesce(c.n, 0)) AS n30
      FROM grid g LEFT JOIN cells c ON c.address = g.address AND c.day BETWEEN g.day - 29 AND g.day GROUP BY g.address, g.day)
"""

_H = sql.hash_
_REPORT = f"""WITH RECURSIVE i AS (SELECT DISTINCT {_H("spending_txid")} AS s, spending_index AS i, CASE WHEN coinbase IS NULL THEN {_H("txid")} END AS t, CASE WHEN coinbase IS NULL AND {_H("txid")} IS NOT NULL THEN vout END AS n FROM transaction_input),
o AS (SELECT DISTINCT {_H("txid")} AS t, n, {_H("spending_txid")} AS s, spending_index AS i FROM transaction_output),
c AS (SELECT DISTINCT {_H("txid")} AS t, height FROM confirmed_transaction WHERE {_H("txid")} IS NOT NULL),
m AS (SELECT {_H("hash")} AS h, {_H("previousblockhash")} AS p, height, strftime(make_timestamp(time * 1000000), '%Y-%m') AS period FROM block),
b AS (SELECT h, p, min(period) AS period FROM m WHERE h IS NOT NULL AND p IS NOT NULL GROUP BY 1, 2),
lost AS (SELECT h AS x FROM b WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.h = b.p) UNION SELECT b.h FROM lost JOIN b ON b.p = lost.x),
hs AS (SELECT height, bool_or(h IS NULL OR h NOT IN (SELECT x FROM lost)) AS sound, min(period) AS period FROM m WHERE height IS NOT NULL GROUP BY height),
ch AS (SELECT c.t, c.height, hs.height IS NOT NULL AS there, coalesce(hs.sound, c.height IS NULL) AS sound, hs.period FROM c LEFT JOIN hs ON hs.height = c.height),
w AS (SELECT t, bool_or(sound) AS sound, min(period) AS period FROM ch GROUP BY t),
r AS (SELECT i.*, NOT EXISTS (SELECT 1 FROM o WHERE o.t = i.t AND o.n = i.n) AS direct FROM i WHERE t IS NOT NULL),
x AS (SELECT t FROM c UNION SELECT s FROM i WHERE s IS NOT NULL UNION SELECT t FROM o WHERE t IS NOT NULL),
bad AS (SELECT t AS x FROM x WHERE t NOT IN (SELECT t FROM w WHERE sound) UNION SELECT s FROM r WHERE direct AND s IS NOT NULL UNION SELECT r.s FROM bad JOIN r ON r.t = bad.x WHERE r.s IS NOT NULL),
u AS (SELECT 'transaction_input' AS tbl, 'transaction_output' AS refers_to, s AS k, CAST(NULL AS VARCHAR) AS own, direct AS d, t IN (SELECT x FROM bad) AS i FROM r
  UNION ALL SELECT 'transaction_input', 'confirmed_transaction', s, NULL, s NOT IN (SELECT t FROM c), s IN (SELECT x FROM bad) FROM (SELECT DISTINCT s, i FROM i WHERE s IS NOT NULL)
  UNION ALL SELECT 'transaction_output', 'transaction_input', t, NULL, NOT EXISTS (SELECT 1 FROM i WHERE i.s = o.s AND i.i = o.i), s IN (SELECT x FROM bad) FROM o WHERE s IS NOT NULL
  UNION ALL SELECT 'transaction_output', 'confirmed_transaction', t, NULL, t NOT IN (SELECT t FROM c), t IN (SELECT x FROM bad) FROM (SELECT DISTINCT t, n FROM o WHERE t IS NOT NULL)
  UNION ALL SELECT 'confirmed_transaction', 'block', t, NULL, NOT there, NOT sound FROM ch WHERE height IS NOT NULL
  UNION ALL SELECT 'block', 'block', NULL, period, NOT EXISTS (SELECT 1 FROM m WHERE m.h = b.p), b.p IN (SELECT x FROM lost) FROM b),
v AS (SELECT tbl, refers_to, coalesce(own, w.period) AS period, d, NOT d AND i AS i FROM u LEFT JOIN w ON w.t = u.k)
SELECT tbl, refers_to, period, count(*) AS refs, CAST(sum(CAST(d AS INTEGER)) AS BIGINT) AS direct, CAST(sum(CAST(i AS INTEGER)) AS BIGINT) AS inherited FROM v GROUP BY tbl, refers_to, period"""

SQL = {
    "p7_report": _REPORT,
    "p1_tree": _TREE + """, anc AS (SELECT tbl, node, node AS up FROM tree UNION ALL SELECT a.tbl, a.node, l.parent FROM anc a JOIN link l ON l.tbl = a.tbl AND l.node = a.up WHERE l.parent IS NOT NULL),
below AS (SELECT tbl, up, count(*) - 1 AS n FROM anc GROUP BY tbl, up)
SELECT t.tbl, t.node, t.root, CAST(t.depth AS BIGINT) AS depth, b.n AS descendants FROM tree t JOIN below b ON b.tbl = t.tbl AND b.up = t.node UNION ALL SELECT tbl, node, root, -1, -1 FROM cyc""",
    "p1_found": _TREE + "SELECT tbl, node, root, CAST(depth AS BIGINT) AS depth FROM tree WHERE depth > 12 UNION ALL SELECT tbl, node, root, CAST(depth AS BIGINT) FROM cyc",
    "p4_found": f"""WITH {sql.CELLS}, days AS (SELECT day, sum(n) AS total FROM cells GROUP BY day)
SELECT address, CAST(c.day AS VARCHAR) AS day FROM cells c JOIN days d ON c.day = d.day WHERE n >= 5 AND n * 100 >= total * 4 AND s < 0""",
    "p4_daily_sums": f"WITH {sql.CELLS} SELECT address, CAST(day AS VARCHAR) AS day, CAST(n AS BIGINT) AS n_rows, s AS sum_sats FROM cells",
    "p5_found": (_P5 := f"""WITH e AS (SELECT DISTINCT event_seq AS s, {sql.word("type")} AS t, {sql.hash_("hash")} AS h, height FROM chain_event),
v AS (SELECT * FROM e WHERE t IN ('add', 'delete') AND h IS NOT NULL AND height IS NOT NULL),
a AS (SELECT height, max(s) AS s, arg_max(h, s) AS h FROM v WHERE t = 'add' GROUP BY height),
n AS (SELECT height, count(*) AS n FROM v GROUP BY height),
f AS (SELECT n.height, n.n, CASE WHEN a.h IS NULL OR EXISTS (SELECT 1 FROM v WHERE v.t = 'delete' AND v.height = a.height AND v.h = a.h AND v.s > a.s) THEN '' ELSE a.h END AS hash
      FROM n LEFT JOIN a ON a.height = n.height)
""") + "SELECT CAST(height AS BIGINT) AS height, hash FROM f WHERE n >= 2",
    "p5_batches": (_STATE := _P5 + "SELECT CAST(height AS BIGINT) AS height, hash, CAST(n AS BIGINT) AS n_events FROM f"),
    "p5_state": _STATE,
    "p6_found": _ROLLING + "SELECT address, CAST(day AS VARCHAR) AS day FROM t WHERE s7 >= 1000000000 AND s30 <= -10000000000",
    "p6_rolling": _ROLLING + """SELECT address, CAST(day AS VARCHAR) AS day, CAST(s7 AS BIGINT) AS total_short, CAST(s30 AS BIGINT) AS total_long,
CAST(s7 AS DOUBLE) / 7 AS average_short, CAST(s30 AS DOUBLE) / 30 AS average_long, CAST(n7 AS BIGINT) AS rows_short, CAST(n30 AS BIGINT) AS rows_long FROM t""",
    "p7_found": f"""SELECT DISTINCT {sql.hash_("i.spending_txid")} AS spending_txid, CAST(spending_index AS BIGINT) AS spending_index FROM transaction_input i
WHERE coinbase IS NULL AND {sql.hash_("i.txid")} IS NOT NULL AND NOT EXISTS (SELECT 1 FROM transaction_output o WHERE {sql.hash_("o.txid")} = {sql.hash_("i.txid")} AND o.n = i.vout)""",
}
QUERIES = {f.__name__: f for f in (p1_found, p1_tree, p1_paths, p4_found, p4_daily_sums, p5_found, p5_state, p5_batches, p6_found, p6_rolling, p7_found, p7_report)}
