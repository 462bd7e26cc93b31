"""Lookups and pages over the serving tables: one function per field of the query interface.

Every list is a page (see plans.paging). A nested field of many parents is one join, not one lookup a parent. The newest
blocks and the unconfirmed transactions are laid over these tables by operators.live.
"""

from __future__ import annotations

from dataclasses import dataclass, fields
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from chainloom.functions.normalise import clean, norm_address, norm_hash, sats
from chainloom.operators import balances as B
from chainloom.operators.changefeed import current_state
from chainloom.operators.hierarchy import ends_of, parent_links
from chainloom.plans.paging import DEFAULT_LIMIT, page
from chainloom.plans.shared import Shared
from chainloom.sources.tables import table


@dataclass
class Store:
    """Serving tables, one row a key, in one spelling. Of the copies of a row one is kept whole: see one_copy."""

    block: DataFrame
    longest_chain: DataFrame
    confirmed_transaction: DataFrame
    transaction: DataFrame
    transaction_input: DataFrame
    transaction_output: DataFrame
    address_transaction: DataFrame
    daily_richlist: DataFrame
    daily_change: DataFrame
    union_find: DataFrame


#: The columns by which each stored table is sorted: what its lookups ask for.
ORDER = {
    "block": ["hash"], "longest_chain": ["height"], "confirmed_transaction": ["height", "tx_n"], "transaction": ["txid"], "transaction_input": ["spending_txid", "spending_index"],
    "transaction_output": ["txid", "n"], "address_transaction": ["address", "timestamp"], "daily_richlist": ["day", "balance_sats"], "daily_change": ["day", "change_sats"], "union_find": ["node"],
}


def one_copy(df: DataFrame, *key: str) -> DataFrame:
    """One row a key, rows with a null in the key left out: the copy with the fewest nulls; of several the one whose
    columns, as text in their order, are the largest. The choice is an aggregate, combined before the shuffle."""
    rest = [c for c in df.columns if c not in key]
    filled = reduce(Column.__add__, (F.col(c).isNotNull().cast("int") for c in rest))
    text = F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in rest))
    best = F.max_by(F.struct(*rest), F.struct(filled.alias("filled"), text.alias("text"))).alias("_v")
    return df.where(" and ".join(f"{k} is not null" for k in key)).groupBy(*key).agg(best).select(*key, "_v.*")


def clean_store(spark: SparkSession, d: str) -> Store:
    """The store as it follows from the tables of a directory; nothing is read until it is used."""
    t = lambda name: table(spark, d, name)
    b = t("block").withColumns({"hash": norm_hash(F.col("hash")), "previousblockhash": norm_hash(F.col("previousblockhash"))})
    live = current_state(t("chain_event")).where("hash <> ''").select(F.col("height").cast("int").alias("height"), "hash")
    c = t("confirmed_transaction").select("height", "tx_n", norm_hash(F.col("txid")).alias("txid"))
    i = t("transaction_input").select(norm_hash(F.col("spending_txid")).alias("spending_txid"), "spending_index", norm_hash(F.col("txid")).alias("txid"), "vout", "coinbase", "sequence", F.col("scriptsig.asm").alias("asm"), F.col("scriptsig.hex").alias("hex"))
    o = t("transaction_output").select(norm_hash(F.col("txid")).alias("txid"), "n", sats(F.col("value")).alias("value_sats"), F.col("scriptpubkey.type").alias("type"), F.concat_ws(",", "scriptpubkey.addresses").alias("addresses"), norm_hash(F.col("spending_txid")).alias("spending_txid"), "spending_index")
    a = t("address_transaction").select(norm_address(F.col("address")).alias("address"), "timestamp", "height", "tx_n", sats(F.col("balance_change")).alias("change_sats"))
    r = t("daily_richlist").select(F.col("date").cast("string").alias("day"), norm_address(F.col("address")).alias("address"), F.struct(sats(F.col("balance")).alias("balance_sats"), sats(F.col("balance_change")).alias("change_sats")).alias("v")).where("v.balance_sats is not null")
    r = r.where("day is not null and address is not null").groupBy("day", "address").agg(F.max("v").alias("v")).select("day", "address", "v.balance_sats", "v.change_sats")
    u = parent_links(t("union_find"), norm_address(F.col("address")), norm_address(F.col("parent")))
    c, i, o, a = one_copy(c, "height", "tx_n"), one_copy(i, "spending_txid", "spending_index"), one_copy(o, "txid", "n"), one_copy(a, "address", "timestamp", "height", "tx_n")
    deltas = a.where("change_sats is not null").groupBy("address", F.col("timestamp").cast("timestamp").alias("ts")).agg(F.sum("change_sats").alias("delta_sats"))
    change = B.candles(deltas).select(F.col("day").cast("string").alias("day"), "address", (F.col("close") - F.col("open")).alias("change_sats"))
    return Store(one_copy(b, "hash"), live, c, _transactions(c, i, o), i, o, a, r, change, u)


def write_store(s: Store, root: str) -> None:
    """Each table as parquet under root, sorted by its key across and inside the files, so that lookups skip row groups."""
    for name, order in ORDER.items():
        getattr(s, name).repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").parquet(f"{root}/{name}")


def read_store(spark: SparkSession, root: str) -> Store:
    return Store(*(spark.read.parquet(f"{root}/{f.name}") for f in fields(Store)))


_opened: dict[tuple, Store] = {}


def open_store(spark: SparkSession, d: str) -> Store:
    """The store over the tables of a directory: cleaned, written once a session in the shared folder and read from there,
    so that the conditions of a lookup reach the parquet files."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _opened:
        root = Shared(spark, "store").root
        write_store(clean_store(spark, d), root)
        _opened[key] = read_store(spark, root)
    return _opened[key]


def coins(available: DataFrame, name: str | None = None) -> DataFrame:
    """The coins of available_coins, one row a name; or the one of a name. Of several rows of a name see one_copy."""
    found = one_copy(available.select(clean(F.col("name")).alias("name"), "bip44_index", "bip44_symbol"), "name")
    return found if name is None else found.where(F.col("name") == name)


def block(s: Store, hash_: str) -> DataFrame:
    return s.block.where(F.col("hash") == hash_)


def block_by_height(s: Store, height: int) -> DataFrame:
    return s.longest_chain.where(F.col("height") == height)


def blocks(s: Store, limit: int = DEFAULT_LIMIT, cursor: dict | None = None) -> DataFrame:
    """(height, hash, has_more) from the tip, or from below the cursor's height, downwards."""
    return page(s.longest_chain, [("height", False)], limit, cursor)


def block_details(s: Store, hashes: DataFrame) -> DataFrame:
    """The blocks of hashes(hash)."""
    return hashes.join(s.block, "hash")


def block_transactions(s: Store, height: int, limit: int = DEFAULT_LIMIT, cursor: dict | None = None) -> DataFrame:
    return page(s.confirmed_transaction.where(F.col("height") == height), [("tx_n", True)], limit, cursor)


def confirmed_transaction(s: Store, height: int, tx_n: int) -> DataFrame:
    return s.confirmed_transaction.where((F.col("height") == height) & (F.col("tx_n") == tx_n))


def _transactions(confirmed: DataFrame, inputs: DataFrame, outputs: DataFrame) -> DataFrame:
    """(txid, height, tx_n, input_count, output_count, fee_sats) of every confirmed transaction.

    The fee is 0 for the first of a block, null if the value of an output or of what an input spends is unknown.
    """
    ins = inputs.where("coinbase is null").join(outputs.select("txid", F.col("n").alias("vout"), F.col("value_sats").alias("v")), ["txid", "vout"], "left")
    ins = ins.groupBy(F.col("spending_txid").alias("txid")).agg(F.count(F.lit(1)).alias("input_count"), F.sum("v").alias("in_sats"), F.count("v").alias("known"))
    outs = outputs.groupBy("txid").agg(F.count(F.lit(1)).alias("output_count"), F.sum("value_sats").alias("out_sats"), F.count("value_sats").alias("valued"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    fee = F.when(F.col("tx_n") == 0, F.lit(0).cast("bigint")).when((F.col("known") == F.col("input_count")) & (zero("valued") == zero("output_count")), F.col("in_sats") - zero("out_sats"))
    return confirmed.join(ins, "txid", "left").join(outs, "txid", "left").select("txid", "height", "tx_n", zero("input_count").alias("input_count"), zero("output_count").alias("output_count"), fee.alias("fee_sats"))


def transaction(s: Store, txid: str) -> DataFrame:
    """(txid, height, tx_n, input_count, output_count, fee_sats) of a transaction; of several places the highest."""
    return s.transaction.where(F.col("txid") == txid).orderBy(F.col("height").desc(), F.col("tx_n").desc()).limit(1)


def of_transaction(s: Store, rows: DataFrame, txid: str) -> DataFrame:
    """rows with the transaction that its column txid names, nulls if it isn't confirmed; of several places the highest."""
    best = s.transaction.where("txid is not null").groupBy("txid").agg(F.max(F.struct("height", "tx_n", "input_count", "output_count", "fee_sats")).alias("_t"))
    return rows.join(best.withColumnRenamed("txid", "_id"), F.col(txid) == F.col("_id"), "left").select(*rows.columns, "_t.*")


def transaction_blocks(s: Store, transactions: DataFrame) -> DataFrame:
    """transactions(height, ...) with the hash of their block on the longest chain, null if there is none."""
    return transactions.join(s.longest_chain, "height", "left")


def transaction_details(s: Store) -> DataFrame:
    """Every confirmed transaction with its counts and its fee."""
    return s.transaction


def inputs(s: Store, txid: str, limit: int = DEFAULT_LIMIT, cursor: dict | None = None) -> DataFrame:
    return page(s.transaction_input.where(F.col("spending_txid") == txid), [("spending_index", True)], limit, cursor)


def outputs(s: Store, txid: str, limit: int = DEFAULT_LIMIT, cursor: dict | None = None) -> DataFrame:
    return page(s.transaction_output.where(F.col("txid") == txid), [("n", True)], limit, cursor)


def transaction_input(s: Store, spending_txid: str, spending_index: int) -> DataFrame:
    return s.transaction_input.where((F.col("spending_txid") == spending_txid) & (F.col("spending_index") == spending_index))


def transaction_output(s: Store, txid: str, n: int) -> DataFrame:
    return s.transaction_output.where((F.col("txid") == txid) & (F.col("n") == n))


def spent_output(s: Store, of: DataFrame) -> DataFrame:
    """of(spending_txid, spending_index, txid, vout) with value_sats and addresses of the output each spends, or nulls."""
    return of.select("spending_txid", "spending_index", "txid", F.col("vout").alias("n")).join(s.transaction_output.select("txid", "n", "value_sats", "addresses"), ["txid", "n"], "left")


def spending_input(s: Store, of: DataFrame) -> DataFrame:
    """of(txid, n) with the input that spends each, found from the inputs; nulls if unspent."""
    by = s.transaction_input.select("txid", F.col("vout").alias("n"), "spending_txid", "spending_index", "sequence")
    return of.select("txid", "n").join(by, ["txid", "n"], "left")


def address_transactions(s: Store, address: str, limit: int = DEFAULT_LIMIT, cursor: dict | None = None) -> DataFrame:
    """(timestamp, height, tx_n, change_sats, has_more), newest first."""
    rows = s.address_transaction.where((F.col("address") == address) & F.col("change_sats").isNotNull())
    return page(rows.select("timestamp", "height", "tx_n", "change_sats"), [("timestamp", False), ("height", False), ("tx_n", False)], limit, cursor)


def with_balance_after(transactions: DataFrame, balances: DataFrame) -> DataFrame:
    """A page of transactions with the balance after their block: balances(timestamp, balance_sats) of the same address,
    first cut to the times of the page."""
    span = transactions.agg(F.min("timestamp").alias("_lo"), F.max("timestamp").alias("_hi"))
    near = balances.join(F.broadcast(span), (F.col("timestamp") >= F.col("_lo")) & (F.col("timestamp") <= F.col("_hi"))).select("timestamp", F.col("balance_sats").alias("balance_after_sats"))  # one row
    return transactions.join(near, "timestamp", "left")


def address_balances(s: Store, address: str) -> DataFrame:
    """(timestamp, balance_sats) after every block of an address, from the sums of its changes."""
    d = s.address_transaction.where((F.col("address") == address) & F.col("change_sats").isNotNull()).groupBy("address", F.col("timestamp").alias("ts")).agg(F.sum("change_sats").alias("delta_sats"))
    return B.running_balances(d).select(F.col("ts").alias("timestamp"), "balance_sats")


def wallets(s: Store) -> DataFrame:
    """(address, cluster_id): the end of each address' parent pointers."""
    ends = ends_of(s.union_find.select("node", F.when(F.col("parent") != F.col("node"), F.col("parent")).alias("parent")))
    return ends.select(F.col("node").alias("address"), F.col("root").alias("cluster_id"))


def cluster_addresses(members: DataFrame, cluster_id: str, limit: int = DEFAULT_LIMIT, cursor: dict | None = None) -> DataFrame:
    return page(members.where(F.col("cluster_id") == cluster_id), [("address", True)], limit, cursor)


def rich_list(s: Store, day: str, limit: int = DEFAULT_LIMIT, cursor: dict | None = None) -> DataFrame:
    rows = s.daily_richlist.where(F.col("day") == day).select("balance_sats", "change_sats", "address")
    return page(rows, [("balance_sats", False), ("change_sats", False), ("address", False)], limit, cursor)


def day_gainers(s: Store, day: str, limit: int = DEFAULT_LIMIT, cursor: dict | None = None) -> DataFrame:
    """(change_sats, address) of all addresses that gained on a day that has ended, the largest gain first."""
    rows = s.daily_change.where((F.col("day") == day) & (F.col("change_sats") > 0)).select("change_sats", "address")
    return page(rows, [("change_sats", False), ("address", False)], limit, cursor)


def day_losers(s: Store, day: str, limit: int = DEFAULT_LIMIT, cursor: dict | None = None) -> DataFrame:
    rows = s.daily_change.where((F.col("day") == day) & (F.col("change_sats") < 0)).select("change_sats", "address")
    return page(rows, [("change_sats", True), ("address", True)], limit, cursor)


@dataclass
class ClusterStore:
    """members(address, cluster_id), transactions(cluster_id, ts, height, tx_n, change_sats), details(cluster_id,
    balance_sats, transactions), days(cluster_id, day, change_sats), confirmed(height, tx_n, txid)."""

    members: DataFrame
    transactions: DataFrame
    details: DataFrame
    days: DataFrame
    confirmed: DataFrame


def cluster_transactions(c: ClusterStore, cluster_id: str, limit: int = DEFAULT_LIMIT, cursor: dict | None = None) -> DataFrame:
    """(ts, height, tx_n, change_sats, has_more), newest first."""
    rows = c.transactions.where(F.col("cluster_id") == cluster_id).select("ts", "height", "tx_n", "change_sats")
    return page(rows, [("ts", False), ("height", False), ("tx_n", False)], limit, cursor)


def confirmed_of(c: ClusterStore, transactions: DataFrame) -> DataFrame:
    """transactions(height, tx_n, ...) with their txid, null if it isn't stored."""
    return transactions.join(c.confirmed, ["height", "tx_n"], "left")


def cluster_days(c: ClusterStore, cluster_id: str, limit: int = DEFAULT_LIMIT, cursor: dict | None = None) -> DataFrame:
    """(day, change_sats, has_more), oldest first."""
    return page(c.days.where(F.col("cluster_id") == cluster_id).select("day", "change_sats"), [("day", True)], limit, cursor)


def cluster_details(c: ClusterStore, cluster_id: str) -> DataFrame:
    return c.details.where(F.col("cluster_id") == cluster_id)


def cluster_rich_list(c: ClusterStore, limit: int = DEFAULT_LIMIT, cursor: dict | None = None) -> DataFrame:
    return page(c.details.where("balance_sats > 0").select("balance_sats", "cluster_id"), [("balance_sats", False), ("cluster_id", False)], limit, cursor)


def cluster_gainers(c: ClusterStore, day, limit: int = DEFAULT_LIMIT, cursor: dict | None = None) -> DataFrame:
    """(change_sats, cluster_id) of the clusters that gained on a day, the largest gain first."""
    rows = c.days.where((F.col("day") == F.lit(day)) & (F.col("change_sats") > 0)).select("change_sats", "cluster_id")
    return page(rows, [("change_sats", False), ("cluster_id", False)], limit, cursor)


def cluster_losers(c: ClusterStore, day, limit: int = DEFAULT_LIMIT, cursor: dict | None = None) -> DataFrame:
    rows = c.days.where((F.col("day") == F.lit(day)) & (F.col("change_sats") < 0)).select("change_sats", "cluster_id")
    return page(rows, [("change_sats", True), ("cluster_id", True)], limit, cursor)
