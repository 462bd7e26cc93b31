"""Lookups read stored tables by key, and see the newest blocks and the pool first."""

import re

import pytest
from pyspark.sql import functions as F

from chainloom.operators import api as A, live as L
from chainloom.queries import ledger
from chainloom.sources.orders import order_live
from tests.oracle import DATA

LOOKUPS = {
    "hash": lambda s: A.block(s, "ab"), "height": lambda s: A.block_by_height(s, 5), "tx_n": lambda s: A.confirmed_transaction(s, 5, 1), "txid": lambda s: A.transaction(s, "ab"),
    "spending_txid": lambda s: A.transaction_input(s, "ab", 0), "n": lambda s: A.transaction_output(s, "ab", 0), "address": lambda s: A.address_transactions(s, "x"), "day": lambda s: A.day_gainers(s, "2012-01-01"),
}


@pytest.mark.parametrize("column", LOOKUPS)
def test_conditions_reach_the_files(spark, column):
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    plan = LOOKUPS[column](A.open_store(spark, DATA))._jdf.queryExecution().executedPlan().toString()
    pushed = re.findall(r"PushedFilters: \[(.*?)\]", plan)
    assert pushed and all(f"EqualTo({column}," in p for p in pushed)
    assert "Exchange hashpartitioning" not in plan  # nothing is cleaned or grouped at the time of a lookup


def test_stored_tables_are_sorted_by_key(spark):
    s = A.open_store(spark, DATA)
    for name, order in A.ORDER.items():
        t = getattr(s, name)
        at = t.select(F.input_file_name().alias("f"), order[0]).groupBy("f").agg(F.min(order[0]).alias("lo"), F.max(order[0]).alias("hi")).where("lo is not null").orderBy("lo").collect()
        assert all(a.hi <= b.lo for a, b in zip(at, at[1:])), name


def test_one_copy_is_kept_whole(spark):
    rows = [("k", 1, None, None), ("k", 2, "a", None), ("k", 1, "b", None), (None, 9, "z", "z"), ("l", None, None, None), ("l", None, None, None)]
    got = {r.key: (r.x, r.y, r.z) for r in A.one_copy(spark.createDataFrame(rows, "key string, x int, y string, z string"), "key").collect()}
    assert got == {"k": (2, "a", None), "l": (None, None, None)}


def test_live_lookups_on_an_empty_pool(spark):
    v = order_live(spark, DATA)
    empty = L.Live(L.Pool(*(df.limit(0) for df in (v.pool.tx, v.pool.inputs, v.pool.outputs))), v.hot, v.outputs, v.address_transaction, v.address_balance, v.confirmed)
    assert tuple(L.pool_totals_of(empty).first()) == (0, 0) and L.pool_page(empty, 5).count() == 0
    assert L.address_pool_page(empty, "nobody", 5).count() == 0 and L.address_transactions(empty, "nobody", 5).count() == 0


def test_hot_rows_hide_their_stored_copies(spark):
    v = order_live(spark, DATA)
    a = ledger._warm(v)
    stale = L.hot_deltas(v).withColumn("change_sats", F.lit(-1).cast("bigint"))
    copied = L.Live(v.pool, v.hot, v.outputs, v.address_transaction.unionByName(stale), v.address_balance, v.confirmed)
    want = [tuple(r) for r in L.address_transactions(v, a, 100).orderBy("ts", "height", "tx_n").collect()]
    assert [tuple(r) for r in L.address_transactions(copied, a, 100).orderBy("ts", "height", "tx_n").collect()] == want and len(want) > 1
