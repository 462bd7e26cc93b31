"""A name that many blocks repeat, and what the documents of the fixture shuffle."""

from chainloom.operators import chain as C
from chainloom.sources.orders import order_blocks, orders_chain
from tests.oracle import DATA


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_inputs_are_not_paired_with_every_output_of_their_name(spark):
    made = [("a", h, k, n, None if (h, n) == (7, 0) else 100 * h + 10 * k + n, [f"x{h}-{k}-{n}"]) for h in range(0, 40, 2) for k in (0, 3) for n in (0, 1)]
    made += [("b", 5, 1, 0, None, ["nothing"]), ("b", 4, 1, 0, 9, None), (None, 0, 0, 0, 77, ["unnamed"])]
    asked = [(f"s{k % 3}", h, k, k % 2, t, n) for h in range(41) for k in range(5) for t, n in (("a", k % 2), ("a", 2), ("b", 0), ("c", 0), (None, 0))]
    asked += [("once", 3, 1, 0, "a", None)]
    txo = spark.createDataFrame(made, "txid string, height int, tx_n int, n int, value_sats bigint, addresses array<string>")
    txi = spark.createDataFrame(asked, "spending_txid string, height int, tx_n int, spending_index int, txid string, n int")
    df = C.spent_outputs(C.Chain(txo, txo, txi))
    # Inputs of one key are one row, that of the one furthest back in the block.
    want = {}
    for s, h, k, i, t, n in sorted(asked, key=lambda x: x[2]):
        before = [m for m in made if t is not None and (m[0], m[3]) == (t, n) and m[1:3] < (h, k)]
        want[s, h, i, t, n] = max(before, key=lambda m: m[1:3])[4:] if before else (None, None)
    got = {(x.spending_txid, x.height, x.spending_index, x.txid, x.n): (x.value_sats, x.addresses) for x in df.collect()}
    assert got == want and df.count() == len(want)
    assert want["s0", 6, 0, "b", 0] == (None, ["nothing"]) and want["s0", 5, 0, "b", 0] == (9, None) and want["s1", 4, 0, "a", 0] == (430, ["x4-3-0"])
    assert "Join" not in plan(df)


def test_documents_shuffle_only_what_they_hold(spark, rows):
    c, f = orders_chain(spark, DATA), C.flatten(order_blocks(spark, DATA))
    out = lambda c: rows(c.txo.selectExpr("string(txid)", "n", "value_sats", "addresses[0]"))
    spent = lambda c: rows(c.txi.selectExpr("string(spending_txid)", "spending_index", "string(txid)", "n"))
    assert out(c) == out(f) and spent(c) == spent(f)
    p = plan(order_blocks(spark, DATA))
    assert "l_quantity" in p and "l_extendedprice" not in p and "l_shipdate" not in p
    assert p.count("Exchange hashpartitioning") <= 5
