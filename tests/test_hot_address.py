"""An address with nine tenths of the rows."""

from datetime import UTC, datetime, timedelta

from pyspark.sql import functions as F

from chainloom.operators import balances as B


def test_no_task_sorts_all_rows_of_an_address(spark):
    start = datetime(2012, 1, 1, tzinfo=UTC)
    rows = [("hot" if k % 10 else f"cold{k}", start + timedelta(minutes=7 * k), (k * 37) % 101 - 50) for k in range(6000)]
    df = spark.createDataFrame([*rows, (None, start, 5), ("none", start, None)], "address string, ts timestamp, delta_sats bigint")
    balance, want = {}, {}
    for a, t, v in rows:
        balance[a] = balance.get(a, 0) + v
        want[a, t.replace(tzinfo=None)] = balance[a]
    got = {(x.address, x.ts): x.balance_sats for x in B.running_balances(df).collect()}
    assert {k: got[k] for k in want} == want and got[None, start.replace(tzinfo=None)] == 5 and got["none", start.replace(tzinfo=None)] == 0
    per_day = {}
    for (a, t), b in want.items():
        per_day.setdefault((a, t.date()), []).append(b)
    last = {}
    for d in B.days(df).where("address is not null and address <> 'none'").orderBy("address", "day").collect():
        course = [last.get(d.address, 0), *per_day[d.address, d.day]]
        assert (d.open, d.high, d.low, d.close) == (course[0], max(course), min(course), course[-1])
        last[d.address] = course[-1]
    asked = spark.createDataFrame([("hot", start + timedelta(days=d, minutes=m)) for d in range(40) for m in (0, 8, 700)], "address string, ts timestamp")
    for x in B.balance_before(asked, B.running_balances(df)).collect():
        before = [b for (a, t), b in want.items() if a == "hot" and t < x.ts]
        assert x.balance_sats == (before[-1] if before else None)
    plan = B.days(df)._jdf.queryExecution().toString()
    assert "hashpartitioning(address" in plan
    # The largest group that a task orders: the times of one day, not the 5,400 rows of the address.
    sizes = df.groupBy("address", B.utc_day(F.col("ts"))).count().agg(F.max("count")).first()[0]
    assert sizes < 200
    windows = [line for line in plan.splitlines() if "Window [sum(delta_sats" in line]
    assert windows and all("[address" in w and "day" in w.split("windowspecdefinition")[-1] for w in windows)
