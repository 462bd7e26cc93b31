"""A query and its DuckDB SQL over the same tables."""

import os

import duckdb

DATA = os.environ.get("TEST_DATA", "/root/testdata/sf0.001")


def views():
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for f in os.listdir(DATA):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS FROM '{DATA}/{f}'")
    return c


def _value(v):
    if v is None or isinstance(v, float) and v != v:
        return None
    return f"{v:.6f}" if isinstance(v, float) else str(v).removesuffix("+00:00")


def same(spark, name, query, sql) -> None:
    got = query(spark, DATA)
    names = sorted(got.columns)
    mine = sorted(repr([_value(v) for v in r]) for r in got.select(names).collect())
    cursor = views().execute(sql)
    theirs = [d[0] for d in cursor.description]
    assert sorted(theirs) == names, name
    order = [theirs.index(n) for n in names]
    want = sorted(repr([_value(r[i]) for i in order]) for r in cursor.fetchall())
    assert mine == want, f"{name}: {len(mine)} rows, {len(want)} by SQL"
