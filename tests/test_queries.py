import pytest

from chainloom.queries import api, ledger, problems, streams
from tests.oracle import DATA, same

MODULES = (api, ledger, problems, streams)
WITH_SQL = [(n, f, m.SQL[n]) for m in MODULES for n, f in m.QUERIES.items() if n in m.SQL]


@pytest.mark.parametrize("name,query,sql", WITH_SQL, ids=[x[0] for x in WITH_SQL])
def test_against_sql(spark, name, query, sql):
    same(spark, name, query, sql)


def test_report_adds_up(spark):
    r = problems.p7_report(spark, DATA).toPandas()
    direct = problems.p7_found(spark, DATA).count()
    assert r[r.tbl == "transaction_input"].direct.sum() >= direct
    assert (r.direct + r.inherited <= r.refs).all()


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
