from chainloom.operators import hierarchy
from chainloom.plans.shared import Shared
from chainloom.queries import problems
from tests.oracle import DATA, views


def test_paths_and_intervals_over_whole_tables(spark, rows):
    t = problems.QUERIES["p1_paths"](spark, DATA).selectExpr("concat(tbl, ':', node) AS node", "concat(tbl, ':', root) AS root", "depth", "chain", "pos", "path", "first", "last")
    t = Shared(spark, "paths").table(t)
    ancestors = "SELECT a.tbl || ':' || a.node, CAST(t.depth AS BIGINT), a.tbl || ':' || a.up FROM anc a JOIN tree t ON t.tbl = a.tbl AND t.node = a.up"
    sql = problems.SQL["p1_tree"].split("below AS")[0].rstrip().rstrip(",") + ancestors
    want = sorted(views().execute(sql).fetchall())
    assert rows(hierarchy.path_nodes(t, t)) == want
    for span in (7, hierarchy.SPAN):
        assert rows(hierarchy.descendants_of(t, t, span)) == sorted((up, node) for node, _, up in want if node != up)


def test_children_of_a_hot_parent(spark, monkeypatch):
    monkeypatch.setattr(hierarchy, "SIBLINGS", 3)
    links = {"star": None, "sub": "star", "x": "sub"} | {f"leaf{i}": "star" for i in range(40)} | {f"low{i}": f"leaf{i}" for i in range(9)}
    got = {x.node: x for x in hierarchy.hierarchy(spark.createDataFrame(list(links.items()), "node string, parent string")).collect()}
    assert sorted(x.first for x in got.values()) == list(range(len(links)))
    below = {n: {m for m, x in got.items() if got[n].first < x.first <= got[n].last} for n in links}
    assert below["star"] == set(links) - {"star"} and below["sub"] == {"x"} and below["leaf8"] == {"low8"} and below["leaf9"] == set()
    ends = {x.node: x.root for x in hierarchy.ends_of(spark.createDataFrame([*links.items(), ("p", "q"), ("q", "p"), ("r", "q"), ("m", "m"), ("n", "gone")], "node string, parent string")).collect()}
    assert ends == dict.fromkeys(links, "star") | {"p": "p", "q": "p", "r": "p", "m": "m", "n": "n"}
