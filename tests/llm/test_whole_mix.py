from pyspark.sql import functions as F

from chainloom.llm import mixing, queries
from chainloom.sources.tables import table
from tests.oracle import DATA


def test_capped_sources_fall_short(spark):
    targets = table(spark, DATA, "mix_target")
    want = mixing.read_targets(targets)
    sizes = mixing.token_sizes(table(spark, DATA, "documents"), list(want))
    longest = sizes.agg(F.max("tokens")).first()[0]
    sizes = {r.source: r.n for r in sizes.groupBy("source").agg(F.sum("tokens").alias("n")).collect() if r.n}
    got = {r.source: r for r in queries.QUERIES["p9_whole_shares"](spark, DATA).collect()}
    total, budget = sum(r.tokens for r in got.values()), sum(sizes.values())
    assert budget - longest < total <= budget
    assert total > queries.QUERIES["p9_mix"](spark, DATA).agg(F.sum("tokens")).first()[0]
    short = [s for s in sizes if got[s].tokens == sizes[s] * want[s].repeats]
    assert short and all(got[s].share < got[s].target_share for s in short)
