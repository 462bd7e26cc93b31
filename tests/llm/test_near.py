from chainloom.llm import leaks, queries
from tests.oracle import DATA


def test_near_windows_are_reported_with_their_size(spark, tmp_path):
    words = [f"word{i}" for i in range(60)]
    other = words[:2] + ["else"] + words[3:50] + ["else"] + words[51:]
    apart = [w for i in range(0, 60, 11) for w in [*words[i : i + 11], "else"]]  # 11 equal words at a time
    docs = [(1, " ".join(words), "en"), (2, " ".join(other), "en"), (3, " ".join(words[5:19]), "en"), (4, " ".join(apart), "en"), (5, None, None)]
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(7, " ".join(words), "", "b", "s")], "item_id bigint, passage string, question string, benchmark string, split string").coalesce(1).write.parquet(f"{tmp_path}/eval_item.parquet")
    got = {r.doc_id: (r.exact, r.size, r.run_words) for r in queries.QUERIES["p8_near"](spark, str(tmp_path)).collect()}
    assert got == {1: (True, 48, 60), 2: (True, 48, 47), 3: (True, 12, 14)}
    rows = leaks.leaks(spark.read.parquet(f"{tmp_path}/documents.parquet"), spark.read.parquet(f"{tmp_path}/eval_item.parquet")).collect()
    assert {r.size for r in rows if r.doc_id == 2} == {12, 24, 48} and all(r.similarity >= 0.8 for r in rows)
    lower = leaks.leaks(spark.read.parquet(f"{tmp_path}/documents.parquet"), spark.read.parquet(f"{tmp_path}/eval_item.parquet"), least=0.3)
    assert lower.where("doc_id = 4").selectExpr("max(run_words)").first()[0] == 0


def test_equal_pairs_are_those_of_p8_found(spark, rows):
    near = queries.QUERIES["p8_near"](spark, DATA)
    assert rows(near.where("exact").select("doc_id", "item_id")) == rows(queries.QUERIES["p8_found"](spark, DATA))
