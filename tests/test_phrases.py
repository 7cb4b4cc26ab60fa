"""The corpus step of phrase mining."""

from prodlens.operators import phrases as P


def test_corpus_drops_texts_without_words(spark):
    df = spark.createDataFrame([(1, "Buy now! Teak Table"), (2, None), (3, ""), (4, " \t "), (5, "https://a.example/x"), (6, "Steel frame")], "doc_id long, text string")
    got = {r.doc_id: r.text for r in P.corpus(df).collect()}
    assert set(got) == {1, 6}
    assert got[6] == "steel frame"


def test_corpus_of_an_empty_table(spark):
    assert P.corpus(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_corpus_cleans_above_the_spread(spark, tmp_path):
    spark.createDataFrame([(1, "Teak Table")], "doc_id long, text string").write.parquet(f"{tmp_path}/t")
    df = spark.read.parquet(f"{tmp_path}/t")
    plan = P.corpus(df)._jdf.queryExecution().optimizedPlan().toString()
    above, below = plan.split("Repartition", 1)
    assert "regexp_replace" in above and "regexp_replace" not in below
