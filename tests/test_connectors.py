"""Connectors and writers on stored responses."""

import json

from pyspark.sql import functions as F

from prodlens.operators import search
from prodlens.sources import connectors as C
from prodlens.sources import sinks


def test_search_responses(spark):
    hit = {"title": "Kettle", "price": "$5", "source": "Shop", "product_link": "http://p"}
    bodies = [("q1", json.dumps({"immersive_products": [hit, {"title": None}], "shopping_results": [hit] * 3})), ("q2", json.dumps({"immersive_products": [], "shopping_results": [hit]})), ("q3", "{}")]
    df = spark.createDataFrame(bodies, "query_key string, body string")
    hits = C.search_hits(df)
    assert sorted((r.query_key, r.pos, r.link) for r in hits.collect()) == [("q1", 0, "http://p"), ("q2", 0, "http://p")]
    more = C.with_fallback(hits, spark.createDataFrame([("q3", 0, "Lamp"), ("q1", 0, "Pot")], "query_key string, pos int, title string"))
    assert sorted((r.query_key, r.title) for r in more.collect()) == [("q1", "Kettle"), ("q2", "Kettle"), ("q3", "Lamp")]


def test_pages_and_scrapes(spark):
    rows = [(200, ' {"html": "<p>x</p>"} '), (200, "<p>y</p>"), (404, "no"), (200, " "), (200, None)]
    df = spark.createDataFrame(rows, "status int, body string").select(C.page_body(F.col("status"), F.col("body")).alias("h"))
    assert [r.h for r in df.collect()] == ["<p>x</p>", "<p>y</p>", None, None, None]
    body = json.dumps({"extract": {"product_name": "Kettle", "features": [{"heading": "a", "description": "b"}]}})
    got = spark.createDataFrame([(body,)], "b string").select(C.scraped(F.col("b")).alias("s")).first().s
    assert got.product_name == "Kettle" and got.features[0].heading == "a"


def test_fetch_and_complete(spark):
    urls = spark.createDataFrame([("a",), ("a",), (None,), ("bad",)], "url string")

    def fetch(url):
        if url == "bad":
            raise OSError
        return 200, f"<p>{url}</p>"

    assert sorted((r.url or "", r.status) for r in C.fetched(urls, fetch).collect() if r.url) == [("a", 200), ("a", 200), ("bad", 0)]
    prompts = urls.withColumnRenamed("url", "prompt")
    assert {r.completion for r in C.completed(prompts, None).collect()} == {None}
    assert {r.completion for r in C.completed(prompts, str.upper).collect()} == {"A", "BAD", None}


def test_writers(spark, tmp_path):
    phrases = spark.createDataFrame([("steel kettle", 71.256, 1.23456, 3, 4, "both")], "phrase string, importance_score double, tfidf_score double, doc_freq long, total_occurrences long, source string")
    sinks.write_csv(phrases, f"{tmp_path}/csv")
    assert spark.read.csv(f"{tmp_path}/csv", header=True).first().Importance == "71.26"
    text = phrases.select(sinks.report(F.lit("Kettle"), F.lit(None).cast("string"), F.lit("two words"), F.array(F.col("phrase"))).alias("report"))
    assert "Words: 2" in text.first().report and "Price" not in text.first().report
    sinks.write_reports(text, f"{tmp_path}/txt")
    assert spark.read.text(f"{tmp_path}/txt").count() > 5


def test_top_up(spark):
    rows = [(1, i, i % 2 == 0) for i in range(30)]
    got = search.topped_up(spark.createDataFrame(rows, "batch int, idx int, ok boolean")).collect()
    assert sorted(r.idx for r in got) == list(range(0, 16, 2))
