"""Hybrid extraction, request caching, page dispatch and dictionaries, against written-out values."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from prodlens.functions import text as T
from prodlens.html import extract as H
from prodlens.operators import entities as E
from prodlens.operators import hybrid
from prodlens.sources import connectors
from prodlens.streaming import dedupe


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("text", "category"),
    [("pocky chocolate", "Food"), ("wine glass", "Drinkware"), ("bike short with pocket", "Apparel"), ("leather handbag", None), ("oak table and chair", "Furniture"), ("microwave safe bowl", None), ("yoga and gym", "Sports"), ("", None)],
)
def test_categories_as_written(spark, text, category):
    assert value(spark, E.best_category(F.lit(text))) == category


def test_materials_of_a_category(spark):
    names = lambda text, category: [e.name for e in value(spark, E.materials(F.lit(text), category=F.lit(category)))]
    assert names("linen and copper box", "Food") == []
    assert names("linen and copper box", "Drinkware") == []
    assert names("linen and copper box", "Footwear") == ["Linen"]
    assert names("linen and copper box", "Decor") == ["Copper", "Linen"]


def test_an_alias_counts_once(spark):
    entries = [("a", "aluminium", ["alloy"]), ("b", "magnesium", ["alloy"]), ("c", "alloy", [])]
    found = lambda t: [e.name for e in value(spark, E.from_dictionary(F.lit(t), entries, "finish", 5))]
    assert found("light alloy") == ["Aluminium"]
    assert found("magnesium alloy") == ["Aluminium", "Magnesium"]


@pytest.mark.parametrize("answer", [None, "", "no json", "[]", "{}", '{"faqs": []}', '{"llm_entities": 3'])
def test_unusable_answers(spark, answer):
    got = value(spark, hybrid.parsed(F.lit(answer).cast("string")))
    assert not got.success and got.llm_entities == [] and got.confidence == 0.0


@pytest.mark.parametrize(("said", "confidence"), [("0.4", 0.4), ("7", 1.0), ("{}", 0.5), ('{"primary_entity": 0.2}', 0.35), ("[]", 0.0)])
def test_confidence_of_an_answer(spark, said, confidence):
    assert value(spark, hybrid.parsed(F.lit(f'{{"llm_entities": [], "confidence": {said}}}'))).confidence == pytest.approx(confidence)


def test_retries_show_the_bad_answer():
    talks = []

    def complete(talk):
        talks.append(talk)
        return "oops" if len(talks) == 1 else json.dumps({"llm_entities": []})

    assert connectors.repaired(complete)("q") == '{"llm_entities": []}'
    assert [m["role"] for m in talks[1]] == ["user", "assistant", "user"] and talks[1][1]["content"] == "oops"
    assert connectors.repaired(lambda talk: "[1]")("q") is None


def brute_stored(times, ttl):
    out, last = [], None
    for t in times:
        out.append(last is None or t - last >= ttl)
        last = t if out[-1] else last
    return out


def test_entries_expire_from_storing():
    assert dedupe.stored(np.array([0, 4, 5, 9, 10]), 5)[0].tolist() == [True, False, True, False, True]
    r = np.random.default_rng(3)
    for _ in range(50):
        times = np.sort(r.integers(0, 200, r.integers(0, 60)))
        cut = len(times) // 2
        first, last = dedupe.stored(times[:cut], 17)
        assert [*first, *dedupe.stored(times[cut:], 17, last)[0]] == brute_stored(times.tolist(), 17)


def test_stream_stores_as_batch(spark, tmp_path):
    rows = [(i, f"u{i % 3}", 10**6 + i * 70) for i in range(40)] + [(99, None, 5)]  # a stream drops events at 1970 itself as late
    events = spark.createDataFrame(rows, "event_id long, k string, at long").withColumn("ts", F.timestamp_seconds("at"))
    want = sorted((r.k, r.at) for r in dedupe.first_in_window(events, "k", "ts", 300).collect())
    times = {u: [10**6 + i * 70 for i in range(40) if i % 3 == u] for u in range(3)}
    assert want == sorted((f"u{u}", t) for u, own in times.items() for t, s in zip(own, brute_stored(own, 300)) if s)
    events.filter("k is not null").coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = dedupe.deduplicated(spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in"), "k", "ts")
    run = stream.writeStream.format("memory").queryName("stored").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/c").start()
    run.awaitTermination(120)
    assert sorted((r.k, r.at) for r in spark.table("stored").select("k", F.unix_seconds("ts").alias("at")).collect()) == want


def fetch(url):
    if "gone" in url:
        raise OSError
    return 200, "Just a moment" if "wall" in url else f"<html><title>Teak Table</title><meta name='description' content='A teak table with a long top for every garden and room.'><h1>Teak Table</h1></html>"


def rendered(url):
    return 200, "Just a moment" if "high" in url else "<html><title>Teak Table</title><meta name='description' content='Rendered teak table with a long top for every garden.'></html>"


def test_pages_fail_and_are_rendered(spark):
    urls = spark.createDataFrame([("http://a",), ("http://gone",), ("http://wall",), ("http://high-wall",), ("",), (None,)], "url string")
    got = {r.url: r.extraction_method for r in connectors.pages(urls, fetch, rendered).collect()}
    assert got == {"http://a": "meta_fallback", "http://gone": "fetch_fail", "http://wall": "meta_fallback", "http://high-wall": "blocked", "": got[""], None: None}
    assert {r.url: r.extraction_method for r in connectors.pages(urls.limit(3), fetch).collect()}["http://wall"] == "blocked"


def test_dictionaries_from_json(spark):
    text = '{"metal": {"Steel": {"aliases": ["Inox"], "description": "d"}, "tin": {}}, "wood": {"Oak": {}}}'
    entries = connectors.dictionary(connectors.read_dictionary(spark.createDataFrame([(text,)], "value string")))
    assert entries == [("metal", "steel", ["inox"], "d"), ("metal", "tin", [], None), ("wood", "oak", [], None)]
    assert [e.name for e in value(spark, E.materials(F.lit("an inox box of oak"), entries))] == ["Steel", "Oak"]


@pytest.mark.parametrize(("text", "title"), [("A steel kettle", "Steel Kettle"), ("", "x"), ("short", "Completely Different Words Here"), ("kettle only", "steel kettle of brass and tin")])
def test_both_forms_of_relevance_agree(spark, text, title):
    assert value(spark, T.is_relevant(F.lit(text), F.lit(title))) == H.relevant(text, title)


@pytest.mark.parametrize("label", ["Description", "about this item", "key features", "zzz", "product details and more", ""])
def test_both_forms_of_heading_score_agree(spark, label):
    assert value(spark, T.heading_score(F.lit(label))) == pytest.approx(H.heading_score(label.lower()))


@pytest.mark.parametrize(("method", "n"), [("jsonld", 10), ("meta_fallback", 300), ("best_block", 600), ("main_product_section", 60)])
def test_both_forms_of_confidence_agree(spark, method, n):
    assert value(spark, T.method_confidence(F.lit(method), F.lit("x" * n))) == pytest.approx(H.confidence("x" * n, method))
