"""The pipeline's stages on a small corpus."""

from pyspark.sql import functions as F

import corpus_pipeline
from prodlens.llm import near_dup

from .test_operators import language_texts


def test_stages(spark, tmp_path):
    item = "one two three four five six seven eight nine ten eleven twelve"
    texts = [*language_texts(), *language_texts()[:5], f"the house and {item} the road", "123 456", None, "the road and mail jo.doe42@site.example of the house is nice"]
    rows = [(i, t, "en" if i % 2 else "de", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == columns, name
    out = corpus_pipeline.run(spark, str(tmp_path))
    kept = {r.doc_id: r for r in out.collect()}
    assert not {205, 206, 207} & set(kept)
    assert not set(range(200, 205)) & set(kept)  # copies of the first ones
    assert "jo.doe42@" not in kept[208].text and "site.example" in kept[208].text
    assert set(out.columns) == {*columns, "mix_tokens", "mix_rate", "mix_copies"}
    assert out.filter(F.col("mix_rate") < 0).count() == 0


def test_language_stage_rejects_by_the_code_and_needs_no_labels(spark):
    texts = [*language_texts(), "Это русский текст о погоде и доме", "这是一个中文文本", "123 456", None]
    docs = spark.createDataFrame([(i, t, "en" if i % 2 else "de") for i, t in enumerate(texts[:200])] + [(i, t, None) for i, t in enumerate(texts) if i >= 200], "doc_id long, text string, lang string")
    kept = lambda df: sorted(r.doc_id for r in corpus_pipeline.keep_languages(spark, df, "").collect())
    assert kept(docs) == list(range(200))
    assert kept(docs.withColumn("lang", F.lit(None).cast("string"))) == list(range(202))


def test_null_and_repeated_ids_are_judged_by_row(spark, tmp_path):
    item = "one two three four five six seven eight nine ten eleven twelve"
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    one, other, third = "the house and road of the nice kettle is iron", "a lamp in the steam was red and then it was green", "no text is like this one in all of the corpus"
    rows = [(None, one), (7, one), (3, one), (3, other), (3, f"see {item}"), (None, f"see {item} too"), (None, third), (None, third), (5, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    pairs = lambda df: sorted(((r.doc_id, r.text) for r in df.collect()), key=str)
    assert pairs(corpus_pipeline.without_benchmark(spark, docs, str(tmp_path))) == sorted((r for r in rows if item not in (r[1] or "")), key=str)
    assert pairs(corpus_pipeline.one_of_each_group(spark, docs.filter(~F.coalesce(F.col("text").contains(item), F.lit(False))), "")) == sorted([(3, one), (3, other), (None, third), (5, None)], key=str)


def test_texts_do_not_move_where_few_rows_go(spark, tmp_path, monkeypatch):
    """Whatever Spark itself would broadcast; beyond the bound the same rows come by shuffle."""
    item = "one two three four five six seven eight nine ten eleven twelve"
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    texts = [*language_texts()[:20], *language_texts()[:3], f"see {item}", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    monkeypatch.setattr(corpus_pipeline.Scratch, "free", lambda self, *frames: None)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for most in (near_dup.BROADCAST_ROWS, 0):
            monkeypatch.setattr(near_dup, "BROADCAST_ROWS", most)
            for stage, gone in ((corpus_pipeline.one_of_each_group, {20, 21, 22}), (corpus_pipeline.without_benchmark, {23})):
                out = stage(spark, docs, str(tmp_path))
                assert {r.doc_id for r in out.collect()} == set(range(len(texts))) - gone
                assert ("SortMergeJoin" in out._jdf.queryExecution().executedPlan().toString()) == (most == 0), stage
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
