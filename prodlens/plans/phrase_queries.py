"""Queries of the phrase operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed_values as fixed
from ..functions import text as T
from ..operators import phrases as P
from ..sources import sinks
from . import sql_text as S


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.corpus(table(spark, sf_dir, "documents"))


def _important(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.with_importance(P.merged_variants(P.united(_docs(spark, sf_dir))))


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A keep-list: the words of the benchmark."""
    return table(spark, sf_dir, "benchmark").select(F.explode(F.split(T.squeezed(F.col("text")), " ")).alias("name"))


COLUMNS = ["phrase", "doc_freq", "total_occurrences", "tfidf_score", "source", "importance_score"]
FREQUENT = f"""with {S.corpus()},
  w as (select doc_id, list_filter(string_split({S.squeezed("lower(text)")}, ' '), lambda w: w <> '') as w from corpus),
  g as (select doc_id, unnest(list_filter({S.grams("w")}, lambda p: len(list_filter(string_split(p, ' '), lambda x: not list_contains({S.lst(sorted({*fixed.FALLBACK_STOP_WORDS, *fixed.GENERIC_WORDS}))}, x))) > 0)) as phrase from w),
  c as (select phrase, count(distinct doc_id) as doc_freq, count(*) as total_occurrences from g group by phrase having count(distinct doc_id) >= 2)
  select phrase, round(total_occurrences * (ln((select count(*) from corpus)::double / (doc_freq + 1)) + 1), 4) as tfidf_score, doc_freq, total_occurrences from c order by doc_freq desc, tfidf_score desc, phrase limit 200"""
NAMES = "names as (select distinct lower(unnest(string_split(" + S.squeezed("text") + ", ' '))) as name from benchmark)"

#: name: (query, SQL)
DEFINED = {
    "clean_corpus": (lambda s, d: _docs(s, d), f"with {S.corpus()} select * from corpus"),
    "marketing_strip": (
        lambda s, d: table(s, d, "documents").select("doc_id", F.concat(F.lit("Buy online or instore: "), F.col("text"), F.lit(" &amp; free shipping! https://x.example/y 5 kg – a W"))).toDF("doc_id", "t").select("doc_id", T.cleaned(F.col("t")).alias("text")),
        f"select doc_id, {S.cleaned("'Buy online or instore: ' || text || ' &amp; free shipping! https://x.example/y 5 kg – a W'")} as text from documents",
    ),
    "unit_word_filter": (
        lambda s, d: table(s, d, "part").select("p_partkey", T.cleaned(F.concat_ws(" ", "p_name", F.col("p_size").cast("string"), F.lit("w q % °c x l"))).alias("text")),
        f"select p_partkey, {S.cleaned("p_name || ' ' || p_size || ' w q % °c x l'")} as text from part",
    ),
    "tfidf_top_phrases": (lambda s, d: P.tfidf(_docs(s, d)).drop("rank"), f"with {S.tfidf()} select phrase, tfidf_score, doc_freq, total_occurrences from counted"),
    "tfidf_rank": (lambda s, d: P.tfidf(_docs(s, d), occurrences=False), f"with {S.tfidf()} select phrase, tfidf_score, doc_freq, row_number() over (order by doc_freq desc, tfidf_score desc, phrase)::int as rank from best"),
    "tfidf_fallback": (lambda s, d: P.frequent_phrases(_docs(s, d)), FREQUENT),
    "phrase_high_both": (lambda s, d: P.filtered(_important(s, d), "", "high", "both").select("phrase", "importance_score"), f"with {S.merged()} select phrase, importance_score from important where importance_score >= 70 and source = 'both'"),
    "tfidf_tiny_corpus": (
        lambda s, d: P.phrases_of(P.corpus(table(s, d, "region").select(F.col("r_regionkey").alias("doc_id"), F.concat(F.lit("steel kettle "), F.lower("r_name")).alias("text")).filter("doc_id < 2"))),
        f"with documents as (select r_regionkey as doc_id, 'steel kettle ' || lower(r_name) as text from region where r_regionkey < 2), {FREQUENT.removeprefix('with ')}",
    ),
    "corpus_sizes": (lambda s, d: P.corpus_sizes(table(s, d, "documents"), _docs(s, d)), f"with {S.corpus()} select (select count(*) from documents) as products_analyzed, count(*) as corpus_size from corpus"),
    "vocab_cap": (lambda s, d: P.vocabulary(_docs(s, d), 2, 0.85, 5000)[0], f"with {S.tfidf()} select phrase, df, total::bigint as total from voc"),
    "noun_phrases_heuristic": (lambda s, d: P.noun_phrases(_docs(s, d)), f"with {S.corpus()}, {S.nouns()} select *, string_split(phrase, ' ')[-1] as root_word from noun"),
    "phrase_merge": (lambda s, d: P.united(_docs(s, d)), f"with {S.merged()} select * from united"),
    "phrase_roots": (lambda s, d: table(s, d, "part").select("p_partkey", T.phrase_root(F.concat(F.lower("p_name"), F.lit(" series boxes glasses pressing pressed ties boxed"))).alias("root")), f"select p_partkey, {S.root("lower(p_name) || ' series boxes glasses pressing pressed ties boxed'")} as root from part"),
    "phrase_variants": (lambda s, d: P.merged_variants(P.united(_docs(s, d))), f"with {S.merged()} select * from variants"),
    "importance_rank": (lambda s, d: P.ranked(_important(s, d), 200).select(*COLUMNS), f"with {S.merged()} select {', '.join(COLUMNS)} from important order by importance_score desc, key limit 200"),
    "importance_buckets": (
        lambda s, d: P.buckets(_important(s, d)).select("bucket", "pos", "phrase", "importance_score"),
        f"with {S.merged()}, r as (select *, case when importance_score >= 70 then 'high' when importance_score >= 40 then 'medium' else 'low' end as bucket from important), n as (select *, row_number() over (partition by bucket order by importance_score desc, key)::int as pos from r) select bucket, pos, phrase, importance_score from n where pos <= 100",
    ),
    "source_stats": (lambda s, d: P.source_counts(_important(s, d)), f"with {S.merged()} select count(*) as total, count_if(source = 'tfidf')::bigint as n_tfidf, count_if(source = 'spacy')::bigint as n_spacy, count_if(source = 'both')::bigint as n_both from important"),
    "phrase_page": (lambda s, d: P.paged(_important(s, d), "phrase", False, 2).select("phrase", "importance_score"), f"with {S.merged()} select phrase, importance_score from important order by lower(phrase), phrase limit 50 offset 50"),
    "phrase_ui_filters": (
        lambda s, d: P.filtered(_important(s, d), "E", "medium").select("phrase", "importance_score"),
        f"with {S.merged()} select phrase, importance_score from important where contains(lower(phrase), 'e') and importance_score >= 40 and importance_score < 70",
    ),
    "keep_list_semi": (lambda s, d: P.kept_terms(P.tfidf(_docs(s, d), occurrences=False), _names(s, d)).select("phrase", "doc_freq"), f"with {S.tfidf()}, {NAMES} select phrase, doc_freq from best where lower(phrase) in (select name from names)"),
    "noise_anti": (lambda s, d: P.dropped_terms(P.tfidf(_docs(s, d), occurrences=False), _names(s, d)).select("phrase", "doc_freq"), f"with {S.tfidf()}, {NAMES} select phrase, doc_freq from best where lower(phrase) not in (select name from names)"),
    "select_keywords": (lambda s, d: P.selected_keywords(_important(s, d)), f"with {S.merged()}, t as (select * from important order by importance_score desc, tfidf_score desc, phrase limit 8) select lower(phrase) as keyword, max(importance_score) as importance_score from t group by 1"),
    "edge_stop_words": (
        lambda s, d: table(s, d, "part").select("p_partkey", T.edge_trimmed(F.concat(F.lit("  The new great "), F.col("p_name"), F.lit(", the best!"))).alias("phrase")),
        f"select p_partkey, regexp_replace(lower(p_name), '^(?:(?:{'|'.join(fixed.EDGE_WORDS)}) )+', '') || ',' as phrase from part",
    ),
    "export_csv_rows": (
        lambda s, d: sinks.phrase_rows(P.ranked(_important(s, d), 200)),
        f"with {S.merged()} select phrase as \"Phrase\", round(importance_score, 2) as \"Importance\", round(tfidf_score, 4) as \"TFIDF\", doc_freq as \"DocFreq\", total_occurrences as \"Occurrences\", source as \"Source\" from important order by importance_score desc, key limit 200",
    ),
}
