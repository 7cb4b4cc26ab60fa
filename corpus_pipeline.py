"""Corpus pipeline: language ID, near-duplicates, decontamination, pseudonyms, mixing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.
run() writes each stage's rows to the shared folder as Parquet and reads them again for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prodlens.llm import contamination, language_id, mixing, near_dup, pseudonyms
from prodlens.llm.queries import PSEUDONYM_KEY
from prodlens.llm.scratch import Scratch


def _keyed(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """docs with a number for each row, written so that it stays. Ids may be null or repeated."""
    return Scratch(spark, "rows").keep(docs.withColumn("row_key", F.monotonically_increasing_id()))


def _without(spark: SparkSession, rows: DataFrame, keys: DataFrame) -> DataFrame:
    """rows but those of keys (row_key). Texts stay where they are unless many rows go."""
    return rows.join(near_dup.small(Scratch(spark, "keys").keep(keys)), "row_key", "left_anti")


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language; those without a letter, and those far from every language's codeword, go.

    Where no text has a language nothing is learned, and only those without a letter go.
    """
    model = language_id.fit(docs)
    if model is None:
        return docs.filter(F.col("text").rlike("\\p{L}"))
    found = language_id.identified(docs, model, far=language_id.FAR)
    return found.filter("lang_pred <> 'und'").select(docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each near-duplicate group the row with the smallest id; one without an id only where all are."""
    rows = _keyed(spark, docs)
    groups = near_dup.near_duplicates(rows, "row_key").select("row_key", "component_id").join(rows.select("row_key", "doc_id"), "row_key")
    first = groups.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_key")).alias("m"))
    others = groups.select("row_key").join(first.select(F.col("m.row_key").alias("row_key")), "row_key", "left_anti")
    return _without(spark, rows, others).select(docs.columns)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    rows = _keyed(spark, docs)
    found = contamination.contamination(rows, benchmark, id_col="row_key").filter("contaminated").select("row_key")
    return _without(spark, rows, found).select(docs.columns)


def with_pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data in their texts replaced."""
    return pseudonyms.pseudonymise(docs, PSEUDONYM_KEY)


def to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the rate and the number of copies at which all sources weigh the same."""
    return mixing.mixed(docs)


STAGES = [
    ("language_id", keep_languages),
    ("near_dedup", one_of_each_group),
    ("decontamination", without_benchmark),
    ("pseudonyms", with_pseudonyms),
    ("mixing", to_weights),
]

#: SQL cannot express the learned and iterated stages; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = scratch.keep(stage(spark, docs, sf_dir))
    return docs
