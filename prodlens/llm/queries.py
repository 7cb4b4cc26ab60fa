"""The registered queries of this subpackage, each over its whole table with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import contamination, hnsw, hpylm, language_id, mixing, near_dup, pseudonyms, quality, token_count, warc


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _read(spark, sf_dir, "embeddings")
    return hnsw.nearest(vectors, vectors.filter("vec_id % 20 = 0"))


#: Stands in for a secret that a deployment would take from its own store.
PSEUDONYM_KEY = "prodlens"


def op2_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return pseudonyms.pseudonymise(docs, PSEUDONYM_KEY)


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(_read(spark, sf_dir, "documents"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.token_counts(_read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.languages(_read(spark, sf_dir, "documents"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classified(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op7_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hpylm.scores(_read(spark, sf_dir, "documents"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(_read(spark, sf_dir, "documents")).drop("text")


def op9_warc_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.page_records(_read(spark, sf_dir, "pages"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination.contamination(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark")).drop("items")


QUERIES = {
    "op1_nearest_neighbours": op1_nearest_neighbours,
    "op2_pseudonyms": op2_pseudonyms,
    "op3_near_duplicates": op3_near_duplicates,
    "op4_token_counts": op4_token_counts,
    "op5_language_id": op5_language_id,
    "op6_quality": op6_quality,
    "op7_lm_scores": op7_lm_scores,
    "op8_mixing": op8_mixing,
    "op9_warc_archives": op9_warc_archives,
    "op10_decontamination": op10_decontamination,
}
ORACLE_SQL: dict[str, str] = {}
