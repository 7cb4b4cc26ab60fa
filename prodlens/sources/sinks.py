"""Writers: phrase tables as CSV, results as JSON, descriptions as text reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def phrase_rows(phrases: DataFrame) -> DataFrame:
    return phrases.select(F.col("phrase").alias("Phrase"), (F.round(F.col("importance_score") * 100) / 100).alias("Importance"), F.round("tfidf_score", 4).alias("TFIDF"), F.col("doc_freq").alias("DocFreq"), F.col("total_occurrences").alias("Occurrences"), F.col("source").alias("Source"))


def write_csv(phrases: DataFrame, path: str) -> None:
    """Phrases are a top list, so one file holds them."""
    phrase_rows(phrases).coalesce(1).write.mode("overwrite").csv(path, header=True)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def json_text(value: Column, pretty: bool = True) -> Column:
    return F.to_json(value, {"pretty": str(pretty).lower()})


def report(name: Column, price: Column, body: Column, keywords: Column) -> Column:
    """A text report; parts that are null are left out."""
    line = "=" * 60
    words = F.size(F.filter(F.split(body, r"\s+"), lambda w: w != ""))
    listed = F.when(F.size(keywords) > 0, F.concat(F.lit("\nKeywords: "), F.array_join(keywords, ", ")))
    return F.concat_ws("\n", F.lit(line), F.lit("PRODUCT DESCRIPTION"), F.lit(line), F.concat(F.lit("Product: "), name), F.concat(F.lit("Price: "), price), F.concat(F.lit("Words: "), words.cast("string")), F.concat(F.lit("\n"), body), listed, F.lit(line))


def write_reports(df: DataFrame, path: str, column: str = "report") -> None:
    df.select(F.col(column).alias("value")).write.mode("overwrite").text(path)
