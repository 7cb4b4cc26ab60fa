"""Search hits: deduplicated queries, top hits, link enrichment, top-up of failures, and request caching over streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def distinct_queries(queries: DataFrame, query_col: str = "query", pos_col: str = "pos") -> DataFrame:
    """The first query of each normalised form."""
    keyed = queries.withColumn("query_key", T.query_key(F.col(query_col)))
    first = keyed.groupBy("query_key").agg(F.min_by(F.struct(query_col, pos_col), F.col(pos_col)).alias("q"))
    return first.select("query_key", f"q.{query_col}", f"q.{pos_col}")


def top_hits(hits: DataFrame, limit: int, key: str = "query_key") -> DataFrame:
    """Of each query the first `limit` positions; a repeated title keeps its first position and its last values."""
    cut = hits.filter((F.col("pos") < limit) & F.col("title").isNotNull())
    rest = [c for c in hits.columns if c not in (key, "pos", "title")]
    # hits that share a position are told apart by their values, so that the result does not depend on row order
    return cut.groupBy(key, "title").agg(F.min("pos").alias("pos"), F.max_by(F.struct(*rest), F.struct("pos", *rest)).alias("v")).select(key, "pos", "title", "v.*")


def linked(hits: DataFrame) -> DataFrame:
    """Hits with a link."""
    return hits.filter(F.length(F.coalesce("link", F.lit(""))) > 0)


def requested(urls: DataFrame, url_col: str = "url") -> DataFrame:
    """Rows of a batch whose address is not blank."""
    return urls.filter(F.trim(F.coalesce(F.col(url_col), F.lit(""))) != "")


def without_errors(results: DataFrame, error_col: str = "error") -> DataFrame:
    """Results without an error."""
    return results.filter(F.coalesce(F.col(error_col), F.lit("")) == "")


def evicted(cache: DataFrame, most: int = 100, dropped: int = 20, time_col: str = "stored") -> DataFrame:
    """Of a cache of more than `most` entries all but the `dropped` oldest; a smaller one as it is. Ties go by key."""
    size = cache.count()
    if size <= most:
        return cache
    oldest = cache.orderBy(time_col, "key").limit(dropped).select("key")  # a bounded list
    return cache.join(F.broadcast(oldest), "key", "left_anti")


def enriched(hits: DataFrame, links: DataFrame, most: int = 5, key: str = "query_key") -> DataFrame:
    """Hits whose missing link is taken from links (title, source, found_link), for the first `most` of each query."""
    wanted = (F.coalesce("link", F.lit("")) == "") & (F.col("pos") < most)
    found = hits.join(links, ["title", "source"], "left")
    return found.withColumn("link", F.when(wanted, F.coalesce("found_link", "link")).otherwise(F.col("link"))).drop("found_link")


def topped_up(results: DataFrame, target: int = 8, key: str = "batch") -> DataFrame:
    """Rows (batch, idx, ok): the first `target` are tried; for failures further ones in order, until `target` succeed. Successes come first to last."""
    upto = Window.partitionBy(key).orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    tried = results.withColumn("before", F.coalesce(F.sum(F.col("ok").cast("int")).over(upto), F.lit(0))).filter((F.col("idx") < target) | (F.col("before") < target))
    order = Window.partitionBy(key).orderBy("idx")
    return tried.filter("ok").withColumn("n", F.row_number().over(order)).filter(F.col("n") <= target).drop("before", "n")


def batch_totals(results: DataFrame, key: str = "batch") -> DataFrame:
    return results.groupBy(key).agg(F.count("*").alias("total"), F.count_if("ok").alias("successes"), F.count_if(~F.col("ok")).alias("failures"))
