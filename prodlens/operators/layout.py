"""Partition layout of inputs whose rows cost much work each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes, by the optimizer's estimate, up to which an input counts as small.
SMALL_BYTES = 512 << 20
#: Bytes of a partition of a larger input that is dealt anew.
PIECE_BYTES = 16 << 20


def _is_spread(df: DataFrame) -> bool:
    """Whether only projections and filters follow a repartition."""
    node = df._jdf.queryExecution().optimizedPlan()
    while node.nodeName() in ("Project", "Filter"):
        node = node.children().apply(0)
    return node.nodeName().startswith("Repartition")


def _is_scan(df: DataFrame) -> bool:
    node = df._jdf.queryExecution().optimizedPlan()
    while node.nodeName() == "Project":
        node = node.children().apply(0)
    return node.nodeName().startswith(("LogicalRelation", "Relation"))


def spread(df: DataFrame) -> DataFrame:
    """df over all cores: a row group is read by one task, however large it is, and a file may be a single one.

    A larger table whose row groups keep all cores busy stays as it is, so it is not shuffled for this. That takes the rows of each
    task, for which only the files' footers are read.
    """
    if df.isStreaming or _is_spread(df):
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size <= SMALL_BYTES:
        return df.repartition(cores)
    if not _is_scan(df):
        return df
    rows = [r["count"] for r in df.groupBy(F.spark_partition_id().alias("task")).count().collect()]
    if not rows or sum(rows) >= cores * max(rows):
        return df
    return df.repartition(max(cores, -(-size // PIECE_BYTES)))
