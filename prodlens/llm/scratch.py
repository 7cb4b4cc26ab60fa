"""Intermediate tables in the cluster's shared folder.

A written table cuts lineage as checkpoint() does, survives the loss of executors, and, unlike
checkpoint(), doesn't compute its input twice.
"""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Settings while a table is written. The first lets Spark delete a query's shuffle files when the query has ended, instead of when
#: the driver collects its garbage; the second keeps the Arrow batches of texts small beside the executor's heap.
WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxRecordsPerBatch": "2048"}


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; where that is unset (tests), one in the warehouse."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"


class Scratch:
    """Tables of one operator call, each in a folder of its own; free() deletes those that are no longer needed.

    Results that are still lazy may read the last of them, so these stay until the folder is cleaned.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.base = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        self.count = 0

    def keep(self, df: DataFrame) -> DataFrame:
        """Write df and read it back. The shuffle files that it took are deleted, as nothing reads them again."""
        self.count += 1
        path = f"{self.base}/{self.count}"
        before = {name: self.spark.conf.get(name, None) for name in WRITING}
        try:
            for name, value in WRITING.items():
                self.spark.conf.set(name, value)
            df.write.parquet(path)
        finally:
            for name, value in before.items():
                if value is None:
                    self.spark.conf.unset(name)
                else:
                    self.spark.conf.set(name, value)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def free(self, *frames: DataFrame) -> None:
        jvm, conf = self.spark._jvm, self.spark._jsparkSession.sessionState().newHadoopConf()
        for df in frames:
            path = jvm.org.apache.hadoop.fs.Path(df._scratch_path)
            path.getFileSystem(conf).delete(path, True)


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The rows in batches of at most `rows`. Texts can be long: few of them at a time keep a Python worker's memory bounded.

    Spark itself bounds the bytes of a batch, so no session setting is needed, nor changed. At the end the worker, which lives on
    beside the executor's JVM, gives the memory that it no longer uses back to the system.
    """
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)
    b = None
    release()


def release() -> None:
    """Give free memory of Arrow's pool and of the C heap (where it has malloc_trim) back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)
