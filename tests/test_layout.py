"""Rows of one row group must not be left to one task."""

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from prodlens.operators import layout
from prodlens.plans import catalog


def busy(df):
    """Tasks of the last stage that have rows."""
    return df.select(F.spark_partition_id().alias("p")).distinct().count()


@pytest.mark.parametrize("name", ["rule_dimensions", "rule_confidence", "heading_score", "scrape_confidence", "category_score", "primary_path", "hybrid_entities", "hybrid_plain", "llm_prompt", "placement_llm"])
def test_parts_of_one_row_group_are_spread(spark, name):
    assert busy(catalog.QUERIES[name](spark, "/root/testdata/sf0.001")) >= 4


@pytest.mark.parametrize("groups", [1, 40])
def test_large_input_is_dealt_anew_only_where_row_groups_leave_cores_idle(spark, tmp_path, monkeypatch, groups):
    n = 4000
    pq.write_table(pa.table({"k": list(range(n)), "t": ["x" * 100] * n}), f"{tmp_path}/t.parquet", row_group_size=n // groups, use_dictionary=False, compression="none")
    monkeypatch.setattr(layout, "SMALL_BYTES", 1000)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1k")
    try:
        df = spark.read.parquet(f"{tmp_path}/t.parquet").select("t")
        out = layout.spread(df)
        assert busy(out) >= 4 and out.count() == n
        assert (out is df) == (groups > 1)
        assert layout.spread(out) is out
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
