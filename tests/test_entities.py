"""Entity rules and text cleaning on single texts."""

import pytest
from pyspark.sql import functions as F

from prodlens.functions import fixed_values as fixed
from prodlens.functions import text as T
from prodlens.operators import entities as E
from prodlens.streaming import dedupe


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("rule", "text", "names"),
    [
        (E.dimensions, "the table is 1200mm w x 600mm d", ["1200mm", "600mm"]),
        (E.dimensions, '48 inch width, 24" depth', ["48inch", "24inch"]),
        (E.weights, "5 lb or 3 pounds and 2g", ["5lb", "3lb"]),
        (E.standards, "certified to as/nzs 4386, ip65", ["AS/NZS 4386", "NZS 4386", "IP65"]),
        (E.care, "5year warranty, hand wash", ["5Year Warranty", "Hand Wash"]),
        (E.materials, "built with a stainless steel frame", ["Stainless Steel", "Steel"]),
        (E.materials, "machine wash only", []),
        (E.materials, "ash frame, do not iron", ["Ash"]),
        (E.materials, "cotton shirt with steel buttons", ["Cotton"]),
        (E.environments, "for patio and salt air", ["Outdoor", "Coastal"]),
        (E.dimensions, "", []),
    ],
)
def test_rules(spark, rule, text, names):
    assert [e.name for e in value(spark, rule(F.lit(text)))] == names


def test_categories(spark):
    assert value(spark, E.primary_path(F.lit("coffee cup"), F.lit(""))) == "Drinkware > Coffee Cup"
    assert value(spark, E.primary_path(F.lit(None).cast("string"), F.lit("custom widget"))) == "Product > Unknown"


def test_confidence_bounds(spark):
    full = E.rule_entities(F.lit("48 inch oak desk, 5kg, 20l, 800w, iso 9001, patio, hand wash, matte"))
    high = value(spark, E.rule_confidence(full, E.missing_types(full), E.rule_conflicts(full)))
    none = F.array().cast(E.NONE)
    assert high > 0.5 and value(spark, E.rule_confidence(none, E.missing_types(none), E.rule_conflicts(none))) == 0.1


@pytest.mark.parametrize("raw", [None, "", "Buy Online or INSTORE! 5 kg – a W  https://x.y/z &amp; q", "é ß ñ"])
def test_cleaning_is_idempotent(spark, raw):
    once = value(spark, T.cleaned(F.lit(raw).cast("string")))
    assert value(spark, T.cleaned(F.lit(once))) == once


def test_stream_dedupe_plans(spark):
    stream = spark.readStream.format("rate").load()
    assert dedupe.deduplicated(stream, "value", "timestamp").isStreaming


def test_measured_rules_search_the_text_once_a_pattern(spark):
    df = spark.createDataFrame([("5 mm x 6 mm x 7 mm, height: 10cm, 3.5 inches wide, 2m",)], "t string").select(E.dimensions(F.col("t")).alias("e"))
    assert df._jdf.queryExecution().analyzed().toString().count("regexp_extract_all(") == len(fixed.DIMENSION_PATTERNS)
    assert [(e.name, e.evidence, e.value, e.unit) for e in df.first().e] == [("5mm", "5 mm x 6 mm x 7 mm", "5", "mm"), ("6mm", "6 mm ", "6", "mm"), ("7mm", "7 mm", "7", "mm"), ("10cm", "10cm", "10", "cm"), ("3.5inch", "3.5 inch", "3.5", "inch")]
