"""Structured scrape results as product records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as fixed
from ..functions import text as T

#: Columns of a record, and those that only a structured scrape has.
RECORD = ["url", "meta_title", "meta_description", "product_description", "extraction_method", "confidence_score"]
SCRAPED = ["product_name", "price", "features", "additional_information"]


def method(url: Column, status: Column, has_key: bool = True) -> Column:
    """What a request says of itself before anything is read: null without an address or a key, a failure without a status (an exception), a refusal unless the status is 200."""
    blank = F.trim(F.coalesce(url, F.lit(""))) == ""
    if not has_key:
        return F.lit(None).cast("string")
    return F.when(blank, F.lit(None).cast("string")).when(F.coalesce(status, F.lit(0)) == 0, fixed.SCRAPE_METHODS["failed"]).when(status != 200, fixed.SCRAPE_METHODS["refused"]).otherwise(fixed.SCRAPE_METHODS["ok"])


def unwrapped(body: Column) -> Column:
    """A response's `data`, or the response itself where it has none."""
    return F.coalesce(F.get_json_object(body, "$.data"), body)


def normalised(records: DataFrame, structured: bool = False) -> DataFrame:
    """Records with the columns that all have, and those of a structured scrape if they are one; missing ones are null."""
    wanted = [*RECORD[:4], *SCRAPED, *RECORD[4:]] if structured else RECORD
    return records.select(*(F.col(c) if c in records.columns else F.lit(None).cast("double" if c == "confidence_score" else "string").alias(c) for c in wanted))


def adapted(results: DataFrame) -> DataFrame:
    """Extraction results (url, error, product_name, title, price, features, additional_information, product_description) as products for phrase mining.

    Those with an error go; the title stands in for a missing name; without features the description's sentences are features without heading.
    """
    feature = "array<struct<heading:string,description:string>>"
    sentences = F.transform(split_features(F.col("product_description")), lambda s: F.struct(F.lit("").alias("heading"), s.alias("description"))).cast(feature)
    none = F.array().cast(feature)
    features = F.when(F.size(F.coalesce("features", none)) > 0, F.col("features").cast(feature)).when(F.coalesce("product_description", F.lit("")) != "", sentences).otherwise(none)
    some = results.filter(F.coalesce("error", F.lit("")) == "")
    return some.select("url", F.coalesce(F.nullif("product_name", F.lit("")), "title").alias("product_name"), "price", features.alias("features"), "additional_information")


def description(features: Column, additional: Column) -> Column:
    """Features as `heading: text` and additional information, as sentences; null if there is nothing."""
    full = lambda x: F.nullif(F.trim(x), F.lit(""))
    one = lambda f: F.when(full(f["heading"]).isNotNull() & full(f["description"]).isNotNull(), F.concat(full(f["heading"]), F.lit(": "), full(f["description"]))).otherwise(F.coalesce(full(f["heading"]), full(f["description"])))
    parts = F.filter(F.concat(F.transform(F.coalesce(features, F.array().cast("array<struct<heading:string,description:string>>")), one), F.array(full(additional))), lambda p: p.isNotNull())
    joined = F.replace(F.replace(F.array_join(parts, ". "), F.lit(".."), F.lit(".")), F.lit("  "), F.lit(" "))
    return F.when(F.size(parts) > 0, F.when(joined.endswith("."), joined).otherwise(F.concat(joined, F.lit("."))))


def checked(text: Column) -> Column:
    """The description, or null if it is an error page's."""
    return F.when(~T.is_error_page(text), text)


def confidence(name: Column, price: Column, features: Column, additional: Column, cached: Column, text: Column) -> Column:
    has = lambda x: F.when(F.coalesce(x, F.lit("")) != "", 1.0).otherwise(0.0)
    n = F.greatest(F.coalesce(F.size(features), F.lit(0)), F.lit(0))
    score = 0.5 + 0.15 * has(name) + 0.1 * has(price) + F.least(F.lit(0.15), 0.03 * n) + 0.1 * has(additional) - F.when(cached, 0.05).otherwise(0.0)
    return F.when(text.isNull(), 0.0).otherwise(F.round(F.least(F.lit(1.0), score), 4))


def product_text(name: Column, features: Column, additional: Column) -> Column:
    """Name, headings and texts of features, and additional information, joined by spaces."""
    full = lambda x: F.nullif(x, F.lit(""))
    inner = F.flatten(F.transform(features, lambda f: F.array(full(f["heading"]), full(f["description"]))))
    return F.concat_ws(" ", full(name), F.array_join(F.filter(inner, lambda x: x.isNotNull()), " "), full(additional))


def split_features(text: Column) -> Column:
    """Sentences of more than 10 characters, where a record has no features."""
    return F.filter(F.split(text, r"\. "), lambda s: F.length(s) > 10)
