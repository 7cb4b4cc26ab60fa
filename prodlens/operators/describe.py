"""Descriptions from extracted products and keywords: source texts, names and prices, the prompt, and what becomes of an answer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as ty

from ..functions import text as T
from .hybrid import unfenced

FEATURES = "array<struct<heading:string,description:string>>"
#: Characters of all source texts together.
SOURCE_CHARS = 2000


def _full(x: Column) -> Column:
    return F.nullif(x, F.lit(""))


def source_text(features: Column, additional: Column, description: Column) -> Column:
    """A product's features (`heading: text`, or the text alone), additional information (array of strings) and description, joined by `; `."""
    one = lambda f: F.when(_full(f["heading"]).isNotNull() & _full(f["description"]).isNotNull(), F.concat(f["heading"], F.lit(": "), f["description"])).otherwise(_full(f["description"]))
    none = F.array().cast("array<string>")
    parts = F.concat(F.coalesce(F.transform(features, one), none), F.coalesce(additional, none), F.array(_full(description)))
    return F.array_join(F.filter(parts, lambda p: p.isNotNull()), "; ")


def additional_texts(df: DataFrame, column: str) -> Column:
    """Additional information as texts, whether it is a map (`key: value`), a list or one value."""
    kind, x = df.schema[column].dataType, F.col(column)
    if isinstance(kind, ty.MapType):
        return F.transform(F.map_entries(x), lambda e: F.concat(e["key"].cast("string"), F.lit(": "), F.coalesce(e["value"].cast("string"), F.lit(""))))
    if isinstance(kind, ty.ArrayType):
        return F.transform(x, lambda v: v.cast("string"))
    return F.when(_full(x.cast("string")).isNotNull(), F.array(x.cast("string")))


def combined(products: DataFrame, key: str, pos: str, text: str) -> DataFrame:
    """(key, source_text): the products' texts in order, one on a line, cut after SOURCE_CHARS characters.

    Of each product only the first SOURCE_CHARS + 1 characters can count, so no more of it is collected.
    """
    part = F.when(F.coalesce(F.col(text), F.lit("")) != "", F.struct(F.col(pos).alias("pos"), F.left(F.col(text), F.lit(SOURCE_CHARS + 1)).alias("t")))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda x: x["t"]), "\n")
    out = products.groupBy(key).agg(joined.alias("t"))
    return out.select(key, F.when(F.col("t") == "", "No source text available.").otherwise(F.when(F.length("t") > SOURCE_CHARS, F.concat(F.left("t", F.lit(SOURCE_CHARS)), F.lit("..."))).otherwise(F.col("t"))).alias("source_text"))


def names_and_prices(products: DataFrame, key: str, pos: str, names: list[str], price: str) -> DataFrame:
    """(key, name, price): the first name that a product has, by product and then by column (`Product` if none has), and the first price."""
    name = F.coalesce(*(_full(F.col(c)) for c in names))
    first = lambda x: F.min_by(x, F.when(x.isNotNull(), F.col(pos)))
    return products.groupBy(key).agg(F.coalesce(first(name), F.lit("Product")).alias("name"), first(_full(F.col(price).cast("string"))).alias("price"), F.count("*").alias("products_combined"))


def prompt(name: Column, price: Column, source: Column, keywords: Column, path: Column, entities: Column, data: Column | None = None) -> Column:
    """What the model is asked for a description. The first 8 entity names are given."""
    line = lambda head, x: F.when(_full(x).isNotNull(), F.concat(F.lit(f"{head}: "), x))
    lines = F.filter(F.array(line("Product Category", path), line("Key Attributes", F.array_join(F.slice(F.filter(F.coalesce(entities, F.array().cast("array<string>")), lambda e: e != ""), 1, 8), ", "))), lambda x: x.isNotNull())
    section = F.when(F.size(lines) > 0, F.concat(F.lit("\n\nProduct Entities (incorporate these naturally):\n"), F.array_join(lines, "\n"), F.lit("\n"))).otherwise("")
    given = F.coalesce(F.lit(None).cast("string") if data is None else _full(data), F.lit("No product data provided"))
    asked = "Write one description of 150 to 300 words of the product below for its page, using the keywords naturally and nothing that the source does not say. Answer in JSON with description and key_features."
    return F.concat(F.lit(asked + "\n\nProduct data: "), given, F.lit("\nProduct: "), name, F.lit("\nPrice: "), F.coalesce(price, F.lit("N/A")), F.lit("\nSource:\n"), source, F.lit("\nKeywords: "), F.array_join(keywords, ", "), section)


def answered(answer: Column) -> Column:
    """(description, key_features, word_count, success) of an answer: JSON, perhaps in a code block, else the whole answer as description; null is a failure."""
    t = F.regexp_replace(answer, r"^\s+|\s+$", "")
    body = unfenced(answer)
    is_json = F.coalesce(body.startswith("{") & F.get_json_object(body, "$").isNotNull(), F.lit(False))
    got = F.from_json(body, "description string, key_features array<string>")
    text = F.when(is_json, F.coalesce(got["description"], F.lit(""))).otherwise(F.coalesce(t, F.lit("")))
    features = F.coalesce(F.when(is_json, got["key_features"]), F.array().cast("array<string>"))
    words = lambda x: F.size(F.filter(F.split(x, r"\s+"), lambda w: w != ""))
    return T.let(text, lambda x: F.struct(x.alias("description"), features.alias("key_features"), words(x).alias("word_count"), answer.isNotNull().alias("success")))


def generated(products: DataFrame, keywords: DataFrame, answers: DataFrame, key: str = "query_key") -> DataFrame:
    """A description for each key: products (key, pos, product_name, title, meta_title, price, features, additional_information, product_description),
    keywords (key, keywords array<string>) and stored answers (key, answer). Keys without an answer have success false and an empty description.
    """
    texts = products.withColumn("t", source_text(F.col("features").cast(FEATURES), additional_texts(products, "additional_information"), F.col("product_description")))
    first = names_and_prices(products, key, "pos", ["product_name", "title", "meta_title"], "price")
    out = combined(texts, key, "pos", "t").join(first, key).join(keywords, key, "left").join(answers, key, "left").withColumn("a", answered(F.col("answer")))
    return out.select(key, F.col("name").alias("product_name"), "price", "source_text", F.coalesce("keywords", F.array().cast("array<string>")).alias("keywords_used"), "a.description", "a.key_features", "a.word_count", "products_combined", "a.success")
