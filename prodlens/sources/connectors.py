"""Responses of outside services as DataFrames. The services themselves are functions given by the caller; without one, stored responses are read."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..html import extract as H
from ..operators.scrape import unwrapped

HIT = "struct<title:string,price:string,source:string,link:string,product_link:string,rating:double,reviews:bigint,thumbnail:string>"
RESPONSE = f"immersive_products array<{HIT}>, shopping_results array<{HIT}>, organic_results array<struct<link:string>>"
FEATURES = "array<struct<heading:string,description:string>>"
SCRAPED = f"struct<product_name:string,price:string,features:{FEATURES},additional_information:string>"


def _filled(x: Column) -> Column:
    return F.when(F.size(x) > 0, x)


def search_hits(responses: DataFrame, body_col: str = "body", limit: int = 10) -> DataFrame:
    """Rows (…, pos, title, price, source, link) of search responses in JSON: immersive products, else shopping results."""
    parsed = responses.withColumn("r", F.from_json(body_col, RESPONSE))
    hits = F.coalesce(_filled(F.col("r.immersive_products")), _filled(F.col("r.shopping_results")))
    out = parsed.select(*[c for c in responses.columns if c != body_col], F.posexplode(hits).alias("pos", "h"))
    link = F.coalesce(F.nullif("h.link", F.lit("")), "h.product_link")
    return out.filter((F.col("pos") < limit) & F.col("h.title").isNotNull()).select(*[c for c in out.columns if c != "h"], "h.title", "h.price", "h.source", link.alias("link"))


def with_fallback(first: DataFrame, second: DataFrame, key: str = "query_key") -> DataFrame:
    """Hits of a second engine for queries without any from the first."""
    return first.unionByName(second.join(first.select(key).distinct(), key, "left_anti"), allowMissingColumns=True)


def organic_link(body: Column) -> Column:
    """The first organic link of a search response."""
    return F.try_element_at(F.transform(F.from_json(body, RESPONSE)["organic_results"], lambda r: r["link"]), F.lit(1))


def page_body(status: Column, body: Column) -> Column:
    """HTML of a fetched page, unwrapped where it comes as JSON; null unless the status is 200 and there is a body."""
    text = F.nullif(F.trim(body), F.lit(""))
    inner = F.coalesce(*(F.nullif(F.get_json_object(text, f"$.{k}"), F.lit("")) for k in ("html", "body", "content")))
    return F.when(status == 200, F.when(text.startswith("{"), F.coalesce(inner, text)).otherwise(text))


def scraped(body: Column) -> Column:
    """The extraction inside a scrape response, which may be wrapped in `data`: the first of three places that holds one."""
    return F.coalesce(*(F.from_json(F.get_json_object(unwrapped(body), f"$.{k}"), SCRAPED) for k in ("json", "extract", "llm_extraction")))


def fetched(urls: DataFrame, fetch: Callable[[str], tuple[int, str]], url_col: str = "url") -> DataFrame:
    """urls with status and body of each, fetched on the executors once for each distinct url. A fetch that fails has status 0."""
    once = urls.select(url_col).filter(F.col(url_col).isNotNull()).distinct()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for u in b[url_col]:
                try:
                    rows.append((u, *fetch(u)))
                except OSError:
                    rows.append((u, 0, None))
            yield pd.DataFrame(rows, columns=[url_col, "status", "body"])

    return urls.join(once.mapInPandas(run, f"{url_col} string, status int, body string"), url_col, "left")


def completed(prompts: DataFrame, complete: Callable[[str], str] | None, prompt_col: str = "prompt") -> DataFrame:
    """prompts with `completion`, asked once for each distinct prompt; null without a model, so that fallbacks apply."""
    if complete is None:
        return prompts.withColumn("completion", F.lit(None).cast("string"))
    once = prompts.select(prompt_col).filter(F.col(prompt_col).isNotNull()).distinct()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({prompt_col: b[prompt_col], "completion": [complete(p) for p in b[prompt_col]]})

    return prompts.join(once.mapInPandas(run, f"{prompt_col} string, completion string"), prompt_col, "left")


#: Added to the conversation when an answer was not usable.
REPAIR = "Your answer was not the JSON object that was asked for. Answer again with valid JSON alone."


def repaired(complete: Callable[[list[dict]], str], retries: int = 2, keys: tuple[str, ...] = ("primary_entity_path", "llm_entities")) -> Callable[[str], str | None]:
    """A completion function that asks up to `retries` times for a JSON object with one of the keys, showing the bad answer each time; None if none came."""

    def ask(prompt: str) -> str | None:
        talk = [{"role": "user", "content": prompt}]
        for _ in range(retries):
            try:
                answer = complete(talk) or ""
            except OSError:
                continue
            try:
                data = json.loads(answer)
            except ValueError:
                data = None
            if isinstance(data, dict) and any(k in data for k in keys):
                return answer
            talk = [*talk, {"role": "assistant", "content": answer}, {"role": "user", "content": REPAIR}]
        return None

    return ask


def pages(urls: DataFrame, fetch: Callable[[str], tuple[int, str]], fetch_rendered: Callable[[str], tuple[int, str]] | None = None, options: H.Options = H.Options()) -> DataFrame:
    """urls (url) with what the ladder finds on each page.

    A page that is not fetched has method `fetch_fail`. A challenge page is fetched once more with scripts run, where that is
    possible, and is `blocked` if that is one too or fails. Rows whose address is blank have nulls.
    """
    body = page_body(F.col("status"), F.col("body"))
    first = fetched(urls.distinct(), fetch).withColumn("html", body)
    if fetch_rendered is not None:
        challenged = first.filter(T.is_challenge(F.col("html")) & F.col("html").isNotNull())
        again = fetched(challenged.select("url"), fetch_rendered).select("url", F.coalesce(body, F.lit("just a moment")).alias("rendered"))
        first = first.join(again, "url", "left").withColumn("html", F.coalesce("rendered", "html"))
    none = F.col("html").isNull() & (F.trim(F.coalesce("url", F.lit(""))) != "")
    found = H.extracted(first.select("url", none.alias("failed"), "html"), options)
    return found.withColumn("extraction_method", F.when(F.col("failed"), "fetch_fail").otherwise(F.col("extraction_method"))).drop("failed")


def dictionary(df: DataFrame, most: int = 20_000) -> list[tuple]:
    """Rows (pos, category, name, aliases[, description]) as the entries that rules take. They go into the plan, so more than `most` are refused."""
    rows = df.orderBy("pos").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} entries")
    return [(r.category, r.name.lower(), [a.lower() for a in r.aliases or []], *([r.description] if "description" in df.columns else [])) for r in rows]


def read_dictionary(df: DataFrame, json_col: str = "value") -> DataFrame:
    """One JSON document {category: {name: {aliases, description}}} as rows (pos, category, name, aliases, description)."""
    inner = "map<string,map<string,struct<aliases:array<string>,description:string>>>"
    a = df.select(F.posexplode(F.map_entries(F.from_json(json_col, inner))).alias("i", "c"))
    b = a.select("i", F.col("c.key").alias("category"), F.posexplode(F.map_entries("c.value")).alias("j", "e"))
    return b.select((F.col("i") * 1_000_000 + F.col("j")).alias("pos"), "category", F.col("e.key").alias("name"), F.col("e.value.aliases").alias("aliases"), F.col("e.value.description").alias("description"))
