"""Scalar text functions, all as Column expressions, so that they work in batch, SQL and streaming alike."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed_values as fixed


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once for a row however often body uses it."""
    return F.transform(F.array(value), lambda x: body(x))[0]  # a body of two parameters would be given the index too


def quoted(x: str) -> str:
    """A string literal of Spark SQL."""
    return "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"


def literals(values: list[str]) -> Column:
    """An array of strings, made by one expression, as one call for each string is slow."""
    return F.expr(f"array({', '.join(map(quoted, values))})")


def _escaped(phrase: str) -> str:
    return re.sub(r"([.^$*+?{}\[\]\\|()&#~-])", r"\\\1", phrase)


def alternation(phrases: list[str]) -> str:
    """A pattern of whole phrases, the first that fits winning."""
    return r"\b(?:" + "|".join(map(_escaped, phrases)) + r")\b"


def grouped_alternation(phrases: list[str]) -> str:
    """The same for many lower-case phrases of three letters or more, by their first two characters, so that few are tried at each place.

    Phrases that start differently can't fit at one place, so only the order inside a group tells.
    """
    groups: dict[str, dict[str, list[str]]] = {}
    for p in phrases:
        groups.setdefault(p[0], {}).setdefault(p[1], []).append(p[2:])
    second = lambda g: "|".join(f"{_escaped(c)}(?:{'|'.join(map(_escaped, rest))})" for c, rest in g.items())
    return f"(?=[{''.join(map(_escaped, groups))}])" + r"\b(?:" + "|".join(f"{_escaped(c)}(?:{second(g)})" for c, g in groups.items()) + r")\b"


def squeezed(x: Column) -> Column:
    return F.trim(F.regexp_replace(x, r"(?U)\s+", " "))


def _replaced(x: Column, pattern: str, new: str, signs: list[str]) -> Column:
    """Matches replaced, where one of the signs that every match holds is there: most texts hold none, and finding that out is quick."""
    return let(x, lambda t: F.when(F.exists(literals(signs), lambda p: F.contains(t, p)), F.regexp_replace(t, pattern, new)).otherwise(t))


def cleaned(x: Column, brands: list[str] = ()) -> Column:
    """Lower-cased text without addresses, marketing phrases, brands, entities, stray marks and single letters that are no unit. Null gives an empty text."""
    x = F.lower(F.coalesce(x, F.lit("")))
    x = _replaced(x, r"https?://\S+|www\.\S+", " ", ["http", "www."])
    x = _replaced(x, r"\b[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z|]{2,}\b", " ", ["@"])
    x = F.regexp_replace(x, grouped_alternation(fixed.MARKETING_PHRASES), " ")
    if brands:
        x = F.regexp_replace(x, "(?i)" + alternation(list(brands)), " ")
    x = _replaced(x, r"&[a-z]+;|&#\d+;", " ", ["&"])
    x = _replaced(x, "[–—]", "-", ["–", "—"])
    x = F.regexp_replace(x, r"(?U)[^\w\s.,\-°%]", " ")
    words = F.split(squeezed(x), " ")
    return F.array_join(F.filter(words, lambda w: (F.length(w) > 1) | w.isin(fixed.UNITS)), " ")


def without_foreign_letters(x: Column) -> Column:
    """Letters and numbers of other scripts as `_`, so that ASCII classes and word boundaries do."""
    return F.regexp_replace(x, r"[^\x00-\x7F\P{L}]|[^\x00-\x7F\P{N}]", "_")


def term_words(x: Column) -> Column:
    """Words that start with a letter, hyphens inside, over letters of any script taken as no letter (as ASCII classes have it)."""
    return F.regexp_extract_all(without_foreign_letters(F.lower(x)), F.lit(r"\b([a-z][a-z0-9\-]*[a-z0-9]|[a-z])\b"), 1)


def ngrams(words: Column, most: int = 3) -> Column:
    """All runs of 1 to `most` words, joined by spaces."""

    def runs(w: Column, n: int) -> Column:
        some = F.transform(F.sequence(F.lit(1), F.size(w) - n + 1), lambda i: F.array_join(F.slice(w, i, n), " "))
        return F.when(F.size(w) >= n, some).otherwise(F.array().cast("array<string>"))

    return let(words, lambda w: F.flatten(F.array(*(runs(w, n) for n in range(1, most + 1)))))


def has_suffix(x: Column) -> Column:
    return x.rlike("(" + "|".join(fixed.NOUN_SUFFIXES) + ")$")


def phrase_key(x: Column) -> Column:
    """How phrases are matched: lower case, single spaces, no marks at the edges; null if under two characters."""
    k = F.regexp_replace(squeezed(F.lower(x)), r"(?U)^[^\w]+|[^\w]+$", "")
    return F.when(F.length(k) >= 2, k)


def phrase_root(x: Column) -> Column:
    """Words without plural, -ing and -ed endings."""

    def root(w: Column) -> Column:
        n = F.length(w)
        plural = F.when(w.endswith("ies"), F.concat(F.left(w, n - 3), F.lit("y"))).when(w.endswith("es") & (n > 4), F.left(w, n - 2)).when(w.endswith("s") & ~w.endswith("ss") & (n > 3), F.left(w, n - 1)).otherwise(w)
        ing = lambda p: F.when(p.endswith("ing") & (F.length(p) > 5), F.left(p, F.length(p) - 3)).otherwise(p)
        ed = lambda p: F.when(p.endswith("ed") & (F.length(p) > 4), F.left(p, F.length(p) - 2)).otherwise(p)
        return let(let(plural, ing), ed)

    return F.array_join(F.transform(F.split(x, " "), root), " ")


def edge_trimmed(x: Column) -> Column:
    """A noun phrase in lower case without marks and stop words at its edges; null if nothing is left."""
    edge = "(?:" + "|".join(fixed.EDGE_WORDS) + ")"
    p = squeezed(F.regexp_replace(F.trim(F.lower(x)), r"(?U)^[^\w]+|[^\w]+$", ""))
    p = F.regexp_replace(F.concat(F.lit(" "), p, F.lit(" ")), f"^(?: {edge}(?= ))+", "")
    p = F.trim(F.regexp_replace(p, f"(?:(?<= ){edge} )+$", ""))
    return F.nullif(p, F.lit(""))


# ---- predicates and scores over texts


def word_overlap(a: Column, b: Column) -> Column:
    """Jaccard similarity of the words of two texts; 0 if either has none."""
    words = lambda x: F.array_distinct(F.filter(F.split(x, r"\s+"), lambda w: w != ""))
    union = F.size(F.array_union(words(a), words(b)))
    return F.when((F.size(words(a)) > 0) & (F.size(words(b)) > 0), F.size(F.array_intersect(words(a), words(b))) / union).otherwise(0.0)


def is_relevant(description: Column, title: Column) -> Column:
    """At least 30 % of the title's words occur in the description; true where there is nothing to check."""
    words = F.array_except(F.regexp_extract_all(F.lower(title), F.lit(r"(?U)\b([a-z]{3,})\b"), 1), literals(fixed.RELEVANCE_STOP_WORDS))
    found = F.size(F.filter(words, lambda w: F.contains(F.lower(description), w)))
    empty = (F.coalesce(description, F.lit("")) == "") | (F.coalesce(title, F.lit("")) == "")
    return F.when(empty, True).when(F.size(words) == 0, True).otherwise(found / F.size(words) >= 0.3)


def heading_score(label: Column) -> Column:
    """How much a heading announces a description, 0 to 1."""
    x = F.lower(label)
    each = F.array(*(F.when(x == k, 1.0).when(F.contains(x, F.lit(k)), 0.7).otherwise(F.when(word_overlap(x, F.lit(k)) > 0.5, word_overlap(x, F.lit(k)) * 0.5).otherwise(0.0)) for k in fixed.HEADING_KEYWORDS))
    bonus = sum((F.when(F.contains(x, F.lit(w)), 0.15).otherwise(0.0) for w in fixed.CONTAINER_WORDS), F.lit(0.0))
    return F.least(F.array_max(each) + bonus, F.lit(1.0))


def is_challenge(html: Column) -> Column:
    """Whether a page looks like a bot check."""
    h = F.lower(F.coalesce(html, F.lit("")))
    n, has = F.length(h), lambda p: F.contains(h, F.lit(p))
    short = (n < 3000) & F.exists(literals(fixed.CHALLENGE_PHRASES), lambda p: F.contains(h, p))
    return short | has("checking your browser before accessing") | (has("verify you are human") & (n < 10000)) | (has("please complete the captcha") & (n < 10000)) | (has("cloudflare") & has("ray id") & (n < 15000))


def is_error_page(text: Column) -> Column:
    t = F.lower(F.coalesce(text, F.lit("")))
    return (F.length(t) < 1000) & F.exists(literals(fixed.ERROR_PHRASES), lambda p: F.contains(t, p))


def clipped(x: Column, most: int = 2000) -> Column:
    """Single-spaced text of at most `most` characters, an ellipsis standing for the rest."""
    t = squeezed(F.coalesce(x, F.lit("")))
    return F.when(F.length(t) <= most, t).otherwise(F.concat(F.rtrim(F.left(t, F.lit(most - 1))), F.lit("…")))


def method_confidence(method: Column, description: Column) -> Column:
    base = F.coalesce(*(F.when(method == m, v) for m, v in fixed.METHOD_CONFIDENCE.items()), F.lit(0.5))
    n = F.length(description)
    return F.when(description.isNull(), 0.0).otherwise(F.least(base + F.when(n >= 200, 0.05).otherwise(0.0) + F.when(n >= 500, 0.05).otherwise(0.0), F.lit(1.0)))


# ---- general helpers


def without_tags(x: Column) -> Column:
    """Text without tags, the common named entities resolved."""
    t = F.regexp_replace(x, "<[^>]+>", "")
    for name, mark in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")):
        t = F.replace(t, F.lit(name), F.lit(mark))
    return t


def truncated(x: Column, most: int, suffix: str = "...") -> Column:
    return F.when(F.length(x) <= most, x).otherwise(F.concat(F.left(x, F.lit(max(0, most - len(suffix)))), F.lit(suffix)))


def numbers(x: Column) -> Column:
    return F.transform(F.regexp_extract_all(x, F.lit(r"(-?\d+(?:\.\d+)?)"), 1), lambda v: v.cast("double"))


def alphanumeric(x: Column, spaces: bool = True) -> Column:
    return F.regexp_replace(x, r"[^a-zA-Z0-9\s]" if spaces else "[^a-zA-Z0-9]", "")


def is_url(x: Column) -> Column:
    """Scheme http or https and a host."""
    return F.coalesce(F.trim(x).rlike(r"(?i)^https?://[^/?#\s]+"), F.lit(False))


def checked_url(x: Column) -> Column:
    """A valid URL without slashes at its end; null otherwise."""
    return F.when(is_url(x), F.regexp_replace(F.trim(x), "/+$", ""))


def is_price(x: Column) -> Column:
    return F.coalesce(x.rlike(r"[$£€¥]\s*\d+(?:[.,]\d{2})?"), F.lit(False))


def file_name(x: Column) -> Column:
    t = F.regexp_replace(F.regexp_replace(F.coalesce(x, F.lit("")), r'[<>:"/\\|?*\x00-\x1f]', "_"), r"^[ .]+|[ .]+$", "")
    return F.coalesce(F.nullif(F.left(t, F.lit(255)), F.lit("")), F.lit("untitled"))


def query_key(x: Column) -> Column:
    """How search queries are told apart: lower case, single spaces."""
    return squeezed(F.lower(x))


def slug(x: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(query_key(x), "[^a-z0-9]+", "_"), "^_+|_+$", "")
