"""Typed entities from product texts: pattern and dictionary rules, categories, merging of two origins, placement.

Rules are Column expressions that give an array of ENTITY structs for a row; merging works on rows
(product_id, origin, pos, name, entity_type, evidence, value, unit).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed_values as fixed
from ..functions import text as T

ENTITY = "struct<name:string,entity_type:string,evidence:string,value:string,unit:string>"
NONE = f"array<{ENTITY}>"


def search_text(name: Column, phrases: Column, description: Column) -> Column:
    """What rules read: name, phrases and the first 2000 characters of the description, in lower case."""
    part = lambda x: F.nullif(x, F.lit(""))
    return F.concat_ws(" ", F.lower(name), F.array_join(F.filter(F.transform(phrases, F.lower), lambda p: p != ""), " "), part(F.left(F.lower(description), F.lit(2000))))


def _entity(name: Column, kind: Column | str, evidence: Column, value: Column | None = None, unit: Column | None = None) -> Column:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    null = F.lit(None).cast("string")
    return F.struct(name.alias("name"), kind.alias("entity_type"), evidence.alias("evidence"), (null if value is None else value).alias("value"), (null if unit is None else unit).alias("unit")).cast(ENTITY)


def first_of_each(entities: Column, most: int, key: str = "name") -> Column:
    """The first entity of each key, in order, `most` at most."""
    step = lambda acc, e: F.when(F.exists(acc, lambda x: x[key] == e[key]), acc).otherwise(F.concat(acc, F.array(e)))
    return F.slice(F.aggregate(entities, F.array().cast(NONE), step), 1, most)


def measured(text: Column, patterns: list[str], kind: str, unit: callable, most: int) -> Column:
    """Value and unit of each match, patterns in order, repeats left out."""
    each = []
    for p in patterns:
        # The text is searched once. The patterns assert nothing about what surrounds them, so a match alone gives the same groups.
        parts = lambda m: F.struct(m.alias("m"), F.regexp_extract(m, p, 1).alias("v"), F.regexp_extract(m, p, 2).alias("u"))  # noqa: B023 (called here)
        groups = F.transform(F.regexp_extract_all(text, F.lit(f"({p})"), 1), parts)
        each.append(F.transform(groups, lambda g: _entity(F.concat(g["v"], unit(g["u"])), kind, g["m"], g["v"], unit(g["u"]))))
    return first_of_each(F.flatten(F.array(*each)), most)


def dimensions(text: Column) -> Column:
    return measured(text, fixed.DIMENSION_PATTERNS, "dimension", lambda u: F.when(u.isin('"', "inch", "inches"), "inch").otherwise(u), 5)


def weights(text: Column) -> Column:
    return measured(text, fixed.WEIGHT_PATTERNS, "weight", lambda u: F.when(u.isin("lb", "lbs", "pound", "pounds"), "lb").when(u == "g", "g").otherwise("kg"), 2)


def capacities(text: Column) -> Column:
    return measured(text, fixed.CAPACITY_PATTERNS, "capacity", lambda u: F.when(u.isin("l", "litre", "liter", "litres", "liters"), "L").when(u == "ml", "mL").otherwise(u), 2)


def power(text: Column) -> Column:
    has = lambda u, p: F.contains(u, F.lit(p))
    return measured(text, fixed.POWER_PATTERNS, "rating", lambda u: F.when(has(u, "watt"), "W").when(has(u, "kw"), "kW").when(has(u, "volt"), "V").when(has(u, "amp"), "A").when(has(u, "mj"), "MJ/h").otherwise(u), 3)


def standards(text: Column) -> Column:
    """Standards in upper case; IP codes are ratings, CE and UL certifications."""
    found = F.flatten(F.array(*(F.regexp_extract_all(text, F.lit(p), 1) for p in fixed.STANDARD_PATTERNS)))
    kind = lambda s: F.when(s.startswith("IP"), "rating").when(F.contains(s, F.lit("CE")) | F.contains(s, F.lit("UL")), "certification").otherwise("standard")
    return first_of_each(F.transform(found, lambda m: _entity(F.upper(m), kind(F.upper(m)), m)), 5)


def titled(x: Column) -> Column:
    """Each letter after a non-letter in upper case."""
    step = lambda a, c: F.concat(a, F.when(F.right(a, F.lit(1)).rlike("[a-zA-Z]"), F.lower(c)).otherwise(F.upper(c)))
    return F.aggregate(F.split(x, ""), F.lit(""), step)


def care(text: Column) -> Column:
    found = F.flatten(F.array(*(F.regexp_extract_all(text, F.lit(f"({p})"), 1) for p in fixed.CARE_PATTERNS)))
    kind = lambda m: F.when(F.contains(m, F.lit("warranty")) | F.contains(m, F.lit("guarantee")), "warranty").otherwise("care")
    return first_of_each(F.transform(found, lambda m: _entity(titled(m), kind(m), m)), 3, "evidence")


def evidence(term: Column, text: Column, around: int = 50) -> Column:
    """The first occurrence with `around` characters on both sides, dots where text is cut off."""
    at = F.instr(text, term)
    start = F.greatest(at - 1 - around, F.lit(0))
    end = F.least(F.length(text), at - 1 + F.length(term) + around)
    cut = F.trim(F.substring(text, start + 1, end - start))
    return F.when(at == 0, term).otherwise(F.concat(F.when(start > 0, "...").otherwise(""), cut, F.when(end < F.length(text), "...").otherwise("")))


def _whole_word(name: str) -> str:
    return rf"\b{name}\b"


def in_care_context(name: str, text: Column) -> Column:
    """Whether every whole-word occurrence stands within 50 characters of a care instruction about it."""
    phrases = fixed.CARE_CONTEXTS.get(name)
    if not phrases:
        return F.lit(False)
    gaps = F.split(text, _whole_word(name), -1)
    n = F.size(gaps)
    # a window is the text around an occurrence; other occurrences inside it are put back by joining all that lies before and after
    before = lambda i: F.array_join(F.slice(gaps, 1, i), name)
    after = lambda i: F.array_join(F.slice(gaps, i + 1, n), name)
    window = lambda i: F.concat(F.right(before(i), F.lit(50)), F.lit(name), F.left(after(i), F.lit(50)))
    hit = lambda w: F.exists(T.literals(phrases), lambda p: F.contains(w, p))
    return F.when(n > 1, F.forall(F.sequence(F.lit(1), n - 1), lambda i: hit(window(i)))).otherwise(False)


def is_textile(text: Column) -> Column:
    return F.exists(T.literals(fixed.TEXTILE_SIGNS), lambda s: F.contains(text, s))


def from_dictionary(text: Column, entries: list[tuple], kind: str, most: int, excluded: Column | None = None) -> Column:
    """Entries (category, name, aliases, ...) in order whose name or else first fitting alias occurs in the text.

    A name or alias that an earlier entry was found by, or is called, does not count again.
    """
    each: list[Column] = []
    by: list[tuple[tuple, Column]] = []  # earlier entries, and the name that each was found by
    for entry in entries:
        name, aliases = entry[1], list(entry[2])
        options, found_by = [], []
        for n in [name, *aliases]:
            found = F.contains(text, F.lit(n)) & text.rlike(_whole_word(n)) if kind == "material" and n in fixed.WHOLE_WORD_MATERIALS else F.contains(text, F.lit(n))
            if kind == "material":
                found = found & ~in_care_context(n, text)
            for earlier, used in by:
                if n in [earlier[1], *earlier[2]]:
                    found = found & ~F.coalesce((used == n) | (used.isNotNull() & F.lit(n == earlier[1])), F.lit(False))
            options.append(F.when(found, _entity(F.lit(name.title()), kind, evidence(F.lit(n), text))))
            found_by.append(F.when(found, F.lit(n)))
        one, used = F.coalesce(*options), F.coalesce(*found_by)
        if excluded is not None:
            barred = F.arrays_overlap(excluded, T.literals([name, *aliases]))
            # few entries are found, and only for these it matters whether they are barred
            one, used = F.when(one.isNotNull() & ~barred, one), F.when(used.isNotNull() & ~barred, used)
        each.append(one)
        by.append((entry, used))
    return F.slice(F.filter(F.array(*each), lambda e: e.isNotNull()), 1, most)


def materials(text: Column, entries: list[tuple] = fixed.MATERIALS, category: Column | None = None) -> Column:
    """Materials of the dictionary; none that a textile, or a product of the category, is not made of."""
    none = F.array().cast("array<string>")
    textile = F.when(is_textile(text), T.literals(fixed.TEXTILE_IMPOSSIBLE)).otherwise(none)
    if category is not None:
        textile = F.concat(textile, F.coalesce(*(F.when(category == c, T.literals(m)) for c, m in fixed.EXCLUDED_MATERIALS.items()), none))
    return T.let(textile, lambda excluded: from_dictionary(text, entries, "material", 5, excluded))


def finishes(text: Column, entries: list[tuple] = fixed.FINISHES) -> Column:
    return from_dictionary(text, entries, "finish", 3)


def environments(text: Column, entries: list[tuple] = fixed.ENVIRONMENTS) -> Column:
    return from_dictionary(text, entries, "environment", 4)


def category_scores(text: Column, categories: dict[str, list[str]] = fixed.CATEGORIES) -> Column:
    """A struct (category, score) for each category in order. The keywords are data in the plan, so its size stays that of one rule."""

    def keyword(k: str) -> str:
        heavy = k in fixed.SPECIFIC_KEYWORDS
        whole = 3.0 if heavy else 1.0
        part = whole if " " in k else (0.5 if heavy else 0.3) if len(k) >= 4 else 0.0
        unless = ", ".join(map(T.quoted, fixed.COMPOUNDS.get(k, [])))
        return f"named_struct('k', {T.quoted(k)}, 'whole', {whole}D, 'part', {part}D, 'unless', cast(array({unless}) as array<string>))"

    def score(words: Column, keywords: Column) -> Column:
        one = lambda k: F.when(F.exists(k["unless"], lambda p: F.contains(text, p)), 0.0).when(F.array_contains(words, k["k"]), k["whole"]).when(F.contains(text, k["k"]), k["part"]).otherwise(0.0)
        return F.round(F.aggregate(keywords, F.lit(0.0), lambda a, k: a + one(k)), 4)

    lists = F.expr("array(" + ", ".join(f"named_struct('category', {T.quoted(c)}, 'ks', array({', '.join(map(keyword, ks))}))" for c, ks in categories.items()) + ")")
    return T.let(F.split(text, r"\s+"), lambda words: F.transform(lists, lambda c: F.struct(c["category"].alias("category"), score(words, c["ks"]).alias("score"))))


def best_category(text: Column, categories: dict[str, list[str]] = fixed.CATEGORIES, least: float = 2.0) -> Column:
    """The category with the highest score of at least `least`, the first on a tie; null if none."""
    step = lambda a, s: F.when((s["score"] >= least) & (s["score"] > a["score"]), s).otherwise(a)
    start = F.struct(F.lit(None).cast("string").alias("category"), F.lit(0.0).alias("score"))
    return F.aggregate(category_scores(F.lower(text), categories), start, step)["category"]


def primary_path(query: Column, text: Column, subtype: Column | None = None) -> Column:
    """`category > subtype`: by the query first, else by all text; `Product > Unknown` if neither tells."""
    sub = F.lit(None).cast("string") if subtype is None else subtype
    # a null concatenates to null, so each category is computed once and the text's only if the query tells nothing
    q = F.concat(best_category(query), F.lit(" > "), F.coalesce(sub, titled(query)))
    t = T.let(best_category(text), lambda c: F.when(c.isNotNull(), F.concat_ws(" > ", c, sub)))
    return F.coalesce(q, t, F.lit("Product > Unknown"))


def rule_entities(text: Column, category: Column | None = None) -> Column:
    """All rules in order."""
    return F.concat(*(materials(text, category=category) if rule is materials else rule(text) for rule in (dimensions, weights, capacities, power, materials, finishes, standards, environments, care)))


def missing_types(entities: Column) -> Column:
    """Types without an entity, in order of name; standards stand for certifications too, and care for warranties."""
    types = F.transform(entities, lambda e: e["entity_type"])
    any_of = lambda *names: F.arrays_overlap(types, T.literals(list(names)))
    found = F.concat(types, F.when(any_of("standard", "certification"), T.literals(["standard", "certification"])).otherwise(F.array().cast("array<string>")), F.when(any_of("care", "warranty"), T.literals(["care", "warranty"])).otherwise(F.array().cast("array<string>")))
    return F.array_except(T.literals(fixed.ENTITY_TYPES), found)


def rule_conflicts(entities: Column) -> Column:
    """1 if both indoor and outdoor are there without indoor/outdoor."""
    names = F.transform(F.filter(entities, lambda e: e["entity_type"] == "environment"), lambda e: F.lower(e["name"]))
    return F.when(F.array_contains(names, "indoor") & F.array_contains(names, "outdoor") & ~F.array_contains(names, "indoor/outdoor"), 1).otherwise(0)


def rule_confidence(entities: Column, missing: Column, conflicts: Column) -> Column:
    n = F.size(entities)
    critical = F.size(F.array_intersect(missing, T.literals(fixed.CRITICAL_TYPES)))
    score = F.least(0.5 + n * 0.05, F.lit(0.8)) - critical * 0.15 - conflicts * 0.1
    return F.when(n == 0, 0.1).otherwise(F.round(F.greatest(F.lit(0.1), F.least(F.lit(1.0), score)), 4))


def needs_model(missing: Column, confidence: Column, threshold: float = 0.6) -> Column:
    """Whether a language model should be asked: a critical type is missing, or confidence is low."""
    return F.arrays_overlap(missing, T.literals(fixed.CRITICAL_TYPES)) | (confidence < threshold)


# ---- merging two origins


def name_key(name: Column) -> Column:
    """Lower case, without marks, the first fitting variant replaced."""
    x = F.regexp_replace(F.trim(F.lower(name)), r"(?U)[^\w\s-]", "")
    out = F.lit(None).cast("string")
    for variant, canonical in reversed(fixed.NAME_VARIANTS):
        fits = (x == variant) | x.startswith(variant + " ")
        out = F.when(fits, F.concat(F.lit(canonical), F.substring(x, F.lit(len(variant) + 1), F.length(x)))).otherwise(out)
    return T.squeezed(F.coalesce(out, x))


def conflicts(entities: DataFrame) -> DataFrame:
    """(product_id, entity_type): materials or finishes that differ altogether, environments that contradict."""
    keyed = entities.withColumn("key", name_key(F.col("name")))
    sets = keyed.groupBy("product_id", "entity_type").agg(F.collect_set(F.when(F.col("origin") == "rules", F.col("key"))).alias("r"), F.collect_set(F.when(F.col("origin") == "llm", F.col("key"))).alias("m"))
    has = lambda c, w: F.exists(c, lambda k: F.contains(k, F.lit(w)))
    both = (F.size("r") > 0) & (F.size("m") > 0)
    differ = F.col("entity_type").isin("material", "finish") & ~F.arrays_overlap("r", "m")
    against = (F.col("entity_type") == "environment") & ((has("r", "indoor") & has("m", "outdoor") & ~has("r", "outdoor")) | (has("r", "outdoor") & has("m", "indoor") & ~has("r", "indoor")))
    return sets.filter(both & (differ | against)).select("product_id", "entity_type")


def merged(entities: DataFrame) -> DataFrame:
    """Rules first; the other origin's entities join where their key is new and their type without conflict."""
    keyed = entities.withColumn("key", name_key(F.col("name")))
    allowed = keyed.join(conflicts(entities).withColumn("conflict", F.lit(True)), ["product_id", "entity_type"], "left").filter((F.col("origin") == "rules") | F.col("conflict").isNull())
    order = Window.partitionBy("product_id", "entity_type", "key").orderBy(F.desc("origin"), "pos")
    return allowed.withColumn("n", F.row_number().over(order)).filter("n = 1").select("product_id", "origin", "pos", "name", "entity_type", "key")


def merged_confidence(entities: DataFrame, rules: float = 0.5, model: float = 0.5) -> DataFrame:
    """Weighted confidence of each product, rules counting twice; less for conflicts, more for agreement."""
    counts = entities.groupBy("product_id").agg(F.count_if(F.col("origin") == "rules").alias("r"), F.count_if(F.col("origin") == "llm").alias("m"))
    n = conflicts(entities).groupBy("product_id").agg(F.count("*").alias("c"))
    c = F.coalesce("c", F.lit(0))
    base = F.when(F.col("m") > 0, (2 * rules * F.col("r") + model * F.col("m")) / (2 * F.col("r") + F.col("m"))).otherwise(rules)
    score = base - 0.1 * c + F.when((F.col("r") > 0) & (F.col("m") > 0) & (c == 0), 0.05).otherwise(0.0)
    return counts.join(n, "product_id", "left").select("product_id", F.round(F.greatest(F.lit(0.1), F.least(F.lit(1.0), score)), 4).alias("confidence"))


def by_type(entities: DataFrame) -> DataFrame:
    """(product_id, entity_type, entities in order)."""
    rest = [c for c in entities.columns if c not in ("product_id", "entity_type", "pos")]
    return entities.groupBy("product_id", "entity_type").agg(F.array_sort(F.collect_list(F.struct("pos", *rest))).alias("entities"))


def described(standards: DataFrame, known: DataFrame, name_col: str = "name") -> DataFrame:
    """standards with `description`: of the known standards (region_pos, name, description) the one of that name in the first region; else null."""
    first = known.groupBy(F.upper("name").alias("known_name")).agg(F.min_by("description", "region_pos").alias("description"))
    return standards.join(first, F.upper(standards[name_col]) == F.col("known_name"), "left").drop("known_name")


def without_brands(x: Column, brands: list[str], patterns: list[str] = ("pty ltd", "inc", "llc")) -> Column:
    """Text without whole-word brands (the longest first) and company forms, tidied."""
    names = sorted(brands, key=lambda b: (-len(b), b)) + list(patterns)
    out = F.regexp_replace(x, "(?i)" + T.alternation(names), "")
    for pattern, becomes in fixed.BRAND_TIDYING:
        out = F.regexp_replace(out, pattern, becomes)
    return F.trim(out)


def has_brand(x: Column, brands: list[str]) -> Column:
    """Whether a brand occurs as whole words; false for null."""
    return F.coalesce(x.rlike("(?i)" + T.alternation(list(brands))), F.lit(False)) if brands else F.lit(False)


def is_brand_only(x: Column, brands: list[str]) -> Column:
    """Whether less than three characters are left without brands."""
    return F.length(without_brands(x, brands)) < 3


def clean_path(path: Column, brands: list[str]) -> Column:
    """A path without brands; the path itself if nothing is left."""
    parts = F.filter(F.transform(F.split(path, r"\s*[>›»]\s*"), lambda p: without_brands(p, brands)), lambda p: F.length(p) >= 2)
    return F.when(F.size(parts) > 0, F.array_join(parts, " > ")).otherwise(path)


def final_path(rules: Column, model: Column) -> Column:
    unsure = rules.isNull() | (rules == "") | rules.startswith("Product >")
    known = model.isNotNull() & (model != "") & ~model.startswith("Product >") & ~F.contains(model, F.lit("Unknown"))
    return F.when(~unsure, rules).when(known, model).otherwise(F.coalesce(F.nullif(rules, F.lit("")), F.lit("Product > Unknown")))


def placements(entities: DataFrame) -> DataFrame:
    """(product_id, name, sections): where the first entity of each name goes."""
    first = entities.groupBy("product_id", "name").agg(F.min_by("entity_type", F.struct(F.when(F.col("origin") == "rules", 0).otherwise(1), "pos")).alias("entity_type"))
    sections = F.coalesce(*(F.when(F.col("entity_type") == t, T.literals(s)) for t, s in fixed.PLACEMENTS.items()), T.literals(["specs_table"]))
    return first.select("product_id", "name", "entity_type", F.array_join(sections, ",").alias("sections"))
