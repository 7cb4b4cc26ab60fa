"""Entities of a product as one result: rules, a language model's stored answer where it is wanted, their merge, and where all goes.

A product is one row and stays one: everything is a Column over its own row, so nothing is shuffled. The model's answers are
columns (its response, its grouping of terms), null where it was not asked or failed, so that fallbacks apply.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as fixed
from ..functions import text as T
from . import entities as E

ITEM = "struct<name:string,entity_type:string,evidence:string,source:string,value:string,unit:string,why_it_matters:string>"
CONFLICT = "struct<entity_type:string,rule_value:string,llm_value:string,resolution:string,reason:string>"
TERM = "struct<phrase:string,tfidf_score:double,doc_freq:bigint,importance_score:double,source:string>"
NO_ITEMS, NO_CONFLICTS, NO_TEXTS = f"array<{ITEM}>", f"array<{CONFLICT}>", "array<string>"


def _text(*parts: Column | str) -> Column:
    """Parts joined; a null part leaves nothing out."""
    return F.concat(*(F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("")) for p in parts))


def _with(df: DataFrame, name: str, value: Column) -> DataFrame:
    """df with a column that is computed once, however many later columns read it: what follows is not merged with it into one projection."""
    return df.select(*[c for c in df.columns if c != name], F.explode(F.array(value)).alias(name))


def _none(kind: str) -> Column:
    return F.array().cast(kind)


def required(products: DataFrame) -> DataFrame:
    """Products with an id, a name and terms."""
    full = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) != ""
    return products.filter(full("product_id") & full("product_name") & (F.coalesce(F.size("terms"), F.lit(0)) > 0))


def request_terms(body: Column) -> Column:
    """Terms of a request in JSON, whichever of its names each field goes by; null unless it is a list."""
    names = [n for ns in fixed.TERM_FIELDS.values() for n in ns]
    raw = F.from_json(body, "array<struct<" + ",".join(f"{n}:string" for n in names) + ">>")
    field = lambda t, f: F.coalesce(*(t[n] for n in fixed.TERM_FIELDS[f]))
    zero = lambda x: F.coalesce(x.try_cast("double"), F.lit(0.0))
    one = lambda t: F.struct(F.coalesce(field(t, "phrase"), F.lit("")).alias("phrase"), zero(field(t, "tfidf_score")).alias("tfidf_score"), F.coalesce(field(t, "doc_freq").try_cast("bigint"), F.lit(1)).alias("doc_freq"), zero(field(t, "importance_score")).alias("importance_score"), F.coalesce(field(t, "source"), F.lit("tfidf")).alias("source"))
    return F.transform(raw, one)


# ---- rules


def as_items(entities: Column, source: str) -> Column:
    """Entities with their source and why they matter."""
    why = lambda e: F.coalesce(*(F.when(e["entity_type"] == t, r) for t, r in fixed.REASONS.items()), F.when(e["entity_type"] == "environment", _text("Product is designed for ", F.lower(e["name"]), " conditions.")))
    return F.transform(entities, lambda e: F.struct(e["name"].alias("name"), e["entity_type"].alias("entity_type"), e["evidence"].alias("evidence"), F.lit(source).alias("source"), e["value"].alias("value"), e["unit"].alias("unit"), why(e).alias("why_it_matters")))


def rules_result(name: Column, phrases: Column, description: Column, query: Column) -> Column:
    """A struct of what the rules find: rule_entities, primary_entity_path, missing_types, conflicts, confidence, notes."""
    text = E.search_text(F.coalesce(name, F.lit("")), F.coalesce(phrases, _none(NO_TEXTS)), description)
    asked = F.nullif(query, F.lit(""))

    def result(t: Column) -> Column:
        found = E.rule_entities(t, E.best_category(F.coalesce(asked, name)))
        return T.let(found, lambda e: T.let(E.missing_types(e), lambda m: T.let(E.rule_conflicts(e), lambda c: whole(t, e, m, c))))

    def whole(t: Column, e: Column, m: Column, c: Column) -> Column:
        conflict = F.struct(F.lit("environment").alias("entity_type"), F.lit("indoor").alias("rule_value"), F.lit("outdoor").alias("llm_value"), F.lit("manual_review").alias("resolution"), F.lit("Both indoor and outdoor mentioned; may be indoor/outdoor").alias("reason"))
        notes = F.concat(F.array(_text("Extracted ", F.size(e), " entities via rules")), F.when(c > 0, F.array(_text("Detected ", c, " potential conflicts"))).otherwise(_none(NO_TEXTS)))
        return F.struct(as_items(e, "rules").alias("rule_entities"), E.primary_path(asked, t).alias("primary_entity_path"), m.alias("missing_types"), F.when(c > 0, F.array(conflict)).otherwise(_none(NO_CONFLICTS)).alias("conflicts"), E.rule_confidence(e, m, c).alias("confidence"), notes.alias("notes"))

    return T.let(text, result)


# ---- the model


def gate(missing: Column, confidence: Column, threshold: float = 0.7, enabled: bool = True, available: bool = True, force: Column | None = None) -> Column:
    """Whether the model is to be asked, and why: (invoke, reason)."""
    answer = lambda yes, why: F.struct(F.lit(yes).alias("invoke"), (F.lit(why) if isinstance(why, str) else why).alias("reason"))
    critical = F.array_intersect(T.literals(fixed.CRITICAL_TYPES[::-1]), missing)
    listed = _text("Missing critical types: ['", F.array_join(critical, "', '"), "']")
    if not available:
        out = answer(False, "LLM not available (no API key or package)")
    elif not enabled:
        out = answer(False, "LLM extraction disabled in config")
    else:
        low = _text("Low rules confidence: ", F.format_string("%.2f", confidence), f" < {threshold}")
        out = F.when(F.size(critical) > 0, answer(True, listed)).when(confidence < threshold, answer(True, low)).otherwise(answer(False, "Rules extraction sufficient"))
    return out if force is None else F.when(force, answer(True, "Forced by request")).otherwise(out)


def prompt(name: Column, title: Column, description: Column, specs: Column, terms: Column, missing: Column, found: Column, conflicts: Column, query: Column, grouped: Column | None = None) -> Column:
    """What the model is asked: the first 3000 characters of the description, 2000 of the specifications and 30 terms unless they are grouped."""
    full = lambda x, else_: F.coalesce(F.nullif(x, F.lit("")), F.lit(else_))
    first = F.filter(F.slice(terms, 1, 30), lambda t: F.coalesce(t["phrase"], F.lit("")) != "")
    scored = F.map_from_entries(F.transform(F.array_distinct(F.transform(first, lambda t: t["phrase"])), lambda p: F.struct(p.alias("key"), F.round(F.element_at(F.filter(first, lambda t: t["phrase"] == p), -1)["tfidf_score"], 3).alias("value"))))
    listed = F.to_json(F.struct(scored.alias("tfidf_terms"))) if grouped is None else F.coalesce(F.to_json(grouped), F.to_json(F.struct(scored.alias("tfidf_terms"))))
    known = F.to_json(F.transform(found, lambda e: F.struct(e["name"].alias("name"), e["entity_type"].alias("type"), e["evidence"].alias("evidence"), e["source"].alias("source"))))
    parts = [("Search query", full(query, "(Not provided)")), ("Product name", name), ("Title", full(title, "(Not provided)")), ("Description", full(F.left(description, F.lit(3000)), "(No description available)")), ("Specifications", full(F.left(specs, F.lit(2000)), "(No specs text available)")), ("Terms", listed), ("Entities found by rules", known), ("Types still missing", F.to_json(missing)), ("Conflicts", F.to_json(conflicts))]
    asked = "Name the product's category path and its entities of the missing types, each with evidence from the inputs. Answer in JSON with primary_entity_path, llm_entities (name, type, evidence, value, unit, why_it_matters), placement_map, faqs (question, answer, evidence), confidence (primary_entity, supporting_entities) and notes (missing_types, conflicts, assumptions)."
    return F.concat_ws("\n\n", F.lit(asked), *(_text(f"{head}:\n", body) for head, body in parts))


def unfenced(answer: Column) -> Column:
    """An answer without the marks of a code block around it."""
    stripped = lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")
    inner = F.regexp_replace(F.get(F.split(stripped(answer), "```"), F.lit(1)), "^json", "")
    return F.when(stripped(answer).startswith("```"), stripped(inner)).otherwise(stripped(answer))


def parsed(response: Column) -> Column:
    """The model's answer as a struct: success, primary_entity_path, llm_entities, placement_suggestions, faqs, confidence and its two parts, notes.

    Entities without name, type and evidence and questions without answer or evidence are left out. An answer that is no JSON object, or has
    neither a path nor entities, is none: success is false and all lists are empty.
    """
    top = F.from_json(response, "primary_entity_path string, llm_entities array<string>, placement_map string, faqs array<string>, confidence string, notes string")
    has = F.trim(response).startswith("{") & (F.get_json_object(response, "$.primary_entity_path").isNotNull() | F.get_json_object(response, "$.llm_entities").isNotNull())
    objects = lambda x, kind: F.filter(F.transform(F.filter(F.coalesce(x, _none(NO_TEXTS)), lambda v: v.startswith("{")), lambda v: F.from_json(v, kind)), lambda v: v.isNotNull())
    full = lambda *xs: F.forall(F.array(*xs), lambda x: F.coalesce(x, F.lit("")) != "")
    entity = lambda e: F.struct(e["name"].alias("name"), F.lower(e["type"]).alias("entity_type"), e["evidence"].alias("evidence"), F.lit("llm").alias("source"), e["value"].alias("value"), e["unit"].alias("unit"), e["why_it_matters"].alias("why_it_matters"))

    def result(r: Column) -> Column:
        items = F.transform(F.filter(objects(r["llm_entities"], "name string, type string, evidence string, value string, unit string, why_it_matters string"), lambda e: full(e["name"], e["type"], e["evidence"])), entity)
        faqs = F.filter(objects(r["faqs"], "question string, answer string, evidence string"), lambda q: full(q["question"], q["answer"], q["evidence"]))
        places = F.from_json(F.coalesce(r["placement_map"], F.lit("{}")), "map<string,array<string>>")
        sections = F.map_from_arrays(T.literals(list(fixed.ANSWER_SECTIONS)), F.array(*(F.coalesce(F.try_element_at(places, F.lit(k)), _none(NO_TEXTS)) for k in fixed.ANSWER_SECTIONS.values())))
        said = F.coalesce(F.trim(r["confidence"]), F.lit("{}"))
        pair = F.from_json(said, "primary_entity double, supporting_entities double")
        number = said.try_cast("double")
        scalar = F.when(number.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), number)))
        side = lambda k: F.when(said.startswith("{"), F.coalesce(pair[k], F.lit(0.5))).otherwise(F.coalesce(scalar, F.lit(0.0)))
        told = F.from_json(F.coalesce(r["notes"], F.lit("{}")), "missing_types array<string>, conflicts array<string>, assumptions array<string>")
        note = lambda head, x: F.when(F.size(x) > 0, _text(f"{head}: ['", F.array_join(x, "', '"), "']"))
        notes = F.filter(F.array(note("LLM conflicts", told["conflicts"]), note("LLM assumptions", told["assumptions"]), note("Still missing after LLM", told["missing_types"]), _text("LLM extracted ", F.size(items), " entities")), lambda n: n.isNotNull())
        a, b = side("primary_entity"), side("supporting_entities")
        return F.struct(F.lit(True).alias("success"), F.coalesce(r["primary_entity_path"], F.lit("Unknown")).alias("primary_entity_path"), items.cast(NO_ITEMS).alias("llm_entities"), sections.alias("placement_suggestions"), faqs.alias("faqs"), ((a + b) / 2).alias("confidence"), a.alias("confidence_primary"), b.alias("confidence_supporting"), notes.alias("notes"))

    none = F.struct(F.lit(False).alias("success"), F.lit(None).cast("string").alias("primary_entity_path"), _none(NO_ITEMS).alias("llm_entities"), F.lit(None).cast("map<string,array<string>>").alias("placement_suggestions"), F.array().cast("array<struct<question:string,answer:string,evidence:string>>").alias("faqs"), F.lit(0.0).alias("confidence"), F.lit(0.0).alias("confidence_primary"), F.lit(0.0).alias("confidence_supporting"), _none(NO_TEXTS).alias("notes"))
    return F.when(F.coalesce(has, F.lit(False)), T.let(top, result)).otherwise(none)


def grouped_terms(phrases: Column, answer: Column) -> Column:
    """(grouped, noise): the model's groups that are not empty and its noise; without a usable answer all are core attributes."""
    some = F.filter(F.transform(F.coalesce(phrases, _none(NO_TEXTS)), lambda p: F.trim(p)), lambda p: p != "")
    groups = F.from_json(F.when(unfenced(answer).startswith("{"), unfenced(answer)), "map<string,array<string>>")
    own = F.map_filter(groups, lambda k, v: (k != "Noise") & (F.size(v) > 0))
    noise = F.coalesce(F.try_element_at(groups, F.lit("Noise")), _none(NO_TEXTS))
    kinds = "map<string,array<string>>"
    every = F.when(F.size(some) > 0, F.map_from_arrays(T.literals(["Core Attributes"]), F.array(some))).otherwise(F.create_map().cast(kinds))
    usable = groups.isNotNull() & (F.size(some) > 0)
    return F.struct(F.when(usable, own.cast(kinds)).otherwise(every).alias("grouped"), F.when(usable, noise).otherwise(_none(NO_TEXTS)).alias("noise"))


# ---- merge


def merged(rules: Column, model: Column, rules_confidence: Column, model_confidence: Column, brands: list[str] = ()) -> Column:
    """(merged_entities, conflicts, confidence, notes) of the items of both sources; rules win, and brand names go."""
    keyed = lambda items: F.transform(items, lambda e: F.struct(e.alias("e"), F.concat(e["entity_type"], F.lit(":"), E.name_key(e["name"])).alias("key"), E.name_key(e["name"]).alias("name")))
    of = lambda items, t: F.filter(items, lambda x: x["e"]["entity_type"] == t)
    names = lambda items, t: F.transform(of(items, t), lambda x: x["name"])

    def found_conflicts(r: Column, m: Column) -> Column:
        def differ(t: str) -> Column:
            a, b = F.get(of(r, t), F.lit(0))["e"]["name"], F.get(of(m, t), F.lit(0))["e"]["name"]
            reason = _text("Rules extracted '", a, "' but LLM suggested '", b, "'. Preferring rules.")
            both = (F.size(of(r, t)) > 0) & (F.size(of(m, t)) > 0) & ~F.arrays_overlap(names(r, t), names(m, t))
            return F.when(both, F.struct(F.lit(t).alias("entity_type"), a.alias("rule_value"), b.alias("llm_value"), F.lit("prefer_rules").alias("resolution"), reason.alias("reason")))

        has = lambda items, w: F.exists(names(items, "environment"), lambda n: F.contains(n, F.lit(w)))
        against = (has(r, "indoor") & has(m, "outdoor") & ~has(r, "outdoor")) | (has(r, "outdoor") & has(m, "indoor") & ~has(r, "indoor"))
        side = lambda items: F.when(has(items, "indoor"), "indoor").otherwise("outdoor")
        place = F.when(against, F.struct(F.lit("environment").alias("entity_type"), side(r).alias("rule_value"), side(m).alias("llm_value"), F.lit("prefer_rules").alias("resolution"), F.lit("Conflicting environment settings. Preferring rules extraction.").alias("reason")))
        return F.filter(F.array(differ("material"), differ("finish"), place), lambda c: c.isNotNull())

    def result(r: Column, m: Column, c: Column) -> Column:
        barred = lambda x: F.exists(c, lambda k: k["entity_type"] == x["e"]["entity_type"])
        new = F.filter(m, lambda x: ~F.exists(r, lambda y: y["key"] == x["key"]))
        skipped = F.transform(F.filter(new, barred), lambda x: _text("Skipped LLM entity '", x["e"]["name"], "' due to conflict in type '", x["e"]["entity_type"], "'"))
        step = lambda acc, x: F.when(F.exists(acc, lambda y: y["key"] == x["key"]), acc).otherwise(F.concat(acc, F.array(x)))
        start = F.array().cast(f"array<struct<e:{ITEM},key:string,name:string>>")
        united = F.transform(F.aggregate(F.concat(r, F.filter(new, lambda x: ~barred(x))), start, step), lambda x: x["e"])
        return T.let(united, lambda u: with_notes(r, m, c, u, skipped))

    def with_notes(r: Column, m: Column, c: Column, united: Column, skipped: Column) -> Column:
        only = F.filter(united, lambda e: E.is_brand_only(e["name"], brands))
        left = F.transform(F.filter(united, lambda e: ~E.is_brand_only(e["name"], brands)), lambda e: e.withField("name", E.without_brands(e["name"], brands)))
        gone = F.concat(F.transform(only, lambda e: _text("Filtered out brand-only entity: '", e["name"], "'")), F.when(F.size(only) > 0, F.array(_text("Brand filtering removed ", F.size(only), " entities"))).otherwise(_none(NO_TEXTS)))
        last = F.array(_text("Merged ", F.size(r), " rules + ", F.size(m), " LLM → ", F.size(left), " entities (", F.size(c), " conflicts)"))
        a, b, n = F.size(r), F.size(m), F.size(c)
        base = F.when(b > 0, (2 * rules_confidence * a + model_confidence * b) / (2 * a + b)).otherwise(rules_confidence)
        score = base - 0.1 * n + F.when((a > 0) & (b > 0) & (n == 0), 0.05).otherwise(0.0)
        confidence = F.when((a == 0) & (b == 0), 0.1).otherwise(F.round(F.greatest(F.lit(0.1), F.least(F.lit(1.0), score)), 4))
        return F.struct(left.alias("merged_entities"), c.alias("conflicts"), confidence.alias("confidence"), F.concat(skipped, gone, last).alias("notes"))

    return T.let(keyed(rules), lambda r: T.let(keyed(model), lambda m: T.let(found_conflicts(r, m), lambda c: result(r, m, c))))


def placed(items: Column, grouped: Column, suggestions: Column | None = None, plain: bool = False) -> Column:
    """Where each entity, the first of its name, and each group of terms goes: (entity_name, entity_type, recommended_sections, reasoning).

    A model's suggestions add sections. The plain format has its own sections and reasons, and repeats names.
    """
    lookup = lambda t, pairs, else_: F.coalesce(*(F.when(t == k, v) for k, v in pairs), else_)
    if plain:
        sections = lambda t: lookup(t, ((k, T.literals(v[0])) for k, v in fixed.PLAIN_PLACEMENTS.items()), _none(NO_TEXTS))
        reason = lambda t: lookup(t, ((k, v[1]) for k, v in fixed.PLAIN_PLACEMENTS.items()), F.lit(fixed.PLAIN_PLACEMENT_REASON))
        rows, own = fixed.PLAIN_GROUP_PLACEMENTS, items
    else:
        sections = lambda t: lookup(t, ((k, T.literals(v)) for k, v in fixed.PLACEMENTS.items()), T.literals(["specs_table"]))
        reason = lambda t: lookup(t, fixed.PLACEMENT_REASONS.items(), F.lit(fixed.OTHER_PLACEMENT_REASON))
        rows, own = fixed.GROUP_PLACEMENTS, F.aggregate(items, _none(NO_ITEMS), lambda acc, e: F.when(F.exists(acc, lambda x: x["name"] == e["name"]), acc).otherwise(F.concat(acc, F.array(e))))
    more = lambda e: _none(NO_TEXTS) if suggestions is None else F.coalesce(F.map_keys(F.map_filter(suggestions, lambda k, v: F.array_contains(v, e["name"]))), _none(NO_TEXTS))
    each = F.transform(own, lambda e: F.struct(e["name"].alias("entity_name"), e["entity_type"].alias("entity_type"), F.array_distinct(F.concat(sections(e["entity_type"]), more(e))).alias("recommended_sections"), reason(e["entity_type"]).alias("reasoning")))
    groups = F.array(*(F.when(F.map_contains_key(grouped, g), F.struct(F.lit(n).alias("entity_name"), F.lit(t).alias("entity_type"), T.literals(s).alias("recommended_sections"), F.lit(r).alias("reasoning"))) for g, n, t, s, r in rows))
    return F.concat(each, F.filter(groups, lambda g: g.isNotNull()))


def extracted(products: DataFrame, brands: list[str] = (), threshold: float = 0.7, enabled: bool = True, available: bool = True) -> DataFrame:
    """The whole result of each product (product_id, product_name, terms array of phrases, description, search_query, force, response, groups).

    response is the model's stored answer and groups its grouping of the terms; both are read only where they are wanted, and null is
    no answer. The result has the audit: whether and why the model was wanted, conflicts, missing types and notes.
    """
    step = _with(products, "rules", rules_result(F.col("product_name"), F.col("terms"), F.col("description"), F.col("search_query")))
    step = _with(step, "gate", gate(F.col("rules.missing_types"), F.col("rules.confidence"), threshold, enabled, available, F.coalesce("force", F.lit(False))))
    step = _with(_with(step, "model", parsed(F.when(F.col("gate.invoke"), F.col("response")))), "groups", grouped_terms(F.col("terms"), F.col("groups")))
    step = _with(step, "merge", merged(F.col("rules.rule_entities"), F.col("model.llm_entities"), F.col("rules.confidence"), F.col("model.confidence"), brands))
    path = E.clean_path(E.final_path(F.col("rules.primary_entity_path"), F.col("model.primary_entity_path")), brands)
    asked = F.when(~F.col("gate.invoke"), F.array(_text("LLM skipped: ", F.col("gate.reason")))).when(F.col("model.success"), F.col("model.notes")).otherwise(F.array(F.lit("LLM extraction failed: Failed to get valid response from LLM")))
    audit = F.struct(F.col("gate.invoke").alias("llm_invoked"), F.when(F.col("gate.invoke"), F.col("gate.reason")).alias("llm_reason"), F.concat("rules.conflicts", "merge.conflicts").alias("conflicts"), F.col("rules.missing_types").alias("missing_types"), F.concat(F.col("rules.notes"), asked, F.col("merge.notes")).alias("notes"))
    return step.select(
        "product_id", E.without_brands(F.col("product_name"), brands).alias("product_name"), path.alias("primary_entity_path"), F.col("groups.grouped").alias("grouped_terms"), F.col("rules.rule_entities").alias("rule_entities"), F.col("model.llm_entities").alias("llm_entities"),
        F.col("merge.merged_entities").alias("supporting_entities"), placed(F.col("merge.merged_entities"), F.col("groups.grouped"), F.col("model.placement_suggestions")).alias("placement_map"), F.col("groups.noise").alias("noise_terms"), F.col("merge.confidence").alias("confidence"), audit.alias("audit"),
    )


def extracted_plain(products: DataFrame, brands: list[str] = ()) -> DataFrame:
    """The result in the plain format: rules alone, without regard to the search query."""
    step = _with(products, "rules", rules_result(F.col("product_name"), F.col("terms"), F.col("description"), F.lit(None).cast("string")))
    step = _with(step, "groups", grouped_terms(F.col("terms"), F.col("groups")))
    items = F.col("rules.rule_entities")
    supporting = F.transform(items, lambda e: F.struct(e["name"].alias("name"), e["entity_type"].alias("entity_type"), F.coalesce(e["why_it_matters"], F.lit("")).alias("why_it_matters")))
    return step.select("product_id", E.without_brands(F.col("product_name"), brands).alias("product_name"), E.clean_path(F.col("rules.primary_entity_path"), brands).alias("primary_entity_path"), supporting.alias("supporting_entities"), placed(items, F.col("groups.grouped"), plain=True).alias("placement_map"), F.col("groups.noise").alias("noise_terms"), F.col("groups.grouped").alias("grouped_terms"))
