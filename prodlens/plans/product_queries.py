"""Queries of the page, entity, search, scrape and helper operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed_values as fixed
from ..functions import text as T
from ..html import extract as H
from ..operators import describe, hybrid, scrape, search
from ..operators import entities as E
from ..operators.layout import spread
from ..sources import connectors, sinks
from ..streaming import dedupe
from . import sql_text as S
from .phrase_queries import table


def _parts(s, d):
    """Parts over all cores: a row of the queries below costs much work, and the table's file may be a single row group."""
    return spread(table(s, d, "part"))


def _spec(s, d):
    """Specification texts built from parts."""
    text = F.lower(F.concat_ws(" ", "p_name", F.concat("p_size", F.lit("cm wide, height: "), "p_size", F.lit(' mm and 48 inch,')), F.concat("p_size", F.lit("kg weighs 3 lbs, 20 litre or 5 ml, 800w 240 volts 10 amps 5 kw,")), F.lit("as/nzs 4386 ip65 iso 9001-2 ul 94, 5 year warranty, hand wash, lifetime guarantee, patio and indoors"), F.when(F.col("p_size") % 3 == 0, "cool iron only, cotton fabric").otherwise("iron frame"), F.when(F.col("p_size") % 4 == 0, "brushed, matte and plated").when(F.col("p_size") % 4 == 1, "powder-coated")))
    return _parts(s, d).select("p_partkey", text.alias("t"))


SPEC = """(select p_partkey, lower(concat_ws(' ', p_name, p_size || 'cm wide, height: ' || p_size || ' mm and 48 inch,', p_size || 'kg weighs 3 lbs, 20 litre or 5 ml, 800w 240 volts 10 amps 5 kw,', 'as/nzs 4386 ip65 iso 9001-2 ul 94, 5 year warranty, hand wash, lifetime guarantee, patio and indoors', case when p_size % 3 = 0 then 'cool iron only, cotton fabric' else 'iron frame' end, case when p_size % 4 = 0 then 'brushed, matte and plated' when p_size % 4 = 1 then 'powder-coated' end)) as t from part)"""


def _rule(rule):
    return lambda s, d: _spec(s, d).select("p_partkey", F.posexplode(rule(F.col("t")))).select("p_partkey", "pos", "col.name", "col.entity_type", "col.evidence")


def _matches(patterns: list[str], unit: str | None, kind: str, most: int) -> str:
    """The first matches of measured patterns, without repeats."""
    parts = []
    for i, p in enumerate(patterns):
        name = f"v || {unit}" if unit else "upper(m)"
        fields = ", ".join(f"regexp_extract_all(t, {S.q(f'({p})')}, {g}) as {n}s" for g, n in ((1, "m"), (2, "v"), *([(3, "u")] if unit else [])))
        at = "ms[o] as m, vs[o] as v" + (", us[o] as u" if unit else "")
        parts.append(f"select p_partkey, {i} as k, o, m, {name} as name from (select p_partkey, o, {at} from (select *, unnest(range(1, len(ms) + 1)) as o from (select p_partkey, {fields} from {SPEC})))")
    return f"""with a as ({" union all ".join(parts)}),
      f as (select p_partkey, name, arg_min(m, (k, o)) as evidence, min((k, o)) as ko from a group by p_partkey, name),
      r as (select p_partkey, (row_number() over (partition by p_partkey order by ko) - 1)::int as pos, name, {kind} as entity_type, evidence from f)
      select * from r where pos < {most}"""


#: A lower-cased name with each letter after a non-letter in upper case.
TITLED = "array_to_string(list_transform(range(1, length(evidence) + 1), lambda i: case when i = 1 or not regexp_matches(evidence[i - 1], '[a-z]') then upper(evidence[i]) else evidence[i] end), '')"


def _dictionary(entries, kind: str, most: int, extra: str = "true") -> str:
    parts = []
    for i, e in enumerate(entries):
        for j, n in enumerate([e[1], *e[2]]):
            test = f"regexp_matches(t, {S.q(rf'\b{n}\b')})" if kind == "material" and n in fixed.WHOLE_WORD_MATERIALS else f"contains(t, {S.q(n)})"
            parts.append(f"select p_partkey, {i} as k, {j} as j, {S.q(e[1].title())} as name, {S.q(n)} as n, t from {SPEC} where {test} and {extra.format(i=i, n=S.q(n), names=S.lst([e[1], *e[2]]))}")
    at = "instr(t, n)"
    start, end = f"greatest({at} - 51, 0)", f"least(length(t), {at} - 1 + length(n) + 50)"
    ev = f"(case when {start} > 0 then '...' else '' end || trim(substr(t, {start} + 1, {end} - {start})) || case when {end} < length(t) then '...' else '' end)"
    return f"""with a as ({" union all ".join(parts)}),
      f as (select p_partkey, k, name, arg_min({ev}, j) as evidence from a group by all having true),
      r as (select p_partkey, (row_number() over (partition by p_partkey order by k) - 1)::int as pos, name, {S.q(kind)} as entity_type, evidence from f)
      select * from r where pos < {most}""".replace("f as (select p_partkey, k, name, arg_min(" + ev + ", j) as evidence from a group by all having true)", "f as (select p_partkey, k, name, arg_min(" + ev + ", j) as evidence from a group by p_partkey, k, name)")


def _category_sql(text: str, rows: str) -> str:
    """Rows with `best`, the category of a lower-cased text column."""
    cats = []
    for i, (c, ks) in enumerate(fixed.CATEGORIES.items()):
        one = []
        for k in ks:
            heavy = k in fixed.SPECIFIC_KEYWORDS
            part = (3.0 if heavy else 1.0) if " " in k else (0.5 if heavy else 0.3) if len(k) >= 4 else 0.0
            one.append(f"case when list_contains(string_split({text}, ' '), {S.q(k)}) then {3.0 if heavy else 1.0} when contains({text}, {S.q(k)}) then {part} else 0.0 end")
        cats.append(f"select *, {S.q(c)} as category, {i} as i, round({' + '.join(one)}, 4)::double as score from {rows}")
    return " union all ".join(cats)


CATEGORY_TEXT = "lower(p_name) || ' phone oven table lamp ' || lower(p_type) || case when p_size % 4 = 0 then ' coffee cup' when p_size % 4 = 1 then ' desk and chair' else '' end"


def _categories(s, d):
    t = F.concat(F.lower("p_name"), F.lit(" phone oven table lamp "), F.lower("p_type"), F.when(F.col("p_size") % 4 == 0, " coffee cup").when(F.col("p_size") % 4 == 1, " desk and chair").otherwise(""))
    return _parts(s, d).select("p_partkey", t.alias("t"))


def _entities(s, d):
    """Two origins of synthetic entities: rules from parts of even size, the other from shifted ones."""
    part = _parts(s, d)
    word = lambda i: F.split("p_name", " ")[i]
    rows = [
        ("rules", 0, word(0), "material", F.lit(True)),
        ("rules", 1, F.lit("Indoor"), "environment", F.col("p_size") % 2 == 0),
        ("rules", 2, F.lit("Powder-Coated"), "finish", F.col("p_size") % 3 == 0),
        ("llm", 0, F.when(F.col("p_size") % 5 == 0, word(0)).otherwise(F.lit("aluminum frame")), "material", F.lit(True)),
        ("llm", 1, F.lit("outdoors"), "environment", F.col("p_size") % 4 == 0),
        ("llm", 2, F.lit("powder coated"), "finish", F.lit(True)),
        ("llm", 3, F.concat(F.col("p_size"), F.lit("cm")), "dimension", F.lit(True)),
    ]
    out = None
    for origin, pos, name, kind, when in rows:
        r = part.filter(when).select(F.col("p_partkey").alias("product_id"), F.lit(origin).alias("origin"), F.lit(pos).alias("pos"), name.alias("name"), F.lit(kind).alias("entity_type"))
        out = r if out is None else out.unionAll(r)
    return out


ENTITIES = """e0 as (
  select p_partkey as product_id, 'rules' as origin, 0 as pos, string_split(p_name, ' ')[1] as name, 'material' as entity_type from part
  union all select p_partkey, 'rules', 1, 'Indoor', 'environment' from part where p_size % 2 = 0
  union all select p_partkey, 'rules', 2, 'Powder-Coated', 'finish' from part where p_size % 3 = 0
  union all select p_partkey, 'llm', 0, case when p_size % 5 = 0 then string_split(p_name, ' ')[1] else 'aluminum frame' end, 'material' from part
  union all select p_partkey, 'llm', 1, 'outdoors', 'environment' from part where p_size % 4 = 0
  union all select p_partkey, 'llm', 2, 'powder coated', 'finish' from part
  union all select p_partkey, 'llm', 3, p_size || 'cm', 'dimension' from part)"""
X = r"regexp_replace(trim(lower(name)), '[^\p{L}\p{N}_\s-]', '', 'g')"
KEY = "case " + " ".join(f"when {X} = {S.q(v)} or starts_with({X}, {S.q(v + ' ')}) then {S.q(c)} || substr({X}, {len(v) + 1})" for v, c in fixed.NAME_VARIANTS) + f" else {X} end"
MERGE = f"""with {ENTITIES}, e as (select *, trim(regexp_replace({KEY}, '\\s+', ' ', 'g')) as key from e0),
  g as (select product_id, entity_type, list(distinct key) filter (origin = 'rules') as r, list(distinct key) filter (origin = 'llm') as m from e group by all),
  c as (select product_id, entity_type from g where r is not null and m is not null and (
    (entity_type in ('material', 'finish') and not list_has_any(r, m))
    or (entity_type = 'environment' and ((len(list_filter(r, lambda x: contains(x, 'indoor'))) > 0 and len(list_filter(m, lambda x: contains(x, 'outdoor'))) > 0 and len(list_filter(r, lambda x: contains(x, 'outdoor'))) = 0)
      or (len(list_filter(r, lambda x: contains(x, 'outdoor'))) > 0 and len(list_filter(m, lambda x: contains(x, 'indoor'))) > 0 and len(list_filter(r, lambda x: contains(x, 'indoor'))) = 0)))))"""
BRANDS = [f"Brand#{i}" for i in range(1, 26)]


def _hits(s, d):
    """Orders as queries and their lines as hits."""
    lines, parts, sup = (table(s, d, n) for n in ("lineitem", "part", "supplier"))
    rows = lines.join(parts, lines.l_partkey == parts.p_partkey).join(F.broadcast(sup) if sup.count() <= 100_000 else sup, lines.l_suppkey == sup.s_suppkey)
    return rows.select(F.col("l_orderkey").alias("query_key"), (F.col("l_linenumber") - 1).alias("pos"), F.col("p_name").alias("title"), F.col("s_name").alias("source"), F.concat(F.lit("$"), F.col("l_partkey").cast("string")).alias("price"), F.when(F.col("l_suppkey") % 3 == 0, F.concat(F.lit("https://x.example/"), F.col("l_partkey").cast("string"))).alias("link"))


HITS = "hits as (select l_orderkey as query_key, l_linenumber - 1 as pos, p_name as title, s_name as source, '$' || l_partkey as price, case when l_suppkey % 3 = 0 then 'https://x.example/' || l_partkey end as link from lineitem join part on l_partkey = p_partkey join supplier on l_suppkey = s_suppkey)"


def _links(s, d):
    hits = _hits(s, d)
    return hits.groupBy("title", "source").agg(F.concat(F.lit("https://found.example/"), F.min("price")).alias("found_link"))


def _results(s, d):
    return table(s, d, "lineitem").select((F.col("l_orderkey") % 500).alias("batch"), F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("idx0"), (F.col("l_returnflag") != "R").alias("ok"))


def _ranked(s, d):
    from pyspark.sql import Window

    return _results(s, d).select("batch", (F.row_number().over(Window.partitionBy("batch").orderBy("idx0")) - 1).alias("idx"), "ok")


RESULTS = "res as (select l_orderkey % 500 as batch, (row_number() over (partition by l_orderkey % 500 order by l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1)::int as idx, l_returnflag <> 'R' as ok from lineitem)"


def _records(s, d):
    """Scrape records from parts."""
    f = lambda h, t: F.struct(h.cast("string").alias("heading"), t.cast("string").alias("description"))
    features = F.array(f(F.lit("Size "), F.concat("p_size", F.lit(" cm."))), f(F.col("p_type"), F.lit("")), f(F.lit(None), F.lit("  Well  made")))
    return _parts(s, d).select("p_partkey", F.col("p_name").alias("name"), F.when(F.col("p_size") % 2 == 0, F.format_string("$%.2f", "p_retailprice")).alias("price"), F.when(F.col("p_size") % 5 != 0, features).alias("features"), F.when(F.col("p_size") % 3 == 0, F.lit("Access denied.")).when(F.col("p_size") % 7 == 0, F.lit(" Ships soon ")).alias("additional"))


DESC = """(select p_partkey, p_name as name, case when p_size % 2 = 0 then printf('$%.2f', p_retailprice) end as price, p_size, case when p_size % 3 = 0 then 'Access denied.' when p_size % 7 = 0 then 'Ships soon' end as add_, case when p_size % 5 <> 0 then ['Size: ' || p_size || ' cm.', p_type, 'Well  made'] end as fs from part)"""
JOINED = "replace(replace(array_to_string(list_concat(coalesce(fs, []), case when add_ is null then [] else [add_] end), '. '), '..', '.'), '  ', ' ')"
DESCRIBED = f"(select *, case when {JOINED} = '' then null when {JOINED} like '%.' then {JOINED} else {JOINED} || '.' end as text from {DESC})"
ERROR = f"(length(text) < 1000 and len(list_filter({S.lst(fixed.ERROR_PHRASES)}, lambda p: contains(lower(text), p))) > 0)"

WORDS = lambda x: f"list_distinct(list_filter(regexp_split_to_array({x}, '\\s+'), lambda w: w <> ''))"
OVERLAP = lambda a, b: f"(case when len({WORDS(a)}) > 0 and len({WORDS(b)}) > 0 then len(list_intersect({WORDS(a)}, {WORDS(b)}))::double / len(list_distinct(list_concat({WORDS(a)}, {WORDS(b)}))) else 0.0 end)"
HEADING = "least(1.0, greatest(" + ", ".join(f"case when x = {S.q(k)} then 1.0 when contains(x, {S.q(k)}) then 0.7 when {OVERLAP('x', S.q(k))} > 0.5 then 0.5 * {OVERLAP('x', S.q(k))} else 0.0 end" for k in fixed.HEADING_KEYWORDS) + ") + " + " + ".join(f"case when contains(x, {S.q(w)}) then 0.15 else 0.0 end" for w in fixed.CONTAINER_WORDS) + ")"


TITLE = "Sturdy Kettle"
OPENING = f"{TITLE} of steel for every kitchen with a long handle and lid "


def _synthetic_pages(s, d, kind=None):
    """A page for each document, with its whole text in JSON-LD, a script, a description block or metadata: of one kind, or by turns."""
    # all but [A-Za-z ], which Java finds several times faster by the ranges than by their complement
    body = F.concat(F.lit(OPENING), F.regexp_replace(F.coalesce("text", F.lit("")), r"[\x00-\x1f!-@\[-`{-\x{10ffff}]", " "))
    turn = F.col("doc_id") % 4 if kind is None else F.lit(kind)
    head, h1 = f"<html><head><title>{TITLE}</title>", f"<h1>{TITLE}</h1>"
    page = lambda before, after: F.concat(F.lit(head + before), body, F.lit(after))
    html = F.when(turn == 0, page(f'<script type="application/ld+json">{{"@graph":[{{"@type":["Thing","Product"],"name":"{TITLE}","description":"', f'"}}]}}</script></head><body>{h1}</body></html>'))
    html = html.when(turn == 1, page(f'</head><body>{h1}<script>var product = {{"description": "', '"};</script></body></html>'))
    html = html.when(turn == 2, page(f'</head><body>{h1}<div class="product-details"><p>', "</p></div></body></html>"))
    html = html.otherwise(page('<meta name="description" content="', f'"></head><body>{h1}</body></html>'))
    return spread(table(s, d, "documents").select("doc_id", "text")).select("doc_id", html.alias("html"))


def _clipped(x: str, most: int) -> str:
    return f"case when length({x}) <= {most} then {x} else rtrim(left({x}, {most - 1})) || '…' end"


BODIES = f"(select doc_id, {S.squeezed(f"{S.q(OPENING)} || regexp_replace(coalesce(text, ''), '[^A-Za-z ]', ' ', 'g')")} as b from documents)"


def _ladder(method: str) -> str:
    return f"select doc_id, {_clipped('b', 2000)} as text, {method} as extraction_method from {BODIES}"


def _found(s, d, kind=None):
    return H.extracted(_synthetic_pages(s, d, kind)).select("doc_id", F.col("product_description").alias("text"), "extraction_method")


ANSWER = """{"primary_entity_path": "Apparel > Shirt", "llm_entities": [{"name": "Acme", "type": "Material", "evidence": "Acme shirt"}, {"name": "Acme Length 70cm", "type": "Dimension", "evidence": "70cm long", "value": "70", "unit": "cm"}, {"name": "Outdoors", "type": "Environment", "evidence": "for outdoors"}, {"name": "Silk", "type": "finish"}, "x"], "placement_map": {"designed_for": ["Hand Wash"], "faqs": ["Length 70cm"]}, "faqs": [{"question": "Is it long?", "answer": "70cm", "evidence": "70cm long"}, {"question": "Why?", "answer": ""}], "confidence": {"primary_entity": 0.8, "supporting_entities": 0.6}, "notes": {"conflicts": ["a"], "missing_types": []}}"""
GROUPS = """```json
{"Core Attributes": ["blue"], "Functional Terms": [], "Care Instructions": ["hand wash"], "Noise": ["sale"]}
```"""


def _products(s, d):
    """Three kinds of products by turns: one that rules tell all of, one that needs the model's answer, and one whose answer cannot be read."""
    k = F.col("p_size") % 3
    pick = lambda *xs: F.when(k == 0, xs[0]).when(k == 1, xs[1]).otherwise(xs[2])
    none = F.lit(None).cast("string")
    return _parts(s, d).select(
        F.col("p_partkey").alias("product_id"), pick("Acme Oak Desk", "Acme Cotton Shirt", "Widget").alias("product_name"), pick(T.literals(["matte", " "]), T.literals(["blue", "hand wash", "sale"]), T.literals(["blue"])).alias("terms"),
        pick(F.lit("120cm wide, 5kg"), F.lit("for indoors"), none).alias("description"), pick(F.lit("office desk and chair"), none, none).alias("search_query"), pick(F.lit(None), F.lit(False), F.lit(True)).cast("boolean").alias("force"), pick(none, F.lit(ANSWER), F.lit("no json")).alias("response"), pick(none, F.lit(GROUPS), F.lit("[1]")).alias("groups"),
    )


def _names(items):
    return F.array_join(F.transform(items, lambda e: F.concat(e["entity_type"], F.lit("="), e["name"])), "; ")


def _by_turns(*rows: str) -> str:
    """SQL of rows by p_size % 3, each a select list."""
    return " union all ".join(f"select p_partkey as product_id, {r} from part where p_size % 3 = {k}" for k, r in enumerate(rows))


def _extraction_results(s, d):
    part = _parts(s, d)
    f = F.struct(F.lit("Size").alias("heading"), F.col("p_size").cast("string").alias("description"))
    return part.select(F.col("p_partkey").cast("string").alias("url"), F.when(F.col("p_size") % 5 == 0, "timeout").when(F.col("p_size") % 5 == 1, "").alias("error"), F.when(F.col("p_size") % 2 == 0, F.col("p_name")).alias("product_name"), F.col("p_type").alias("title"), F.col("p_retailprice").cast("string").alias("price"), F.when(F.col("p_size") % 3 == 0, F.array(f)).alias("features"), F.lit(None).cast("string").alias("additional_information"), F.concat(F.lit("A short. This one is long enough. "), F.col("p_name")).alias("product_description"))


#: name: (query, SQL or None)
DEFINED = {
    "rule_dimensions": (_rule(E.dimensions), _matches(fixed.DIMENSION_PATTERNS, "case when u in ('\"', 'inch', 'inches') then 'inch' else u end", "'dimension'", 5)),
    "rule_weights": (_rule(E.weights), _matches(fixed.WEIGHT_PATTERNS, "case when u in ('lb', 'lbs', 'pound', 'pounds') then 'lb' when u = 'g' then 'g' else 'kg' end", "'weight'", 2)),
    "rule_capacity": (_rule(E.capacities), _matches(fixed.CAPACITY_PATTERNS, "case when u in ('l', 'litre', 'liter', 'litres', 'liters') then 'L' when u = 'ml' then 'mL' else u end", "'capacity'", 2)),
    "rule_power": (_rule(E.power), _matches(fixed.POWER_PATTERNS, "case when contains(u, 'watt') then 'W' when contains(u, 'kw') then 'kW' when contains(u, 'volt') then 'V' when contains(u, 'amp') then 'A' when contains(u, 'mj') then 'MJ/h' else u end", "'rating'", 3)),
    "rule_standards": (_rule(E.standards), _matches([p.strip() for p in fixed.STANDARD_PATTERNS], None, "case when name like 'IP%' then 'rating' when contains(name, 'CE') or contains(name, 'UL') then 'certification' else 'standard' end", 5)),
    "rule_care": (_rule(E.care), _matches([f"({p})" for p in fixed.CARE_PATTERNS], None, "case when contains(evidence, 'warranty') or contains(evidence, 'guarantee') then 'warranty' else 'care' end", 3).replace("select * from r", f"select p_partkey, pos, {TITLED} as name, entity_type, evidence from r")),
    "rule_finishes": (_rule(E.finishes), _dictionary(fixed.FINISHES, "finish", 3)),
    "rule_environments": (_rule(E.environments), _dictionary(fixed.ENVIRONMENTS, "environment", 4)),
    "rule_materials": (_rule(E.materials), _dictionary(fixed.MATERIALS, "material", 5, f"not (list_has_any({{names}}, {S.lst(fixed.TEXTILE_IMPOSSIBLE)}) and len(list_filter({S.lst(fixed.TEXTILE_SIGNS)}, lambda s: contains(t, s))) > 0) and not ({{n}} = 'iron' and contains(t, 'cool iron'))")),
    "rule_confidence": (
        lambda s, d: _spec(s, d).select("p_partkey", T.let(F.col("t"), E.rule_entities).alias("e")).select("p_partkey", F.size("e").alias("n"), E.missing_types(F.col("e")).alias("m"), "e").select("p_partkey", "n", F.array_join(F.array_sort("m"), ",").alias("missing"), E.rule_confidence(F.col("e"), F.col("m"), E.rule_conflicts(F.col("e"))).alias("confidence")),
        None,
    ),
    "category_score": (lambda s, d: _categories(s, d).select("p_partkey", F.explode(E.category_scores(F.col("t"))).alias("c")).select("p_partkey", "c.category", "c.score"), f"select p_partkey, category, score from ({_category_sql('t', f'(select p_partkey, {CATEGORY_TEXT} as t from part)')})"),
    "primary_path": (
        lambda s, d: _categories(s, d).join(table(s, d, "part").select("p_partkey", F.when(F.col("p_size") % 2 == 0, F.lit("coffee cup")).alias("query")), "p_partkey").select("p_partkey", E.primary_path(F.col("query"), F.col("t")).alias("path")),
        f"with c as (select * from ({_category_sql('t', f'(select p_partkey, p_size, {CATEGORY_TEXT} as t from part)')}) where score >= 2.0), b as (select p_partkey, arg_min(category, (-score, i)) as best from c group by p_partkey) select part.p_partkey, case when p_size % 2 = 0 then 'Drinkware > Coffee Cup' else coalesce(best, 'Product > Unknown') end as path from part left join b on b.p_partkey = part.p_partkey",
    ),
    "entity_merge": (lambda s, d: E.merged(_entities(s, d)), MERGE + ", a as (select e.* from e left join c using (product_id, entity_type) where origin = 'rules' or c.product_id is null), n as (select *, row_number() over (partition by product_id, entity_type, key order by origin desc, pos) as n from a) select product_id, origin, pos, name, entity_type, key from n where n = 1"),
    "entity_conflicts": (lambda s, d: E.conflicts(_entities(s, d)), MERGE + " select * from c"),
    "entity_confidence": (lambda s, d: E.merged_confidence(_entities(s, d), 0.7, 0.4), MERGE + ", k as (select product_id, count(*) filter (origin = 'rules') as r, count(*) filter (origin = 'llm') as m from e group by 1), cc as (select product_id, count(*) as c from c group by 1) select k.product_id, round(greatest(0.1, least(1.0, case when m > 0 then (2 * 0.7 * r + 0.4 * m) / (2 * r + m) else 0.7 end - 0.1 * coalesce(c, 0) + case when r > 0 and m > 0 and c is null then 0.05 else 0.0 end)), 4)::double as confidence from k left join cc on cc.product_id = k.product_id"),
    "placement_map": (
        lambda s, d: E.placements(_entities(s, d)),
        f"with {ENTITIES}, f as (select product_id, name, arg_min(entity_type, (case when origin = 'rules' then 0 else 1 end, pos)) as entity_type from e0 group by 1, 2) select *, case entity_type " + " ".join(f"when {S.q(t)} then {S.q(','.join(x))}" for t, x in fixed.PLACEMENTS.items()) + " else 'specs_table' end as sections from f",
    ),
    "missing_types": (
        lambda s, d: _entities(s, d).groupBy("product_id").agg(F.array_join(F.array_sort(F.array_except(T.literals(fixed.ENTITY_TYPES), F.collect_set("entity_type"))), ",").alias("missing")),
        f"with {ENTITIES}, t as (select product_id, list(distinct entity_type) as ts from e0 group by 1) select product_id, array_to_string(list_sort(list_filter({S.lst(fixed.ENTITY_TYPES)}, lambda x: not list_contains(ts, x))), ',') as missing from t",
    ),
    "brand_removal": (lambda s, d: _parts(s, d).select("p_partkey", E.without_brands(F.concat("p_brand", F.lit(" - "), F.col("p_name"), F.lit(" pty ltd ,")), BRANDS).alias("name")), "select p_partkey, p_name as name from part"),
    "entity_path_clean": (lambda s, d: _parts(s, d).select("p_partkey", E.clean_path(F.concat(F.lit("Hardware › Acme > "), F.col("p_type"), F.lit(" » acme Tap")), ["Acme"]).alias("path")), "select p_partkey, 'Hardware > ' || p_type || ' > Tap' as path from part"),
    "final_path": (lambda s, d: _parts(s, d).select("p_partkey", E.final_path(F.when(F.col("p_size") % 2 == 0, F.col("p_type")).otherwise("Product > Unknown"), F.when(F.col("p_size") % 3 == 0, F.lit("Tools"))).alias("path")), "select p_partkey, case when p_size % 2 = 0 then p_type when p_size % 3 = 0 then 'Tools' else 'Product > Unknown' end as path from part"),
    "search_hits_topk": (lambda s, d: search.top_hits(_hits(s, d), 4), f"with {HITS}, c as (select * from hits where pos < 4) select query_key, title, min(pos)::int as pos, arg_max(source, (pos, source, price)) as source, arg_max(price, (pos, source, price)) as price, arg_max_null(link, (pos, source, price)) as link from c group by 1, 2"),
    "query_dedupe": (
        lambda s, d: search.distinct_queries(table(s, d, "part").select(F.concat(F.lit("  "), F.upper("p_name"), F.lit("  x ")).alias("query"), F.col("p_partkey").alias("pos"))),
        "select lower(trim(p_name)) || ' x' as query_key, arg_min('  ' || upper(p_name) || '  x ', p_partkey) as query, min(p_partkey) as pos from part group by 1",
    ),
    "link_enrich": (lambda s, d: search.enriched(_hits(s, d), _links(s, d), 3), f"with {HITS}, l as (select title, source, 'https://found.example/' || min(price) as found_link from hits group by 1, 2) select query_key, pos, title, source, price, case when coalesce(link, '') = '' and pos < 3 then coalesce(found_link, link) else link end as link from hits left join l using (title, source)"),
    "backup_topup": (lambda s, d: search.topped_up(_ranked(s, d)), f"with {RESULTS}, b as (select *, coalesce(sum(ok::int) over (partition by batch order by idx rows between unbounded preceding and 1 preceding), 0) as before from res), t as (select batch, idx, ok, row_number() over (partition by batch order by idx) as n from b where (idx < 8 or before < 8) and ok) select batch, idx, ok from t where n <= 8"),
    "batch_totals": (lambda s, d: search.batch_totals(_ranked(s, d)), f"with {RESULTS} select batch, count(*) as total, count_if(ok)::bigint as successes, count_if(not ok)::bigint as failures from res group by 1"),
    "title_relevance": (
        lambda s, d: table(s, d, "pages").select("page_id", T.is_relevant(F.regexp_replace("html", "(?s)<title.*?</title>|<h1.*?</h1>", " "), F.regexp_extract("html", "(?s)<title[^>]*>(.*?)</title>", 1)).alias("relevant")),
        rf"with t as (select page_id, lower(regexp_replace(html, '(?s)<title.*?</title>|<h1.*?</h1>', ' ', 'g')) as x, list_filter(list_distinct(regexp_extract_all(regexp_replace(lower(regexp_extract(html, '(?s)<title[^>]*>(.*?)</title>', 1)), '[^\x00-\x7F\P{{L}}]', '_', 'g'), '\b([a-z]{{3,}})\b', 1)), lambda w: not list_contains({S.lst(fixed.RELEVANCE_STOP_WORDS)}, w)) as w from pages) select page_id, case when x = '' or len(w) = 0 then true else len(list_filter(w, lambda y: contains(x, y))) / len(w) >= 0.3 end as relevant from t",
    ),
    "heading_score": (
        lambda s, d: _parts(s, d).select("p_partkey", F.round(T.heading_score(F.concat(F.element_at(T.literals(["Key Features of ", "About ", "Main product details ", "Technical ", "Zzz "]), F.col("p_size") % 5 + 1), F.col("p_name"))), 4).alias("score")),
        f"select p_partkey, round({HEADING}, 4)::double as score from (select p_partkey, lower((['Key Features of ', 'About ', 'Main product details ', 'Technical ', 'Zzz '])[p_size % 5 + 1] || p_name) as x from part)",
    ),
    "jaccard": (lambda s, d: table(s, d, "documents").select("doc_id", F.round(T.word_overlap(F.lower("text"), F.lower(F.regexp_replace("text", r"[aeiou]\S*", ""))), 6).alias("j")), f"select doc_id, round({OVERLAP('a', 'b')}, 6)::double as j from (select doc_id, lower(text) as a, lower(regexp_replace(text, '[aeiou]\\S*', '', 'g')) as b from documents)"),
    "bot_challenge": (
        lambda s, d: table(s, d, "pages").select("page_id", T.is_challenge(F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("Just a moment"), F.substring("html", 1, 100))).when(F.col("page_id") % 5 == 0, F.concat("html", F.lit("Cloudflare RAY ID"))).otherwise(F.col("html"))).alias("challenge")),
        f"with h as (select page_id, lower(case when page_id % 3 = 0 then 'Just a moment' || substr(html, 1, 100) when page_id % 5 = 0 then html || 'Cloudflare RAY ID' else html end) as h from pages) select page_id, (length(h) < 3000 and len(list_filter({S.lst(fixed.CHALLENGE_PHRASES)}, lambda p: contains(h, p))) > 0) or contains(h, 'checking your browser before accessing') or (contains(h, 'verify you are human') and length(h) < 10000) or (contains(h, 'please complete the captcha') and length(h) < 10000) or (contains(h, 'cloudflare') and contains(h, 'ray id') and length(h) < 15000) as challenge from h",
    ),
    "clip_text": (lambda s, d: table(s, d, "documents").select("doc_id", T.clipped(F.col("text"), 200).alias("text")), f"select doc_id, case when length(t) <= 200 then t else rtrim(left(t, 199)) || '…' end as text from (select doc_id, {S.squeezed('text')} as t from documents)"),
    "meta_title": (lambda s, d: H.extracted(table(s, d, "pages")).select("page_id", "meta_title"), r"select page_id, trim(replace(replace(replace(replace(replace(regexp_extract(html, '(?s)<title[^>]*>(.*?)</title>', 1), '&lt;', '<'), '&gt;', '>'), '&copy;', '©'), '&middot;', '·'), '&amp;', '&')) as meta_title from pages"),
    "jsonld_extract": (lambda s, d: _found(s, d, 0), _ladder("'jsonld'")),
    "js_product_data": (lambda s, d: _found(s, d, 1), _ladder("'javascript'")),
    "html_ladder": (lambda s, d: H.extracted(table(s, d, "pages")), None),
    "html_ladder_synthetic": (lambda s, d: _found(s, d), _ladder("(['jsonld', 'javascript', 'main_product_section', 'meta_fallback'])[doc_id % 4 + 1]")),
    "scrape_project": (lambda s, d: _records(s, d).select("p_partkey", "name", "price", scrape.description(F.col("features"), F.col("additional")).alias("text")), f"select p_partkey, name, price, text from {DESCRIBED}"),
    "scrape_error_filter": (lambda s, d: _records(s, d).select("p_partkey", scrape.checked(scrape.description(F.col("features"), F.col("additional"))).alias("text")), f"select p_partkey, case when not {ERROR} then text end as text from {DESCRIBED}"),
    "scrape_confidence": (
        lambda s, d: _records(s, d).withColumn("text", scrape.checked(scrape.description(F.col("features"), F.col("additional")))).select("p_partkey", scrape.confidence(F.col("name"), F.col("price"), F.col("features"), F.col("additional"), F.col("p_partkey") % 2 == 0, F.col("text")).alias("confidence")),
        f"select p_partkey, case when text is null or {ERROR} then 0.0 else round(least(1.0, 0.5 + 0.15 + case when price is not null then 0.1 else 0.0 end + least(0.15, 0.03 * coalesce(len(fs), 0)) + case when add_ is not null then 0.1 else 0.0 end - case when p_partkey % 2 = 0 then 0.05 else 0.0 end), 4) end::double as confidence from {DESCRIBED}",
    ),
    "product_text": (lambda s, d: _records(s, d).select("p_partkey", scrape.product_text(F.col("name"), F.col("features"), F.col("additional")).alias("text")), "select p_partkey, concat_ws(' ', p_name, case when p_size % 5 <> 0 then 'Size  ' || p_size || ' cm. ' || p_type || '   Well  made' end, case when p_size % 3 = 0 then 'Access denied.' when p_size % 7 = 0 then ' Ships soon ' end) as text from part"),
    "split_features": (lambda s, d: table(s, d, "documents").select("doc_id", F.size(scrape.split_features(F.col("text"))).alias("n")), "select doc_id, len(list_filter(string_split(text, '. '), lambda x: length(x) > 10))::int as n from documents"),
    "combine_source_text": (
        lambda s, d: describe.combined(table(s, d, "conversations"), "conv_id", "turn", "text"),
        "with t as (select conv_id, coalesce(string_agg(text, chr(10) order by turn, text) filter (text <> ''), '') as t from conversations group by 1) select conv_id, case when t = '' then 'No source text available.' when length(t) <= 2000 then t else left(t, 2000) || '...' end as source_text from t",
    ),
    "first_name_price": (
        lambda s, d: describe.names_and_prices(table(s, d, "part").select("p_brand", F.col("p_partkey").alias("pos"), F.when(F.col("p_size") > 40, F.col("p_name")).alias("product_name"), F.when(F.col("p_size") > 45, F.lit("")).otherwise(F.col("p_type")).alias("title"), F.when(F.col("p_size") > 10, F.col("p_retailprice")).alias("price")), "p_brand", "pos", ["product_name", "title"], "price"),
        "with r as (select *, case when p_size > 40 then p_name else nullif(case when p_size > 45 then '' else p_type end, '') end as n from part) select p_brand, coalesce(arg_min(n, p_partkey) filter (n is not null), 'Product') as name, (arg_min(p_retailprice, p_partkey) filter (p_size > 10))::varchar as price, count(*) as products_combined from r group by 1",
    ),
    "source_text": (
        lambda s, d: _records(s, d).select("p_partkey", describe.source_text(F.col("features"), F.when(F.col("additional").isNotNull(), F.array("additional")), F.col("name")).alias("text")),
        "select p_partkey, concat_ws('; ', case when p_size % 5 <> 0 then 'Size : ' || p_size || ' cm.' end, case when p_size % 5 <> 0 then '  Well  made' end, case when p_size % 3 = 0 then 'Access denied.' when p_size % 7 = 0 then ' Ships soon ' end, p_name) as text from part",
    ),
    "description_answer": (
        lambda s, d: _parts(s, d).select("p_partkey", describe.answered(F.when(F.col("p_size") % 3 == 0, F.concat(F.lit('```json\n{"description": "A fine '), F.col("p_name"), F.lit('", "key_features": ["a", "b"]}\n```'))).when(F.col("p_size") % 3 == 1, F.concat(F.lit(" Just "), F.col("p_name"), F.lit(" ")))).alias("a")).select("p_partkey", "a.description", F.array_join("a.key_features", ",").alias("features"), "a.word_count", "a.success"),
        "with a as (select p_partkey, p_size % 3 as k, case p_size % 3 when 0 then 'A fine ' || p_name when 1 then 'Just ' || p_name else '' end as description from part) select p_partkey, description, case when k = 0 then 'a,b' else '' end as features, len(list_filter(string_split(description, ' '), lambda w: w <> ''))::int as word_count, k < 2 as success from a",
    ),
    "hybrid_entities": (
        lambda s, d: hybrid.extracted(_products(s, d), ["acme"]).select("product_id", "product_name", "primary_entity_path", _names(F.col("rule_entities")).alias("rules"), _names(F.col("supporting_entities")).alias("merged"), "confidence", F.col("audit.llm_invoked").alias("invoked"), F.col("audit.llm_reason").alias("reason"), F.array_join("audit.notes", " / ").alias("notes"), F.array_join(F.transform("audit.conflicts", lambda c: F.concat_ws("|", c["entity_type"], c["rule_value"], c["llm_value"], c["resolution"])), ";").alias("conflicts"), F.array_join("noise_terms", ",").alias("noise")),
        _by_turns(
            "'Oak Desk' as product_name, 'Furniture > Office Desk And Chair' as primary_entity_path, 'dimension=120cm; weight=5kg; material=Oak; finish=Matte' as rules, 'dimension=120cm; weight=5kg; material=Oak; finish=Matte' as merged, 0.7::double as confidence, false as invoked, null::varchar as reason, 'Extracted 4 entities via rules / LLM skipped: Rules extraction sufficient / Merged 4 rules + 0 LLM → 4 entities (0 conflicts)' as notes, '' as conflicts, '' as noise",
            "'Cotton Shirt', 'Apparel', 'material=Cotton; environment=Indoor; care=Hand Wash', 'material=Cotton; environment=Indoor; care=Hand Wash; dimension=Length 70cm', 0.3667::double, true, 'Missing critical types: [''dimension'']', 'Extracted 3 entities via rules / LLM conflicts: [''a''] / LLM extracted 3 entities / Skipped LLM entity ''Acme'' due to conflict in type ''material'' / Skipped LLM entity ''Outdoors'' due to conflict in type ''environment'' / Merged 3 rules + 3 LLM → 4 entities (2 conflicts)', 'material|Cotton|Acme|prefer_rules;environment|indoor|outdoor|prefer_rules', 'sale'",
            "'Widget', 'Product > Unknown', '', '', 0.1::double, true, 'Forced by request', 'Extracted 0 entities via rules / LLM extraction failed: Failed to get valid response from LLM / Merged 0 rules + 0 LLM → 0 entities (0 conflicts)', '', ''",
        ),
    ),
    "hybrid_plain": (
        lambda s, d: hybrid.extracted_plain(_products(s, d), ["acme"]).select("product_id", "product_name", "primary_entity_path", F.array_join(F.transform("supporting_entities", lambda e: F.concat(e["name"], F.lit(": "), e["why_it_matters"])), "; ").alias("entities"), F.array_join(F.transform("placement_map", lambda p: F.concat(p["entity_name"], F.lit(">"), F.array_join(p["recommended_sections"], "+"))), "; ").alias("places")),
        _by_turns(
            f"'Oak Desk' as product_name, 'Product > Unknown' as primary_entity_path, '120cm: ' || {S.q(fixed.REASONS['dimension'])} || '; 5kg: ' || {S.q(fixed.REASONS['weight'])} || '; Oak: ' || {S.q(fixed.REASONS['material'])} || '; Matte: ' || {S.q(fixed.REASONS['finish'])} as entities, '120cm>; 5kg>; Oak>specs_table+features+care_instructions; Matte>; Specifications>specs_table' as places",
            f"'Cotton Shirt', 'Apparel', 'Cotton: ' || {S.q(fixed.REASONS['material'])} || '; Indoor: Product is designed for indoor conditions.; Hand Wash: ' || {S.q(fixed.REASONS['care'])}, 'Cotton>specs_table+features+care_instructions; Indoor>designed_for+use_cases+features; Hand Wash>care_instructions+maintenance+faq; Specifications>specs_table'",
            "'Widget', 'Product > Unknown', '', 'Specifications>specs_table'",
        ),
    ),
    "llm_parse": (
        lambda s, d: _products(s, d).select("product_id", hybrid.parsed(F.col("response")).alias("p")).select("product_id", "p.success", "p.primary_entity_path", _names(F.col("p.llm_entities")).alias("entities"), F.size("p.faqs").alias("faqs"), F.round("p.confidence", 4).alias("confidence"), F.array_join(F.col("p.placement_suggestions")["features"], ",").alias("features"), F.array_join("p.notes", " / ").alias("notes")),
        _by_turns("false as success, null::varchar as primary_entity_path, '' as entities, 0 as faqs, 0.0::double as confidence, null::varchar as features, '' as notes", "true, 'Apparel > Shirt', 'material=Acme; dimension=Acme Length 70cm; environment=Outdoors', 1, 0.7::double, 'Hand Wash', 'LLM conflicts: [''a''] / LLM extracted 3 entities'", "false, null, '', 0, 0.0::double, null, ''"),
    ),
    "placement_llm": (
        lambda s, d: hybrid.extracted(_products(s, d), ["acme"]).select("product_id", F.explode("placement_map").alias("p")).select("product_id", "p.entity_name", "p.entity_type", F.array_join("p.recommended_sections", "+").alias("sections"), "p.reasoning"),
        "with x as (" + " union all ".join(f"select {k} as k, {S.q(n)} as entity_name, {S.q(t)} as entity_type, {S.q(sec)} as sections, {S.q(r)} as reasoning" for k, n, t, sec, r in [
            *((0, n, t, "+".join(fixed.PLACEMENTS[t]), fixed.PLACEMENT_REASONS[t]) for n, t in (("120cm", "dimension"), ("5kg", "weight"), ("Oak", "material"), ("Matte", "finish"))),
            (1, "Cotton", "material", "specs_table+features+care_instructions", fixed.PLACEMENT_REASONS["material"]), (1, "Indoor", "environment", "designed_for+use_cases+features", fixed.PLACEMENT_REASONS["environment"]),
            (1, "Hand Wash", "care", "care_instructions+maintenance+faq+features+designed_for", fixed.PLACEMENT_REASONS["care"]), (1, "Length 70cm", "dimension", "specs_table+hero_copy+faqs", fixed.PLACEMENT_REASONS["dimension"]),
            *((k, "Specifications", "core_attributes", "specs_table", fixed.GROUP_PLACEMENTS[0][4]) for k in (0, 1, 2)),
        ]) + ") select p_partkey as product_id, entity_name, entity_type, sections, reasoning from part join x on p_size % 3 = k",
    ),
    "term_grouping": (
        lambda s, d: _products(s, d).select("product_id", hybrid.grouped_terms(F.col("terms"), F.col("groups")).alias("g")).select("product_id", F.array_join(F.array_sort(F.transform(F.map_entries("g.grouped"), lambda e: F.concat(e["key"], F.lit(":"), F.array_join(e["value"], ",")))), ";").alias("grouped"), F.array_join("g.noise", ",").alias("noise")),
        _by_turns("'Core Attributes:matte' as grouped, '' as noise", "'Care Instructions:hand wash;Core Attributes:blue', 'sale'", "'Core Attributes:blue', ''"),
    ),
    "llm_gate": (
        lambda s, d: _parts(s, d).select("p_partkey", hybrid.gate(F.when(F.col("p_size") % 4 == 0, T.literals(["care", "dimension", "material"])).otherwise(T.literals(["care"])), F.col("p_size") / 100, 0.3).alias("g")).select("p_partkey", "g.invoke", "g.reason"),
        "select p_partkey, p_size % 4 = 0 or p_size < 30 as invoke, case when p_size % 4 = 0 then 'Missing critical types: [''material'', ''dimension'']' when p_size < 30 then 'Low rules confidence: ' || printf('%.2f', p_size / 100) || ' < 0.3' else 'Rules extraction sufficient' end as reason from part",
    ),
    "llm_prompt": (
        lambda s, d: _products(s, d).withColumn("r", hybrid.rules_result(F.col("product_name"), F.col("terms"), F.col("description"), F.col("search_query"))).select("product_id", F.contains(hybrid.prompt(F.col("product_name"), F.lit(None).cast("string"), F.col("description"), F.lit(None).cast("string"), F.transform("terms", lambda t: F.struct(t.alias("phrase"), F.lit(0.12345).alias("tfidf_score"))), F.col("r.missing_types"), F.col("r.rule_entities"), F.col("r.conflicts"), F.col("search_query")), F.lit('{"tfidf_terms":{"blue":0.123')).alias("has_terms")),
        _by_turns("false as has_terms", "true", "true"),
    ),
    "request_terms": (
        lambda s, d: _parts(s, d).select("p_partkey", F.explode(hybrid.request_terms(F.concat(F.lit('[{"term": "'), F.col("p_name"), F.lit('", "score": 1.5, "docFreq": '), F.col("p_size"), F.lit('}, {"phrase": "x", "term": "y", "importanceScore": "7"}]')))).alias("t")).select("p_partkey", "t.*"),
        "select p_partkey, p_name as phrase, 1.5::double as tfidf_score, p_size::bigint as doc_freq, 0.0::double as importance_score, 'tfidf' as source from part union all select p_partkey, 'x', 0.0, 1, 7.0, 'tfidf' from part",
    ),
    "products_required": (lambda s, d: hybrid.required(_products(s, d).withColumn("product_name", F.when(F.col("product_id") % 3 == 0, "").otherwise(F.col("product_name"))).withColumn("terms", F.when(F.col("product_id") % 5 != 0, F.col("terms")))).select("product_id"), "select p_partkey as product_id from part where p_partkey % 3 <> 0 and p_partkey % 5 <> 0"),
    "brand_only": (lambda s, d: _parts(s, d).select("p_partkey", E.is_brand_only(F.when(F.col("p_size") % 2 == 0, F.col("p_brand")).otherwise(F.concat("p_brand", F.lit(" kettle"))), BRANDS).alias("only"), E.has_brand(F.concat(F.lit("a "), F.lower("p_brand")), BRANDS).alias("has")), "select p_partkey, p_size % 2 = 0 as only, true as has from part"),
    "standard_descriptions": (
        lambda s, d: E.described(_parts(s, d).select("p_partkey", F.concat(F.lit("iso "), F.col("p_size") % 4).alias("name")), s.createDataFrame([(1, "ISO 1", "second"), (0, "iso 1", "first"), (2, "Iso 2", "two")], "region_pos int, name string, description string")),
        "select p_partkey, 'iso ' || (p_size % 4) as name, case p_size % 4 when 1 then 'first' when 2 then 'two' end as description from part",
    ),
    "entities_by_type": (lambda s, d: E.by_type(_entities(s, d)).select("product_id", "entity_type", F.array_join(F.transform("entities", lambda e: e["name"]), ",").alias("names")), f"with {ENTITIES} select product_id, entity_type, string_agg(name, ',' order by pos, origin, name) as names from e0 group by 1, 2"),
    "hits_linked": (lambda s, d: search.linked(_hits(s, d)).groupBy("query_key").agg(F.count("*").alias("n")), f"with {HITS} select query_key, count(*) as n from hits where coalesce(link, '') <> '' group by 1"),
    "urls_requested": (lambda s, d: search.requested(table(s, d, "pages").select("page_id", F.when(F.col("page_id") % 3 == 0, "  ").when(F.col("page_id") % 3 == 1, F.col("url")).alias("url"))).select("page_id"), "select page_id from pages where page_id % 3 = 1 and trim(url) <> ''"),
    "results_adapted": (
        lambda s, d: scrape.adapted(_extraction_results(s, d)).select("url", "product_name", "price", F.array_join(F.transform("features", lambda f: F.concat_ws("=", f["heading"], f["description"])), "|").alias("features")),
        "select p_partkey::varchar as url, case when p_size % 2 = 0 then p_name else p_type end as product_name, p_retailprice::varchar as price, case when p_size % 3 = 0 then 'Size=' || p_size else '=This one is long enough' || case when length(p_name) > 10 then '|=' || p_name else '' end end as features from part where p_size % 5 <> 0",
    ),
    "results_without_errors": (lambda s, d: search.without_errors(_extraction_results(s, d)).select("url"), "select p_partkey::varchar as url from part where p_size % 5 <> 0"),
    "scrape_status": (
        lambda s, d: table(s, d, "pages").select("page_id", scrape.method(F.when(F.col("page_id") % 7 != 0, F.col("url")).otherwise(" "), F.when(F.col("page_id") % 3 == 0, 200).when(F.col("page_id") % 3 == 1, 500)).alias("method")),
        "select page_id, case when page_id % 7 = 0 then null when page_id % 3 = 0 then 'firecrawl' when page_id % 3 = 1 then 'firecrawl_api_error' else 'firecrawl_error' end as method from pages",
    ),
    "scrape_unwrap": (
        lambda s, d: _parts(s, d).select("p_partkey", connectors.scraped(F.concat(F.when(F.col("p_size") % 2 == 0, F.lit('{"success": true, "data": {')).otherwise(F.lit("{")), F.when(F.col("p_size") % 3 == 0, F.lit('"json"')).otherwise(F.lit('"extract"')), F.lit(': {"product_name": "'), F.col("p_name"), F.lit('"}}'), F.when(F.col("p_size") % 2 == 0, F.lit("}")).otherwise(""))).getField("product_name").alias("name")),
        "select p_partkey, p_name as name from part",
    ),
    "record_normalised": (lambda s, d: scrape.normalised(table(s, d, "pages").select("url", F.lit("m").alias("extraction_method"), F.lit(1).alias("extra")), True).select("url", "product_name", "extraction_method", "confidence_score"), "select url, null::varchar as product_name, 'm' as extraction_method, null::double as confidence_score from pages"),
    "cache_eviction": (lambda s, d: search.evicted(table(s, d, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_orderdate").alias("stored"))).select("key"), "select o_orderkey as key from orders where o_orderkey not in (select o_orderkey from orders order by o_orderdate, o_orderkey limit 20)"),
    "url_valid": (lambda s, d: table(s, d, "pages").select("page_id", T.is_url(F.when(F.col("page_id") % 2 == 0, F.col("url")).otherwise("ftp://x")).alias("ok"), T.checked_url(F.concat("url", F.lit("//"))).alias("checked")), r"select page_id, page_id % 2 = 0 and regexp_matches(url, '^https?://[^/?#\s]+') as ok, case when regexp_matches(url, '^https?://[^/?#\s]+') then regexp_replace(url || '//', '/+$', '') end as checked from pages"),
    "price_valid": (lambda s, d: _records(s, d).select("p_partkey", T.is_price(F.col("price")).alias("ok")), "select p_partkey, p_size % 2 = 0 as ok from part"),
    "numbers": (lambda s, d: table(s, d, "documents").select("doc_id", F.posexplode(T.numbers(F.col("text"))).alias("pos", "value")), r"select doc_id, (generate_subscripts(v, 1) - 1)::int as pos, unnest(v)::double as value from (select doc_id, regexp_extract_all(text, '(-?\d+(?:\.\d+)?)', 1) as v from documents)"),
    "filename": (lambda s, d: table(s, d, "pages").select("page_id", T.file_name(F.col("url")).alias("name")), r"""select page_id, coalesce(nullif(left(regexp_replace(regexp_replace(url, '[<>:"/\\|?*\x00-\x1f]', '_', 'g'), '^[ .]+|[ .]+$', '', 'g'), 255), ''), 'untitled') as name from pages"""),
    "truncate": (lambda s, d: table(s, d, "documents").select("doc_id", T.truncated(F.col("text"), 50).alias("text")), "select doc_id, case when length(text) <= 50 then text else left(text, 47) || '...' end as text from documents"),
    "strip_tags": (lambda s, d: table(s, d, "pages").select("page_id", T.without_tags(F.col("html")).alias("text")), "select page_id, replace(replace(replace(replace(replace(replace(replace(replace(regexp_replace(html, '<[^>]+>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&nbsp;', ' '), '&copy;', '©'), '&middot;', '·'), '&amp;', '&') as text from pages"),
    "alphanumeric": (lambda s, d: table(s, d, "documents").select("doc_id", T.alphanumeric(F.col("text")).alias("text")), r"select doc_id, regexp_replace(text, '[^a-zA-Z0-9\s]', '', 'g') as text from documents"),
    "request_ttl_dedupe": (
        lambda s, d: dedupe.first_in_window(table(s, d, "events"), "user_id", "ts", 300).select("event_id", "user_id"),
        "with recursive s as (select user_id, min(ts) as ts from events group by 1 union all select e.user_id, min(e.ts) from s join events e on e.user_id = s.user_id and e.ts >= s.ts + interval 300 seconds group by e.user_id) select min(event_id) as event_id, e.user_id from s join events e on e.user_id = s.user_id and e.ts = s.ts group by e.user_id, e.ts",
    ),
    "report_text": (
        lambda s, d: _parts(s, d).select("p_partkey", sinks.report(F.col("p_name"), F.when(F.col("p_size") % 2 == 0, F.format_string("$%.2f", "p_retailprice")), F.concat("p_type", F.lit("  goods ")), F.when(F.col("p_size") % 3 == 0, F.array("p_brand", "p_type")).otherwise(F.array().cast("array<string>"))).alias("report")),
        "select p_partkey, concat_ws(chr(10), repeat('=', 60), 'PRODUCT DESCRIPTION', repeat('=', 60), 'Product: ' || p_name, case when p_size % 2 = 0 then printf('Price: $%.2f', p_retailprice) end, 'Words: ' || (len(string_split(p_type, ' ')) + 1), chr(10) || p_type || '  goods ', case when p_size % 3 = 0 then chr(10) || 'Keywords: ' || p_brand || ', ' || p_type end, repeat('=', 60)) as report from part",
    ),
}
