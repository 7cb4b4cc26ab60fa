"""Every quick query against its SQL on the smallest tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from prodlens.functions import fixed_values as fixed
from prodlens.plans import catalog

SF = "/root/testdata/sf0.001"
SLOW = {"phrase_merge", "phrase_variants", "importance_rank", "importance_buckets", "source_stats", "phrase_page", "phrase_ui_filters", "keep_list_semi", "noise_anti", "select_keywords", "export_csv_rows", "tfidf_top_phrases"}


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if type(v).__name__ == "Decimal":
        return round(float(v), 6)
    return v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        path = f"{SF}/{f}" + ("/*" if os.path.isdir(f"{SF}/{f}") else "")
        con.execute(f"create view {f.split('.')[0]} as select * from read_parquet('{path}')")
    return con


@pytest.mark.parametrize("name", [n for n in catalog.ORACLE_SQL if n not in SLOW])
def test_same_rows(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    cur = duck.execute(catalog.ORACLE_SQL[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    assert got == sorted((tuple(plain(r[names.index(c)]) for c in cols) for r in cur.fetchall()), key=repr)


def test_rule_confidence_as_the_rules_sql(spark, duck):
    """Counts, missing types and confidence worked out from the rows that the SQL of the single rules gives."""
    found = {p: [] for (p,) in duck.execute("select p_partkey from part").fetchall()}
    for rule in ("dimensions", "weights", "capacity", "power", "materials", "finishes", "standards", "environments", "care"):
        for p, name, kind in duck.execute(f"select p_partkey, name, entity_type from ({catalog.ORACLE_SQL[f'rule_{rule}']})").fetchall():
            found[p].append((name, kind))
    expected = []
    for p, entities in found.items():
        types = {kind for _, kind in entities}
        for pair in ({"standard", "certification"}, {"care", "warranty"}):
            types |= pair if types & pair else set()
        missing = set(fixed.ENTITY_TYPES) - types
        places = {name.lower() for name, kind in entities if kind == "environment"}
        conflicts = {"indoor", "outdoor"} <= places and "indoor/outdoor" not in places
        score = min(0.5 + 0.05 * len(entities), 0.8) - 0.15 * len(missing & set(fixed.CRITICAL_TYPES)) - 0.1 * conflicts
        expected.append((p, len(entities), ",".join(sorted(missing)), round(max(0.1, min(1.0, score)), 4) if entities else 0.1))
    got = catalog.QUERIES["rule_confidence"](spark, SF).select("p_partkey", "n", "missing", "confidence").collect()
    assert sorted(map(tuple, got)) == sorted(expected)


def test_entry(spark):
    assert entry.entry(spark).columns == ["phrase", "tfidf_score", "doc_freq", "total_occurrences"]


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
