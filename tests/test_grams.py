"""Counts of n-grams against counting them all."""

import random
import re
from collections import Counter

import pytest

from prodlens.functions import fixed_values as fixed
from prodlens.functions import text as T
from prodlens.operators import grams as G
from prodlens.operators import phrases as P


@pytest.fixture(scope="module")
def lines():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(60)]
    return ["", *(" ".join(rng.choices(words, [1 / (i + 1) for i in range(60)], k=rng.randint(0, 40))) for _ in range(150))]


@pytest.fixture(scope="module")
def texts(spark, lines):
    return spark.createDataFrame([(x,) for x in lines], "words string").repartition(3)


def counts(lines):
    df, total = Counter(), Counter()
    for x in lines:
        w = x.split()
        g = [tuple(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)]
        total.update(g)
        df.update(set(g))
    return df, total


@pytest.mark.parametrize("by, cap", [("total", 40), ("df", 100), ("total", 100_000)])
def test_most_frequent_is_exact_with_ties(texts, lines, by, cap):
    df, total = counts(lines)
    fits = lambda p, d: 2 <= d <= 0.85 * len(lines) and p != ("w1",)
    measure = df if by == "df" else total
    every = sorted(((measure[p], p) for p in total if fits(p, df[p])), reverse=True)
    least = every[min(cap, len(every)) - 1][0]
    got = {p: (d, t) for p, d, t in G.most_frequent(texts, cap, by, 2, fits)}
    wanted = {p: (df[p], total[p]) for m, p in every if m >= least}
    assert wanted.items() <= got.items()
    assert all((df[p], total[p]) == v for p, v in got.items())


def test_too_many_rare_phrases_are_counted_in_full(spark, lines, monkeypatch):
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    expected = P.vocabulary(docs, cap=500)[0].collect(), P.frequent_phrases(docs, 150).collect()
    monkeypatch.setattr(G, "LIST_ROWS", 30)
    assert G.most_frequent(P._words(docs, []), 500, "total", 2, lambda p, d: True) is None
    assert (P.vocabulary(docs, cap=500)[0].collect(), P.frequent_phrases(docs, 150).collect()) == expected


def test_substring_counts_do_not_overlap(spark):
    df = spark.createDataFrame([("aaaa b aa",), (None,), ("b",), ("a\na",)], "text string")
    assert {r.i: r.n for r in G.substring_counts(df, ["aa", "b", "zz"]).collect()} == {0: 3, 1: 2, 2: 0}
    assert {r.i: r.n for r in G.substring_counts(df, ["a\na"]).collect()} == {0: 1}
    assert G.substring_counts(df, []).collect() == []


def test_noun_phrases_per_document_and_occurrence(spark):
    docs = spark.createDataFrame([(1, "steel kettle handling printer printer"), (2, "steel kettle printer"), (3, "ring")], "doc_id long, text string")
    got = {r.phrase: (r.doc_freq, r.total_occurrences, r.root_word) for r in P.noun_phrases(docs, min_df=1).collect()}
    assert got == {"steel kettle": (2, 2, "kettle"), "handling": (1, 1, "handling"), "kettle handling": (1, 1, "handling"), "printer": (2, 3, "printer"), "handling printer": (1, 2, "printer"), "printer printer": (1, 2, "printer"), "kettle printer": (1, 1, "printer"), "ring": (1, 1, "ring")}


def test_nothing_stays_held(spark, lines):
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    P.united(docs)
    assert not docs.is_cached and spark.sparkContext._jsc.getPersistentRDDs().isEmpty()


def test_grouped_alternation_finds_the_same():
    rng = random.Random(1)
    pieces = [*fixed.MARKETING_PHRASES, *(w for p in fixed.MARKETING_PHRASES for w in p.split()), "x", "un", "-", "1"]
    a, b = re.compile(T.alternation(fixed.MARKETING_PHRASES)), re.compile(T.grouped_alternation(fixed.MARKETING_PHRASES))
    for _ in range(3000):
        t = "".join(rng.choice(pieces) + rng.choice([" ", " ", " ", "", "."]) for _ in range(8))
        assert [m.span() for m in a.finditer(t)] == [m.span() for m in b.finditer(t)]
