"""The page ladder on hand-made pages."""

import re

import pytest

from prodlens.html.dom import parse
from prodlens.html.extract import Options, clip, extract, heading_score, relevant, squeeze
from prodlens.plans import product_queries

LONG = "The acme kettle boils water quickly, keeps it warm for hours, and pours without a drip every time."


@pytest.mark.parametrize(
    ("html", "method"),
    [
        (f'<title>Acme Kettle</title><script type="application/ld+json">[{{"@type": "Product", "name": "Acme Kettle", "description": "{LONG}"}}]</script><h1>Acme Kettle</h1>', "jsonld"),
        (f'<h1>Acme Kettle</h1><script>window.product = {{"details": "<p>{LONG}</p>"}};</script>', "javascript"),
        (f'<h1>Acme Kettle</h1><div class="product-details"><p>{LONG}</p></div>', "main_product_section"),
        (f"<h1>Acme Kettle</h1><section><h2>Overview</h2><p>{LONG}</p></section>", "semantic_section"),
        (f'<title>Acme Kettle</title><meta name="description" content="{LONG}">', "meta_fallback"),
        (f"<title>Acme Kettle</title><main><i>{LONG}</i></main>", "best_block"),
        ("<title>Acme Kettle</title><p>Short.</p>", None),
        ("", None),
        (None, None),
    ],
)
def test_ladder(html, method):
    title, about, text, found, confidence = extract(html)
    assert found == method
    assert (text is None) == (method is None) and (confidence > 0) == (method is not None)


def test_related_products_are_left_out():
    html = f'<h1>Acme Kettle</h1><div class="related"><div class="product-details"><p>{LONG}</p></div></div>'
    assert extract(html)[3] is None


def test_unclosed_tags_and_scripts():
    root = parse("<div><p>one<p>two<script>var a = '</p>';</script><br>three</div><p>four")
    assert root.text() == "one two three four"


def test_irrelevant_description_is_skipped():
    assert not relevant("A poem about trees", "Acme Kettle Steel")
    assert relevant("anything", None)


def test_scores_and_clipping():
    assert heading_score("description") == 1.0 and heading_score("zzz") == 0.0
    assert clip("a  b " * 100, 10) == "a b a b a…"
    assert len(extract(f'<meta name="description" content="{"word " * 300}">', Options(max_chars=100))[2]) <= 100


def test_synthetic_pages_hold_letters_and_spaces_alone(spark, tmp_path):
    every = "".join(map(chr, [*range(0x00, 0xD800), *range(0xE000, 0x10000), 0x1F600, 0x10FFFF]))
    spark.createDataFrame([(2, every), (6, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.html for r in product_queries._synthetic_pages(spark, str(tmp_path)).collect()}
    assert product_queries.OPENING + re.sub("[^A-Za-z ]", " ", every) + "</p>" in got[2]
    assert product_queries.OPENING + "</p>" in got[6]


def test_squeeze_takes_all_white_space():
    every = "".join(map(chr, range(0x10000)))
    assert squeeze(every) == re.sub(r"\s+", " ", every).strip()


def test_title_entities_are_resolved_as_html_has_it():
    assert extract("<title>a &quot;b&quot; c&amp;d &amp</title><p>x</p>")[0] == 'a "b" c&d &'
