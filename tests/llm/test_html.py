import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from warpsift.llm import html
from warpsift.llm.html_blocks import blocks_of


@pytest.fixture(scope="module")
def chain():
    return html.default_chain()


def texts(page):
    return [b.text for b in blocks_of(page)]


def test_blocks():
    assert texts("a<p>b <b>c</b>\n d<br>e<p>f&amp;g &eacute;&#x41;&am") == [
        "a", "b c d e", "f&g éA&am"]
    assert texts("<script>var x='</p>';</script><style>p{}</style><p>x<!-- no --> y") == ["x y"]
    assert texts("<title>t</title><body>u<SCRIPT>1</Script >v") == ["uv"]
    assert texts("") == [] and texts("   \n") == [] and texts("<") == ["<"]
    assert texts("1 < 2 and <a href='x>y'>3</a>") == ["1 < 2 and 3"]
    assert texts("<p>x<script>never closed") == ["x"]
    assert texts('<p title="it\'s>x') == ["x"] and texts("<!-- open <p>x") == []


def test_elements_around_a_block():
    b = blocks_of('<div class="Side-bar x"><ul><li>one<li><a href="">two</a></ul></div><p>three')
    assert [x.tags for x in b] == [("div", "ul", "li"), ("div", "ul", "li"), ("p",)]
    assert b[0].names == ("side", "bar", "x") and b[2].names == ()
    assert [x.links for x in b] == [0, 1, 0]
    nested = blocks_of("<article><p><b>a<br><p>b</article><footer>c")
    assert [x.tags for x in nested] == [("article", "p"), ("article", "p"), ("footer",)]


def test_long_and_broken_pages_take_linear_time():
    for piece in ("<p>word word ", "<div class='x'>", "<a href=\"", "<!--", "</p>", "&amp", "< "):
        blocks_of(piece * 3_000)
    assert len(texts("<p>x</p>" * 20_000)) == 20_000


def test_held_out_pages(chain):
    pages = html.training_pages(250, seed=77)
    right = [x == y for blocks, labels in pages for x, y in zip(chain.label(blocks), labels)]
    assert np.mean(right) > 0.97


def test_viterbi_against_all_labellings(chain):
    blocks = blocks_of("<nav>a</nav><div>b c</div><article><h1>T</h1><p>Long text here. And more."
                       "</p></article><footer>f</footer>")
    emit = [sum(chain.weights.get(f, 0.0) for f in html.block_features(b, i, len(blocks)))
            for i, b in enumerate(blocks)]

    def score(labels):
        total = chain.start[labels[0]] + sum(e for e, x in zip(emit, labels) if x)
        return total + sum(chain.step[a, b] for a, b in zip(labels, labels[1:]))

    want = max(itertools.product([0, 1], repeat=len(blocks)), key=score)
    assert tuple(map(int, chain.label(blocks))) == want


def test_training_lowers_the_penalised_loss():
    pages = html.training_pages(40, seed=3)
    rare = html.train(pages)
    right = [x == y for blocks, labels in pages for x, y in zip(rare.label(blocks), labels)]
    assert np.mean(right) > 0.99


def test_main_text(chain):
    page = """<html><head><title>t</title></head><body><header><h2>Site name</h2></header>
    <nav><ul><li><a href=/>Home</a></li></ul></nav><div class="cookie-notice">We use cookies.</div>
    <article><h1>The   title</h1><p>First &amp; foremost, this is a text.</p>
    <div class="ad">Buy now.</div><p>Second paragraph\n follows, with <a href=x>a link</a> in it.</p>
    </article><section class="comments"><div class="comment"><p>First comment!</p></div></section>
    <form><label>Mail</label><button>Go</button></form><aside><h3>Related</h3><p>Another</p></aside>
    <footer>&copy; somebody</footer>"""
    assert html.main_text(page, chain) == (
        "The title First & foremost, this is a text. "
        "Second paragraph follows, with a link in it.")
    assert html.main_text(None, chain) == html.main_text("", chain) == ""


def test_query_against_the_article_element(spark):
    import re
    from html import unescape
    sf = "/root/testdata/sf0.01"
    pages = {r.page_id: r for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    wrong = 0
    for r in html.op5_main_text(spark, sf).collect():
        inner = re.search("<article>(.*?)</article>", pages[r.page_id].html, re.S)
        want = " ".join(unescape(re.sub("<[^>]*>", " ", inner[1])).split()) if inner else ""
        wrong += want != r.text
        assert r.n_chars == len(r.text) and r.url == pages[r.page_id].url
    assert wrong <= 0.02 * len(pages)


def test_odd_rows(spark, chain):
    rows = [(1, "u", None), (2, None, ""), (None, "u", "<article><p>Some text here.</p></article>"),
            (3, "u", "<p>" + "Long text. " * 50_000), (3, "u", "plain text without a tag."),
            (3, "u", "plain text without a tag.")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    out = html.extract(df.withColumns({"text": F.lit("x"), "blocks": F.lit(1)}), chain).collect()
    assert len(out) == 6 and {r.text for r in out if r.page_id in (1, 2)} == {""}
    assert [r.text for r in out if r.page_id is None] == ["Some text here."]
    assert html.extract(df.limit(0), chain).count() == 0
    assert html.extract(df.drop("url"), chain).count() == 6


def test_heads_without_an_end():
    head = "<!DOCTYPE html><html><head><title>x <b>y</title><meta a=b><style>p{}</style>"
    assert texts(f"{head}<article><h1>A</h1><p>b") == ["A", "b"]
    assert texts(f"{head}<noscript><p>z</noscript><script>1</script> <a href=''>A</a>") == ["A"]
    assert texts(f"{head}b<p>c") == ["b", "c"]
    assert texts(f"{head}</head><body><p>c") == ["c"]


def test_formulas_and_upper_case_end_tags():
    assert texts("<p>so <math><semantics><mi>E</mi><mo>=</mo><mi>m</mi><annotation>E=m</annotation>"
                 "</semantics></math> holds") == ["so E=m holds"]
    assert texts("<p>İ<SCRIPT>1</SCRIPT>x<STYLE>p{}</STYLE>y") == ["İxy"]
    assert texts("<p>a<script>'</scripts>'</script>b") == ["ab"]
