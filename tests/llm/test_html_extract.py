from __future__ import annotations

import itertools
import random
import time

import numpy as np
import pytest

from tests.llm import html_layouts
from tests.llm.conftest import LONG
from tillwatch.llm import gbt
from tillwatch.llm import html_extract as hx

PAGE = """<!DOCTYPE html><html><head><title>Not this</title><style>p{margin:0}</style><script>var t="</p>";</script></head><body>
<nav><ul><li><a href="/a">Home</a></li><li><a href="/b">the,</a></li><li><a href="/c">More</a></li></ul></nav><!-- ad --><div class="ad">Buy this now at once.</div>
<article><h1>A   title &amp; more</h1><p><b>First paragraph,<br>second line &lt;kept&gt;.<p>Loose &eacute;nd of it, with a <a href="#">link</a> inside.</p><p> </p><p>Short.</p></article>
<div class="comments"><p>I do not agree with this at all.</p></div><footer>&copy; example &middot; All of it.</footer></body></html>"""


@pytest.fixture(scope="module")
def model():
    return hx.fit()


def test_article_only(model):
    expected = "A title & more\n\nFirst paragraph, second line <kept>.\n\nLoose énd of it, with a link inside.\n\nShort."
    assert list(hx.extract_all([PAGE, PAGE.replace("</body></html>", "")], model)) == [expected] * 2


def main_blocks(html, main):
    page = hx.Page().finish(html)
    found = (hx.text_of(block, set(hx.holding(block, main)).__contains__) for block in page.blocks)
    return [text for text in found if text]


def test_held_out_pages(model):
    rng, right = random.Random(77), 0
    for _ in range(100):
        html, main = hx.labelled_page(rng)
        right += next(hx.extract_all([html], model)) == "\n\n".join(main_blocks(html, main))
    assert right >= 80


def test_pages_of_other_layouts(model):
    pages = html_layouts.pages()
    got = list(hx.extract_all([html for _, html, _ in pages], model))
    wrong = [name for (name, _, main), text in zip(pages, got, strict=True) if text != main]
    assert len(pages) == 40 and len(wrong) <= 4, wrong


def test_inline_clutter_within_a_kept_block(model):
    story = "<article><h1>How the old mill was saved</h1><p>For nearly forty years the mill by the river stood empty.{}</p><p>Today it grinds flour again.</p></article>"
    plain = next(hx.extract_all([story.format("")], model))
    for clutter in ('<span class="ad">Buy now!</span>', '<a class="advert" href="#">Two for one</a>', '<cookie-banner class="cookie-notice">We use cookies.</cookie-banner>'):
        assert next(hx.extract_all([story.format(" " + clutter)], model)) == plain, clutter
    kept = next(hx.extract_all([story.format(' So <em class="term">it was</em>, <span class="hl">they <b>say</b></span>, for long.')], model))
    assert "stood empty. So it was, they say, for long." in kept


def test_reading_the_tree():
    texts = lambda html: [hx.text_of(b, lambda _: True) for b in hx.Page().finish(html).blocks]
    assert texts("<p>a<button>A<button>B</button><p>b") == ["a", "b"]
    assert texts("<div><button>never closed</div>after<p>b") == ["after", "b"]
    assert texts("<select><option>A<option>B</select>x<select><option>never closed<input>y") == ["xy"]
    assert texts("<template><template>t</template>t</template>x") == ["x"]
    page = hx.Page().finish('<span class="a">1<span>2</span>3</span>4<b class="c"><i>5</b>6</i><p><span class="d">7<p>8</span>9')
    assert [[(page.kind[n], t) for n, t, _ in b] for b in page.blocks] == [[("inline", "123"), ("body", "4"), ("inline", "5"), ("body", "6")], [("inline", "7")], [("p", "89")]]
    named = hx.Page().finish(f'<div class="{"x " * 3000}sideBar">a</div>')
    assert named.marks[1] & hx.WORD_BITS["side"] and named.marks[1] & hx.WORD_BITS["bar" if "bar" in hx.WORD_BITS else "side"]
    rows = hx.Page().finish("<table><tr><td>a<tr><td>b<table><tr><td>c</table><td>d")
    assert [rows.depth[b[0][0]] for b in rows.blocks] == [3, 3, 6, 3]


@pytest.mark.parametrize("html", ["<div>" * 100_000 + "x" + "</p>" * 100_000, "<ul>" + "<li>x" * 100_000, "<li><ul>" + "<div>" * 50_000 + "<li></li>" * 50_000, '<span class="a">' * 50_000 + "<b>" * 50_000 + "</i>" * 50_000])
def test_time_in_proportion_to_the_page(model, html):
    started = time.monotonic()
    list(hx.extract_all([html], model))
    assert time.monotonic() - started < 20


def test_decoding_is_the_best_consistent_choice():
    rng = np.random.default_rng(1)
    for _ in range(60):
        n = int(rng.integers(1, 8))
        parent = [-1, *(int(rng.integers(0, i)) for i in range(1, n))]
        odds = rng.normal(size=n) * 2

        def value(kept, odds=odds):
            return sum(-np.logaddexp(0, -o) if k else -np.logaddexp(0, o) for k, o in zip(kept, odds, strict=True))

        choices = [k for k in itertools.product([True, False], repeat=n) if k[0] and all(not k[i] or k[parent[i]] for i in range(1, n))]
        got = hx.decode(parent, odds)
        assert tuple(got) in choices and value(got) == pytest.approx(max(map(value, choices)))


def test_trees_learn_a_rule_and_score_alike():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(600, 5))
    y = ((x[:, 1] > 0.2) ^ (x[:, 3] > 0)).astype(float)
    made = gbt.fit(x[:400], y[:400], trees=30)
    assert ((gbt.score(made, x[400:]) > 0) == y[400:]).mean() > 0.9
    assert gbt.fit(x[:400], y[:400], trees=30) == made
    assert gbt.score(gbt.fit(np.zeros((0, 3)), np.zeros(0)), np.zeros((2, 3))).tolist() == [0, 0]


def test_pages(spark):
    rows = [(1, "u", PAGE), (2, None, None), (3, "u", ""), (4, "u", "plain words, no markup"), (None, "u", PAGE), (1, "u", PAGE), (5, "u", "<p" * 500), (6, "u", "<article>" + f"<p>{LONG}</p>" * 3)]
    rows += [(7, "u", "<div>" * 3000 + "deep"), (8, "u", "<script>x</script><article><p>é&#x41;&amp</p>"), (9, "u", "</p></div>\x00<![CDATA[x]]><!-- never closed")]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id bigint, url string, html string, text string")
    got = hx.main_texts(pages).collect()
    by = {r.page_id: r.text for r in got}
    assert len(got) == len(rows) and by[1] == by[None] and by[2] == by[3] == "" and by[8] == "éA&"
    assert all(r.n_chars == len(r.text) for r in got) and by[6] == "\n\n".join([LONG] * 3)
    assert hx.main_texts(pages.limit(0)).collect() == []
