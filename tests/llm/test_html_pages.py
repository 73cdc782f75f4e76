"""Pages that once lost text of the article, kept what is none, or took too long."""

import time

import pytest

from tidewright.llm import html

text = lambda t: html._text(html.parse(t), set())

WHOLE = {
    "<article><p>a<svg/>b</p><p>c</p></article>": "ab\nc",
    "<article><p>a<svg><path d='x'/></svg>b</p><p>c</p></article>": "ab\nc",
    "<article><p>of <math><mi>x</mi><mspace/><mo>+</mo><mn>1</mn><annotation encoding='tex'>x+1</annotation></math> here</p><p>c</p></article>": "of x+1 here\nc",
    "<main><header><h1>Title</h1></header><p>b</p></main>": "Title\nb",
    "<main><div class='page-header'><h1>Title</h1></div><p>b</p></main>": "Title\nb",
    "<div class='page-header'><h1>Title</h1></div><div class='content'><p>body</p></div>": "Title\nbody",
    "<article><p class='social'>a</p><ul><li class='menu'>b</li></ul></article>": "a\nb",
    "<article><p>x</p><section id='notice'><h2>Notice</h2><p>of the court</p></section></article>": "x\nNotice\nof the court",
    "<article><p>x</p><blockquote class='promo'>said</blockquote><table><tr><td class='login'>cell</td></tr></table></article>": "x\nsaid\ncell",
    "<header><h1>Site</h1></header><main><article><header><h1>T</h1></header><p>b</p></article></main>": "T\nb",
}
CLEAN = {
    "<article><p>x</p><div id='disqus_thread'><p>mine</p></div></article>": "x",
    "<body><div class='content'><p>only this</p></div><div id='disqus_thread'><p>mine</p></div></body>": "only this",
    "<article><p>x</p><div class='notice'><p>we use cookies</p></div></article>": "x",
    "<article><p>x</p><section id='comments'><h2>Comments</h2><p>nice</p></section></article>": "x",
    "<article><p>x</p><div class='related-posts'><h3>More</h3><ul><li>y</li></ul></div></article>": "x",
    "<article><p>x</p><div class='ad'><h4>Buy</h4><p>now</p></div><span class='share'>tweet</span></article>": "x",
    "<div class='header'><h1>Site</h1></div><div class='post'><h1>Title</h1><p>body of it</p></div>": "Title\nbody of it",
}


@pytest.mark.parametrize("page", WHOLE)
def test_article_text_stays(page):
    assert text(page) == WHOLE[page]


@pytest.mark.parametrize("page", CLEAN)
def test_what_is_no_article_goes(page):
    assert text(page) == CLEAN[page]


@pytest.mark.parametrize(
    "page",
    [
        "<i>" * 100_000 + "x" + "</b>" * 100_000,
        "<b><p>" + "<i>" * 100_000 + "x" + "</b>" * 100_000,
        "<ul>" + "<li><b>" * 50_000 + "x" + "</u>" * 50_000,
        "<div>" * 50_000 + "x" + "</div>" * 50_000,
        "<p>x" + "<dt><i>" * 50_000,
        "<article>" * 30_000 + "<p>x</p>" + "</article>" * 30_000,
        "<p>x</p>" + "<h1>" * 40_000,
    ],
)
def test_deep_and_unbalanced_pages_take_linear_time(page):
    began = time.process_time()
    got = html.parse(page)
    got.hashes()
    assert time.process_time() - began < 4 and "x" in "".join(got.blocks)


def test_nested_subtrees_with_equal_text_have_equal_hashes():
    one, two = html.parse("<div><div><p>a</p><p>b</p></div><p>c</p></div>"), html.parse("<p>z</p><div><p>a</p><p>b</p></div>")
    hashes = lambda p, n: {h for h, a, b in p.hashes() if b - a == n}
    assert hashes(one, 2) == hashes(two, 2) != set() and not hashes(one, 3) & hashes(two, 3)
