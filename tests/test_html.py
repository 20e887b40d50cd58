"""Markup cases that the given pages lack."""

import pytest
from pyspark.sql import functions as F

from lodestrand.functions import html as H
from lodestrand.operators import candidates as C


def rows(spark, *pages):
    return spark.createDataFrame(list(enumerate(pages)), "page_id long, html string")


@pytest.mark.parametrize(
    ("token", "name", "value"),
    [
        ('<meta name="description" content="Bob\'s rice is good">', "content", "Bob's rice is good"),
        ("<meta content='say \"yes\"'>", "content", 'say "yes"'),
        ("<div class=sidebar>", "class", "sidebar"),
        ("<div CLASS = Side id=x>", "class", "Side"),
        ('<div data-id="header">', "id", ""),
        ('<div title="a class=b" class="c">', "class", "c"),
        ("<div class>", "class", ""),
        ("<div/class=a/>", "class", "a/"),
        ('<div class="">', "class", ""),
        ('<div class="one" class="two">', "class", "one"),
        ("<div " + "a " * 20000 + "class=z>", "class", "z"),
    ],
)
def test_attribute(spark, token, name, value):
    assert spark.createDataFrame([(token,)], "t string").select(H.attribute(F.col("t"), name)).first()[0] == value


def test_titles_and_descriptions_resolve_every_entity(spark):
    page = '<title>A &eacute; &#233; &#xe9; &hellip; x</title><meta name="description" content="Bob&rsquo;s &amp;amp; &frac12;"><meta property="og:description" content=" ">'
    got = rows(spark, page, "<h1>&Auml;</h1>").select("page_id", H.page_title(F.col("html")).alias("t"), H.meta_descriptions(F.col("html")).alias("d")).orderBy("page_id").collect()
    assert [(r.t.title, r.t.source, r.d) for r in got] == [("A é é é … x", "title", ["Bob’s &amp; ½"]), ("Ä", "h1", [])]


def test_source_text_is_cleaned_as_candidates_are(spark):
    parsed = spark.createDataFrame([(1, ["one &eacute; <b>two</b>", ""], "body &#x41;\r\n\r\n\r\nend")], "page_id long, descriptions array<string>, body string")
    assert C.source_text(parsed).first().source_text == "one é two\n\nbody A\n\nend"


def test_elements_named_in_quotes_only(spark):
    page = '<body><div class=sidebar>gone <p>gone too</p></div><div data-id="header">stays</div><div id=\'footer\'>gone</div><p role=navigation>gone</p><p>end</p></body>'
    text = H.block_text(H.without(H.html_tokens(rows(spark, page)), H.by_tag, H.by_role, H.by_hint)).first().text
    assert text.split() == ["stays", "end"]


def test_bodies_in_one_pass(spark):
    page = (
        "<body><article><p>Inside the article.</p><a href='x'>link <b>in</b></a></article><nav>gone</nav>"
        "<p>" + "long text " * 5 + "</p><p><a href='y'>" + "only a link " * 4 + "</a></p><p>short</p></body>"
    )
    got = C.bodies(rows(spark, page, "<p></p>", "<main>open")).orderBy("page_id").collect()
    assert got[0].container.split() == "Inside the article. link in".split()
    assert got[0].density.split() == ["long", "text"] * 5
    assert "only a link" in got[0].full and "short" in got[0].full and "gone" not in got[0].full
    assert (got[2].container, got[2].full) == ("open", "open")


@pytest.mark.parametrize(
    "odd",
    [
        "<meta " + "x" * 1_000_000 + ">",
        "<meta " + "x=y " * 250_000 + ">",
        "<meta " + 'x="y" ' * 170_000 + ">",
        '<div title="' + "y" * 1_000_000 + "'>",
        "<div title=don't " + "<" * 100_000 + ">",
        "<div " + "=" * 1_000_000 + ">",
        "<" * 1_000_000,
        "<h1 " + "'" * 999_999 + ">",
        "<!--" * 100_000 + "-->",
        "<script>" * 50_000 + "</script>",
    ],
)
def test_very_long_tags(spark, odd):
    """One odd page gives its row, and the others theirs."""
    page = f'<html><head><title>Of the page</title><meta name="description" content="About."></head><body>{odd}<p>Body text.</p></body></html>'
    pages = spark.createDataFrame([(1, page), (2, "<title>Plain</title><p>Other.</p>")], "page_id long, html string")
    heads = {r.page_id: (r.t.title, list(r.d)) for r in pages.select("page_id", H.page_title(F.col("html")).alias("t"), H.meta_descriptions(F.col("html")).alias("d")).collect()}
    assert heads == {1: ("Of the page", ["About."]), 2: ("Plain", [])}
    texts = {r.page_id: r.text for r in H.block_text(H.without(H.html_tokens(pages), H.by_tag, H.by_role, H.by_hint)).collect()}
    assert "Other." in texts[2] and "Of the page" in texts[1]


def test_signs_in_quotes(spark):
    html = """<div data-x="a>b" title='c > "d"' id=e>f</div><p title=don't>5 < 6 > 4</p><br/><a href = "x>y">z</a"""
    tokens = [(r.kind, r.tag, r.token) for r in H.html_tokens(spark.createDataFrame([(1, html)], "page_id long, html string")).orderBy("pos").collect()]
    assert tokens == [
        ("open", "div", """<div data-x="a>b" title='c > "d"' id=e>"""), ("text", "", "f"), ("close", "div", "</div>"), ("open", "p", "<p title=don't>"), ("text", "", "5 < 6 > 4"),
        ("close", "p", "</p>"), ("void", "br", "<br/>"), ("open", "a", '<a href = "x>y">'), ("text", "", "z"), ("close", "a", "</a"),
    ]
    about = """<meta data-x="1>0" content='a > "b"' name=description><meta name="description" content=bare>"""
    assert spark.createDataFrame([(about,)], "html string").select(H.meta_descriptions(F.col("html"))).first()[0] == ['a > "b"', "bare"]
