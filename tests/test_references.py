"""Character references that a cut has left without their semicolon."""

import pytest
from pyspark.sql import functions as F

from lodestrand.functions import text as X
from lodestrand.plans import queries as Q

from .compare import difference

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize(
    ("text", "plain"),
    [
        ("a&amp", "a&amp"),
        ("a&amp b &copy", "a&amp b &copy"),
        ("&ampere &amp; &hellip;", "&ampere & …"),
        ("&hellip &eacute; &#233 &#xe9;", "&hellip é &#233 é"),
        ("&nosuch; &amp;hellip; &;", "&nosuch; &hellip; &;"),
        ("&am&amp;p; &a&#8230;", "&am&p; &a…"),
    ],
)
def test_only_whole_references_are_resolved(spark, text, plain):
    assert spark.createDataFrame([(text,)], "t string").select(X.unescape(F.col("t"))).first()[0] == plain


@pytest.mark.parametrize("name", ["block_text", "body_extract", "build_candidates", "score_sentence"])
def test_cut_references_as_sql_has_them(spark, tmp_path, name):
    from pathlib import Path

    for p in Path(SMALL).glob("*.parquet"):
        if p.name != "pages.parquet":
            (tmp_path / p.name).symlink_to(p)
    page = "<html><head><title>T</title></head><body><article><h1>Of this &amp; that&amp</h1><p>Some words of it &amp that go on here.</p><p>Some more words of the and&amp</p><p>Other words of the rest, &copy; of it.</p></article></body></html>"
    frame = spark.createDataFrame([(k, f"https://a.example/{k}", page) for k in range(3)], "page_id long, url string, html string").toPandas()
    frame.to_parquet(tmp_path / "pages.parquet")
    assert difference(spark, Q.QUERIES[name], Q.SQL[name], str(tmp_path)) == ""
