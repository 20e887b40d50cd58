"""A url that several pages have gives a row for each of their results, as the SQL has it."""

from pathlib import Path

import pytest

from lodestrand.operators import results as R
from lodestrand.plans import queries as Q

from .compare import connection, difference

SMALL = "/root/testdata/sf0.001"
#: Urls by page_id: of two requests, one of them good in each, with a failed page too; of one request, one page failed; of failed pages only; of one page.
URLS = {0: "a", 20: "a", 25: "a", 1: "b", 3: "b", 4: "c", 23: "c", 21: "d"}


@pytest.fixture(scope="module")
def shared(spark, tmp_path_factory) -> str:
    path = tmp_path_factory.mktemp("shared")
    for p in Path(SMALL).glob("*.parquet"):
        if p.name != "pages.parquet":
            (path / p.name).symlink_to(p)
    page = "<html><head><title>T{0}</title></head><body><article><h1>Of the page with number {0}.</h1><p>Some words of page {0} that go on here.</p><p>Some more words of the page {0}.</p><p>Other words of the rest of {0}.</p></article></body></html>"
    frame = spark.createDataFrame([(k, f"https://{u}.example/x", page.format(k)) for k, u in URLS.items()], "page_id long, url string, html string").toPandas()
    frame.to_parquet(path / "pages.parquet")
    return str(path)


@pytest.mark.parametrize("name", ["assemble_results", "results_exact", "results_fuzzy", "stream_results"])
def test_same_as_sql(spark, shared, name):
    assert connection(shared).execute(f"SELECT count(*) FROM ({Q.SQL[name]})").fetchone()[0] == 3 * 3 + 2 * 2 + 2 * 2 + 1
    assert difference(spark, Q.QUERIES[name], Q.SQL[name], shared) == ""


def test_each_result_of_a_url(spark):
    urls = spark.createDataFrame([(0, 0, "a"), (0, 1, "b"), (1, 0, "a"), (1, 1, "none")], "request_id long, ordinal long, url string")
    done = spark.createDataFrame([("a", "T", "x", "y", None), ("a", "T", "x", "y", None), ("a", None, None, None, "fetch_error"), ("b", "U", None, None, None)], "url string, title string, line2 string, line3 string, error_code string")
    rows = [tuple(r) for r in R.assemble_results(urls, done).collect()]
    good, failed = ("a", "T", "x", "y", None), ("a", "", "", "", "fetch_error")
    wanted = [(k, 0, *r) for k in (0, 1) for r in (good, good, failed)] + [(0, 1, "b", "U", "", "", None), (1, 1, "none", "", "", "", "internal_error")]
    assert sorted(rows, key=repr) == sorted(wanted, key=repr)
