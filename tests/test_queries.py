"""Every registered query with SQL gives the rows that the SQL gives; the entry point's shape."""

import importlib.util

import pytest

import __spark_entry__
from lodestrand.plans import queries as Q

from .compare import difference

SMALL = "/root/testdata/sf0.001"


#: Earlier names of other keys; the same functions and SQL.
ALIASES = {n for n in Q.SQL if n.endswith("_fuzzy") and n != "resolve_fuzzy"}


@pytest.mark.parametrize("name", sorted(set(Q.SQL) - ALIASES))
def test_same_as_sql(spark, name):
    assert difference(spark, Q.QUERIES[name], Q.SQL[name], SMALL) == ""


@pytest.mark.parametrize("name", sorted(set(Q.QUERIES) - set(Q.SQL)))
def test_rows(spark, name):
    assert len(Q.QUERIES[name](spark, SMALL).limit(5).collect()) > 0


def test_stream_of_feedback_is_the_batch(spark):
    batch = {tuple(r) for r in Q.QUERIES["feedback_ring"](spark, SMALL).select("owner", "key", "id", "recency").collect()}
    stream = {tuple(r) for r in Q.QUERIES["stream_feedback"](spark, SMALL).select("owner", "key", "id", "recency").collect()}
    assert stream == batch


def test_entry(spark):
    df = __spark_entry__.entry(spark)
    assert df.columns == ["page_id", "pos", "text", "match_key"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_nothing_imports_the_corpus_operators():
    spec = importlib.util.find_spec("lodestrand")
    from pathlib import Path

    root = Path(next(iter(spec.submodule_search_locations)))
    assert not [p for p in root.rglob("*.py") if "llm" not in p.parts and "lodestrand.llm" in p.read_text()]
