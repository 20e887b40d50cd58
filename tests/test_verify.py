"""Fuzzy and nearest matches, and results end to end, against a plain cascade over the collected tables."""

import unicodedata
from collections import defaultdict
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from lodestrand.functions import text as X
from lodestrand.operators import verify as V
from lodestrand.plans import queries as Q
from lodestrand.profiles import LATIN

SMALL = "/root/testdata/sf0.001"


def key(text):
    return "".join(unicodedata.normalize("NFKC", text).lower().split())


def ratio(query, candidate):
    m = SequenceMatcher(autojunk=False)
    m.set_seq2(query)
    m.set_seq1(candidate)
    return m.ratio()


class Page:
    """The cascade over one page's candidates (pos, text, key, score) and source text."""

    def __init__(self, candidates, source):
        self.candidates, self.source = sorted(candidates), source

    def slice_of(self, query):
        chars = [(c, i) for i, c in enumerate(self.source) if not c.isspace()]
        folded, origin = "", []
        for c, i in chars:
            f = unicodedata.normalize("NFKC", c).lower()
            folded, origin = folded + f, origin + [i] * len(f)
        at = folded.find(query)
        return self.source[origin[at] : origin[at + len(query) - 1] + 1].strip() if at >= 0 else None

    def alike(self, query, least, candidates):
        if len(query) < LATIN.min_fuzzy_chars:
            return None
        rated = [(ratio(query, k), -pos, text) for pos, text, k, _ in candidates if k]
        best = max(rated, default=None)
        return best if best and best[0] >= least else None

    def resolve(self, query):
        if query:
            for _, text, k, _ in self.candidates:
                if k == query:
                    return text, "exact"
            if found := self.slice_of(query):
                return found, "contained"
            held = [(len(k), -pos, text) for pos, text, k, _ in self.candidates if k in query]
            if held:
                return max(held)[2], "contained"
            if best := self.alike(query, LATIN.min_ratio, self.candidates):
                return best[2], "fuzzy"
        return "", "none"

    def line(self, query, excluded=()):
        text, method = self.resolve(query)
        if text and key(text) not in excluded:
            return text, method
        allowed = [c for c in self.candidates if c[2] not in excluded]
        if best := self.alike(query, LATIN.fallback_ratio, allowed):
            return best[2], "nearest"
        if allowed:
            return max(allowed, key=lambda c: (c[3], -c[0]))[1], "unverified"
        return "", "none"


@pytest.fixture(scope="module")
def tables(spark):
    """Queries, candidates, sources; half of the proposals are misspelled, so that every step has its cases."""
    q, c, t = Q.verified(spark, SMALL)
    odd = F.concat(F.lit("qx"), F.regexp_replace("proposal", "[aeiou]", "o"), F.lit("w"))
    proposal = F.when((F.col("page_id") + F.length("slot")) % 2 == 0, odd).otherwise(F.col("proposal"))
    q = q.select("page_id", "slot", proposal.alias("text")).checkpoint()
    q = V.keyed(q)
    pages = {}
    scored = c.withColumn("score", X.score_sentence(F.col("text"), F.col("pos"), LATIN))
    rows = defaultdict(list)
    for r in scored.collect():
        rows[r.page_id].append((r.pos, r.text, r.match_key, r.score))
    for r in t.collect():
        pages[r.page_id] = Page(rows[r.page_id], r.source_text)
    return q, c, t, pages, {(r.page_id, r.slot): r["query"] for r in q.collect()}


def test_resolve(spark, tables):
    q, c, t, pages, asked = tables
    got = {(r.page_id, r.slot): (r.text, r.method) for r in V.resolve(q, c, t).collect()}
    assert got == {k: pages[k[0]].resolve(query) for k, query in asked.items()}
    assert {"exact", "contained", "fuzzy", "none"} <= {m for _, m in got.values()}


def test_most_alike(spark, tables):
    q, c, _, pages, asked = tables
    for least, method in ((LATIN.min_ratio, "fuzzy"), (LATIN.fallback_ratio, "nearest")):
        got = {(r.page_id, r.slot): (round(r.ratio, 9), r.text) for r in V.most_alike(q, c, least, method).collect()}
        want = {k: pages[k[0]].alike(query, least, pages[k[0]].candidates) for k, query in asked.items()}
        assert got == {k: (round(x[0], 9), x[2]) for k, x in want.items() if x}


def test_resolve_pair(spark, tables):
    q, c, t, pages, asked = tables
    got = {r.page_id: ((r.line2, r.method2), (r.line3, r.method3)) for r in V.resolve_pair(q, c, t).collect()}
    for page, lines in got.items():
        second = pages[page].line(asked[page, "line2"])
        third = pages[page].line(asked[page, "line3"], {key(second[0])} if second[0] else set())
        assert lines == (second, third)
    assert {"fuzzy", "nearest", "unverified"} & {m for x in got.values() for _, m in x}


def test_results_end_to_end(spark):
    rows = Q.whole_results(spark, SMALL).collect()
    assert len(rows) == spark.read.parquet(f"{SMALL}/pages.parquet").count()
    assert len(rows[0].meta.asDict()) == 16
    good = [r for r in rows if r.error_code is None]
    assert good and len(good) < len(rows)
    for r in good:
        assert r.title and r.line2 and r.line3 and key(r.line2) != key(r.line3)
        assert r.meta.candidate_count == len(r.meta.candidates) > 0
        assert r.meta.candidates[0].startswith("First text here")
        assert r.meta.http_status == 200 and r.meta.title_source in ("json-ld", "og:title", "title", "h1")
        held = {key(x) for x in r.meta.candidates}
        for line, method in ((r.line2, r.meta.line2_match), (r.line3, r.meta.line3_match)):
            assert method in ("exact", "contained", "fuzzy", "nearest", "unverified")
            if method in ("exact", "fuzzy", "nearest", "unverified"):
                assert key(line) in held
    assert all((r.title, r.line2, r.line3) == ("", "", "") for r in rows if r.error_code)
    stored = Q.QUERIES["write_results"](spark, SMALL).collect()
    assert sorted((r.request_id, r.ordinal, r.failed) for r in stored) == sorted((r.request_id, r.ordinal, r.error_code is not None) for r in rows)
    counts = {(r.dimension, r.value): r.n for r in Q.QUERIES["result_breakdown"](spark, SMALL).collect()}
    assert sum(n for (d, _), n in counts.items() if d == "error_code") == len(rows)
    assert counts["error_code", ""] == len(good)
