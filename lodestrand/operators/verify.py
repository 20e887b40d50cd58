"""Proposed lines resolved to text that stands on the page."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X
from ..lineage import kept
from ..profiles import LATIN, TextProfile
from ..sources.crawl import first_by
from .candidates import rank_candidates

ID = ["page_id", "slot"]


def keyed(proposals: DataFrame) -> DataFrame:
    """(page_id, slot, proposal, query): proposals with their match key."""
    return proposals.select("page_id", "slot", F.col("text").alias("proposal"), X.match_key(F.col("text")).alias("query"))


def _result(df: DataFrame, text: Column, method: str, ratio: Column | float) -> DataFrame:
    return df.select("page_id", "slot", text.alias("text"), F.lit(method).alias("method"), (ratio if isinstance(ratio, Column) else F.lit(ratio)).alias("ratio"))


def match_exact(queries: DataFrame, candidates: DataFrame) -> DataFrame:
    met = queries.where("query <> ''").join(candidates, (queries.page_id == candidates.page_id) & (queries["query"] == candidates.match_key)).select(queries.page_id, "slot", "text", "pos")
    return _result(first_by(met, ID, F.col("pos")), F.col("text"), "exact", 1.0)


def with_keys(sources: DataFrame) -> DataFrame:
    """``sources`` with source_key and source_folded, once a page, before proposals multiply it."""
    if "source_key" in sources.columns:
        return sources
    return sources.withColumn("source_key", X.match_key(F.col("source_text"))).withColumn("source_folded", X.folded_key(F.col("source_text")))


def match_contained_slice(queries: DataFrame, sources: DataFrame) -> DataFrame:
    """The stretch of the page's source text that has the proposal's key; only pages whose key holds it reach the Arrow function."""
    met = queries.where("query <> ''").join(with_keys(sources), "page_id").withColumn("at", F.instr(F.col("source_folded"), F.col("query")) - 1).where("at >= 0")
    found = met.withColumn("span", X.span_of(F.col("source_text"), F.col("at"), F.length("query")))
    text = X.trimmed(F.substring(F.col("source_text"), F.col("span.start") + 1, F.col("span.size")))
    return _result(found.withColumn("slice", text).where("slice <> ''"), F.col("slice"), "contained", 1.0)


def match_contained_candidate(queries: DataFrame, candidates: DataFrame) -> DataFrame:
    """The candidate of the longest key that the proposal holds whole."""
    met = queries.where("query <> ''").join(candidates, "page_id").where(F.contains(F.col("query"), F.col("match_key")))
    return _result(first_by(met, ID, F.desc(F.length("match_key")), F.col("pos")), F.col("text"), "contained", 1.0)


def length_bound(a: Column, b: Column) -> Column:
    """No pair of such lengths is more alike."""
    return F.try_divide(2.0 * F.least(a, b), a + b)


def fuzzy_prune(queries: DataFrame, candidates: DataFrame, least: float, profile: TextProfile = LATIN) -> DataFrame:
    """(page_id, slot, query, text, match_key, pos): pairs whose lengths allow a ratio of ``least``."""
    long_enough = queries.where(F.length("query") >= profile.min_fuzzy_chars)
    return long_enough.join(candidates.where("match_key <> ''"), "page_id").where(length_bound(F.length("query"), F.length("match_key")) >= least)


def ratio_from(least: float):
    """An Arrow function of (page_id, slot, candidate key, query key): the ratio of their matching blocks, null below ``least`` and where another candidate
    of the same query is surely more alike.

    What the counts of single characters allow is looked at first, for all candidates of a query; those that it puts first are compared first, and the rest
    only as far as it reaches the best ratio so far. Equal ratios are all given."""

    @F.pandas_udf(T.DoubleType())
    def ratio(page: pd.Series, slot: pd.Series, candidate: pd.Series, query: pd.Series) -> pd.Series:
        out, matcher, texts, asked = [None] * len(query), SequenceMatcher(autojunk=False), candidate.tolist(), query.tolist()
        of: dict[tuple, list[int]] = {}
        for i, k in enumerate(zip(page, slot, strict=True)):
            of.setdefault(k, []).append(i)
        for rows in of.values():
            matcher.set_seq2(asked[rows[0]])
            bounds = []
            for i in rows:
                matcher.set_seq1(texts[i])
                bounds.append((matcher.quick_ratio(), i))
            best = least
            for bound, i in sorted(bounds, key=lambda x: (-x[0], x[1])):
                if bound < best:
                    break
                matcher.set_seq1(texts[i])
                found = matcher.ratio()
                if found >= best:
                    out[i] = best = found
        return pd.Series(out, dtype="float64")

    return ratio


def most_alike(queries: DataFrame, candidates: DataFrame, least: float, method: str, profile: TextProfile = LATIN) -> DataFrame:
    """The candidate of the highest ratio of ``least`` or more, the first of equal ones. Lengths are compared in the engine, before the Arrow function."""
    pairs = fuzzy_prune(queries, candidates, least, profile)
    rated = pairs.withColumn("ratio", ratio_from(least)(F.col("page_id"), "slot", "match_key", "query")).where(F.col("ratio").isNotNull())
    return _result(first_by(rated, ID, F.desc("ratio"), F.col("pos")), F.col("text"), method, F.col("ratio"))


def resolve(queries: DataFrame, candidates: DataFrame, sources: DataFrame, profile: TextProfile = LATIN, fuzzy: bool = True) -> DataFrame:
    """(page_id, slot, text, method, ratio) of every proposal: exact, contained in the page, holding a candidate, then alike; else none."""
    steps = [match_exact(queries, candidates), match_contained_slice(queries, sources), match_contained_candidate(queries, candidates)]
    found = steps[0].withColumn("step", F.lit(0))
    for i, step in enumerate(steps[1:], 1):
        found = found.unionByName(step.withColumn("step", F.lit(i)))
    best = first_by(found, ID, F.col("step")).drop("step")
    if fuzzy:
        best = kept(best)
        rest = queries.join(best.select(*ID), ID, "left_anti")
        best = best.unionByName(most_alike(rest, candidates, profile.min_ratio, "fuzzy", profile))
    out = queries.select(*ID).join(best, ID, "left")
    return out.select(*ID, F.coalesce("text", F.lit("")).alias("text"), F.coalesce("method", F.lit("none")).alias("method"), F.coalesce("ratio", F.lit(0.0)).alias("ratio"))


def resolve_line(queries: DataFrame, candidates: DataFrame, sources: DataFrame, excluded: DataFrame, profile: TextProfile = LATIN, fuzzy: bool = True) -> DataFrame:
    """(page_id, slot, text, method): a verified line that isn't in ``excluded`` (page_id, match_key), else the nearest candidate, else the best scored."""
    allowed = candidates.join(excluded, ["page_id", "match_key"], "left_anti")
    done = resolve(queries, candidates, sources, profile, fuzzy).where("method <> 'none' and text <> ''")
    done = done.withColumn("match_key", X.match_key(F.col("text"))).join(excluded, ["page_id", "match_key"], "left_anti").select(*ID, "text", "method")
    done = kept(done)
    if fuzzy:
        rest = queries.join(done.select(*ID), ID, "left_anti")
        done = done.unionByName(most_alike(rest, allowed, profile.fallback_ratio, "nearest", profile).select(*ID, "text", "method"))
        done = kept(done)
    rest = queries.select(*ID).join(done.select(*ID), ID, "left_anti")
    best = rank_candidates(allowed, profile, 1).select("page_id", F.col("text").alias("best"))
    last = rest.join(best, "page_id", "left").select(*ID, F.coalesce("best", F.lit("")).alias("text"), F.when(F.col("best").isNotNull(), "unverified").otherwise("none").alias("method"))
    return done.unionByName(last)


def resolve_pair(queries: DataFrame, candidates: DataFrame, sources: DataFrame, profile: TextProfile = LATIN, fuzzy: bool = True) -> DataFrame:
    """(page_id, line2, method2, line3, method3): the second line is resolved first, the third against it."""
    none = candidates.select("page_id", "match_key").where("1 = 0")
    second = kept(resolve_line(queries.where("slot = 'line2'"), candidates, sources, none, profile, fuzzy))
    taken = second.select("page_id", X.match_key(F.col("text")).alias("match_key")).where("match_key <> ''")
    third = resolve_line(queries.where("slot = 'line3'"), candidates, sources, taken, profile, fuzzy)
    pages = queries.select("page_id").distinct()
    return (
        pages.join(second.select("page_id", F.col("text").alias("line2"), F.col("method").alias("method2")), "page_id", "left")
        .join(third.select("page_id", F.col("text").alias("line3"), F.col("method").alias("method3")), "page_id", "left")
    )


def resolve_title(titles: DataFrame, proposals: DataFrame, candidates: DataFrame, sources: DataFrame, profile: TextProfile = LATIN, fuzzy: bool = True) -> DataFrame:
    """(page_id, title): the page's own title; a proposal that resolves only where the page has none."""
    untitled = titles.where("title = ''").select("page_id")
    found = resolve(keyed(proposals.where("slot = 'title'")).join(untitled, "page_id", "left_semi"), candidates, sources, profile, fuzzy)
    joined = titles.join(found.select("page_id", F.col("text").alias("found")), "page_id", "left")
    return joined.select("page_id", F.coalesce(F.nullif("title", F.lit("")), "found", F.lit("")).alias("title"))


def verbatim_audit(lines: DataFrame, sources: DataFrame) -> DataFrame:
    """(n_lines, n_violations): non-empty lines that the page's source text, compared by key, doesn't hold."""
    checked = lines.where("text <> ''").join(with_keys(sources), "page_id")
    absent = ~F.contains("source_key", X.match_key(F.col("text")))
    return checked.agg(F.count("*").alias("n_lines"), F.coalesce(F.sum(absent.cast("long")), F.lit(0)).alias("n_violations"))


def mark_chosen(candidates: DataFrame, lines: DataFrame) -> DataFrame:
    """(page_id, pos, chosen): candidates that a chosen line equals but for white space."""
    bare = lambda c: F.regexp_replace(c, "(?U)\\s", "")
    chosen = lines.where("text <> ''").select("page_id", bare(F.col("text")).alias("bare")).distinct().withColumn("hit", F.lit(True))
    return candidates.withColumn("bare", bare(F.col("text"))).join(chosen, ["page_id", "bare"], "left").select("page_id", "pos", F.coalesce("hit", F.lit(False)).alias("chosen"))


