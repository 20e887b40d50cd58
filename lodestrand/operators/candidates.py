"""From page text to candidate sentences, ranks and prompt batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import html as H
from ..functions import text as X
from ..profiles import LATIN, TextProfile
from ..sources.crawl import first_by

ENOUGH = 3


def dedupe_sentences(rows: DataFrame, group: str = "page_id", text: str = "text", pos: str = "pos") -> DataFrame:
    """First row of each match key in a group; empty keys go. A group is dealt to one partition, where the places that ``placed`` gives are counted too."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = rows.where(X.has_key(F.col(text))).withColumn("match_key", X.match_key(F.col(text))).repartition(n, group)
    return first_by(keyed, [group, "match_key"], F.col(pos))


def usable_pieces(sources: DataFrame, profile: TextProfile = LATIN, group: str = "page_id") -> DataFrame:
    """(group, source_no, sent_no, piece_no, text) of the sentences of (group, source_no, raw) that may be candidates. Affixes go before long sentences are
    cut; length and noise are judged on the pieces."""
    cleaned = sources.where("raw is not null").select(group, "source_no", X.clean_text(F.col("raw")).alias("clean"))
    sentences = cleaned.select(group, "source_no", F.posexplode(X.split_sentences(F.col("clean"), profile)).alias("sent_no", "sentence"))
    bare = sentences.withColumn("bare", X.strip_promo_affixes(F.col("sentence"), profile))  # empty ones fall to the least length
    pieces = bare.select(group, "source_no", "sent_no", F.posexplode(X.split_long(F.col("bare"), profile)).alias("piece_no", "text"))
    return pieces.where((F.length("text") >= profile.min_chars) & ~X.is_noise(F.col("text"), profile))


def placed(pieces: DataFrame, profile: TextProfile = LATIN, group: str = "page_id") -> DataFrame:
    """(group, pos, text, match_key): the first piece of each key, in order from 0, at most ``limit`` a group."""
    unique = dedupe_sentences(pieces.withColumn("at", F.struct("source_no", "sent_no", "piece_no")), group, "text", "at")
    ranked = unique.withColumn("pos", F.row_number().over(Window.partitionBy(group).orderBy("at")) - 1)
    return ranked.where(F.col("pos") < profile.limit).select(group, "pos", "text", "match_key")


def build_candidates(texts: DataFrame, profile: TextProfile = LATIN, group: str = "page_id", descriptions: str | None = None, body: str = "body") -> DataFrame:
    """(group, pos, text, match_key): usable sentences of the descriptions, then of the body, from 0; at most ``limit`` a group.

    Equal keys keep the first. All but the match key of non-ASCII text stays in the engine; the shuffles are on the group and its key."""
    parts = F.array(F.col(body)) if descriptions is None else F.concat(F.coalesce(F.col(descriptions), F.array().cast("array<string>")), F.array(F.col(body)))
    return placed(usable_pieces(texts.select(group, F.posexplode(parts).alias("source_no", "raw")), profile, group), profile, group)


def bodies(pages: DataFrame) -> DataFrame:
    """(page_id, container, density, full) of three extractors: article and main elements; blocks that are long and hold few links; all text.

    One pass over the tokens and one grouping by page, in the partitions that the tokens are dealt to."""
    marked = H.depths(
        H.html_tokens(pages), noise=H.any_rule(H.by_tag, H.by_role, H.by_hint), main=F.col("tag").isin("article", "main"), link=F.col("tag") == "a",
    ).where("noise = 0").drop("noise")
    running = Window.partitionBy("page_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    pieces = H.text_pieces(marked).withColumn("block", F.sum(F.when(F.col("piece") == "\n", 1).otherwise(0)).over(running))
    size = F.length(F.trim("piece"))
    listed = F.array_sort(F.collect_list(F.struct("pos", "piece", (F.col("main") > 0).alias("inside"))))
    blocks = pieces.groupBy("page_id", "block").agg(listed.alias("pieces"), F.sum(size).alias("chars"), F.sum(F.when(F.col("link") > 0, size).otherwise(0)).alias("link_chars"))
    kept = (F.col("chars") >= 25) & (2 * F.col("link_chars") <= F.col("chars"))
    paged = blocks.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("block", kept.alias("kept"), "pieces"))).alias("blocks"))

    def text(chosen: Column, inside: bool = False) -> Column:
        parts = F.flatten(F.transform(chosen, lambda b: b["pieces"]))
        parts = F.filter(parts, lambda p: p["inside"]) if inside else parts
        return X.trimmed(F.array_join(F.transform(parts, lambda p: p["piece"]), " "))

    every = F.col("blocks")
    return paged.select("page_id", text(every, True).alias("container"), text(F.filter(every, lambda b: b["kept"])).alias("density"), text(every).alias("full"))


EXTRACTORS = ("container", "density", "full")


#: Where a body's pieces stand among those of the descriptions.
LAST_SOURCE = 1 << 30


def _chosen(found: DataFrame, profile: TextProfile, keep) -> tuple[DataFrame, DataFrame]:
    """((page_id, extractor, n_candidates, body), pieces of the chosen bodies) of ``bodies``.

    Pieces of the other extractors are made only where the first has fewer than three candidates."""

    def counted(names: tuple[str, ...], of: DataFrame) -> tuple[DataFrame, DataFrame]:
        texts = F.array(*(F.struct(F.lit(EXTRACTORS.index(k)).alias("prio"), F.lit(k).alias("extractor"), F.col(k).alias("text")) for k in names))
        rows = of.select("page_id", F.explode(F.filter(texts, lambda t: t["text"] != "")).alias("t")).select("page_id", "t.*")
        sources = rows.select(F.struct("page_id", "prio").alias("of"), F.lit(LAST_SOURCE).alias("source_no"), F.col("text").alias("raw"))
        pieces = keep(usable_pieces(sources, profile, "of"))
        keys = pieces.select("of", X.match_key(F.col("text")).alias("match_key")).where("match_key <> ''").distinct()
        n = keys.groupBy("of").agg(F.least(F.count("*"), F.lit(profile.limit)).alias("n")).select("of.*", "n")
        return rows.join(n, ["page_id", "prio"], "left").withColumn("n", F.coalesce("n", F.lit(0))), pieces.select("of.*", "source_no", "sent_no", "piece_no", "text")

    first, pieces = counted(EXTRACTORS[:1], found)
    first = keep(first)
    settled = first.where(F.col("n") >= ENOUGH)
    others, more = counted(EXTRACTORS[1:], found.join(settled.select("page_id"), "page_id", "left_anti"))
    enough = F.col("n") >= ENOUGH
    best = first_by(first.unionByName(others), ["page_id"], F.desc(enough), F.when(enough, F.col("prio")), F.desc("n"), F.desc(F.length("text")), F.col("prio"))
    best = keep(best)
    of_best = pieces.unionByName(more).join(best.select("page_id", "prio"), ["page_id", "prio"], "left_semi").drop("prio")
    return best.select("page_id", "extractor", F.col("n").alias("n_candidates"), F.col("text").alias("body")), of_best


def body_extract(pages: DataFrame, profile: TextProfile = LATIN, keep=lambda df: df) -> DataFrame:
    """(page_id, extractor, n_candidates, body): the first extractor with three usable candidates, else the most candidates, then the longest text.
    ``keep`` may write what several steps read."""
    return _chosen(keep(bodies(pages)), profile, keep)[0]


def parsed_candidates(pages: DataFrame, profile: TextProfile = LATIN, keep=lambda df: df) -> tuple[DataFrame, DataFrame]:
    """(``parse_page`` of the pages, their candidates): descriptions first, then the chosen body, whose sentences are cut once for the gate and the candidates."""
    chosen, pieces = _chosen(keep(bodies(pages)), profile, keep)
    about = pages.select("page_id", F.posexplode(H.meta_descriptions(F.col("html"))).alias("source_no", "raw"))
    return _with_head(pages, chosen), placed(usable_pieces(about, profile).unionByName(pieces), profile)


def _with_head(pages: DataFrame, chosen: DataFrame) -> DataFrame:
    head = pages.select("page_id", H.page_title(F.col("html")).alias("t"), H.meta_descriptions(F.col("html")).alias("descriptions"))
    joined = head.join(chosen, "page_id", "left")
    failed = F.col("body").isNull() & (F.size("descriptions") == 0)
    return joined.select(
        "page_id", F.col("t.title").alias("title"), F.col("t.source").alias("title_source"), F.coalesce("extractor", F.lit("none")).alias("extractor"),
        F.coalesce("body", F.lit("")).alias("body"), "descriptions", F.when(failed, "content_extraction_error").alias("error_code"),
    )


def parse_page(pages: DataFrame, profile: TextProfile = LATIN, keep=lambda df: df) -> DataFrame:
    """(page_id, title, title_source, extractor, body, descriptions, error_code): a page without a body is in error unless it has a description."""
    return _with_head(pages, body_extract(pages, profile, keep))


def source_text(parsed: DataFrame) -> DataFrame:
    """(page_id, source_text): cleaned descriptions and body, once cleaned, joined by line feeds."""
    stripped = F.transform(F.concat("descriptions", F.array("body")), X.without_tags)
    return parsed.select("page_id", F.array_join(F.transform(H.each_unescaped(stripped), X.normalize_ws), "\n").alias("source_text"))


def rank_candidates(candidates: DataFrame, profile: TextProfile = LATIN, top: int | None = None) -> DataFrame:
    """``candidates`` with score and rank from 1; the order of equal scores is theirs on the page. ``top`` keeps the best."""
    scored = candidates.withColumn("score", X.score_sentence(F.col("text"), F.col("pos"), profile))
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("page_id").orderBy(F.desc("score"), "pos")))
    return ranked if top is None else ranked.where(F.col("rank") <= top)


def pick_best(candidates: DataFrame, excluded: DataFrame, profile: TextProfile = LATIN) -> DataFrame:
    """(page_id, text, match_key): the best candidate whose key isn't in ``excluded`` (page_id, match_key)."""
    left = candidates.join(excluded, ["page_id", "match_key"], "left_anti")
    return rank_candidates(left, profile, 1).select("page_id", "text", "match_key")


def pack_candidates(candidates: DataFrame, budget: int = LATIN.prompt_chars) -> DataFrame:
    """(page_id, prompt): numbered lines up to the first that would pass the budget."""
    lines = candidates.withColumn("line", F.concat((F.col("pos") + 1).cast("string"), F.lit(". "), "text"))
    total = F.sum(F.length("line") + 1).over(Window.partitionBy("page_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    fit = lines.withColumn("total", total).where(F.col("total") <= budget)
    return fit.groupBy("page_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n").alias("prompt"))


def candidates_or_error(pages: DataFrame, candidates: DataFrame) -> DataFrame:
    counts = candidates.groupBy("page_id").agg(F.count("*").alias("n_candidates"))
    joined = pages.select("page_id").join(counts, "page_id", "left").select("page_id", F.coalesce("n_candidates", F.lit(0)).alias("n_candidates"))
    return joined.withColumn("error_code", F.when(F.col("n_candidates") == 0, "content_extraction_error"))


