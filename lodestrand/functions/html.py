"""HTML as a token table: subtrees are stretches of positions, found by running sums within a page."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..profiles import BLOCK_TAGS, NOISE_HINTS, NOISE_ROLES, NOISE_TAGS, PRODUCT_TYPES
from .text import contains_any, unescape

#: Elements whose content is no markup, and comments, are blanked before tokens are cut; one that is never closed ends with the page.
RAW = "(?is)<!--.*?(?:-->|\\z)" + "".join(f"|<{t}\\b.*?(?:</{t}\\s*>|\\z)" for t in ("script", "style", "noscript", "template", "textarea"))
#: The inside of a tag up to its end: a > within a quoted value, which stands behind an equals sign, doesn't end it. Possessive, so the engine's stack stays
#: flat and a tag of any length is read once.
INSIDE = "(?:[^>=]++|=\\s*+(?:\"[^\"]*+\"|'[^']*+')|=)*+"
#: Tags, declarations and the like, and text, which a < that begins no tag belongs to.
TOKEN = f"</?[a-zA-Z]{INSIDE}(?:>|\\z)|<[!?/][^>]*+(?:>|\\z)|(?:[^<]++|<(?![a-zA-Z/!?]))++"
TAG = f"</?[a-zA-Z]{INSIDE}>|<[!?/][^>]*+>"
VOID_TAGS = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr")
#: An opening one of these ends a line too, for pages that leave out the end tags.
IMPLIED_ENDS = ("p", "li", "tr", "td", "th", "dt", "dd")
#: An attribute of a tag: white space or a slash, a name, and a value in either kind of quotes or bare.
ATTRIBUTE = "[\\s/]+[^\\s\"'<>/=]+(?:\\s*=\\s*(?:\"[^\"]*\"|'[^']*'|[^\\s\"'>][^\\s>]*))?"
ATTRIBUTE_NAME = "[^\\s\"'<>/=]+"
ATTRIBUTE_VALUE = "(?s)=\\s*(?:\"(.*)\"|'(.*)'|([^\"'].*))\\z"
#: Stands between texts whose entities are resolved together; no entity stands for it.
BETWEEN = "\x1e\x1e"


def html_tokens(pages: DataFrame) -> DataFrame:
    """(page_id, pos, kind, tag, token) in document order; kind is open, close, void or text."""
    n = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = pages.select("page_id", "html").repartition(n, "page_id")  # the one shuffle: every window and grouping by page that follows stays in place
    cut = dealt.select("page_id", F.posexplode(F.regexp_extract_all(F.regexp_replace("html", RAW, " "), F.lit(TOKEN), F.lit(0))).alias("pos", "token"))
    tag = F.lower(F.regexp_extract("token", "^</?([a-zA-Z][a-zA-Z0-9]*)", 1))
    kind = (
        F.when(F.col("token").rlike("^</[a-zA-Z]"), "close")
        .when(F.col("token").rlike("^<[a-zA-Z]"), F.when(tag.isin(*VOID_TAGS) | F.col("token").rlike("/>$"), "void").otherwise("open"))
        .when(F.col("token").rlike("^<[!?/]"), "void")
        .otherwise("text")
    )
    return cut.select("page_id", "pos", kind.alias("kind"), tag.alias("tag"), "token")


def attribute(token: Column, name: str) -> Column:
    """The value of the first attribute of that name, empty without one."""
    named = F.filter(F.regexp_extract_all(token, F.lit(ATTRIBUTE), F.lit(0)), lambda a: F.lower(F.regexp_extract(a, ATTRIBUTE_NAME, 0)) == name)
    first = F.coalesce(F.get(named, 0), F.lit(""))
    return F.when(F.contains(F.lower(token), F.lit(name)), F.concat(*(F.regexp_extract(first, ATTRIBUTE_VALUE, k) for k in (1, 2, 3)))).otherwise("")


def by_tag(token: Column, tag: Column) -> Column:
    return tag.isin(*NOISE_TAGS)


def by_role(token: Column, tag: Column) -> Column:
    return (tag != "") & F.lower(attribute(token, "role")).isin(*NOISE_ROLES)


def by_hint(token: Column, tag: Column) -> Column:
    return (tag != "") & contains_any(F.lower(F.concat_ws(" ", attribute(token, "class"), attribute(token, "id"))), NOISE_HINTS)


def depths(tokens: DataFrame, **starts: Column) -> DataFrame:
    """``tokens`` with a column for each of ``starts``: how many elements whose open tag fulfils it hold the token. An element ends with the close tag of
    its own depth among equal tags; one that is never closed ends with the page. All are counted in one pass: windows stay within a page, on one shuffle by page_id."""
    names = list(starts)
    begun = [F.when(F.coalesce(starts[k], F.lit(False)) & F.col("kind").isin("open", "void"), 1).otherwise(0).alias(k) for k in names]
    rows = tokens.select("page_id", "pos", "kind", "tag", "token", *begun)
    same = Window.partitionBy("page_id", "tag").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    level = F.sum(F.when(F.col("kind") == "open", 1).when(F.col("kind") == "close", -1).otherwise(0)).over(same) + F.when(F.col("kind") == "close", 1).otherwise(0)
    rows = rows.withColumn("level", level)
    paired = Window.partitionBy("page_id", "tag", "level", F.col("kind").isin("open", "close")).orderBy("pos")
    ending = F.when(F.col("kind") == "void", F.col("pos")).otherwise(F.coalesce(F.lead("pos").over(paired), F.lit(1 << 30)))
    rows = rows.withColumn("ending", ending)

    def move(at: Column, step: int, sign: int) -> Column:
        return F.struct(at.alias("at"), F.lit(step).alias("step"), *((sign * F.col(k)).alias(k) for k in names))

    starting = sum((F.col(k) for k in names), F.lit(0)) > 0
    # Of equal positions a start comes first, then the token, then the end.
    moves = F.when(starting, F.array(move(F.col("pos"), 0, 1), move(F.col("pos"), 1, 0), move(F.col("ending"), 2, -1))).otherwise(F.array(move(F.col("pos"), 1, 0)))
    moved = rows.select("page_id", "pos", "kind", "tag", "token", F.explode(moves).alias("m"))
    running = Window.partitionBy("page_id").orderBy("m.at", "m.step").rowsBetween(Window.unboundedPreceding, 0)
    summed = moved.select("page_id", "pos", "kind", "tag", "token", F.col("m.step").alias("step"), *(F.sum(f"m.{k}").over(running).alias(k) for k in names))
    return summed.where("step = 1").drop("step")


def subtrees(tokens: DataFrame, start: Column) -> DataFrame:
    """``tokens`` with ``depth``: how many elements whose open tag fulfils ``start`` hold the token."""
    return depths(tokens, depth=start)


def any_rule(*rules) -> Column:
    start = F.lit(False)
    for rule in rules:
        start = start | F.coalesce(rule(F.col("token"), F.col("tag")), F.lit(False))
    return start


def without(tokens: DataFrame, *rules) -> DataFrame:
    """``tokens`` outside every element that one of the rules names."""
    return subtrees(tokens, any_rule(*rules)).where("depth = 0").drop("depth")


def text_pieces(tokens: DataFrame) -> DataFrame:
    """``tokens`` with their ``piece`` in place of kind, tag and token: text nodes with entities resolved, and a line feed for each br, block end and implied end."""
    feed = (F.col("tag") == "br") | (F.col("kind") == "close") & F.col("tag").isin(*BLOCK_TAGS) | (F.col("kind") == "open") & F.col("tag").isin(*IMPLIED_ENDS)
    piece = F.when(F.col("kind") == "text", unescape(F.when(F.col("kind") == "text", F.col("token")))).when(feed, F.lit("\n"))
    return tokens.where((F.col("kind") == "text") | feed).withColumn("piece", piece).drop("kind", "tag", "token")


def joined_text(pieces: DataFrame) -> DataFrame:
    """(page_id, text): pieces in order with a blank between."""
    ordered = F.array_sort(F.collect_list(F.struct("pos", "piece")))
    return pieces.groupBy("page_id").agg(F.array_join(F.transform(ordered, lambda p: p["piece"]), " ").alias("text"))


def block_text(tokens: DataFrame) -> DataFrame:
    return joined_text(text_pieces(tokens))


def _collapsed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, "(?U)\\s+", " "))


def each_unescaped(texts: Column) -> Column:
    """An array of texts with their entities resolved, all of them in one call."""
    return F.when(F.size(texts) == 0, texts).otherwise(F.split(unescape(F.array_join(texts, BETWEEN)), BETWEEN))


def meta_contents(html: Column, attribute_name: str, value: str) -> Column:
    """The content of each meta tag whose attribute has the value, white space collapsed, empty ones left out."""
    tags = F.filter(F.regexp_extract_all(html, F.lit(f"(?i)<meta\\b{INSIDE}>"), F.lit(0)), lambda t: F.lower(attribute(t, attribute_name)) == value)
    contents = each_unescaped(F.transform(tags, lambda t: attribute(t, "content")))
    return F.filter(F.transform(contents, _collapsed), lambda c: c != "")


def meta_descriptions(html: Column) -> Column:
    return F.array_distinct(F.concat(meta_contents(html, "property", "og:description"), meta_contents(html, "name", "description"), meta_contents(html, "name", "twitter:description")))


#: A product type's name, behind any path or fragment of an address.
_PRODUCT = re.compile(rf"(?:.*[/#])?\s*(?:{'|'.join(PRODUCT_TYPES)})\s*", re.I | re.S)


def _is_product(kind: object) -> bool:
    return any(isinstance(k, str) and _PRODUCT.fullmatch(k) for k in (kind if isinstance(kind, list) else (kind,)))


def _name_text(value: object) -> str:
    while isinstance(value, dict):
        value = value.get("@value")
    if isinstance(value, list):
        return next((t for t in map(_name_text, value) if t), "")
    return value if isinstance(value, str) else ""


def first_product_name(blocks: list[str], deepest: int = 8) -> str:
    """The first non-blank product name, each block in document order, nodes before what they hold; blocks that aren't JSON are passed over."""
    for block in blocks:
        try:
            stack = [(json.loads(block), 0)]
        except (ValueError, RecursionError):
            continue
        while stack:
            node, depth = stack.pop()
            if depth > deepest or not isinstance(node, (dict, list)):
                continue
            if isinstance(node, dict) and _is_product(node.get("@type")) and (name := " ".join(_name_text(node.get("name")).split())):
                return name
            inner = node if isinstance(node, list) else node.values()
            stack += [(x, depth + 1) for x in reversed(list(inner))]
    return ""


@F.pandas_udf(T.StringType())
def _product_names(blocks: pd.Series) -> pd.Series:
    return blocks.map(lambda b: first_product_name(list(b)) or None, na_action="ignore")


def jsonld_product_name(html: Column) -> Column:
    """Null without one. Only pages that mention ld+json reach the Arrow function."""
    blocks = F.regexp_extract_all(html, F.lit("(?is)<script\\b[^>]*ld\\+json[^>]*>(.*?)</script\\s*>"), F.lit(1))
    return _product_names(F.when(F.contains(F.lower(html), F.lit("ld+json")), blocks))


def page_title(html: Column) -> Column:
    """struct<title, source>: JSON-LD product, og:title by property, by name, the title element, the first h1; empty ones fall to the next."""
    bare = F.regexp_replace(html, RAW, " ")
    tagless = lambda t: _collapsed(unescape(F.regexp_replace(t, TAG, " ")))
    found = [
        (jsonld_product_name(html), "json-ld"),
        (F.get(meta_contents(html, "property", "og:title"), 0), "og:title"),
        (F.get(meta_contents(html, "name", "og:title"), 0), "og:title"),
        (tagless(F.regexp_extract(bare, f"(?is)<title\\b{INSIDE}>(.*?)</title>", 1)), "title"),
        (tagless(F.regexp_extract(bare, f"(?is)<h1\\b{INSIDE}>(.*?)</h1>", 1)), "h1"),
    ]
    structs = [F.when(F.coalesce(t, F.lit("")) != "", F.struct(t.alias("title"), F.lit(s).alias("source"))) for t, s in found]
    return F.coalesce(*structs, F.struct(F.lit("").alias("title"), F.lit("").alias("source")))
