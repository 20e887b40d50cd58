"""Request rows for an external chooser, and its responses read back."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X
from ..profiles import UNKNOWN_TITLE

FIELDS = ("title", "line2", "line3")
#: The instruction that stands before personas and examples; only its wording is a fixed value.
BASE_PROMPT = "Choose two sentences that stand on the page. Copy them; do not write, change or shorten text. Answer with JSON: title, line2, line3."


def resolve_persona(requests: DataFrame, settings: DataFrame) -> DataFrame:
    """(request_id, persona, persona_applied): the request's own text wins, an empty one means none, and only null falls to the saved one."""
    joined = requests.join(settings, "owner", "left")
    persona = F.when(F.col("persona_prompt").isNotNull(), F.nullif("persona_prompt", F.lit(""))).otherwise(F.nullif("active_prompt", F.lit("")))
    return joined.select("request_id", persona.alias("persona"), persona.isNotNull().alias("persona_applied"))


def resolve_route(requests: DataFrame, routes: DataFrame) -> DataFrame:
    """(request_id, route): the requested id, else the saved one, else the default; ids that no route has give the default."""
    default = routes.where("is_default").select(F.col("model_id").alias("fallback")).limit(1)
    known = routes.select("model_id")
    wanted = requests.select("request_id", F.coalesce(F.nullif("model_id", F.lit("")), F.nullif("saved_model_id", F.lit(""))).alias("model_id"))
    joined = wanted.join(known.withColumn("known", F.lit(True)), "model_id", "left").withColumn("one", F.lit(1))
    return joined.join(default.withColumn("one", F.lit(1)), "one", "left").select("request_id", F.when(F.col("known"), F.col("model_id")).otherwise(F.col("fallback")).alias("route"))


def system_prompt(persona: Column, examples: Column) -> Column:
    """The instruction with a persona section and numbered examples; empty lines of an example are left out. ``examples`` is array<struct<title, line2, line3>>."""
    persona_part = F.when(F.coalesce(persona, F.lit("")) != "", F.concat(F.lit("Point of view:\n"), persona))

    def one(e: Column, i: Column) -> Column:
        lines = F.array(F.concat(F.lit("1: "), e["title"]), *(F.when(e[f] != "", F.concat(F.lit(f"{n}: "), e[f])) for n, f in ((2, "line2"), (3, "line3"))))
        return F.concat(F.lit("Example "), (i + 1).cast("string"), F.lit("\n"), F.array_join(F.array_compact(lines), "\n"))

    parts = F.array_compact(F.concat(F.array(F.lit(BASE_PROMPT), persona_part), F.transform(examples, one)))
    return F.array_join(parts, "\n\n")


def request_rows(titles: DataFrame, packed: DataFrame) -> DataFrame:
    """(page_id, message): the title, or a mark that there is none, and the numbered candidates."""
    title = F.coalesce(F.nullif("title", F.lit("")), F.lit(UNKNOWN_TITLE))
    return titles.join(packed, "page_id").select("page_id", F.concat(F.lit("title:\n"), title, F.lit("\n\ncandidates:\n"), "prompt").alias("message"))


#: Strings, which may hold braces, single braces, and what lies between; together they are the whole text.
PIECES = "(?s)\"(?:[^\"\\\\]++|\\\\.)*+\"?|[{}]|[^\"{}]++"


def objects_in(text: Column) -> Column:
    """The top-level {...} stretches of a text, braces within strings not counted, by one scan over its pieces."""
    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("depth"), F.lit(0).alias("open"), F.array().cast("array<struct<a:int,n:int>>").alias("found"))

    def step(s: Column, piece: Column) -> Column:
        opens, closes = piece == "{", (piece == "}") & (s["depth"] > 0)
        whole = F.struct(s["open"].alias("a"), (s["at"] + 2 - s["open"]).alias("n"))
        return F.struct(
            (s["at"] + F.length(piece)).alias("at"),
            (s["depth"] + F.when(opens, 1).when(closes, -1).otherwise(0)).alias("depth"),
            F.when(opens & (s["depth"] == 0), s["at"] + 1).otherwise(s["open"]).alias("open"),
            F.when(closes & (s["depth"] == 1), F.concat(s["found"], F.array(whole))).otherwise(s["found"]).alias("found"),
        )

    spans = F.aggregate(F.regexp_extract_all(text, F.lit(PIECES), F.lit(0)), start, step, lambda s: s["found"])
    return F.transform(spans, lambda x: F.substring(text, x["a"], x["n"]))


def _object(text: str) -> dict | None:
    try:
        value = json.loads(text)
    except (ValueError, RecursionError):
        return None
    return value if isinstance(value, dict) else None


@F.pandas_udf(T.StringType())
def _first_object(texts: pd.Series) -> pd.Series:
    return texts.map(lambda some: next((t for t in some if _object(t) is not None), None), na_action="ignore")


def parse_response(responses: DataFrame) -> DataFrame:
    """(page_id, json, error_code): the first JSON object of a response, without thinking blocks, within the first code fence if there is one.

    A stretch is taken whole or not at all, so nothing stands behind an object's end. Equal keys (the last one counts) and NaN are no errors; only
    responses where the engine's parser refuses a stretch that may have such reach the Arrow function."""
    bare = F.trim(F.regexp_replace("raw", "(?is)<think>.*?</think>", ""))
    fence = "(?s)```(?:json)?\\s*(.*?)\\s*```"
    inner = F.when(bare.rlike(fence), F.regexp_extract(bare, fence, 1)).otherwise(bare)
    rows = responses.select("page_id", objects_in(inner).alias("found"))
    likely = rows.select("page_id", F.filter("found", lambda t: t.rlike('^\\{\\s*["}]')).alias("found"))  # nothing else begins an object
    strict = likely.withColumn("strict", F.transform("found", lambda t: F.try_parse_json(t).isNotNull()))
    settled = F.get("strict", 0)
    other = _first_object(F.when(~settled, F.col("found")))
    picked = F.when(settled, F.get("found", 0)).otherwise(other)
    return strict.select("page_id", picked.alias("json")).withColumn("error_code", F.when(F.col("json").isNull(), "llm_parse_error"))


def spelled(value: object) -> str:
    """A value as a line: null is empty, texts are trimmed, a list is its values with blanks between, trimmed, other values as they are written out."""
    lists: list[tuple[list, list[str]]] = [([value], [])]
    while True:
        left, done = lists[-1]
        if left:
            first, left[:] = left[0], left[1:]
            if isinstance(first, list):
                lists.append((list(first), []))
            else:
                done.append("" if first is None else str(first).strip())
        elif len(lists) == 1:
            return done[0]
        else:
            lists.pop()
            lists[-1][1].append(" ".join(done).strip())


def _spelled_fields(fields: tuple[str, ...]):
    @F.pandas_udf(T.StructType([T.StructField(f, T.StringType()) for f in fields]))
    def read(texts: pd.Series) -> pd.DataFrame:
        rows = [{} if t is None else _object(t) or {} for t in texts]
        return pd.DataFrame({f: [None if t is None else spelled(r.get(f)) for t, r in zip(texts, rows, strict=True)] for f in fields}, dtype=object)

    return read


def coerce_fields(parsed: DataFrame, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """(page_id, fields): null is empty, strings are trimmed, lists joined by blanks, lists in them too, other values written out as Python does.

    Texts, nulls, whole numbers, truth values and lists of texts stay in the engine; rows that have other kinds reach the Arrow function."""
    value = F.try_parse_json("json")

    def kind(name: str) -> Column:
        return F.coalesce(F.schema_of_variant(F.try_variant_get(value, f"$.{name}", "variant")), F.lit("VOID"))

    rows = parsed.withColumn("kinds", F.when(value.isNotNull(), F.array(*map(kind, fields))))
    plain = F.coalesce(F.forall("kinds", lambda k: k.isin("STRING", "VOID", "BIGINT", "BOOLEAN", "ARRAY<STRING>")), F.lit(False))
    rows = rows.withColumn("other", _spelled_fields(fields)(F.when(~plain, F.col("json"))))

    def one(i: int, name: str) -> Column:
        path, of = f"$.{name}", F.get("kinds", i)
        listed = X.trimmed(F.array_join(F.transform(F.try_variant_get(value, path, "array<string>"), lambda x: F.coalesce(X.trimmed(x), F.lit(""))), " "))
        truth = F.when(F.try_variant_get(value, path, "boolean"), "True").otherwise("False")
        native = F.when(of == "VOID", "").when(of == "BOOLEAN", truth).when(of == "ARRAY<STRING>", listed).otherwise(X.trimmed(F.try_variant_get(value, path, "string")))
        return F.coalesce(F.when(plain, native), F.col(f"other.{name}"), F.lit("")).alias(name)

    return rows.select("page_id", *(one(i, f) for i, f in enumerate(fields)))
