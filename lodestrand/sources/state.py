"""Stored state files: each is read whole, a file that can't be read is set aside by its name and the others are loaded."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_EXAMPLE = "id string, title string, line2 string, line3 string, source_url string, created_at string, catchphrase_parts array<string>"
_PRESET = "id string, name string, prompt string, created_at string"


@F.pandas_udf(T.StringType())
def _plain(text: pd.Series) -> pd.Series:
    """The value written out anew, with the last of equal keys and NaN as text; null for what is no JSON."""

    def one(t: str) -> str | None:
        try:
            return json.dumps(json.loads(t, parse_constant=str))
        except (ValueError, RecursionError):
            return None

    return text.map(one, na_action="ignore")


def state_files(spark: SparkSession, path: str) -> DataFrame:
    """(file, quarantined, examples, presets, active_prompt, selected_model_id) of every file under ``path``.

    A file that is no JSON is quarantined and empty; one that holds no object is empty; sections of a wrong type are empty, and so are list items
    that are no objects left out. Old examples' parts become their lines unless they have some."""
    files = spark.read.option("wholetext", "true").text(path).select(F.col("_metadata.file_path").alias("file"), _plain("value").alias("json"))
    value = F.try_parse_json("json")
    is_object = F.coalesce(F.schema_of_variant(value).startswith("OBJECT"), F.lit(False))

    def section(name: str, schema: str) -> Column:
        items = F.when(is_object, F.try_variant_get(value, f"$.{name}", "array<variant>"))
        held = F.filter(F.coalesce(items, F.array().cast("array<variant>")), lambda x: F.schema_of_variant(x).startswith("OBJECT"))
        return F.transform(held, lambda x: F.from_json(F.to_json(x), schema))

    def text(name: str) -> Column:
        kept = is_object & (F.schema_of_variant(F.try_variant_get(value, f"$.{name}", "variant")) == "STRING")
        return F.when(kept, F.try_variant_get(value, f"$.{name}", "string")).otherwise("").alias(name)

    def line(x: Column, name: str, i: int) -> Column:
        return F.coalesce(x[name], F.get(x["catchphrase_parts"], i), F.lit("")).alias(name)

    examples = F.transform(section("examples", _EXAMPLE), lambda x: F.struct(x["id"].alias("id"), F.coalesce(x["title"], F.lit("")).alias("title"), line(x, "line2", 0), line(x, "line3", 1), x["source_url"].alias("source_url"), x["created_at"].alias("created_at")))
    return files.select("file", F.col("json").isNull().alias("quarantined"), examples.alias("examples"), section("presets", _PRESET).alias("presets"), text("active_prompt"), text("selected_model_id"))


def examples_of(files: DataFrame) -> DataFrame:
    """(file, place, id, title, line2, line3, source_url, created_at) of the files that could be read, in the order of each."""
    return files.where("not quarantined").select("file", F.posexplode("examples").alias("place", "e")).select("file", "place", "e.*")


def set_aside(spark: SparkSession, files: DataFrame, path: str, target: str) -> None:
    """The quarantined files' names and bytes, kept under ``target`` as they are."""
    bad = files.where("quarantined").select(F.col("file").alias("path"))
    spark.read.format("binaryFile").load(path).join(bad, "path", "left_semi").select(F.col("path").alias("file"), "content", "modificationTime").write.mode("append").parquet(target)
