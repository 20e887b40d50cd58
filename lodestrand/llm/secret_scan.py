"""Secret scans by corpus-wide ownership frequency. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lineage import cut

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: A shorter run can only fail the length rule, so the rule stands in the pattern.
ACCESS = r"(AKIA[A-Z0-9]{16,})"
HEX = r"([0-9a-f]{24,})"
KINDS = ("assign", "access", "hex", "owned")
ASSIGN_LENGTH = 6
#: Matches that one step of ``located`` puts together: arrays are copied as they grow, so long ones grow by so many at a time.
STEP = 256
#: Values that documentation shows in place of a secret.
PLACEHOLDER = r"(?i)example|sample|dummy|changeme|placeholder|your|test|xxxx|(.)\1{5}|\.\.\."


def located(text: Column, pattern: str, value_group: int, kind: int) -> Column:
    """Leftmost non-overlapping matches as array<struct<start, end, kind, value>>, in code points, end exclusive.

    The text between matches comes from a split by the same pattern, so starts are running lengths."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(value_group))
    gaps = F.split(text, pattern, -1)
    zipped = F.arrays_zip(F.slice(gaps, F.lit(1), F.size(whole)).alias("gap"), whole.alias("whole"), values.alias("value"))
    empty = F.array().cast("array<struct<start:int,end:int,kind:int,value:string>>")
    start = F.struct(F.lit(0).alias("at"), empty.alias("out"))

    def step(a: Column, x: Column) -> Column:
        begin = a["at"] + F.length(x["gap"])
        end = begin + F.length(x["whole"])
        span = F.struct(begin.alias("start"), end.alias("end"), F.lit(kind).alias("kind"), x["value"].alias("value"))
        return F.struct(end.alias("at"), F.concat(a["out"], F.array(span)).alias("out"))

    def stretch(a: Column, k: Column) -> Column:
        fresh = F.struct(a["at"].alias("at"), empty.alias("out"))
        part = F.aggregate(F.slice(zipped, k * STEP + 1, F.lit(STEP)), fresh, step)
        return F.struct(part["at"].alias("at"), F.concat(a["out"], part["out"]).alias("out"))

    short = F.aggregate(zipped, start, step, lambda a: a["out"])
    long = F.aggregate(F.sequence(F.lit(0), F.floor(F.size(whole) / STEP).cast("int")), start, stretch, lambda a: a["out"])
    return F.when(text.rlike(pattern), F.when(F.size(whole) <= STEP, short).otherwise(long)).otherwise(empty)


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repository_col: str = "doc_id", owner_col: str = "source", carry: tuple[str, ...] = ()) -> DataFrame:
    """(row, doc_id, repository, owner, base, and the columns ``carry``): base spans of each row by start, then kind."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    narrow = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(repository_col).cast("string").alias("repository"), F.col(owner_col).cast("string").alias("owner"), text.alias("text"), *carry
    )
    long_enough = F.filter(located(F.col("text"), ASSIGN, 2, 0), lambda s: F.length(s["value"]) >= ASSIGN_LENGTH)
    base = F.array_sort(F.concat(long_enough, located(F.col("text"), ACCESS, 1, 1), located(F.col("text"), HEX, 1, 2)))
    return narrow.select("doc_id", "repository", "owner", base.alias("base"), *carry).withColumn("row", F.monotonically_increasing_id())


def ownership(candidates: DataFrame) -> DataFrame:
    """(hash, n_owners, n_repositories) of candidate rows (hash, repository, owner): distinct counts in two steps, each with map-side partial sums,
    so a value that a third of the corpus holds arrives as a few rows a task. A null owner counts as one owner."""
    return (
        candidates.select("hash", F.coalesce("owner", F.lit("")).alias("owner"), F.coalesce("repository", F.lit("")).alias("repository"))
        .groupBy("hash", "owner", "repository").agg(F.lit(1).alias("one"))
        .groupBy("hash", "owner").agg(F.sum("one").alias("n"))
        .groupBy("hash").agg(F.count("*").alias("n_owners"), F.sum("n").alias("n_repositories"))
    )


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repository_col: str = "doc_id", owner_col: str = "source", max_repositories: int | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, base, owned, and the columns ``carry``): spans of each row; ``base`` by pattern, ``owned`` of values that live-looking secrets of one owner have.

    A candidate is owned if its value occurs with one owner only, holds a digit and a letter, and doesn't look like a placeholder; values that
    several owners share are widely copied examples and add nothing. ``max_repositories`` also counts values in more repositories as examples.
    Null and empty texts have no spans. Repeated rows keep a result each. An empty table gives an empty result. Spans hold code points."""
    found = cut(find(docs, id_col, text_col, repository_col, owner_col, carry))
    spans = found.where("size(base) > 0").select("row", "repository", "owner", F.explode("base").alias("s"))
    spans = spans.select("row", "repository", "owner", (F.col("s.end") - F.length("s.value")).alias("start"), F.col("s.end").alias("end"), F.col("s.value").alias("value"), F.sha2("s.value", 256).alias("hash"))
    few = F.lit(True) if max_repositories is None else F.col("n_repositories") <= max_repositories
    rare = ownership(spans).where((F.col("n_owners") == 1) & few).select("hash")
    live = spans.where(F.col("value").rlike("[0-9]") & F.col("value").rlike("[A-Za-z]") & ~F.col("value").rlike(PLACEHOLDER))
    owned = live.join(rare, "hash").groupBy("row").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("owned"))
    return found.join(owned, "row", "left").select("doc_id", "base", F.coalesce("owned", F.array().cast("array<struct<start:int,end:int>>")).alias("owned"), *carry)


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined, of an array<struct<start, end, kind>>."""
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def all_spans(base: Column, owned: Column) -> Column:
    plain = F.transform(base, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))
    added = F.transform(owned, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(KINDS.index("owned")).alias("kind")))
    return F.array_sort(F.concat(plain, added), lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(a["kind"] - b["kind"]))


def redacted(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """``text`` with each stretch that spans (sorted by start) cover put as ``mark``; overlapping spans give one mark."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(a: Column, s: Column) -> Column:
        gap = F.substring(text, a["at"] + 1, s["start"] - a["at"])
        fresh = F.struct(s["end"].alias("at"), F.concat(a["out"], gap, F.lit(mark)).alias("out"))
        wider = F.struct(F.greatest(a["at"], s["end"]).alias("at"), a["out"].alias("out"))
        return F.when((s["start"] >= a["at"]), fresh).otherwise(wider)

    return F.aggregate(spans, start, step, lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text) - a["at"])))
