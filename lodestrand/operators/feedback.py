"""A log of liked results and saved settings, and the views that follow from it."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..lineage import kept
from ..sources.crawl import first_by

KEEP, PROMPT_EXAMPLES, PRESETS, PROMPT_CHARS, NAME_CHARS = 10, 6, 5, 400, 40
LOG = "id string, owner string, title string, line2 string, line3 string, ts timestamp_ntz, op string"


def feedback_key(title: Column, line2: Column, line3: Column) -> Column:
    parts = [F.coalesce(c, F.lit("")) for c in (title, line2, line3)]
    return F.regexp_replace(F.concat_ws(" ", *parts), "(?U)\\s", "")


def feedback_latest(log: DataFrame) -> DataFrame:
    """The newest addition of each (owner, key); ties go to the larger id."""
    return first_by(log.where("op = 'add'"), ["owner", "key"], F.desc("ts"), F.desc("id"))


def feedback_recent(log: DataFrame, keep: int = KEEP) -> DataFrame:
    """The last ``keep`` distinct keys of an owner with their recency from 1, for logs that only add. Ranks below ``keep`` are dropped before the shuffle."""
    newest = feedback_latest(log)
    return newest.withColumn("recency", F.row_number().over(Window.partitionBy("owner").orderBy(F.desc("ts"), F.desc("id")))).where(F.col("recency") <= keep)


def fold(events: list[tuple[str, str, str]], kept: list[tuple[str, str]], keep: int) -> list[tuple[str, str]]:
    """A ring of (key, id), oldest first, after (op, key, id) events in order: an addition moves its key to the end, the oldest beyond ``keep`` are
    gone for good, a deletion removes its key, a toggle deletes a key that the ring holds and adds any other."""
    for op, key, event in events:
        left = [k for k in kept if k[0] != key]
        adds = op == "add" or op == "toggle" and len(left) == len(kept)
        kept = [*left, (key, event)][-keep:] if adds and keep else left
    return kept


def _in_order() -> Column:
    """Time, then id, nulls last; equal rows of both by operation and key."""
    return F.struct(F.col("ts").isNull().alias("no_ts"), "ts", F.col("id").isNull().alias("no_id"), "id", "op", "key")


def _followed(events: DataFrame) -> DataFrame:
    """``events`` of stretches (owner, key, op, at, stretch) with the operation on the same key before each (before_op, before_at), null for a key's first.

    A stretch hands on the last operation of each key only; so a window holds the events of a key in one stretch, or one row of each stretch."""
    last = events.groupBy("owner", "key", "stretch").agg(F.max(F.struct("at", "op")).alias("last"))
    earlier = F.lag("last").over(Window.partitionBy("owner", "key").orderBy("stretch"))
    handed = last.withColumn("earlier", earlier).where("earlier is not null").select("owner", "key", F.col("earlier.op").alias("op"), F.col("earlier.at").alias("at"), "stretch", F.lit(True).alias("handed"))
    both = events.select("owner", "key", "op", "at", "stretch", F.lit(False).alias("handed")).unionByName(handed)
    before = Window.partitionBy("owner", "key", "stretch").orderBy("at")
    return both.select("*", F.lag("op").over(before).alias("before_op"), F.lag("at").over(before).alias("before_at")).where("not handed").drop("handed")


def feedback_ring(log: DataFrame, keep: int = KEEP) -> DataFrame:
    """(owner, key, id, recency) of the ring buffer with deletions; an entry that was pushed out doesn't come back when others are deleted.

    The ring can hold the newest ``keep`` keys only whose last operation is an addition. Such a key was pushed out if at some time since its addition
    ``keep`` other keys stood behind it. That number moves by one with an addition of a key that doesn't stand there or the deletion of one that does, so
    it is a running sum of steps, and its peak is the largest of (sum of earlier stretches + peak within a stretch): stretches of an owner's events are
    summed up by different tasks and their summaries put together, one row for each stretch. No task holds an owner, or a key, of any size."""
    stretches = log.select("owner", "key", "id", "op", _in_order().alias("at")).where(F.col("op").isin("add", "delete"))
    stretches = kept(stretches.repartitionByRange("owner", "at").withColumn("stretch", F.spark_partition_id()))
    last = stretches.groupBy("owner", "key").agg(F.max(F.struct("at", "op", "id")).alias("last")).where("last.op = 'add'")
    newest = Window.partitionBy("owner").orderBy(F.desc("last.at"))
    held = last.withColumn("place", F.row_number().over(newest)).where(F.col("place") <= keep)
    held = kept(held.select(F.struct("owner").alias("of"), "owner", "key", F.col("last.id").alias("id"), F.col("last.at").alias("since"), "place"))  # a null owner is an owner, too
    steps = _followed(stretches).withColumn("of", F.struct("owner")).drop("owner", "key").join(held.select("of", "place", "since"), "of").where("at > since")
    behind = (F.col("before_op") == "add") & (F.col("before_at") > F.col("since"))
    behind = F.coalesce(behind, F.lit(False))
    step = F.when((F.col("op") == "add") & ~behind, 1).when((F.col("op") == "delete") & behind, -1)
    steps = steps.withColumn("step", step).where("step is not null")
    running = F.sum("step").over(Window.partitionBy("of", "place", "stretch").orderBy("at").rowsBetween(Window.unboundedPreceding, 0))
    summed = steps.withColumn("running", running).groupBy("of", "place", "stretch").agg(F.sum("step").alias("total"), F.max("running").alias("peak"))
    earlier = F.coalesce(F.sum("total").over(Window.partitionBy("of", "place").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    gone = summed.withColumn("peak", earlier + F.col("peak")).groupBy("of", "place").agg(F.max("peak").alias("peak")).where(F.col("peak") >= keep)
    left = held.join(gone.select("of", "place"), ["of", "place"], "left_anti")
    recency = F.row_number().over(Window.partitionBy("of").orderBy("place"))
    return left.select("owner", "key", "id", recency.alias("recency"))


def feedback_toggle(log: DataFrame, builtin: DataFrame | None = None, keep: int = KEEP) -> DataFrame:
    """(owner, key, id, recency) of the ring after toggles: one of a key that the ring holds deletes it, one of any other key adds it. Keys of ``builtin`` stay as they are.

    What a toggle does depends on what was pushed out before it, so an owner's toggles are folded in order: Spark sorts them, with spill, and a task folds
    batch by batch, holding the ring of one owner."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def ring(owner: str | None, held: list[tuple[str, str]]) -> pa.RecordBatch:
            newest = held[::-1]
            rows = [pa.array([owner] * len(held), pa.string()), pa.array([k for k, _ in newest], pa.string()), pa.array([i for _, i in newest], pa.string())]
            return pa.RecordBatch.from_arrays([*rows, pa.array(range(1, len(held) + 1), pa.int32())], ["owner", "key", "id", "recency"])

        owner, held, begun = None, [], False
        for batch in batches:
            owners, keys, ids = (batch.column(n).to_pylist() for n in ("owner", "key", "id"))
            for o, rows in groupby(zip(owners, keys, ids, strict=True), lambda r: r[0]):
                if begun and o != owner:
                    yield ring(owner, held)
                    held = []
                owner, begun = o, True
                held = fold([("toggle", k, i) for _, k, i in rows], held, keep)
        if begun:
            yield ring(owner, held)

    own = log if builtin is None else log.join(builtin.select("key").distinct(), "key", "left_anti")
    ordered = own.select("owner", "key", "id", "ts").repartition("owner").sortWithinPartitions("owner", F.asc_nulls_last("ts"), F.asc_nulls_last("id"), "key")
    return ordered.select("owner", "key", "id").mapInArrow(run, "owner string, key string, id string, recency int")


def feedback_list(recent: DataFrame, builtin: tuple[str, ...]) -> DataFrame:
    """(owner, place, key, builtin): an owner's entries newest first, then the fixed ones of every owner in their order."""
    own = recent.select("owner", F.lit(0).alias("part"), F.col("recency").alias("n"), "key", F.lit(False).alias("builtin"))
    each = F.posexplode(F.array(*map(F.lit, builtin))).alias("n", "key")
    fixed = recent.select("owner").distinct().select("owner", each).select("owner", F.lit(1).alias("part"), "n", "key", F.lit(True).alias("builtin"))
    both = own.unionByName(fixed) if builtin else own
    return both.select("owner", F.row_number().over(Window.partitionBy("owner").orderBy("part", "n")).alias("place"), "key", "builtin")


def prompt_examples(listed: DataFrame, limit: int = PROMPT_EXAMPLES) -> DataFrame:
    return listed.where(F.col("place") <= max(limit, 0))


def feedback_delete(entries: DataFrame, deletes: DataFrame) -> DataFrame:
    """(id, kept, outcome) of every entry and every deletion asked for: fixed entries stay, and ids that aren't there are not found."""
    asked = deletes.select("id").distinct().withColumn("asked", F.lit(True))
    joined = entries.select("id", "builtin").join(asked, "id", "full")
    outcome = F.when(F.col("builtin").isNull(), "not_found").when(F.col("asked") & F.col("builtin"), "protected").when(F.col("asked"), "deleted").otherwise("kept")
    return joined.select("id", outcome.alias("outcome"), outcome.isin("kept", "protected").alias("kept"))


def feedback_exists(results: DataFrame, entries: DataFrame) -> DataFrame:
    """``results`` (with key) plus whether an entry has the key."""
    known = entries.select("key").distinct().withColumn("hit", F.lit(True))
    return results.join(known, "key", "left").withColumn("registered", F.coalesce("hit", F.lit(False))).drop("hit")


def preset_admit(log: DataFrame, cap: int = PRESETS, longest: int = PROMPT_CHARS) -> DataFrame:
    """(id, owner, reason): null for admitted presets; too_long, then cap, then duplicate. Among an owner's distinct texts the first ``cap`` get in,
    and what comes after the cap is reached is refused as such, duplicates included."""
    rows = log.withColumn("too_long", F.length("prompt") > longest)
    first = F.row_number().over(Window.partitionBy("owner", "too_long", "prompt").orderBy("ts", "id")) == 1
    fresh = rows.withColumn("fresh", first & ~F.col("too_long"))
    before = F.coalesce(F.sum(F.col("fresh").cast("int")).over(Window.partitionBy("owner").orderBy("ts", "id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    reason = F.when(F.col("too_long"), "too_long").when(before >= cap, "cap").when(~F.col("fresh"), "duplicate")
    return fresh.select("id", "owner", reason.alias("reason"))


def active_setting(log: DataFrame, longest: int = PROMPT_CHARS) -> DataFrame:
    """(owner, value): the last value that isn't too long."""
    return log.where(F.length("value") <= longest).groupBy("owner").agg(F.max_by("value", F.struct("ts", "id")).alias("value"))


def feedback_problem(title: Column, line2: Column, line3: Column) -> Column:
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    return F.when(blank(title), "title_required").when(blank(line2) & blank(line3), "line_required")


def preset_problem(name: Column) -> Column:
    n = F.trim(F.coalesce(name, F.lit("")))
    return F.when(n == "", "name_required").when(F.length(n) > NAME_CHARS, "name_too_long")
