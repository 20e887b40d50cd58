"""Texts that stand whole within others, compared by key, over whole tables: blocks of the longer texts meet rare k-grams of the shorter ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..lineage import kept

#: Characters of the longest gram; grams are powers of two, at most half as long as their item.
GRAM = 32


def _grams(items: DataFrame) -> DataFrame:
    """(item_id, key, n, k, offset, gram) of every gram of each item. ``k`` characters twice, less one, fit into the item: wherever it stands in a text that is
    cut into blocks of k, it covers a whole block."""
    fitting = F.pow(2, F.floor(F.log2((F.col("n") + 1) / 2))).cast("int")
    sized = items.withColumn("n", F.length("key")).where("n > 0").withColumn("k", F.least(F.lit(GRAM), fitting))
    each = [F.when(F.col("k") == k, F.regexp_extract_all("key", F.lit(f"(?s)(?=(.{{{k}}}))"), F.lit(1))) for k in (2**p for p in range(GRAM.bit_length()))]
    return sized.select("item_id", "key", "n", "k", F.posexplode(F.coalesce(*each)).alias("offset", "gram")).withColumn("gram", F.xxhash64("gram"))


def _blocks(k: int) -> Column:
    """The whole blocks of ``k`` characters of a document's key, with their places."""
    cut = F.regexp_extract_all("doc_key", F.lit(f"(?s).{{{k}}}"), F.lit(0))
    return F.transform(cut, lambda b, i: F.struct(F.lit(k).alias("k"), (i * k).alias("place"), F.xxhash64(b).alias("gram")))


def contained(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, at, start, size): where each item of (item_id, text) first stands in each document of (doc_id, text): ``at`` in the document's key,
    ``start`` and ``size`` in its characters, from 0. Ids name rows; null and blank texts hold nothing and stand nowhere.

    Each document gives one block of k characters in k, and only those that equal a gram of some item are kept. Their counts say which k neighbouring
    grams of an item are rarest; exactly one of these meets a block at each place where the item stands, so the join makes a row for each such place and
    few others, which the comparison of the whole text drops. Texts are joined by id with the few documents that have a place."""
    keyed = documents.where("text is not null").select("doc_id", X.folded_key(F.col("text")).alias("doc_key"))
    grams = kept(_grams(items.where("text is not null").select("item_id", X.match_key(F.col("text")).alias("key"))))
    sizes = sorted(r.k for r in grams.select("k").distinct().collect())
    if not sizes:
        return keyed.join(grams.select("item_id"), F.lit(False)).select("doc_id", "item_id", *(F.lit(0).alias(c) for c in ("at", "start", "size")))
    laid = keyed.select("doc_id", F.explode(F.flatten(F.array(*map(_blocks, sizes)))).alias("b")).select("doc_id", "b.*")
    laid = kept(laid.join(grams.select("k", "gram").distinct(), ["k", "gram"], "left_semi"))
    counts = laid.groupBy("k", "gram").agg(F.count("*").alias("n_blocks"))
    counted = grams.join(counts, ["k", "gram"], "left").withColumn("n_blocks", F.coalesce("n_blocks", F.lit(0)))
    phases = None
    for k in sizes:  # a frame's length is fixed, so each size has its own window
        ahead = Window.partitionBy("item_id", "key").orderBy("offset").rowsBetween(0, k - 1)
        one = counted.where(F.col("k") == k).withColumn("cost", F.sum("n_blocks").over(ahead))
        phases = one if phases is None else phases.unionByName(one)
    fits = F.col("offset") <= F.col("n") - 2 * F.col("k") + 1
    base = phases.where(fits).groupBy("item_id", "key").agg(F.min(F.struct("cost", "offset")).alias("best")).select("item_id", "key", F.col("best.offset").alias("base"))
    chosen = counted.join(base, ["item_id", "key"]).where((F.col("offset") >= F.col("base")) & (F.col("offset") < F.col("base") + F.col("k")) & (F.col("n_blocks") > 0))
    places = chosen.join(laid, ["k", "gram"]).select("doc_id", "item_id", "key", (F.col("place") - F.col("offset")).alias("at")).where("at >= 0")
    places = kept(places)
    few = documents.select("doc_id", "text").join(places.select("doc_id").distinct(), "doc_id", "left_semi")
    few = kept(few.withColumn("doc_key", X.folded_key(F.col("text"))))  # a key for each document, however many places it has
    met = places.join(few, "doc_id").where(F.substring(F.col("doc_key"), F.col("at") + 1, F.length("key")) == F.col("key"))
    first = met.groupBy("doc_id", "item_id", "key").agg(F.min(F.struct("at", "text")).alias("m")).select("doc_id", "item_id", "key", "m.*")
    span = X.span_of(F.col("text"), F.col("at"), F.length("key"))
    return first.select("doc_id", "item_id", "at", span.alias("s")).select("doc_id", "item_id", "at", "s.start", "s.size")
