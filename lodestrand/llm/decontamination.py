"""Benchmark decontamination over a distributed positional inverted index."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .buffers import LOWER, flat_utf8, slices
from .buffers import words_in as words_by
from .lineage import cut, written

WORDS = 13
#: Above so many terms or item positions, joins take the place of broadcasts.
BROADCAST_TERMS, BROADCAST_ROWS, BROADCAST_BYTES = 1_000_000, 200_000, 32 << 20
LOWEST = -(1 << 63)
_IN_WORD = np.zeros(256, bool)
_IN_WORD[[*range(ord("0"), ord("9") + 1), *range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1), *range(0x80, 0x100)]] = True


def _keyed(docs: DataFrame, id_col: str, text_col: str, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, key, text) and the columns ``carry`` under names of our own, c0, c1 and so on."""
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(LOWEST))
    carried = [F.col(c).alias(f"c{i}") for i, c in enumerate(carry)]
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), key.alias("key"), F.col(text_col).cast("string").alias("text"), *carried)


def term_counts(docs: DataFrame, terms: np.ndarray | None) -> DataFrame:
    """(term, n) over all words of ``text``; of ``terms`` (sorted) only, if given. Each task sends its sums."""
    sent = docs.sparkSession.sparkContext.broadcast(terms)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = sent.value
        total = np.zeros(0 if wanted is None else len(wanted), np.int64)
        for batch in batches:
            for _, _, flat, ends in slices(*flat_utf8(batch.column(0))):
                hashes = words_by(flat, ends, _IN_WORD)[3]
                if wanted is None:
                    found, n = np.unique(hashes, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(n)], ["term", "n"])
                elif len(wanted):
                    at = np.minimum(np.searchsorted(wanted, hashes), len(wanted) - 1)
                    total += np.bincount(at[wanted[at] == hashes], minlength=len(wanted))
        if wanted is not None and total.any():
            yield pa.RecordBatch.from_arrays([pa.array(wanted[total > 0]), pa.array(total[total > 0])], ["term", "n"])

    return docs.select("text").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))


def postings(docs: DataFrame, terms: np.ndarray | None) -> DataFrame:
    """The positional index as (term, key, position): each place, in words, where a text of ``docs`` (key, text) has a term."""
    sent = docs.sparkSession.sparkContext.broadcast(terms)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = sent.value
        for batch in batches:
            keys = batch.column(0).to_numpy()
            for a, _, flat, ends in slices(*flat_utf8(batch.column(1))):
                text, _, _, hashes = words_by(flat, ends, _IN_WORD)
                place = np.arange(len(text)) - np.searchsorted(text, text)
                if wanted is not None:
                    at = np.minimum(np.searchsorted(wanted, hashes), len(wanted) - 1) if len(wanted) else np.zeros(len(hashes), np.int64)
                    hit = wanted[at] == hashes if len(wanted) else np.zeros(len(hashes), bool)
                    text, place, hashes = text[hit], place[hit], hashes[hit]
                yield pa.RecordBatch.from_arrays([pa.array(hashes), pa.array(keys[a + text]), pa.array(place.astype(np.int32))], ["term", "key", "position"])

    return docs.select("key", "text").mapInArrow(run, "term long, key long, position int")


def item_words(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item, item_id, words, terms): the item's lower-cased words, blank-joined, and their hashes. Items without a word are left out."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, ends = flat_utf8(batch.column(1))
            text, first, end, hashes = words_by(flat, ends, _IN_WORD)
            low = LOWER[flat].tobytes()
            cuts = np.searchsorted(text, np.arange(batch.num_rows + 1))
            joined = [b" ".join(low[i:j] for i, j in zip(first[a:b].tolist(), end[a:b].tolist(), strict=True)).decode("utf-8", "replace") for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            terms = pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(hashes))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(joined, pa.string()), terms], ["item_id", "words", "terms"])

    rows = items.select(F.col(id_col).cast("string").alias("item_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "item_id string, words string, terms array<long>")
    return rows.where("size(terms) > 0").withColumn("item", F.monotonically_increasing_id())


def sorted_terms(df: DataFrame, column: str) -> np.ndarray | None:
    """Distinct values of a column, sorted, or None if there are too many to send to every worker."""
    found = df.select(column).distinct().limit(BROADCAST_TERMS + 1)
    if found.count() > BROADCAST_TERMS:
        return None
    return np.sort(np.array([x[0] for x in found.collect()], np.int64))


def rarest_places(items: DataFrame, counts: DataFrame, words: int = WORDS) -> DataFrame:
    """(item, window, rank, place, term): for each window of an item its two rarest terms in the corpus, rank 1 and 2; ties go to the earlier place.

    An item of fewer words is one window. A window with a term that the corpus lacks is left out: it can't occur."""
    places = items.select("item", F.size("terms").alias("n"), F.posexplode("terms").alias("place", "term")).join(counts, "term", "left")
    first, last = F.greatest(F.lit(0), F.col("place") - words + 1), F.least(F.col("place"), F.greatest(F.lit(0), F.col("n") - words))
    spread = places.withColumn("window", F.explode(F.sequence(first, last)))
    window = Window.partitionBy("item", "window")
    ranked = spread.withColumn("known", F.min(F.coalesce("n_corpus", F.lit(0))).over(window)).where("known > 0")
    return ranked.withColumn("rank", F.row_number().over(window.orderBy("n_corpus", "place"))).where("rank <= 2").select("item", "window", "rank", "place", "term")


def _small(df: DataFrame) -> DataFrame:
    """A hint to broadcast ``df`` if it has ``BROADCAST_ROWS`` rows at most."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def index(docs: DataFrame, items: DataFrame, words: int = WORDS) -> tuple[DataFrame, DataFrame]:
    """(postings of the terms that some window of ``items`` has as its rarest, those windows' places). ``docs`` is (key, text), ``items`` from ``item_words``."""
    vocabulary = sorted_terms(items.select(F.explode("terms").alias("term")), "term")
    counts = term_counts(docs, vocabulary).withColumnRenamed("n", "n_corpus")
    chosen = cut(rarest_places(items, counts, words))
    return postings(docs, sorted_terms(chosen, "term")), chosen


def laid_places(docs: DataFrame, items: DataFrame, words: int = WORDS) -> tuple[DataFrame, DataFrame]:
    """((key, item, place, shift), the windows' places): every meeting of a posting with a place of its term in an item, the list adjusted by that
    place, so equal shifts mean the same laying of the item on the text. Written once; phrases and proximity are read from it."""
    index_rows, chosen = index(docs, items, words)
    places = chosen.select("term", "item", "place").distinct()
    return written(index_rows.join(_small(places), "term").select("key", "item", "place", (F.col("position") - F.col("place")).alias("shift"))), chosen


def phrase_places(laid: DataFrame, chosen: DataFrame) -> DataFrame:
    """(key, item, shift): where both rarest terms of one of the item's windows meet in one laying."""
    met = laid.groupBy("key", "item", "shift").agg(F.collect_set("place").alias("places"))
    windows = chosen.groupBy("item", "window").agg(F.collect_set("place").alias("needed")).groupBy("item").agg(F.collect_set("needed").alias("windows"))
    both = F.exists("windows", lambda w: F.size(F.array_except(w, F.col("places"))) == 0)
    return met.join(_small(windows), "item").where(both).select("key", "item", "shift")


def near_places(laid: DataFrame, chosen: DataFrame, slop: int) -> DataFrame:
    """(key, item, window) where both rarest terms of a window stand at most ``slop`` words off the distance that they have in the item.

    Layings meet by stretches of 2 * slop + 1 words, so a term that a long text repeats isn't paired with all its other places."""
    stretch = 2 * slop + 1

    def side(rank: int) -> DataFrame:
        return laid.join(_small(chosen.where(F.col("rank") == rank).select("item", "place", "window")), ["item", "place"])

    low, high = F.floor((F.col("shift") - slop) / stretch), F.floor((F.col("shift") + slop) / stretch)
    first = side(1).select("key", "item", "window", F.col("shift").alias("at"), F.explode(F.sequence(low, high)).alias("stretch"))
    second = side(2).select("key", "item", "window", F.col("shift").alias("other"), F.floor(F.col("shift") / stretch).alias("stretch"))
    met = first.join(second, ["key", "item", "window", "stretch"]).where(F.abs(F.col("at") - F.col("other")) <= slop)
    return met.select("key", "item", "window").distinct()


def phrase_matches(docs: DataFrame, items: DataFrame, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", carry: tuple[str, ...] = (), slop: int | None = None) -> DataFrame:
    """(doc_id, n_words, n_hit, item_ids, with ``slop`` near_ids, and with ``carry`` the text and those columns): for each row its words, how many of them lie in an occurrence of a window of an item, and the items met.

    Words and windows are compared whole after the index has named the places. Texts without words (null and empty ones) have 0 and no items; rows that
    repeat get a result each, by their own text even under one id; items of equal id count once; an empty table of either kind gives no hits.
    Rows with a null id share the places that the index names for any of them, and each is compared by its own text. near_ids are the items with a
    window whose two rarest terms stand in the text (any text of that id) at most ``slop`` words off their distance in the item, other words whatever they are."""
    rows = _keyed(docs, id_col, text_col, carry)
    known = cut(item_words(items, item_id_col, item_text_col))
    laid, chosen = laid_places(rows, known, words)
    places = phrase_places(laid, chosen)
    table = _item_table(known)
    if table is None:
        places = places.join(known.select("item", "item_id", "words"), "item")
    else:
        places = places.select("key", "item", "shift", F.lit(None).cast("string").alias("item_id"), F.lit(None).cast("string").alias("words"))
    sent = docs.sparkSession.sparkContext.broadcast(table)
    per_doc = places.groupBy("key").agg(F.collect_list(F.struct("item", "shift", "item_id", "words")).alias("places"))

    kept = [f"c{i}" for i in range(len(carry))]
    if slop is not None:
        near = near_places(laid, chosen, slop).select("key", "item").distinct().join(_small(known.select("item", "item_id")), "item")
        near = near.groupBy("key").agg(F.array_sort(F.collect_set(F.coalesce("item_id", F.lit("")))).alias("near_ids"))
        per_doc = per_doc.join(near, "key", "full")
    near_ids = F.coalesce("near_ids", F.array().cast("array<string>")) if slop is not None else F.lit(None).cast("array<string>")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items_sent = sent.value
        for batch in batches:
            n_words, n_hit, met = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64), [[] for _ in range(batch.num_rows)]
            for a, b, flat, ends in slices(*flat_utf8(batch.column(1))):
                text, first, end, _ = words_by(flat, ends, _IN_WORD)
                cuts = np.searchsorted(text, np.arange(b - a + 1))
                n_words[a:b] = np.diff(cuts)
                for k in range(b - a):
                    found = batch.column(2)[a + k].as_py()
                    if found:
                        low = LOWER[flat[ends[k] : ends[k + 1]]].tobytes()
                        spans = list(zip((first[cuts[k] : cuts[k + 1]] - ends[k]).tolist(), (end[cuts[k] : cuts[k + 1]] - ends[k]).tolist(), strict=True))
                        n_hit[a + k], met[a + k] = _confirmed(low, spans, found, words, items_sent)
            columns = [batch.column(0), pa.array(n_words), pa.array(n_hit), pa.array(met, pa.list_(pa.string())), batch.column(3)]
            if kept:
                columns += [batch.column(1), *batch.columns[4:]]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_hit", "item_ids", "near_ids", *(["text"] if kept else []), *kept])

    kinds = dict(rows.dtypes)
    joined = rows.join(per_doc, "key", "left").select("doc_id", "text", "places", near_ids.alias("near_ids"), *kept)
    schema = ["doc_id long, n_words long, n_hit long, item_ids array<string>, near_ids array<string>", *(["text string"] if kept else []), *(f"{c} {kinds[c]}" for c in kept)]
    out = joined.mapInArrow(run, ", ".join(schema)).withColumnsRenamed(dict(zip(kept, carry, strict=True)))
    return out if slop is not None else out.drop("near_ids")


def _item_table(known: DataFrame) -> dict[int, tuple[str | None, str]] | None:
    """{item: (item_id, words)} to send to every worker, so that places name items by number; None if the words are too many, and are joined to the places."""
    n = known.agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.octet_length("words")), F.lit(0)).alias("bytes")).first()
    if n["rows"] > BROADCAST_ROWS or n["bytes"] > BROADCAST_BYTES:
        return None
    return {x["item"]: (x["item_id"], x["words"]) for x in known.select("item", "item_id", "words").collect()}


def _confirmed(low: bytes, spans: list[tuple[int, int]], places: list[dict], words: int, table: dict[int, tuple[str | None, str]] | None) -> tuple[int, list[str]]:
    """(words hit, sorted ids of items met) among the places named for one text. Words of items come from ``table``, else with the places."""
    hit = np.zeros(len(spans), bool)
    met = set()
    for p in places:
        item_id, joined = (p["item_id"], p["words"]) if table is None else table[p["item"]]
        item = joined.encode().split(b" ")
        width = min(words, len(item))
        start = max(0, p["shift"])
        stop = min(len(spans), p["shift"] + len(item))
        same = np.fromiter((low[i:j] == item[at - p["shift"]] for at, (i, j) in enumerate(spans[start:stop], start)), bool, max(0, stop - start))
        if len(same) < width:
            continue
        run = np.concatenate(([0], np.cumsum(same)))
        whole = np.flatnonzero(run[width:] - run[:-width] == width)
        if len(whole):
            met.add(item_id or "")
            for w in whole.tolist():
                hit[start + w : start + w + width] = True
    return int(hit.sum()), sorted(met)


def proximity_matches(docs: DataFrame, items: DataFrame, slop: int, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, window) where both rarest terms of a window stand at most ``slop`` words off the distance that they have in the item.

    Texts and items without words, null ones too, match nothing; rows of one id, and items that repeat, give a row once an item; empty tables give none."""
    rows = _keyed(docs, id_col, text_col)
    known = cut(item_words(items, item_id_col, item_text_col))
    met = near_places(*laid_places(rows, known, words), slop).join(_small(known.select("item", "item_id")), "item")
    return met.select(F.when(F.col("key") != LOWEST, F.col("key")).alias("doc_id"), "item_id", "window")
