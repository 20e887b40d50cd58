"""Exact long repeats by run-length indexes over fragments that meet at shared anchors."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .buffers import flat_utf8, mix, powers, sliding_min
from .lineage import cut, written
from .run_length_index import RunLengthIndex, laid_out

#: Bytes of the repeats looked for, and of an anchor.
WIDTH, ANCHOR = 100, 20
#: Bytes of fragments in one index, and fragments of one anchor beyond which their windows are compared by hash instead.
BLOCK_BYTES, HOT_FRAGMENTS = 1 << 20, 20_000
PIECE = 1 << 16
#: Keys with several texts up to which they are broadcast.
BROADCAST_ROWS = 200_000
BASE = 0x27D4EB2F165667C5
_RISE, _FALL = powers(BASE, PIECE + 4096), powers(pow(BASE, -1, 1 << 64), PIECE + 4096)
LOWEST = -(1 << 63)


def fragments_of(data: np.ndarray, width: int = WIDTH, anchor: int = ANCHOR) -> list[np.ndarray]:
    """[anchor hash, fragment hash, start, windows, left, right] arrays that cover every window of ``width`` bytes of a text once.

    A window's anchor is the k-gram of least hash in it, the rightmost of equal ones: equal windows have equal anchors wherever they stand.
    Neighbouring windows with one anchor make a fragment, of windows + ``width`` - 1 bytes. A window holds at least half of its other bytes on one
    side of its anchor, so fragments that share one agree in their ``left`` or in their ``right``: ten bits of a hash of the anchor with so many
    bytes on that side."""
    half = (width - anchor) // 2
    parts: list[list[np.ndarray]] = []
    for a in range(0, len(data) - width + 1, PIECE):
        low, end = max(0, a - half), min(len(data), a + PIECE + width - 1)
        piece = data[low : end + half].astype(np.uint64) + np.uint64(1)
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(piece * _RISE[: len(piece)], dtype=np.uint64)))
        shift, stop = a - low, end - low
        grams = mix((total[shift + anchor : stop + 1] - total[shift : stop + 1 - anchor]) * _FALL[shift : stop + 1 - anchor])
        keys = (grams & np.uint64(0xFFFFFFFF00000000)) | (np.uint64(0xFFFFFFFF) - np.arange(len(grams), dtype=np.uint64))
        least = sliding_min(keys, width - anchor + 1)
        start = np.flatnonzero(np.concatenate(([True], least[1:] != least[:-1])))
        windows = np.diff(np.concatenate((start, [len(least)])))
        at = (np.uint64(0xFFFFFFFF) - (least[start] & np.uint64(0xFFFFFFFF))).astype(np.int64)
        whole = mix((total[start + shift + windows + width - 1] - total[start + shift]) * _FALL[start + shift] + windows.astype(np.uint64))

        def side(first: np.ndarray, last: np.ndarray, held: np.ndarray, total=total, whole=whole) -> np.ndarray:
            first, last = np.where(held, first, 0), np.where(held, last, 0)
            own = mix((total[last] - total[first]) * _FALL[first] + np.uint64(1))
            return (np.where(held, own, mix(whole)) >> np.uint64(54)).astype(np.int64)  # what no window asks for agrees with nothing

        here = at + shift
        left = side(here - half, here + anchor, at - start >= half)
        right = side(here, here + anchor + half, at - (start + windows - 1) < half)
        parts.append([grams[at].view(np.int64), whole.view(np.int64), start + a, windows, left, right])
    return [np.concatenate(x) for x in zip(*parts, strict=True)] if parts else [np.empty(0, np.int64)] * 6


def _anchored(rows: DataFrame, width: int) -> DataFrame:
    """(anchor, whole, key, tie, place) of every fragment; place is start << 32 | left << 22 | right << 12 | windows << 1 | copy.

    Within an Arrow batch all but the first of equal fragments are known to be copies. They take a random anchor, so that what a third of the corpus
    repeats is spread over all tasks, and only a row for each batch meets at the common anchor."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, ends = flat_utf8(batch.column(2))
            long = np.flatnonzero(np.diff(ends) >= width)
            if not len(long):
                continue
            found = [fragments_of(flat[ends[i] : ends[i + 1]], width) for i in long.tolist()]
            anchor, whole, start, windows, left, right = (np.concatenate(x) for x in zip(*found, strict=True))
            counts = [len(x[0]) for x in found]
            key, tie = (np.repeat(batch.column(i).to_numpy()[long], counts) for i in range(2))
            order = np.lexsort((start, tie, key, whole, anchor))
            copy = np.zeros(len(anchor), bool)
            a, w = anchor[order], whole[order]
            copy[order[1:]] = (a[1:] == a[:-1]) & (w[1:] == w[:-1])
            place = (start << 32) | (left << 22) | (right << 12) | (windows << 1) | copy  # rows stay in text order, in which keys compress well
            anchor = np.where(copy, mix((key ^ (start << 28)).view(np.uint64)).view(np.int64), anchor)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (anchor, whole, key, tie, place)], ["anchor", "whole", "key", "tie", "place"])

    return rows.select("key", "tie", "text").mapInArrow(run, "anchor long, whole long, key long, tie long, place long")


def _texts_cut(rows: DataFrame, places: DataFrame, width: int) -> DataFrame:
    """(anchor, key, tie, start, body): the bytes of the fragments in ``places`` (key, tie, places array<struct<anchor, start, windows>>).

    The join keeps texts without places, so that its shuffle of the texts is the very one that ``remove_repeats`` needs, and runs once."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                part = part.filter(part.column(3).is_valid())
                if not part.num_rows:
                    continue
                flat, ends = flat_utf8(part.column(2))
                found = part.column(3)
                each = found.flatten()
                row = np.repeat(np.arange(part.num_rows), found.value_lengths().to_numpy())
                anchor, start, windows = (each.field(i).to_numpy() for i in range(3))
                first = ends[row] + start
                last = np.minimum(first + windows + width - 1, ends[row + 1])
                bodies = [flat[a:b].tobytes() for a, b in zip(first.tolist(), last.tolist(), strict=True)]
                key, tie = (pa.array(part.column(i).to_numpy()[row]) for i in range(2))
                yield pa.RecordBatch.from_arrays([pa.array(anchor), key, tie, pa.array(start), pa.array(bodies, pa.binary())], ["anchor", "key", "tie", "start", "body"])

    joined = rows.join(places.hint("merge"), ["key", "tie"], "left").select("key", "tie", "text", "places")
    return joined.mapInArrow(run, "anchor long, key long, tie long, start long, body binary")


def anchor_places(flat: np.ndarray, ends: np.ndarray, anchors: np.ndarray, width: int, anchor: int = ANCHOR) -> np.ndarray:
    """Where in each fragment its anchor stands: the rightmost place in its first window of the k-gram with that hash."""
    grams = np.zeros(len(flat), np.int64)
    for a in range(0, len(flat) - anchor + 1, PIECE):
        piece = flat[a : a + PIECE + anchor - 1].astype(np.uint64) + np.uint64(1)
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(piece * _RISE[: len(piece)], dtype=np.uint64)))
        n = len(piece) - anchor + 1
        grams[a : a + n] = mix((total[anchor:] - total[:n]) * _FALL[:n]).view(np.int64)
    place = np.zeros(len(anchors), np.int64)
    for offset in range(width - anchor + 1):
        place = np.where(grams[ends[:-1] + offset] == anchors, offset, place)
    return place


def _repeated_inside(anchors: np.ndarray, bodies: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """(ends, marks): of the windows of all fragments in order, those of fragment k at ends[k]:ends[k + 1], which ones an earlier fragment of the anchor has.

    Fragments lie in text order. In round t those of one anchor whose ranks differ in bit t and agree in all higher ones meet: the earlier half is indexed,
    the later half is streamed, and a window is marked if the matching statistic at its start is a whole window. Every two fragments of an anchor meet
    in one round. Halves of different anchors and ranks share an index: the first byte of the anchor, which every window holds at the same place as
    its equals do, is put by a symbol of their own. Fragments all of whose windows are marked needn't be indexed any more: each window has an earlier one."""
    sizes = np.fromiter(map(len, bodies), np.int64, len(bodies))
    ends = np.concatenate(([0], np.cumsum(sizes)))
    flat = np.frombuffer(b"".join(bodies), np.uint8)
    symbols = flat.astype(np.int32)
    tagged = ends[:-1] + anchor_places(flat, ends, anchors, width)
    windows = sizes - width + 1
    window_ends = np.concatenate(([0], np.cumsum(windows)))
    marks = np.zeros(int(window_ends[-1]), bool)
    order = np.argsort(anchors, kind="stable")
    new = np.concatenate(([True], anchors[order][1:] != anchors[order][:-1]))
    group = np.cumsum(new) - 1
    rank = np.arange(len(order)) - np.flatnonzero(new)[group]
    count = np.bincount(group)[group]
    for t in range(int(count.max() - 1).bit_length()):
        half, pair = rank >> t & 1, group << 32 | rank >> (t + 1)
        met = (rank >> t | 1) << t < count  # the pair's later half isn't empty
        unmarked = np.add.reduceat(~marks, window_ends[:-1])[order] > 0
        early, late = np.flatnonzero(met & (half == 0) & unmarked), np.flatnonzero((half == 1) & unmarked)
        early = early[np.isin(pair[early], pair[late])]
        late = late[np.isin(pair[late], pair[early])]
        if not len(late):
            continue
        names = np.unique(pair[late])

        def taken(rows: np.ndarray, names=names, pair=pair) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
            who = order[rows]
            own = np.concatenate(([0], np.cumsum(sizes[who])))
            at = np.arange(own[-1]) + np.repeat(ends[who] - own[:-1], sizes[who])
            part = symbols[at]
            tags = tagged[who] - ends[who] + own[:-1]
            part[tags] = 256 + np.searchsorted(names, pair[rows])
            return who, own, part, tags

        _, own, part, _ = taken(early)
        text = laid_out(part, own)
        index = RunLengthIndex(text)
        who, own, part, tags = taken(late)
        long = index.statistics(part, own, text, width, tags) >= width
        n = windows[who]
        inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        marks[np.repeat(window_ends[who], n) + inner] |= long[np.repeat(own[:-1], n) + inner]
    return window_ends, marks


def _indexed(fragments: DataFrame, width: int) -> DataFrame:
    """(key, tie, start, windows) of repeated windows among ``fragments`` (anchor, key, tie, start, body), which lie sorted by anchor.

    Whole anchors go into one index until it has ``BLOCK_BYTES``: equal windows never part, and memory is bounded by a block and its last anchor."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def marks() -> pa.RecordBatch:
            rows = sorted({r[:4]: r for r in held}.values(), key=lambda r: r[1:4])  # a document given twice is one
            anchor, key, tie, start = (np.array([r[i] for r in rows], np.int64) for i in range(4))
            ends, found = _repeated_inside(anchor, [r[4] for r in rows], width)
            head = found.copy()
            head[1:] &= ~found[:-1]
            head[ends[:-1]] |= found[ends[:-1]]
            first = np.flatnonzero(head)
            who = np.searchsorted(ends, first, "right") - 1
            stops = np.flatnonzero(np.concatenate((found[:-1] & head[1:] | found[:-1] & ~found[1:], found[-1:])))
            return pa.RecordBatch.from_arrays([pa.array(x) for x in (key[who], tie[who], start[who] + first - ends[who], stops - first + 1)], ["key", "tie", "start", "windows"])

        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if size >= BLOCK_BYTES and row[0] != held[-1][0]:
                    yield marks()
                    held, size = [], 0
                held.append(row)
                size += len(row[4]) + 1
        if held:
            yield marks()

    return fragments.mapInArrow(run, "key long, tie long, start long, windows long")


def _by_window_hash(fragments: DataFrame, width: int) -> DataFrame:
    """As ``_indexed``, for anchors with too many fragments for one index: a row for each window, and the first of equal ones by partial minima."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, tie, start, body in zip(*(batch.column(i).to_pylist() for i in range(1, 5)), strict=True):
                n = len(body) - width + 1
                windows = [body[i : i + width] for i in range(n)]
                columns = [pa.array(windows, pa.binary()), pa.array([key] * n, pa.int64()), pa.array([tie] * n, pa.int64()), pa.array(range(start, start + n), pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["window", "key", "tie", "start"])

    rows = fragments.select("anchor", "key", "tie", "start", "body").mapInArrow(run, "window binary, key long, tie long, start long")
    rows = rows.select(F.xxhash64("window").alias("a"), F.xxhash64(F.lit(1), "window").alias("b"), "key", "tie", "start")
    here = F.struct("key", "tie", "start")
    first = rows.groupBy("a", "b").agg(F.min(here).alias("first"))
    return rows.join(first, ["a", "b"]).where(here != F.col("first")).select("key", "tie", "start", F.lit(1).cast("long").alias("windows"))


def repeated_windows(rows: DataFrame, width: int = WIDTH) -> DataFrame:
    """(key, tie, start, windows): stretches of windows of ``width`` bytes of ``rows`` (key, tie, text) that also start earlier, in a smaller (key, tie) or further left.

    1. Fragments meet by anchor, in one shuffle; those whose anchor has no other fragment that agrees on a side are dropped. 2. Of equal fragments all
    but the first are repeats as a whole. 3. Different fragments of one anchor - the edges of what repeats - go to run-length indexes, by anchor; an
    anchor with very many of them is compared window by window instead, in many tasks."""
    if width - ANCHOR + 1 >= 1 << 11:
        raise ValueError("too wide for a place")
    here, first = F.struct("key", "tie", "place"), F.col("first").cast("int")

    def bits(low: int, n: int) -> Column:
        return F.shiftright("place", low).bitwiseAND((1 << n) - 1)

    placed = _anchored(rows, width).repartition("anchor")  # serves all windows
    placed = placed.withColumn("first", (bits(0, 1) == 0) & (F.min(here).over(Window.partitionBy("anchor", "whole")) == here))
    placed = placed.withColumn("fragments", F.sum(first).over(Window.partitionBy("anchor"))).where("not first or fragments > 1")
    placed = placed.withColumn("left", bits(22, 10)).withColumn("right", bits(12, 10))
    agreeing = F.greatest(*(F.sum(first).over(Window.partitionBy("anchor", side)) for side in ("left", "right")))
    placed = placed.withColumn("agreeing", agreeing).where("not first or agreeing > 1")
    placed = written(placed.select("anchor", "key", "tie", bits(32, 31).alias("start"), bits(1, 11).alias("windows"), "first", "fragments"))
    copies = placed.where("not first").select("key", "tie", "start", "windows")
    edges = placed.where("first")
    several = edges.select("anchor", "fragments").distinct()
    places = edges.groupBy("key", "tie").agg(F.collect_list(F.struct("anchor", "start", "windows")).alias("places"))
    hot = several.where(F.col("fragments") > HOT_FRAGMENTS)
    bodies = _texts_cut(rows, places, width)
    if hot.limit(1).count():
        large = _by_window_hash(bodies.join(hot, "anchor", "left_semi"), width)
        bodies = bodies.join(hot, "anchor", "left_anti")
        copies = copies.unionByName(large)
    parts = rows.sparkSession.conf.get("spark.sql.shuffle.partitions")
    dealt = bodies.repartition(int(parts), "anchor").sortWithinPartitions("anchor")
    return copies.unionByName(_indexed(dealt, width))


def with_ties(rows: DataFrame) -> DataFrame:
    """``rows`` (key, text) with a ``tie``: 0, but for a key that different texts have a hash of the text, which tells them apart."""
    hashed = F.xxhash64("text")
    several = cut(rows.groupBy("key").agg(F.min(hashed).alias("low"), F.max(hashed).alias("high")).where("low <> high").select("key", F.lit(True).alias("several")))
    n = several.limit(BROADCAST_ROWS + 1).count()
    if not n:
        return rows.select("key", F.lit(0).cast("long").alias("tie"), "text")
    joined = rows.join(F.broadcast(several) if n <= BROADCAST_ROWS else several, "key", "left")
    return joined.select("key", F.when(F.col("several"), hashed).otherwise(F.lit(0)).alias("tie"), "text")


def remove_repeats(docs: DataFrame, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, spans array<struct<start, end>>, kept binary): UTF-8 bytes that a repeated string of ``width`` bytes covers, removed.

    A string repeats if it also starts earlier: in a text of smaller doc_id (a null id is smallest), or further left in the same text; all are judged
    on the input. Spans are the maximal removed stretches. Null texts are empty; texts under ``width`` bytes stay whole; different texts of one id
    are different documents, in the order of a hash; rows with the same id and text count as one document given twice, so what they have in the
    same place is no repeat; other columns are left out; an empty table gives an empty result."""
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(LOWEST))
    rows = with_ties(docs.select(key.alias("key"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")))
    marks = repeated_windows(rows, width).groupBy("key", "tie").agg(F.collect_list(F.struct("start", "windows")).alias("marks"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.struct([("start", pa.int64()), ("end", pa.int64())])
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                flat, ends = flat_utf8(part.column(2))
                spans, kept = [], []
                for k, found in enumerate(part.column(3)):
                    data = flat[ends[k] : ends[k + 1]]
                    if not found.is_valid:
                        spans.append([])
                        kept.append(data.tobytes())
                        continue
                    start, windows = (found.values.field(i).to_numpy() for i in range(2))
                    start, end = np.minimum(start, len(data)), np.minimum(start + windows + width - 1, len(data))
                    edge = np.bincount(start, minlength=len(data) + 1) - np.bincount(end, minlength=len(data) + 1)
                    gone = np.concatenate(([False], np.cumsum(edge)[:-1] > 0, [False]))
                    turns = np.flatnonzero(gone[1:] != gone[:-1])
                    spans.append([{"start": a, "end": b} for a, b in turns.reshape(-1, 2).tolist()])
                    kept.append(data[~gone[1:-1]].tobytes())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(ends)), pa.array(spans, pa.list_(span)), pa.array(kept, pa.binary())], ["key", "n_bytes", "spans", "kept"])

    joined = rows.join(marks.hint("merge"), ["key", "tie"], "left").select("key", "tie", "text", "marks")
    out = joined.mapInArrow(run, "key long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary")
    return out.select(F.when(F.col("key") != LOWEST, F.col("key")).alias("doc_id"), "n_bytes", "spans", "kept")
