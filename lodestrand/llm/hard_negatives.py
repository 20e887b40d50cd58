"""Hard negatives: for each anchor and each of its nearest rows of the same label, the best rows of other labels within a window of scores below it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import written

POSITIVES, NEGATIVES = 5, 10
#: Bounds of a window, in hundredths of the positive's score.
LOW, HIGH = 30, 90
#: Anchors' vectors that one pass over the rows may broadcast; more anchors take several passes.
BROADCAST_BYTES = 32 << 20
#: Anchors that are multiplied with a batch of rows at a time.
STRIP = 256
_SIGN = np.uint64(1 << 63)


def quantised(rows: DataFrame, id: str, label: Column, vector: str) -> DataFrame:
    """(id, label, q): floor(256 * x) of each component. Rows with a null id, label or vector or with a null or non-finite component are left out;
    of rows that repeat an id the least label and vector stays."""
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    q = F.transform(vector, lambda x: F.floor(256 * x.cast("double")).cast("long"))
    usable = rows.where(F.col(id).isNotNull() & label.isNotNull() & F.coalesce(sound, F.lit(False)))
    one = usable.select(F.col(id).cast("long").alias("id"), F.struct(label.cast("long").alias("label"), q.alias("q")).alias("row")).groupBy("id").agg(F.min("row").alias("row"))
    return one.select("id", "row.label", "row.q")


def _matrices(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, labels, vectors) of the rows of each length of vector, by ascending id."""
    ids, labels = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("id", "label"))
    q = batch.column("q")
    ends = q.offsets.to_numpy()
    flat = q.values.to_numpy(zero_copy_only=False)
    sizes = np.diff(ends)
    for dim in np.unique(sizes):
        at = np.flatnonzero(sizes == dim)
        at = at[np.argsort(ids[at], kind="stable")]
        yield ids[at], labels[at], flat[ends[at][:, None] + np.arange(dim)] if dim else np.zeros((len(at), 0), np.int64)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products, by floating multiplication where its mantissa holds every sum."""
    most = (float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0))) * max(a.shape[1], 1)
    kind = np.float32 if most < 2**24 else np.float64 if most < 2**53 else np.int64
    return (a.astype(kind) @ b.astype(kind).T).astype(np.int64)


def _best(group: np.ndarray, score: np.ndarray, ids: np.ndarray, n: int) -> np.ndarray:
    """Positions of the first ``n`` of each group by descending score, ties by id."""
    order = np.lexsort((ids, -score, group))
    g = group[order]
    new = np.ones(len(g), bool)
    new[1:] = g[1:] != g[:-1]
    heads = np.flatnonzero(new)
    place = np.arange(len(g)) - np.repeat(heads, np.diff(np.append(heads, len(g))))
    return order[place < n]


class _Running:
    """The best so far of each group over the batches of a task."""

    def __init__(self, n: int):
        self.n, self.rows = n, tuple(np.empty(0, np.int64) for _ in range(3))

    def add(self, group: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        if len(group):
            best = _best(group, score, ids, self.n)
            joined = [np.concatenate([x, y[best]]) for x, y in zip(self.rows, (group, score, ids))]
            best = _best(*joined, self.n)
            self.rows = tuple(x[best] for x in joined)


class Anchors:
    """A part of the anchors as arrays: ids, labels, the matrix of each length of vector, and the scores that open windows (-1 for none)."""

    def __init__(self, part: pa.Table):
        self.ids, self.labels = (part.column(c).to_numpy().astype(np.int64) for c in ("id", "label"))
        q, scores = part.column("q").to_pylist(), part.column("scores").to_pylist()
        of = {}
        for k, x in enumerate(q):
            of.setdefault(len(x), []).append(k)
        self.matrices = {dim: (np.array(at), np.array([q[k] for k in at], np.int64).reshape(len(at), dim)) for dim, at in of.items()}
        self.windows = np.full((len(q), max((len(x) for x in scores), default=0)), -1, np.int64)
        for k, x in enumerate(scores):
            self.windows[k, : len(x)] = x

    def strips(self, vectors: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(numbers of anchors, their scores with the rows) for the anchors whose vectors are as long as the rows'."""
        at, matrix = self.matrices.get(vectors.shape[1], (np.empty(0, np.int64), None))
        for k in range(0, len(at), STRIP):
            yield at[k : k + STRIP], products(matrix[k : k + STRIP], vectors)


def _positives(shared, n: int):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors, running = shared.value, _Running(n)
        for batch in batches:
            for ids, labels, vectors in _matrices(batch):
                for strip, scores in anchors.strips(vectors):
                    a, r = np.nonzero((anchors.labels[strip][:, None] == labels) & (anchors.ids[strip][:, None] != ids))
                    running.add(strip[a], scores[a, r], ids[r])
        group, score, ids = running.rows
        yield pa.RecordBatch.from_arrays([pa.array(anchors.ids[group]), pa.array(score), pa.array(ids)], ["anchor_id", "score", "id"])

    return find


def packed(anchor: np.ndarray, score: np.ndarray, kind: int, ids: np.ndarray) -> pa.Array:
    """Keys of 25 bytes whose order as bytes is (anchor, descending score, positives before negatives, id)."""
    out = np.zeros((len(anchor), 25), np.uint8)
    for at, column in ((0, anchor.view(np.uint64) ^ _SIGN), (8, ~(score.view(np.uint64) ^ _SIGN)), (17, ids.view(np.uint64) ^ _SIGN)):
        out[:, at : at + 8] = column.astype(">u8").view(np.uint8).reshape(-1, 8)
    out[:, 16] = kind
    return pa.BinaryArray.from_buffers(pa.binary(), len(out), [None, pa.py_buffer((25 * np.arange(len(out) + 1)).astype(np.int32)), pa.py_buffer(out.tobytes())])


def unpacked(keys: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, score, kind, id)."""
    raw = np.frombuffer(b"".join(keys.to_pylist()), np.uint8).reshape(-1, 25)
    longs = [np.ascontiguousarray(raw[:, at : at + 8]).view(">u8").reshape(-1).astype(np.uint64) for at in (0, 8, 17)]
    return (longs[0] ^ _SIGN).view(np.int64), (~longs[1] ^ _SIGN).view(np.int64), raw[:, 16], (longs[2] ^ _SIGN).view(np.int64)


def _pairs(shared, n: int, low: int, high: int):
    """Keys of the rows of other labels that a window may return: of each window the task's best."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors, running = shared.value, _Running(n)
        most = anchors.windows.shape[1]
        for batch in batches:
            for ids, labels, vectors in _matrices(batch):
                for strip, scores in anchors.strips(vectors):
                    other = anchors.labels[strip][:, None] != labels
                    for w in range(most):
                        positive = anchors.windows[strip, w][:, None]
                        a, r = np.nonzero(other & (100 * scores >= low * positive) & (100 * scores <= high * positive) & (positive >= 0))
                        running.add(strip[a] * most + w, scores[a, r], ids[r])
        group, score, ids = running.rows
        found = np.unique(np.stack([group // max(most, 1), score, ids]), axis=1)
        yield pa.RecordBatch.from_arrays([packed(anchors.ids[found[0]], np.ascontiguousarray(found[1]), 1, np.ascontiguousarray(found[2]))], ["key"])

    return find


def _positive_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        columns = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("anchor_id", "score", "id")]
        yield pa.RecordBatch.from_arrays([packed(columns[0], columns[1], 0, columns[2])], ["key"])


def _mined(n: int, low: int, high: int):
    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sorted keys in, result rows out; all that is kept are the windows of the present anchor."""
        present, windows = None, []
        for batch in batches:
            out = []
            for anchor, score, kind, other in zip(*(x.tolist() for x in unpacked(batch.column("key")))):
                if anchor != present:
                    present, windows = anchor, []
                if kind == 0:
                    windows.append([other, score, 0])
                    continue
                for window in windows:
                    if window[2] < n and low * window[1] <= 100 * score <= high * window[1]:
                        window[2] += 1
                        out.append((anchor, window[0], window[2], other, window[1], score))
            columns = list(zip(*out)) or [()] * 6
            types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            names = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

    return walk


def _in_passes(anchors: DataFrame, limit: int) -> Iterator[Anchors]:
    """Anchors in parts whose vectors take about ``limit`` bytes, by hash of the id: what the driver holds and broadcasts at a time."""
    total = anchors.agg(F.sum(8 * F.size("q"))).first()[0] or 0
    parts = max(1, -(-total // limit))
    for k in range(parts):
        yield Anchors(anchors.where(F.pmod(F.xxhash64("id"), F.lit(parts)) == k).select("id", "label", "q", "scores").toArrow())


def _over(rows: DataFrame, anchors: DataFrame, limit: int, make, schema: str) -> DataFrame:
    out = None
    for part in _in_passes(anchors, limit):
        one = rows.mapInArrow(make(rows.sparkSession.sparkContext.broadcast(part)), schema)
        out = one if out is None else out.unionByName(one)
    return out


def mine(rows: DataFrame, anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, limit: int = BROADCAST_BYTES) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) from (id, label, q) of ``quantised``; ``anchor`` says which rows are anchors.

    All rows are scored against all anchors, a bounded part of the anchors at a time; a task sends on only what its windows may return. Sorted by packed
    keys, each anchor's positives open their windows before the negatives come by, so no anchor's rows are gathered. Vectors of another length than the
    anchor's are no partners of it. An anchor without positives, or a window without rows, gives nothing; so does an empty table. Scores must fit 64 bits."""
    rows = written(rows)
    anchors = rows.where(anchor)
    none = F.array().cast("array<long>")
    found = _over(rows, anchors.withColumn("scores", none), limit, lambda shared: _positives(shared, positives), "anchor_id long, score long, id long")
    in_order = F.row_number().over(Window.partitionBy("anchor_id").orderBy(F.desc("score"), "id"))
    found = written(found.withColumn("place", in_order).where(F.col("place") <= positives).drop("place"))
    scores = found.groupBy(F.col("anchor_id").alias("id")).agg(F.collect_list("score").alias("scores"))  # at most ``positives`` each
    keys = _over(rows, anchors.join(scores, "id"), limit, lambda shared: _pairs(shared, negatives, low, high), "key binary")
    keys = keys.unionByName(found.mapInArrow(_positive_keys, "key binary"))
    dealt = keys.repartition(F.substring("key", 1, 8)).sortWithinPartitions("key")
    return dealt.mapInArrow(_mined(negatives, low, high), "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
