"""Quality scores from non-negative positive-unlabelled classifiers over binned measures of a text."""

from __future__ import annotations

import operator
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import pu
from .buffers import flat_utf8

THRESHOLD = 0.3
BINS = 12
MEASURES = ("log_bytes", "upper", "symbols", "exclaims", "pipes", "stops", "digits", "other", "lines", "word_length", "distinct_words", "repeats", "marked_words")
#: Class of each byte: 1 lower case or beyond ASCII, 2 upper case, 3 symbols, 4 "!", 5 "|", 6 stops, 7 digits, 8 line feed, 9 other white space, 0 the rest.
_CLASS = np.zeros(256, np.uint8)
_CLASS[0x80:] = 1
for _kind, _chars in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"#$%&*@^~=+<>\\_{}", b"!", b"|", b".,;:?", b"0123456789", b"\n", b" \t\r\v\f"), 1):
    _CLASS[list(_chars)] = _kind


def measures(column: pa.Array) -> np.ndarray:
    """A row of ``MEASURES`` for each text; an empty text has zeros."""
    flat, ends = flat_utf8(column)
    n = len(column)
    kinds = _CLASS[flat]
    counts = np.zeros((n, 10))
    for k, (a, b) in enumerate(zip(ends[:-1], ends[1:], strict=True)):
        counts[k] = np.bincount(kinds[a:b], minlength=10)
    size = np.maximum(np.diff(ends), 1)
    letters = np.maximum(counts[:, 1] + counts[:, 2], 1)
    out = np.zeros((n, len(MEASURES)))
    out[:, 0] = np.log1p(np.diff(ends))
    out[:, 1] = counts[:, 2] / letters
    for at, kind in ((2, 3), (3, 4), (4, 5), (5, 6), (6, 7), (7, 0), (8, 8)):
        out[:, at] = counts[:, kind] / size
    for k, text in enumerate(column):
        words = (text.as_py() or "").split()
        if words:
            out[k, 9] = counts[k, 1:3].sum() / len(words)
            out[k, 10] = len(set(words)) / len(words)
            out[k, 11] = sum(map(operator.eq, words, words[1:])) / len(words)
            out[k, 12] = (counts[k, 3:6].sum()) / len(words)
    return out


def active(values: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature): for each measure the number of the bin that holds it."""
    n, m = values.shape
    bins = np.stack([np.searchsorted(edges[j], values[:, j], "right") for j in range(m)], axis=1) + np.arange(m) * (edges.shape[1] + 1)
    return np.repeat(np.arange(n), m), bins.ravel()


def _measured(docs: DataFrame, kept: list[str]) -> DataFrame:
    kinds = dict(docs.dtypes)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = measures(batch.column("text"))
            rows = pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1, dtype=np.int32) * len(MEASURES)), pa.array(found.ravel()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), rows], [*kept, "measures"])

    return docs.select(*kept, "text").mapInArrow(run, ", ".join([*(f"{c} {kinds[c]}" for c in kept), "measures array<double>"]))


def train(docs: DataFrame, labels: DataFrame, trainable: Column, label_col: str = "quality") -> tuple[np.ndarray, list[pu.Linear]]:
    """(bin edges, classifiers). Only labels of 1 are used: the class prior is estimated from positive and unlabelled rows. Edges are quantiles of the unlabelled sample; an edge that repeats leaves a bin empty.

    What reaches the driver is ``len(MEASURES)`` numbers for each sampled row. Without a positive row there are no classifiers."""
    sample, _ = pu.training_sample(docs, labels, label_col, trainable)
    rows = _measured(sample, ["positive", "unlabelled"]).toPandas()  # within the sample's bound
    values = np.stack(rows["measures"].to_numpy()) if len(rows) else np.zeros((0, len(MEASURES)))
    p, u = values[rows["positive"].to_numpy(bool)], values[rows["unlabelled"].to_numpy(bool)]
    if not len(p) or not len(u):
        return np.zeros((len(MEASURES), 1)), []
    # Rare extremes get bins of their own: quantiles are dense at both ends.
    shares = np.concatenate(([0.01, 0.03], np.linspace(0, 1, BINS + 1)[1:-1], [0.95, 0.97, 0.99]))
    edges = np.quantile(u, np.sort(shares), axis=0).T + 1e-12
    features = len(MEASURES) * (edges.shape[1] + 1)
    positives, unlabelled = (*active(p, edges), len(p)), (*active(u, edges), len(u))
    prior = pu.estimated_prior(positives, unlabelled, features)
    return edges, pu.fit_bag(positives, unlabelled, features, prior, epochs=800, rate=0.3, decay=3e-6)


def score(docs: DataFrame, model: tuple[np.ndarray, list[pu.Linear]], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) of each whole text, map-only. Null is an empty text, whose measures are all 0; without classifiers every score is 0.5.

    Repeated rows are scored each; other columns are left out. The broadcast model has a fixed size."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges, bag = sent.value
        for batch in batches:
            n = batch.num_rows
            scores = pu.mean_scores(bag, *active(measures(batch.column(1)), edges), n) if bag else np.full(n, 0.5)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], ["doc_id", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")
