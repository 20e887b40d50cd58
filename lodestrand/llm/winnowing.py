"""Document fingerprints by winnowing rolling k-gram hashes."""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .buffers import flat_utf8, mix, powers, sliding_min

BASE = 0x2545F4914F6CDD1D
INVERSE = pow(BASE, -1, 1 << 64)
#: Bytes of a k-gram and k-grams of a window: equal passages of K + WINDOW - 1 bytes share a fingerprint.
K, WINDOW = 20, 40
#: A k-gram's rolling hash is taken in stretches of so many bytes, to bound a long text's arrays.
STRETCH = 1 << 18
#: Bytes of text in a range of ids that ``with_next`` aims at, ranges for each shuffle partition at least, and ranges at most.
RANGE_BYTES, RANGES_EACH, MOST_RANGES = 16 << 20, 4, 20_000
_RISE, _FALL = powers(BASE, STRETCH + 4096), powers(INVERSE, STRETCH + 4096)


def kgram_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """64-bit hash of each k bytes of ``data``, rolling: differences of a running polynomial sum, brought to power 0."""
    n = len(data) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    parts = []
    for a in range(0, n, STRETCH):
        piece = data[a : min(a + STRETCH, n) + k - 1].astype(np.uint64) + np.uint64(1)
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(piece * _RISE[: len(piece)], dtype=np.uint64)))
        parts.append(mix((total[k:] - total[:-k]) * _FALL[: len(piece) - k + 1]))
    return parts[0] if len(parts) == 1 else np.concatenate(parts)


def winnow(data: np.ndarray, k: int = K, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, positions) chosen from one text: the least hash of each window of k-grams, the rightmost of equal ones, each position once.

    A text with fewer k-grams than a window is one window; one shorter than ``k`` is one k-gram; an empty one has none."""
    if len(data) == 0:
        return np.empty(0, np.uint32), np.empty(0, np.uint32)
    hashes = kgram_hashes(data, min(k, len(data)))
    positions = np.arange(len(hashes), dtype=np.uint64)
    keys = (hashes & np.uint64(0xFFFFFFFF00000000)) | (np.uint64(0xFFFFFFFF) - positions)
    least = sliding_min(keys, min(window, len(keys)))
    chosen = least[np.concatenate(([True], least[1:] != least[:-1]))]
    return (chosen >> np.uint64(32)).astype(np.uint32), (np.uint64(0xFFFFFFFF) - (chosen & np.uint64(0xFFFFFFFF))).astype(np.uint32)


def pack(hashes: np.ndarray, positions: np.ndarray) -> str:
    """Base64 of little-endian (hash, position) pairs of 32 bits each."""
    return base64.b64encode(np.column_stack((hashes, positions)).astype("<u4").tobytes()).decode()


def unpack(fingerprint: str) -> tuple[np.ndarray, np.ndarray]:
    pairs = np.frombuffer(base64.b64decode(fingerprint), "<u4").reshape(-1, 2)
    return pairs[:, 0], pairs[:, 1]


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two fingerprints' hash sets; of two empty ones 1."""
    a, b = np.unique(a), np.unique(b)
    if len(a) == 0 and len(b) == 0:
        return 1.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def fingerprint(texts: DataFrame, columns: list[str], k: int = K, window: int = WINDOW) -> DataFrame:
    """``texts`` with, for each text column c of ``columns``, a string column c_fingerprint, and for each c after the first a double
    c_likeness to the first. Map-only. A null text is an empty one; equal texts have equal fingerprints. The text columns are dropped."""
    kept = [c for c in texts.columns if c not in columns]
    added = [f"{c}_fingerprint string" for c in columns] + [f"{c}_likeness double" for c in columns[1:]]
    kinds = dict(texts.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in kept), *added])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                chosen = []
                for c in columns:
                    flat, ends = flat_utf8(part.column(c))
                    chosen.append([winnow(flat[a:b], k, window) for a, b in zip(ends[:-1], ends[1:], strict=True)])
                out = [part.column(c) for c in kept]
                out += [pa.array([pack(*x) for x in one], pa.string()) for one in chosen]
                out += [pa.array([likeness(x[0], y[0]) for x, y in zip(chosen[0], one, strict=True)], pa.float64()) for one in chosen[1:]]
                yield pa.RecordBatch.from_arrays(out, [*kept, *(x.split()[0] for x in added)])

    return texts.mapInArrow(run, schema)


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", parts: int | None = None) -> DataFrame:
    """(doc_id, text, next_text): each row with the text that follows in ascending id (null first, then text), the first after the last.

    Ids are cut into ranges at quantiles that are ids themselves; each range also gets the row that starts the next range, so no range waits
    for another and one shuffle of the texts does. The broadcast list has ``parts`` ids; by default there are as many ranges as the texts' bytes ask for,
    ``RANGES_EACH`` a shuffle partition at least, so that tasks are even. A range's rows are sorted with spill and read as a stream."""
    spark = docs.sparkSession
    lowest = -(1 << 63)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(id_col).cast("long"), F.lit(lowest)).alias("key"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    if parts is None:
        size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        parts = min(MOST_RANGES, max(RANGES_EACH * int(spark.conf.get("spark.sql.shuffle.partitions")), size // RANGE_BYTES + 1))
    shares = ", ".join(repr(i / parts) for i in range(1, parts)) or "0.5"
    found = rows.agg(F.min("key").alias("low"), F.expr(f"percentile_approx(key, array({shares}), {max(10000, 20 * parts)})").alias("cuts")).first()
    starts = sorted({found["low"], *(found["cuts"] or [])}) if found["low"] is not None else [lowest]
    sent = np.array(starts, np.int64)

    @F.pandas_udf("int")
    def range_of(key: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(sent, key.to_numpy(), "right") - 1).astype("int32")

    heads = spark.createDataFrame([(s, (i - 1) % len(starts)) for i, s in enumerate(starts)], "head long, before int")
    dealt = rows.withColumn("range", range_of("key")).join(F.broadcast(heads), F.col("key") == F.col("head"), "left")
    copies = F.array(F.struct(F.col("range"), F.lit(0).alias("tail")), F.struct(F.col("before").alias("range"), F.lit(1).alias("tail")))
    dealt = dealt.select("doc_id", "key", "text", F.explode(F.filter(copies, lambda c: c["range"].isNotNull())).alias("c")).select("doc_id", "key", "text", "c.range", "c.tail")
    order = Window.partitionBy("range").orderBy("tail", "key", "text")
    return dealt.withColumn("next_text", F.lead("text").over(order)).where("tail = 0").select("doc_id", "text", "next_text")
