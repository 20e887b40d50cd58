"""Toxicity scores from non-negative positive-unlabelled classifiers over a vocabulary of words and word heads."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import pu
from .lineage import cut

#: Terms of the model at most, the least share of the positives that must hold a term, and the least gap between the shares in standard errors.
VOCABULARY, LEAST_SHARE, LEAST_GAP = 512, 0.01, 4.0
THRESHOLD = 0.3
#: Heads of so many letters stand for the longer words that begin with them. Chosen, as are the rules above, by three folds of the trainable rows of sf0.1.
HEADS = (7,)
_WORD = re.compile(r"[^\W\d_]+")


def terms_in(text: str) -> set[str]:
    """The words; as head* the heads of longer words; as head** those that two or more different words begin with."""
    words = set(_WORD.findall(text.lower()))
    out = set(words)
    for n in HEADS:
        heads = Counter(w[:n] for w in words if len(w) > n)
        out.update(h + "*" for h in heads)
        out.update(h + "**" for h, k in heads.items() if k > 1)
    return out


def family_in(text: str) -> int:
    """A min-hash of the runs of four words (of all words, if there are fewer): most near copies of a text share it, other texts don't."""
    words = _WORD.findall(text.lower())
    return min(zlib.crc32(" ".join(words[k : k + 4]).encode()) for k in range(max(1, len(words) - 3)))


def with_terms(rows: DataFrame, text_col: str = "text") -> DataFrame:
    """``rows`` with the ``family`` and the ``terms`` of the text in place of it."""
    kept = [c for c in rows.columns if c != text_col]
    kinds = dict(rows.dtypes)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [t or "" for t in part.column(len(kept)).to_pylist()]
                family, terms = pa.array(list(map(family_in, texts)), pa.int64()), pa.array([sorted(terms_in(t)) for t in texts], pa.list_(pa.string()))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], family, terms], [*kept, "family", "terms"])

    return rows.select(*kept, text_col).mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in kept), "family long", "terms array<string>"]))


def numbered(rows: DataFrame, words: list[str]) -> DataFrame:
    """``rows`` with the numbers of those ``terms`` that are among ``words``: an array in each row, so nothing is joined."""
    sent = rows.sparkSession.sparkContext.broadcast({w: i for i, w in enumerate(words)})
    kept = [c for c in rows.columns if c != "terms"]
    kinds = dict(rows.dtypes)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = sent.value
        for batch in batches:
            found = [[number[w] for w in terms.as_py() if w in number] for terms in batch.column(len(kept))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, pa.list_(pa.int32()))], [*kept, "numbers"])

    return rows.select(*kept, "terms").mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in kept), "numbers array<int>"]))


def train(docs: DataFrame, labels: DataFrame, trainable: Column, label_col: str = "toxic", vocabulary: int = VOCABULARY) -> tuple[list[str], list[pu.Linear]]:
    """(terms, classifiers). Terms are those whose presence differs most, in standard errors, between positives and unlabelled rows.

    In choosing words, a family of near copies counts once, so that no word stands for one often copied text. One rule holds at every size: a term
    is in ``LEAST_SHARE`` of the positive families and ``LEAST_GAP`` standard errors off. Only ``vocabulary`` words and, for each sampled row, the numbers
    of its terms reach the driver. Without a positive row there are no classifiers."""
    sample, prior = pu.training_sample(docs, labels, label_col, trainable)
    held = cut(with_terms(sample.select("positive", "unlabelled", "text")))
    one = F.col("positive").cast("int").alias("p"), F.col("unlabelled").cast("int").alias("u")
    n = held.groupBy("family").agg(*(F.max(c).alias(k) for c, k in zip(one, "pu", strict=True))).agg(*(F.coalesce(F.sum(k), F.lit(0)).alias(k) for k in "pu")).first()
    if not n["p"] or not n["u"]:
        return [], []
    by_text = held.select("family", *one, F.explode("terms").alias("word")).groupBy("family", "word").agg(F.max("p").alias("p"), F.max("u").alias("u"))
    share_p, share_u = F.sum("p") / n["p"], F.sum("u") / n["u"]
    pooled = (F.sum("p") + F.sum("u")) / (n["p"] + n["u"])
    gap = F.abs(share_p - share_u) / F.sqrt(pooled * (1 - pooled) * (1 / n["p"] + 1 / n["u"]) + F.lit(1e-12))
    fits = (F.col("held") >= LEAST_SHARE * n["p"]) & (F.col("gap") >= LEAST_GAP)
    best = by_text.groupBy("word").agg(F.sum("p").alias("held"), gap.alias("gap")).where(fits).orderBy(F.desc("gap"), "word").limit(vocabulary)
    words = [x["word"] for x in best.collect()]
    rows = numbered(held.select(*one, "terms"), words).collect()  # within the sample's bound

    def flat(kind: str) -> tuple[np.ndarray, np.ndarray, int]:
        found = [x["numbers"] for x in rows if x[kind]]
        return np.repeat(np.arange(len(found)), [len(x) for x in found]).astype(np.int64), np.array([i for x in found for i in x], np.int64), len(found)

    return words, pu.fit_bag(flat("p"), flat("u"), len(words), prior)


def score(docs: DataFrame, model: tuple[list[str], list[pu.Linear]], id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, score, and the columns ``carry``) of each whole text, map-only. Null and empty texts hold no word and get the classifiers' base score; without classifiers 0.

    Repeated rows are scored each; columns that aren't carried are left out. The broadcast model has ``VOCABULARY`` words at most."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, bag = sent.value
        number = {w: i for i, w in enumerate(words)}
        known = number.keys()
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                row: list[int] = []
                feature: list[int] = []
                for k, text in enumerate(part.column(1)):
                    hits = known & terms_in(text.as_py() or "")
                    row += [k] * len(hits)
                    feature += [number[w] for w in hits]
                n = part.num_rows
                scores = pu.mean_scores(bag, np.array(row, np.int64), np.array(feature, np.int64), n) if bag else np.zeros(n)
                columns = dict(zip(others, part.columns[2:], strict=True)) | {text_col: part.column(1)}
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(scores, pa.float64()), *(columns[c] for c in carry)], ["doc_id", "score", *carry])

    kinds = dict(docs.dtypes) | {text_col: "string"}
    others = [c for c in carry if c != text_col]
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("_text"), *others)
    return rows.mapInArrow(run, ", ".join(["doc_id long", "score double", *(f"`{c}` {kinds[c]}" for c in carry)]))
