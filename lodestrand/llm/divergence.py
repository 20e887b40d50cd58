"""How far the sources of a language stand apart: exact chi-square distances between their term distributions, and the terms that set each source off."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import transducer
from .buffers import LOWER, flat_utf8, slices, words_in
from .lineage import written

#: Bytes of terms: A-Z, a-z and all that isn't ASCII.
IN_TERM = np.zeros(256, bool)
IN_TERM[65:91] = IN_TERM[97:123] = IN_TERM[128:] = True
MIN_DOCS, TOP, SCALE = 3, 200, 1_000_000_000
#: Transducers that one pass over the texts may broadcast; larger vocabularies take several passes, each for its own prefixes.
BROADCAST_BYTES = 64 << 20
#: Cells (sources x ordinals) of a block of counts.
CELLS = 1 << 16


def _term_strings(flat: np.ndarray, first: np.ndarray, end: np.ndarray) -> pa.Array:
    size = end - first
    offsets = np.concatenate([[0], np.cumsum(size)])
    at = np.arange(offsets[-1]) + np.repeat(first - offsets[:-1], size)
    return pa.LargeStringArray.from_buffers(len(size), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(LOWER[flat[at]])).cast(pa.string())


def _codes(column: pa.Array) -> tuple[np.ndarray, list[str]]:
    coded = column.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary.to_pylist()


def _document_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, term, n_docs) of each slice of texts: in how many of its texts each term stands."""
    for batch in batches:
        lang, names = _codes(batch.column("lang"))
        flat, ends = flat_utf8(batch.column("text"))
        for row, _, part, part_ends in slices(flat, ends):
            text, first, end, hashes = words_in(part, part_ends, IN_TERM)
            if not len(text):
                continue
            order = np.lexsort((text, hashes, lang[row + text]))
            t, h, g = text[order], hashes[order], lang[row + text][order]
            new = np.ones(len(order), bool)
            new[1:] = (h[1:] != h[:-1]) | (g[1:] != g[:-1])
            once = new.copy()
            once[1:] |= t[1:] != t[:-1]
            heads = np.flatnonzero(new)
            n = np.add.reduceat(once.astype(np.int64), heads)
            held = order[heads]
            yield pa.RecordBatch.from_arrays([pa.array(names).take(pa.array(g[heads])).cast(pa.string()), _term_strings(part, first[held], end[held]), pa.array(n)], ["lang", "term", "n_docs"])


def _prefix(term: Column) -> Column:
    return F.substring(term.cast("binary"), 1, 2)


def kept_terms(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(lang, term, prefix) of the terms that stand in ``min_docs`` rows of a language or more. Within a slice of a megabyte, words are told apart by 64 bits of hash."""
    counted = docs.select("lang", "text").mapInArrow(_document_counts, "lang string, term string, n_docs long")
    kept = counted.groupBy("lang", "term").agg(F.sum("n_docs").alias("n")).where(F.col("n") >= min_docs)
    return written(kept.select("lang", "term", _prefix(F.col("term")).alias("prefix")))


def vocabulary(kept: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Transducers (lang, prefix, first, ...) and the terms with their ordinals (lang, ordinal, term): places in UTF-8 order among the language's terms.

    A group holds the terms of one prefix, never rows of the corpus."""
    sizes = kept.groupBy("lang", "prefix").agg(F.count("*").alias("n"))
    before = Window.partitionBy("lang").orderBy("prefix").rowsBetween(Window.unboundedPreceding, -1)
    firsts = written(sizes.select("lang", "prefix", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first")))

    def machine(terms: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([{"lang": terms["lang"].iloc[0], "prefix": terms["prefix"].iloc[0]} | transducer.build(sorted(t.encode() for t in terms["term"]))])

    built = kept.groupBy("lang", "prefix").applyInPandas(machine, "lang string, prefix binary, keys binary, targets binary, outs binary, finals binary")
    place = F.row_number().over(Window.partitionBy("lang", "prefix").orderBy("term")) - 1
    terms = kept.join(firsts, ["lang", "prefix"]).select("lang", (F.col("first") + place).alias("ordinal"), "term")
    return written(built.join(firsts, ["lang", "prefix"])), terms


def _passes(machines: DataFrame, limit: int) -> Iterator[list]:
    """The transducers in runs of at most ``limit`` bytes (one at least): what the driver holds and broadcasts at a time."""
    size = sum((F.octet_length(c) for c in ("keys", "targets", "outs", "finals")), F.lit(0))
    known = sorted((r.asDict() for r in machines.select("lang", "prefix", size.alias("size")).collect()), key=lambda r: (r["lang"], bytes(r["prefix"])))
    runs, total = [[]], 0
    for r in known:
        if runs[-1] and total + r["size"] > limit:
            runs, total = [*runs, []], 0
        runs[-1].append((r["lang"], bytes(r["prefix"])))
        total += r["size"]
    if len(runs) == 1:
        yield machines.collect() if runs[0] else []
        return
    for run in runs:
        low, high = (F.struct(F.lit(lang).alias("lang"), F.lit(bytearray(p)).alias("prefix")) for lang, p in (run[0], run[-1]))
        yield machines.where(F.struct("lang", "prefix").between(low, high)).collect()


_HELD: dict[int, transducer.Vocabulary] = {}


def _counter(shared):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if shared.value["id"] not in _HELD:
            _HELD.clear()
            _HELD[shared.value["id"]] = transducer.Vocabulary(shared.value["machines"])
        vocabulary = _HELD[shared.value["id"]]
        for batch in batches:
            group, names = _groups(batch)
            lang = np.array([vocabulary.langs.get(n[0], -1) for n in names], np.int64)
            flat, ends = flat_utf8(batch.column("text"))
            pairs, counts = [np.arange(len(names)) << 40], [np.zeros(len(names), np.int64)]
            for row, _, part, part_ends in slices(flat, ends):
                text, first, end = words_in(part, part_ends, IN_TERM)[:3]
                of = group[row + text]
                ordinal = vocabulary.ordinals(lang[of], part, first, end)
                known = ordinal >= 0
                pair, n = np.unique(of[known] << 40 | (ordinal[known] + 1), return_counts=True)
                pairs.append(pair)
                counts.append(n)
            pair, back = np.unique(np.concatenate(pairs), return_inverse=True)
            n = np.zeros(len(pair), np.int64)
            np.add.at(n, back, np.concatenate(counts))
            of = pair >> 40
            column = lambda k: pa.array([x[k] for x in names], pa.string()).take(pa.array(of))
            yield pa.RecordBatch.from_arrays([column(0), column(1), pa.array((pair & ((1 << 40) - 1)) - 1), pa.array(n)], ["lang", "source", "ordinal", "n"])

    return count


def _groups(batch: pa.RecordBatch) -> tuple[np.ndarray, list[tuple[str, str]]]:
    """The number of each row's (lang, source) among the batch's distinct ones."""
    lang, langs = _codes(batch.column("lang"))
    source, sources = _codes(batch.column("source"))
    pair, group = np.unique(lang * max(len(sources), 1) + source, return_inverse=True)
    return group, [(langs[p // len(sources)], sources[p % len(sources)]) for p in pair]


def recount(docs: DataFrame, machines: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """(lang, source, ordinal, n): occurrences of each kept term in each group; ordinal -1 stands once for every group, with or without terms."""
    spark: SparkSession = docs.sparkSession
    counts = None
    for k, run in enumerate(_passes(machines, limit)):
        shared = spark.sparkContext.broadcast({"id": id(run) ^ k, "machines": [{c: bytes(v) if isinstance(v, bytearray) else v for c, v in r.asDict().items()} for r in run]})
        one = docs.select("lang", "source", "text").mapInArrow(_counter(shared), "lang string, source string, ordinal long, n long")
        counts = one if counts is None else counts.unionByName(one)
    return written(counts.groupBy("lang", "source", "ordinal").agg(F.sum("n").alias("n")))


def _shares(counts: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """1 + floor(SCALE * (count + 1) / total), exact: in Python's integers where 64 bits don't hold the product."""
    if counts.size and int(counts.max()) + 1 >= (1 << 63) // SCALE:
        return np.array([[1 + SCALE * (int(c) + 1) // int(t) for c in row] for row, t in zip(counts, totals)], np.int64)
    return 1 + SCALE * (counts + 1) // totals[:, None]


def _compared(top: int, width: int):
    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        """Sums of a block of ordinals for each pair of sources, and the block's best terms of each source."""
        heads = rows[rows["ordinal"] < 0].sort_values("source")
        sources, v, base = heads["source"].to_numpy(), int(heads["v"].iloc[0]), int(heads["block"].iloc[0]) * width
        counts = np.zeros((len(sources), max(0, min(width, v - base))), np.int64)
        body = rows[rows["ordinal"] >= 0]
        counts[np.searchsorted(sources, body["source"].to_numpy()), body["ordinal"].to_numpy() - base] = body["n"].to_numpy()
        totals = heads["n"].to_numpy().astype(np.int64)
        p = _shares(counts, np.maximum(totals + v, 1))
        q = _shares(counts.sum(axis=0)[None], np.array([max(1, int(heads["lang_n"].iloc[0]) + v)]))[0]
        out = []
        for s, name in enumerate(sources):
            apart = p - p[s]
            sums = (apart * apart // p[s]).sum(axis=1)
            out += [(x, "pair", name, int(sums[k]), -1) for k, x in enumerate(sources) if k != s]
            gain = p[s] - q
            at = np.flatnonzero((counts[s] > 0) & (gain > 0))
            value = gain[at] * gain[at] // q[at]
            best = np.lexsort((at, -value))[:top]
            out += [(name, "term", None, int(value[k]), base + int(at[k])) for k in best]
        found = pd.DataFrame(out, columns=["source", "part", "item", "value", "ordinal"])
        found.insert(0, "lang", heads["lang"].iloc[0])
        return found

    return compare


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP, limit: int = BROADCAST_BYTES, cells: int = CELLS) -> DataFrame:
    """(lang, source, part, item, value, rank): each source against the others of its language (part ``pair``) and its most telling terms (``term``, to ``top``).

    Null text, lang and source are empty strings. A group without terms takes part, with counts of 0; a language without kept terms has pairs of value 0.
    Repeated rows count each. An empty table gives no rows; other columns are ignored. Texts of any length are read whole; they are cut into slices between rows only."""
    filled = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    machines, terms = vocabulary(kept_terms(filled, min_docs))
    counts = recount(filled, machines, limit)
    groups = counts.groupBy("lang", "source").agg(F.sum("n").alias("n"))
    size = terms.groupBy("lang").agg(F.count("*").alias("v"))
    langs = groups.groupBy("lang").agg(F.sum("n").alias("lang_n"), F.count("*").alias("n_groups")).join(size, "lang", "left").fillna(0, ["v"])
    width = max(1, cells // (langs.agg(F.max("n_groups")).first()[0] or 1))  # one width for all languages, so counts find their block without a join
    blocks = F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0), F.ceil(F.col("v") / width) - 1).cast("long"))
    heads = groups.join(langs, "lang").select("lang", F.explode(blocks).alias("block"), "source", F.lit(-1).cast("long").alias("ordinal"), "n", "v", "lang_n")
    none = F.lit(None).cast("long")
    body = counts.where("ordinal >= 0").select("lang", F.floor(F.col("ordinal") / width).alias("block"), "source", "ordinal", "n", none.alias("v"), none.alias("lang_n"))
    dealt = heads.unionByName(body)
    found = written(dealt.groupBy("lang", "block").applyInPandas(_compared(top, width), "lang string, source string, part string, item string, value long, ordinal long"))
    pairs = found.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    in_order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.withColumn("rank", F.row_number().over(in_order))
    best = found.where("part = 'term'").withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "ordinal"))).where(F.col("rank") <= top)
    named = best.drop("item").join(terms.withColumnRenamed("term", "item"), ["lang", "ordinal"])
    columns = ("lang", "source", "part", "item", "value", "rank")
    return pairs.select(*columns).unionByName(named.select(*columns))
