"""Byte-level BPE: encoding by batched numpy merge rounds, decoding, and a token counter with a two-tier lookup."""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .buffers import flat_utf8, slices
from .pretokens import boundaries, distinct

#: Distinct pre-tokens that a worker remembers; beyond it the cache starts anew.
CACHE_WORDS = 250_000
#: Words of the broadcast table at most, and the longest of them in bytes: longer words are rare and always misses.
FREQUENT, FREQUENT_BYTES = 4096, 64
_NEVER = np.int64(1 << 40)


def _visible_bytes() -> dict[str, int]:
    """The printable character that a vocabulary file writes for each byte: itself where printable, else the next from U+0100."""
    shown = {b: chr(b) for b in (*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100))}
    hidden = [b for b in range(256) if b not in shown]
    return {c: b for b, c in (shown | {b: chr(0x100 + i) for i, b in enumerate(hidden)}).items()}


def gathered(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The stretches of ``flat`` one after the other."""
    return flat[np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))]


class Vocabulary:
    """Tables of one byte-level BPE file: byte ids, sorted pair keys with rank and product, and the bytes of each id."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        vocab, byte_of = file["model"]["vocab"], _visible_bytes()
        self.special = {t["content"].encode(): t["id"] for t in file["added_tokens"]}
        pieces = [b""] * (max([*vocab.values(), *self.special.values()]) + 1)
        for token, i in vocab.items():
            pieces[i] = bytes(byte_of[c] for c in token) if token.encode() not in self.special else token.encode()
        for token, i in self.special.items():
            pieces[i] = token
        self.bytes_flat = np.frombuffer(b"".join(pieces), np.uint8)
        self.bytes_sizes = np.array([len(p) for p in pieces], np.int64)
        self.bytes_starts = np.cumsum(self.bytes_sizes) - self.bytes_sizes
        self.byte_ids = np.zeros(256, np.int64)
        for c, b in byte_of.items():
            self.byte_ids[b] = vocab[c]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in file["model"]["merges"]]
        keys = np.array([(vocab[a] << 32) | vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.product = np.array([vocab[a + b] for a, b in pairs], np.int64)[order]
        self.special_pattern = re.compile(b"|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None

    def _merges(self, symbols: np.ndarray, at: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, product) of the pairs that begin at ``at``; no pair crosses a word's end."""
        rank, product = np.full(len(at), _NEVER), np.zeros(len(at), np.int64)
        inner = np.flatnonzero(~last[at])
        if len(inner) and len(self.keys):
            keys = (symbols[at[inner]] << 32) | symbols[at[inner] + 1]
            found = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            known = self.keys[found] == keys
            rank[inner[known]], product[inner[known]] = self.ranks[found[known]], self.product[found[known]]
        return rank, product

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words one after the other, number of ids of each word).

        All words lie in one flat array of symbols. A round finds each word's lowest rank and merges all its pairs of that rank, left to
        right; pairs that a merge made are found by binary search in the sorted keys; words without a mergeable pair leave the array."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        symbols = self.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
        names = np.flatnonzero(lengths)
        sizes = lengths[names]
        last = np.zeros(len(symbols), bool)
        last[np.cumsum(sizes) - 1] = True
        rank, product = self._merges(symbols, np.arange(len(symbols)), last)
        ready: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # names, sizes, symbols of finished words
        while len(names):
            lowest = np.minimum.reduceat(rank, np.cumsum(sizes) - sizes)
            done = lowest == _NEVER
            if done.any():
                gone = np.repeat(done, sizes)
                ready.append((names[done], sizes[done], symbols[gone]))
                symbols, rank, product, last = symbols[~gone], rank[~gone], product[~gone], last[~gone]
                names, sizes, lowest = names[~done], sizes[~done], lowest[~done]
                if not len(names):
                    break
            word = np.repeat(np.arange(len(names)), sizes)
            chosen = np.flatnonzero(rank == lowest[word])
            first = np.concatenate(([True], np.diff(chosen) != 1))  # of overlapping pairs, such as in a row of equal symbols, every second one
            run = chosen[np.maximum.accumulate(np.where(first, np.arange(len(chosen)), 0))]
            chosen = chosen[(chosen - run) % 2 == 0]
            symbols[chosen] = product[chosen]
            last[chosen] = last[chosen + 1]
            sizes = sizes - np.bincount(word[chosen], minlength=len(names))
            keep = np.ones(len(symbols), bool)
            keep[chosen + 1] = False
            symbols, rank, product, last = symbols[keep], rank[keep], product[keep], last[keep]
            merged = chosen - np.arange(len(chosen))
            fresh = np.union1d(merged, merged[merged > 0] - 1)
            rank[fresh], product[fresh] = self._merges(symbols, fresh, last)
        counts = np.zeros(len(words), np.int64)
        if not ready:
            return np.empty(0, np.int32), counts
        names, sizes, symbols = (np.concatenate(x) for x in zip(*ready, strict=True))
        starts = np.cumsum(sizes) - sizes
        order = np.argsort(names)
        counts[names] = sizes
        return gathered(symbols, starts[order], sizes[order]).astype(np.int32), counts


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class WordCache:
    """Ids of the words that this worker met, in one flat array: at most ``limit`` words between two calls."""

    def __init__(self, vocab: Vocabulary, limit: int = CACHE_WORDS):
        self.vocab, self.limit = vocab, limit
        self._start_anew()

    def _start_anew(self) -> None:
        self.numbers = {w: k for k, w in enumerate(self.vocab.special)}
        self.ids = np.fromiter(self.vocab.special.values(), np.int32, len(self.vocab.special))
        self.sizes = np.ones(len(self.ids), np.int64)

    def look_up(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(starts, sizes) in ``ids`` of the words' ids."""
        if len(self.numbers) > self.limit:
            self._start_anew()
        new = [w for w in words if w not in self.numbers]
        if new:
            ids, sizes = self.vocab.encode_words(new)
            self.numbers.update(zip(new, range(len(self.numbers), len(self.numbers) + len(new)), strict=True))
            self.ids, self.sizes = np.concatenate((self.ids, ids)), np.concatenate((self.sizes, sizes))
        at = np.fromiter(map(self.numbers.__getitem__, words), np.int64, len(words))
        return (np.cumsum(self.sizes) - self.sizes)[at], self.sizes[at]


def encoded(flat: np.ndarray, ends: np.ndarray, cache: WordCache) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts, offsets of each text's ids): the distinct words are looked up once, their ids gathered."""
    starts = boundaries(flat, ends, cache.vocab.special_pattern)
    if not len(starts):
        return np.empty(0, np.int32), np.zeros(len(ends), np.int64)
    number, words = distinct(flat, starts)
    first, sizes = cache.look_up(words)
    total = np.concatenate((np.zeros(1, np.int64), np.cumsum(sizes[number])))
    return gathered(cache.ids, first[number], sizes[number]), total[np.searchsorted(starts, ends)]


def _id_lists(ids: np.ndarray, offsets: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids))


def decoded(ids: np.ndarray, offsets: np.ndarray, vocab: Vocabulary) -> pa.Array:
    """The texts of stretches of ``ids``: bytes joined and read as UTF-8, with U+FFFD for what is not."""
    sizes = vocab.bytes_sizes[ids]
    raw = gathered(vocab.bytes_flat, vocab.bytes_starts[ids], sizes).tobytes()
    cuts = np.concatenate((np.zeros(1, np.int64), np.cumsum(sizes)))[offsets].tolist()
    return pa.array([raw[a:b].decode("utf-8", "replace") for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.string())


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>): the ids of each whole text, special strings in it as their own id.

    A null or empty text has no ids; repeated rows give repeated rows; other columns are left out. Map-only."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordCache(vocabulary(path))
        for batch in batches:
            for a, b, flat, ends in slices(*flat_utf8(batch.column(1))):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), _id_lists(*encoded(flat, ends, cache))], ["doc_id", "ids"])

    return _rows(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>")


def decode(rows: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, ids, text): ids joined to bytes, read as UTF-8 with U+FFFD for what is not. Null ids give an empty text."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                ids = part.column(1)
                offsets = np.concatenate((np.zeros(1, np.int64), np.cumsum(ids.value_lengths().fill_null(0).to_numpy())))
                texts = decoded(ids.flatten().to_numpy(zero_copy_only=False).astype(np.int64), offsets, vocab)
                yield pa.RecordBatch.from_arrays([part.column(0), ids, texts], ["doc_id", "ids", "text"])

    return rows.select(F.col(id_col).alias("doc_id"), F.col(ids_col).alias("ids")).mapInArrow(run, "doc_id long, ids array<int>, text string")


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids, text): what ``decode`` makes of what ``encode`` gives, in one pass over the rows."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordCache(vocabulary(path))
        for batch in batches:
            for a, b, flat, ends in slices(*flat_utf8(batch.column(1))):
                ids, offsets = encoded(flat, ends, cache)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), _id_lists(ids, offsets), decoded(ids, offsets, cache.vocab)], ["doc_id", "ids", "text"])

    return _rows(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>, text string")


def frequent_words(docs: DataFrame, path: str, n: int = FREQUENT, text_col: str = "text") -> list[bytes]:
    """The pre-tokens of up to ``FREQUENT_BYTES`` bytes that occur most over all texts.

    Each task counts its own and sends its ``n`` most frequent; only such sums meet. A word that no task has among its own may be
    missing, which costs time, never a result."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        special = vocabulary(path).special_pattern
        total: dict[bytes, int] = {}

        def most(k: int) -> dict[bytes, int]:
            return dict(sorted(total.items(), key=lambda x: (-x[1], x[0]))[:k])

        for batch in batches:
            for _, _, flat, ends in slices(*flat_utf8(batch.column(0))):
                starts = boundaries(flat, ends, special)
                if not len(starts):
                    continue
                number, words = distinct(flat, starts)
                for w, k in zip(words, np.bincount(number).tolist(), strict=True):
                    if len(w) <= FREQUENT_BYTES:
                        total[w] = total.get(w, 0) + k
                if len(total) > CACHE_WORDS:
                    total = most(CACHE_WORDS // 2)
        top = most(n)
        yield pa.RecordBatch.from_arrays([pa.array(list(top), pa.binary()), pa.array(list(top.values()), pa.int64())], ["word", "n"])

    counted = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "word binary, n long")
    return [bytes(x["word"]) for x in counted.groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(n).collect()]  # n words


def count_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", frequent: int = FREQUENT, cache_words: int = CACHE_WORDS) -> DataFrame:
    """(doc_id, n_bytes, n_tokens) of each whole text; null counts as empty; repeated rows are counted each.

    The first tier is a broadcast table of at most ``frequent`` pre-tokens of up to ``FREQUENT_BYTES`` bytes with their token counts,
    whatever the corpus. A miss is encoded once and kept in this worker's second tier. No shuffle of pre-tokens."""
    vocab = vocabulary(path)
    words = frequent_words(docs, path, frequent, text_col)
    sizes = vocab.encode_words(words)[1]
    known = {w: 1 for w in vocab.special} | dict(zip(words, sizes.tolist(), strict=True))
    sent = docs.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, table = vocabulary(path), sent.value
        misses: dict[bytes, int] = {}
        for batch in batches:
            for a, b, flat, ends in slices(*flat_utf8(batch.column(1))):
                n = np.zeros(b - a, np.int64)
                starts = boundaries(flat, ends, vocab.special_pattern)
                if len(starts):
                    number, words = distinct(flat, starts)
                    if len(misses) > cache_words:
                        misses.clear()
                    new = [w for w in words if w not in table and w not in misses]
                    misses.update(zip(new, vocab.encode_words(new)[1].tolist(), strict=True))
                    lengths = np.fromiter((table.get(w) or misses[w] for w in words), np.int64, len(words))
                    total = np.concatenate((np.zeros(1, np.int64), np.cumsum(lengths[number])))
                    n = np.diff(total[np.searchsorted(starts, ends)])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(np.diff(ends)), pa.array(n)], ["doc_id", "n_bytes", "n_tokens"])

    return _rows(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")
