"""Main text of pages: what markup says is the article, and of the rest the runs of words that a host's pages don't repeat, found by suffix arrays of the host's pages."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import page_blocks
from .buffers import flat_utf8, mix, powers, words_in
from .lineage import written

#: Words of a repeat.
WORDS = 5
#: Characters of a host's pages that one suffix array takes; larger hosts are dealt over several, whose repeats meet by hash.
SHARD_CHARS = 1 << 19
#: Pages that hold a run before its share of the host's pages counts.
COMMON_PAGES = 3

_BLOCK = pa.struct([("no", pa.int32()), ("what", pa.int32()), ("path", pa.string()), ("text", pa.string())])
_IN_WORD = np.ones(256, bool)
_IN_WORD[32] = False
_PLACES = powers(0x9E6C63D0876A9A63, 64)


@F.arrow_udf(T.ArrayType(T.StructType().add("no", T.IntegerType()).add("what", T.IntegerType()).add("path", T.StringType()).add("text", T.StringType())))
def _blocks(html: pa.Array) -> pa.Array:
    rows = [[{"no": k, "what": b[0], "path": b[1], "text": b[2]} for k, b in enumerate(page_blocks.blocks(x or ""))] for x in html.to_pylist()]
    return pa.array(rows, pa.list_(_BLOCK))


class Streams:
    """The words of some pages of a host, one page after another."""

    def __init__(self, pages: pa.Table, words: int):
        blocks = pages.column("blocks").combine_chunks()
        if isinstance(blocks, pa.ChunkedArray):
            blocks = pa.concat_arrays(blocks.chunks)
        ends = blocks.offsets.to_numpy() - (blocks.offsets[0].as_py() if len(blocks.offsets) else 0)
        self.blocks = blocks.flatten()
        flat, text_ends = flat_utf8(self.blocks.field("text"))
        self.text, _, _, hashes = words_in(flat, text_ends, _IN_WORD)
        self.hashes = hashes.view(np.uint64)
        self.page_of_block = np.searchsorted(ends, np.arange(len(self.blocks)), "right") - 1
        page = self.page_of_block[self.text]
        self.words, n = words, max(0, len(page) - words + 1)
        #: First words of the windows that lie within a page, their pages, and their hashes.
        self.at = np.flatnonzero(page[:n] == page[len(page) - n :]) if n else np.empty(0, np.int64)
        self.page = page[self.at]

    def window_hashes(self) -> np.ndarray:
        total = np.zeros(len(self.at), np.uint64)
        for k in range(self.words):
            total += self.hashes[self.at + k] * _PLACES[k]
        return mix(total).view(np.int64)

    def suffix_array(self) -> tuple[np.ndarray, np.ndarray]:
        """(order, class): the windows' suffixes sorted to a depth of ``words``, and a number for each window that equal ones share. Ranks of k words
        pair up to ranks of 2k. A stretch that repeats is a union of repeated windows, so no deeper order is needed to find all of them."""
        rank = np.unique(self.hashes, return_inverse=True)[1]
        depth = 1
        while depth < self.words:
            step = min(depth, self.words - depth)
            pair = rank[: len(rank) - step] * (int(rank.max()) + 1) + rank[step:]
            rank, depth = np.unique(pair, return_inverse=True)[1], depth + step
        held = rank[self.at]
        return np.argsort(held, kind="stable"), held


def _repeats(words: int):
    def find(pages: pa.Table) -> pa.Table:
        """(host, shard, window, pages): each class of equal windows with the number of pages that hold it; those of one page only where other shards may hold it too."""
        streams = Streams(pages, words)
        names = ["host", "shard", "window", "pages"]
        host, shard, shards = (pages.column(c)[0].as_py() for c in ("host", "shard", "shards"))
        if len(streams.at):
            order, held = streams.suffix_array()
            pair = held[order] * (len(pages) + 1) + streams.page[order]
            first = np.ones(len(order), bool)
            first[1:] = held[order][1:] != held[order][:-1]
            other = np.ones(len(order), bool)
            other[1:] = pair[1:] != pair[:-1]
            heads = np.flatnonzero(first)
            n = np.add.reduceat(other.astype(np.int64), heads)
            sent = (n > 1) | (shards > 1)
            window, n = streams.window_hashes()[order[heads]][sent], n[sent]
        else:
            window = n = np.empty(0, np.int64)
        return pa.table([pa.array([host] * len(n), pa.string()), pa.array([shard] * len(n), pa.int64()), pa.array(window), pa.array(n)], names)

    return find


def _marks(words: int):
    def mark(pages: pa.Table, repeated: pa.Table) -> pa.Table:
        """(host, row, no, path, n, covered, common) of each block that markup leaves open: its words, those that repeats cover, those that common repeats cover."""
        streams = Streams(pages, words) if len(pages) else None
        names = ["host", "row", "no", "path", "n", "covered", "common"]
        types = [pa.string(), pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
        if streams is None or not len(streams.text):
            return pa.table([pa.array([], t) for t in types], names)
        known, n_pages = (repeated.column(c).to_numpy() for c in ("window", "pages"))
        order = np.argsort(known)
        known, n_pages = known[order], n_pages[order]
        windows = streams.window_hashes()
        found = np.minimum(np.searchsorted(known, windows), max(len(known) - 1, 0))
        hit = known[found] == windows if len(known) else np.zeros(len(windows), bool)
        common = hit.copy()
        if len(known):
            common &= (n_pages[found] >= COMMON_PAGES) & (2 * n_pages[found] >= pages.column("host_pages")[0].as_py())
        counts = []
        n_blocks = len(streams.blocks)
        for which in (hit, common):
            edge = np.zeros(len(streams.text) + 1, np.int64)
            np.add.at(edge, streams.at[which], 1)
            np.add.at(edge, streams.at[which] + words, -1)
            counts.append(np.bincount(streams.text, weights=np.cumsum(edge)[:-1] > 0, minlength=n_blocks).astype(np.int64))
        n = np.bincount(streams.text, minlength=n_blocks)
        open_ones = np.flatnonzero((streams.blocks.field("what").to_numpy() == page_blocks.OPEN) & (n > 0))
        at = pa.array(open_ones)
        rows = pages.column("row").combine_chunks().take(pa.array(streams.page_of_block[open_ones]))
        columns = [pa.array([pages.column("host")[0].as_py()] * len(open_ones), pa.string()), rows, streams.blocks.field("no").take(at), streams.blocks.field("path").take(at)]
        columns += [pa.array(x[open_ones]) for x in (n, *counts)]
        return pa.table([c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in columns], names)

    return mark


def repeated_blocks(pages: DataFrame, words: int = WORDS, shard_chars: int = SHARD_CHARS) -> DataFrame:
    """(row, dropped) from (row, host, blocks): the numbers of a page's open blocks that the host's pages repeat.

    A run of ``words`` words or more that stands on two pages of a host is a repeat. A block goes if repeats cover half of its words or more, and either
    they also cover half of the words of all the host's blocks at that path, so a copied article among articles of its own stays, or half of its words
    stand on at least half of the host's pages, and on three."""
    chars = F.aggregate("blocks", F.lit(0).cast("long"), lambda a, b: a + F.length(b["text"]))
    open_text = pages.select("row", "host", F.filter("blocks", lambda b: b["what"] != page_blocks.CONTENT).alias("blocks")).where(F.exists("blocks", lambda b: b["what"] == page_blocks.OPEN))
    hosts = open_text.groupBy("host").agg(F.sum(chars).alias("chars"), F.count("*").alias("host_pages"))
    shards = F.greatest(F.lit(1), F.ceil(F.col("chars") / shard_chars)).cast("long")
    dealt = open_text.join(hosts.select("host", "host_pages", shards.alias("shards")), "host")
    dealt = written(dealt.withColumn("shard", F.pmod(F.xxhash64("row"), F.col("shards"))))
    found = written(dealt.groupBy("host", "shard").applyInArrow(_repeats(words), "host string, shard long, window long, pages long"))
    totals = found.groupBy("host", "window").agg(F.sum("pages").alias("pages")).where("pages > 1")
    repeated = found.drop("pages").join(totals, ["host", "window"])
    schema = "host string, row long, no int, path string, n long, covered long, common long"
    marks = written(dealt.groupBy("host", "shard").cogroup(repeated.groupBy("host", "shard")).applyInArrow(_marks(words), schema))
    paths = marks.groupBy("host", "path").agg((2 * F.sum("covered") >= F.sum("n")).alias("template"))
    gone = (2 * F.col("covered") >= F.col("n")) & (F.col("template") | (2 * F.col("common") >= F.col("n")))
    return marks.join(paths, ["host", "path"]).where(gone).groupBy("row").agg(F.collect_list("no").alias("dropped"))


def main_text(pages: DataFrame, words: int = WORDS, shard_chars: int = SHARD_CHARS) -> DataFrame:
    """``page_id``, ``url`` and ``text`` of each row of pages: the blocks of the article, and the open blocks that aren't repeated, joined by line feeds.

    Blocks within article elements (main elements on pages without one) are the article's, whether other pages repeat them or not: copies stay whole. Menus,
    headers, footers, asides, forms, hidden elements and elements named as adverts, notices, comments or the like go. What markup leaves open is decided by
    ``repeated_blocks``. Null and empty html give an empty text; null ids, repeated ids and repeated rows are pages of their own; a null url is a host of its
    own; other columns are ignored; an empty table gives no rows. A page of any length is read whole, by one task."""
    host = F.lower(F.regexp_extract(F.coalesce(F.col("url").cast("string"), F.lit("")), "^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#]*)", 1))
    base = pages.select("page_id", "url", host.alias("host"), _blocks(F.col("html").cast("string")).alias("blocks"), F.monotonically_increasing_id().alias("row"))
    base = written(base)
    gone = repeated_blocks(base.select("row", "host", "blocks"), words, shard_chars)
    joined = base.join(gone, "row", "left")
    stays = F.filter("blocks", lambda b: (b["what"] == page_blocks.CONTENT) | (b["what"] == page_blocks.OPEN) & ~F.array_contains(F.coalesce("dropped", F.array().cast("array<int>")), b["no"]))
    return joined.select("page_id", "url", F.array_join(F.transform(stays, lambda b: b["text"]), "\n").alias("text"))
