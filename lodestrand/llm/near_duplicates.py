"""Near-duplicate documents by bottom-k sketches from one hash function."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .buffers import flat_utf8, mix, slices, words_in
from .components import components
from .lineage import cut

#: Retained values of a sketch, the longest inverted list whose members are all paired at once, and the leaders and lists by which longer ones are met first.
K, LIST, LEADERS, LISTS = 32, 16, 4, 4
#: Members of a long list on each side of a cell when what the leaders left apart is paired, values compared at once there, and the most values a member brings.
BLOCK, COLUMNS, WIDE = 1024, 2048, 2048
#: Rows up to which the names of wanted texts are broadcast; above, the texts are shuffled.
BROADCAST_ROWS = 200_000
LOWEST = -(1 << 63)
#: What names a shingle set, and copies of one from which it is a hot key.
SET, HOT_COPIES = ["set_a", "set_b", "n"], 1000
#: A pair goes on to the exact comparison if its estimate is at most so far below the threshold (four standard errors at K = 32).
SLACK = 0.25
#: The same for the wide sketches of sets of more than ``WIDE`` values.
WIDE_SLACK = 0.05
_IN_WORD = np.ones(256, bool)
_IN_WORD[[0x20, *range(0x09, 0x0E)]] = False
_ODD = np.array([0x9E3779B97F4A7C15 * (2 * i + 1) % (1 << 64) | 1 for i in range(64)], np.uint64)


def shingle_sets(flat: np.ndarray, ends: np.ndarray, words: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's shingles of ``words`` words; a text of fewer words is one shingle, one without words none."""
    text, _, _, hashes = words_in(flat, ends, _IN_WORD)
    hashes = hashes.view(np.uint64)
    cuts = np.searchsorted(text, np.arange(len(ends)))
    n = len(hashes)
    rolled = np.zeros(max(0, n - words + 1), np.uint64)
    for j in range(words):
        rolled += hashes[j : n - words + 1 + j] * _ODD[j]
    rolled = mix(rolled)
    out = []
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        if b - a >= words:
            out.append(np.unique(rolled[a : b - words + 1]))
        else:
            out.append(mix((hashes[a:b] * _ODD[: b - a]).sum(keepdims=True, dtype=np.uint64) + np.uint64(b - a)) if b > a else rolled[:0])
    return out


def set_digest(values: np.ndarray) -> tuple[int, int]:
    """The first 128 bits of the SHA-256 of a sorted set."""
    return tuple(np.frombuffer(hashlib.sha256(values).digest(), np.int64)[:2].tolist())


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))


def sketches(docs: DataFrame, words: int, k: int = K, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_hash, n, set_a, set_b, sketch): size, a digest in two halves and the ``k`` least values of each row's shingle set. Map-only."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, flat, ends in slices(*flat_utf8(batch.column(2))):
                sets = shingle_sets(flat, ends, words)
                low = [s[:k].view(np.int64) for s in sets]
                at = np.concatenate(([0], np.cumsum([len(x) for x in low]))).astype(np.int32)
                digests = [set_digest(s) for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, b - a),
                        batch.column(1).slice(a, b - a),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([x for x, _ in digests], pa.int64()),
                        pa.array([y for _, y in digests], pa.int64()),
                        pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(low) if low else np.empty(0, np.int64))),
                    ],
                    ["doc_id", "text_hash", "n", "set_a", "set_b", "sketch"],
                )

    return _keyed(docs, id_col, text_col).mapInArrow(run, "doc_id long, text_hash long, n long, set_a long, set_b long, sketch array<long>")


def wide_sets(texts: DataFrame, words: int) -> DataFrame:
    """(node, values): the whole shingle set of each text, or its ``WIDE`` least values."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, flat, ends in slices(*flat_utf8(batch.column(1))):
                low = [s[:WIDE].view(np.int64) for s in shingle_sets(flat, ends, words)]
                at = np.concatenate(([0], np.cumsum([len(x) for x in low]))).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(low)))], ["node", "values"])

    return texts.select("node", "text").mapInArrow(run, "node long, values array<long>")


def near_sizes(a: Column, b: Column, percent: int) -> Column:
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def needed(size: Column, least: float) -> Column:
    """How many values a sketch of ``size`` shares at least with any other for an estimate of ``least``: the union has no fewer values than either sketch's part."""
    return F.greatest(F.lit(1), F.ceil(size * least - 1e-9)).cast("int")


def rare_lists(reps: DataFrame, least: float) -> DataFrame:
    """(node, n, list, members): inverted lists of retained values in which any two nodes of ``reps`` (node, n, sketch) whose estimate is ``least`` or more meet.

    Two sketches that share c values share one among the (size - c + 1) first of each in any common order. The order is by how many sketches hold
    a value, rarest first, so a passage that many texts repeat makes a list only for texts of which it is most. Values of one sketch come first and make no list."""
    values = reps.select("node", "n", F.size("sketch").alias("size"), F.explode("sketch").alias("list"))
    held = values.groupBy("list").agg(F.count("*").alias("held")).where("held > 1")
    sorted_values = values.join(held, "list").groupBy("node", "n", "size").agg(F.array_sort(F.collect_list(F.struct("held", "list"))).alias("v"))
    first = F.col("size") - needed(F.col("size"), least) + 1 - (F.col("size") - F.size("v"))
    lists = cut(sorted_values.select("node", "n", F.explode(F.slice("v", F.lit(1), F.greatest(F.lit(0), first))).alias("x")).select("node", "n", F.col("x.list").alias("list")))
    return cut(lists.join(lists.groupBy("list").agg(F.count("*").alias("members")).where("members > 1"), "list").select("node", "n", "list", "members"))


def first_pairs(lists: DataFrame, percent: int) -> DataFrame:
    """(a, b), a < b, each once: all pairs of the lists of up to LIST nodes, and members of longer ones with the list's leaders.

    A leader is the node in the most long lists among those of one hash class, so a list's leaders come from partial maxima. They join a large group of near copies by few pairs; ``rest_pairs`` gives all others."""
    member = F.struct("node", "n")
    short = lists.where(F.col("members") <= LIST).groupBy("list").agg(F.collect_list(member).alias("m"))

    def partners(x: Column) -> Column:
        return F.transform(F.filter("m", lambda y: (y["node"] > x["node"]) & near_sizes(x["n"], y["n"], percent)), lambda y: F.struct(x["node"].alias("a"), y["node"].alias("b")))

    near = short.select(F.explode(F.flatten(F.transform("m", partners))).alias("p")).select("p.a", "p.b")
    long = lists.where(F.col("members") > LIST)
    taking = long.join(long.groupBy("node").agg(F.count("*").alias("shared")), "node")
    best = F.max(F.struct("shared", (-F.col("node")).alias("least"), "node", "n")).alias("best")
    leaders = taking.groupBy("list", F.pmod(F.xxhash64("node"), F.lit(LEADERS)).alias("class")).agg(best)
    leaders = leaders.select("list", F.col("best.node").alias("leader"), F.col("best.n").alias("leader_n"))
    few = taking.withColumn("r", F.row_number().over(Window.partitionBy("node").orderBy("list"))).where(F.col("r") <= LISTS)
    led = few.join(leaders, "list").where((F.col("node") != F.col("leader")) & near_sizes(F.col("n"), F.col("leader_n"), percent))
    led = led.select(F.least("node", "leader").alias("a"), F.greatest("node", "leader").alias("b"))
    return near.unionByName(led).distinct()


def mixed_lists(lists: DataFrame, found: DataFrame) -> DataFrame:
    """(list, node, n, part): members of long lists of which ``found`` (node, component) leaves some apart, every pair of a long list in one of them.

    Long lists with one centre - the member in most long lists, then the least - are taken together: the lists of a large group of near copies have
    one centre, so its members come once, not once a list. A node is in a few lists only, so few lists have one centre."""
    long = lists.where(F.col("members") > LIST).select("node", "n", "list")
    taking = long.join(long.groupBy("node").agg(F.count("*").alias("shared")), "node")
    centres = taking.groupBy("list").agg(F.max_by("node", F.struct("shared", -F.col("node"))).alias("centre"))
    parts = long.join(centres, "list").select(F.col("centre").alias("list"), "node", "n").distinct().join(found, "node", "left")
    parts = parts.select("list", "node", "n", F.coalesce("component", "node").alias("part"))
    apart = parts.groupBy("list").agg(F.min("part").alias("low"), F.max("part").alias("high")).where("low <> high").select("list")
    return cut(parts.join(apart, "list"))


def rest_links(mixed: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b, sure): links between the parts of each list of ``mixed``, decided on the values in ``sets`` (node, values).

    Only members outside a list's largest part need partners. They and the list's members are dealt to blocks, and each block of the one
    meets each of the other in a cell of its own, so a long list is many tasks' work and a cell's size is bounded. See ``cell_links``."""
    held = mixed.groupBy("list", "part").agg(F.count("*").alias("held"))
    main = held.groupBy("list").agg(F.max_by("part", F.struct("held", "part")).alias("main"), F.sum("held").alias("all"), F.max("held").alias("most"))
    blocks = main.select("list", "main", F.ceil((F.col("all") - F.col("most")) / BLOCK).cast("int").alias("rows"), F.ceil(F.col("all") / BLOCK).cast("int").alias("columns"))
    apart = mixed.join(blocks, "list").join(sets, "node")
    outside = F.col("part") != F.col("main")

    def dealt(rows: DataFrame, side: int, own: str, other: str) -> DataFrame:
        here, every = F.pmod(F.xxhash64("node", F.lit(side)), own).cast("int"), F.explode(F.sequence(F.lit(0), F.col(other) - 1))
        row, column = (here, every) if side == 0 else (every, here)
        return rows.select("list", row.alias("row"), column.alias("column"), F.lit(side).alias("side"), "node", "n", "part", outside.alias("outside"), "values")

    cells = dealt(apart.where(outside), 0, "rows", "columns").unionByName(dealt(apart, 1, "columns", "rows"))
    tasks = int(mixed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cells = cells.repartition(tasks, "list", "row", "column").sortWithinPartitions("list", "row", "column", "side")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell: list[pa.RecordBatch] = []
        name = None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.column_stack([batch.column(i).to_numpy() for i in range(3)])
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
            for x, y in zip(cuts[:-1], cuts[1:], strict=True):
                if cell and tuple(keys[x]) != name:
                    yield cell_links(cell, percent)
                    cell = []
                name = tuple(keys[x])
                cell.append(batch.slice(x, y - x))
        if cell:
            yield cell_links(cell, percent)

    return cells.mapInArrow(run, "a long, b long, sure boolean").distinct()


def _joined_parts(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(parts, the least part that each reaches) by the links ``a`` - ``b``."""
    names, both = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = both[: len(a)], both[len(a) :]
    least = np.arange(len(names))
    while True:
        low = np.minimum(least[x], least[y])
        now = least.copy()
        np.minimum.at(now, x, low)
        np.minimum.at(now, y, low)
        now = now[now]
        if (now == least).all():
            return names, names[least]
        least = now


def cell_links(cell: list[pa.RecordBatch], percent: int) -> pa.RecordBatch:
    """(a, b, sure) from the rows of a cell. Shared values of all pairs of different parts are counted by matrix products.

    Pairs of whole sets are decided here, and of the parts that they link a tree is left (sure). A pair with a set of more than ``WIDE`` values
    that may be a link by the estimate, and whose parts the tree doesn't join, is left for the exact comparison (not sure)."""
    rows = pa.Table.from_batches(cell).combine_chunks().to_batches()[0]
    side, node, n, part, outside = (rows.column(i).to_numpy(zero_copy_only=False) for i in range(3, 8))
    listed = rows.column(8)
    size = listed.value_lengths().to_numpy().astype(np.int64)
    owner, values = np.repeat(np.arange(len(size)), size), listed.flatten().to_numpy()
    left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    place = np.empty(len(side), np.int64)
    place[left], place[right] = np.arange(len(left)), np.arange(len(right))
    common = np.intersect1d(values[side[owner] == 0], values[side[owner] == 1])
    at = np.minimum(np.searchsorted(common, values), max(len(common) - 1, 0))
    held = np.flatnonzero(common[at] == values) if len(common) else np.empty(0, np.int64)
    owner, at = owner[held], at[held]
    shared = np.zeros((len(left), len(right)), np.float32)
    for low in range(0, len(common), COLUMNS):
        here = (at >= low) & (at < low + COLUMNS)
        tables = []
        for which, count in ((0, len(left)), (1, len(right))):
            mine = here & (side[owner] == which)
            table = np.zeros((count, COLUMNS), np.float32)
            table[place[owner[mine]], at[mine] - low] = 1
            tables.append(table)
        shared += tables[0] @ tables[1].T
    least = percent / 100 - WIDE_SLACK
    i, j = np.nonzero(shared >= least * np.maximum(size[left][:, None], size[right][None, :]))
    both = shared[i, j].astype(np.int64)
    i, j = left[i], right[j]
    fits = (part[i] != part[j]) & (~outside[j].astype(bool) | (node[i] < node[j])) & (100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j]))
    i, j, both = i[fits], j[fits], both[fits]
    whole = (size[i] == n[i]) & (size[j] == n[j])
    link = whole & (100 * both >= percent * (n[i] + n[j] - both))
    parts, least_part = _joined_parts(part[i[link]], part[j[link]])
    tree = parts != least_part

    def class_of(x: np.ndarray) -> np.ndarray:
        if not len(parts):
            return x
        found = np.minimum(np.searchsorted(parts, x), len(parts) - 1)
        return np.where(parts[found] == x, least_part[found], x)

    maybe = ~whole & (class_of(part[i]) != class_of(part[j]))
    i, j = i[maybe], j[maybe]
    a = np.concatenate((least_part[tree], np.minimum(node[i], node[j])))
    b = np.concatenate((parts[tree], np.maximum(node[i], node[j])))
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(np.arange(len(a)) < tree.sum())], ["a", "b", "sure"])


def alike(least: float, k: int = K) -> Column:
    """Whether the union sketch of x and y puts their similarity at ``least`` or more: of the values up to the lesser of both sketches' ends, the share in both."""
    far = F.lit((1 << 63) - 1)
    # Sketches are in the order of unsigned values.
    flip = F.lit(-(1 << 63))

    def end(s: str) -> Column:
        return F.when(F.size(s) < k, far).otherwise(F.element_at(s, -1).bitwiseXOR(flip))

    bound = F.least(end("x"), end("y"))

    def within(s: Column) -> Column:
        return F.size(F.filter(s, lambda v: v.bitwiseXOR(flip) <= bound))

    both = F.array_intersect("x", "y")
    # The first condition follows from the second and is cheap.
    return (F.size(both) >= needed(F.greatest(F.size("x"), F.size("y")), least)) & (within(both) >= least * (within(F.col("x")) + within(F.col("y")) - within(both)))


def estimated(pairs: DataFrame, reps: DataFrame, least: float, k: int = K) -> DataFrame:
    """The pairs that are ``alike``."""
    a = reps.select(F.col("node").alias("a"), F.col("sketch").alias("x"))
    b = reps.select(F.col("node").alias("b"), F.col("sketch").alias("y"))
    return pairs.join(a, "a").join(b, "b").where(alike(least, k)).select("a", "b")


def confirmed(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs whose whole shingle sets have 100 * intersection >= percent * union; ``texts`` is (node, text)."""
    a = texts.select(F.col("node").alias("a"), F.col("text").alias("x"))
    b = texts.select(F.col("node").alias("b"), F.col("text").alias("y"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                left, right = (shingle_sets(*flat_utf8(part.column(i)), words) for i in (2, 3))
                common = np.array([len(np.intersect1d(x, y, assume_unique=True)) for x, y in zip(left, right, strict=True)], np.int64)
                union = np.array([len(x) + len(y) for x, y in zip(left, right, strict=True)], np.int64) - common
                yield part.select(["a", "b"]).filter(pa.array((100 * common >= percent * union) & (union > 0)))

    return pairs.join(a, "a").join(b, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def classes(docs: DataFrame, words: int = 5, percent: int = 80, k: int = K, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_hash, n_shingles, component_id, leading): near-duplicate classes of whole texts over distinct shingles of ``words`` lower-cased words.

    Rows with equal sets (by a SHA-256 of the whole set) are one node, so copies make no pairs. component_id is the least doc_id reachable by links of
    ``percent`` or more. ``leading`` names one row of each class, of the least doc_id. Texts without words, null ones too, are linked with nothing and
    lead. Rows are told apart by number, so equal ids with different texts are different rows, and rows with a null id take part: their
    component_id is null where no row of the class has an id. An empty table gives an empty result; other columns are left out."""
    rows = cut(sketches(docs, words, k, id_col, text_col).withColumn("row", F.monotonically_increasing_id()))
    linked = rows.where("n > 0")
    of_node = F.min(F.struct("row", "doc_id", "text_hash")).alias("first")
    lead = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")).alias("lead")
    same = linked.groupBy(*SET).agg(of_node, lead, F.count("*").alias("copies"))
    same = cut(same.select(*SET, F.col("first.row").alias("node"), F.col("first.doc_id").alias("doc_id"), F.col("first.text_hash").alias("text_hash"), "lead", "copies"))
    nodes = same.select("node", "doc_id", "text_hash", "lead")
    reps = linked.join(nodes.select(F.col("node").alias("row")), "row", "left_semi").select(F.col("row").alias("node"), "n", "sketch")
    lowest = percent / 100 - SLACK
    lists = rare_lists(reps, lowest)
    pairs = cut(estimated(first_pairs(lists, percent), reps, lowest, k))

    def key() -> Column:
        return F.coalesce("doc_id", F.lit(LOWEST)).alias("key")

    def texts_of(some: DataFrame) -> DataFrame:
        """(node, text) of the nodes in ``some``."""
        wanted = cut(nodes.join(some, "node", "left_semi").select("node", key(), "text_hash"))
        if wanted.count() <= BROADCAST_ROWS:
            wanted = F.broadcast(wanted)
        texts = _keyed(docs, id_col, text_col).select(key(), "text_hash", "text").join(wanted, ["key", "text_hash"]).select("node", "text")
        return cut(texts.dropDuplicates(["node"]))

    links = cut(confirmed(pairs, texts_of(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()), words, percent))
    found = components(links)
    mixed = mixed_lists(lists, found)
    if not mixed.isEmpty():
        texts = texts_of(mixed.select("node").distinct())
        rest = cut(rest_links(mixed, wide_sets(texts, words), percent))
        maybe = rest.where("not sure").select("a", "b")
        found = components(links.unionByName(rest.where("sure").select("a", "b")).unionByName(confirmed(maybe, texts, words, percent)))
    named = found.join(nodes.select("node", "lead"), "node")
    moved = named.select("node", "component").join(named.groupBy("component").agg(F.min("lead").alias("class_lead")), "component").select("node", "class_lead")
    led = cut(same.join(moved, "node", "left").select(*SET, F.coalesce("class_lead", "lead").alias("lead"), "copies"))
    out = of_sets(linked.select("row", "doc_id", "text_hash", *SET), led)
    out = out.select("doc_id", "text_hash", F.col("n").alias("n_shingles"), F.col("lead.doc_id").alias("component_id"), (F.col("lead.row") == F.col("row")).alias("leading"))
    return out.unionByName(rows.where("n = 0").select("doc_id", "text_hash", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(True).alias("leading")))


def of_sets(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """``rows`` with the columns of their set in ``sets``. Sets of very many copies are few and are broadcast, so that no task gets all rows of one."""
    hot = sets.where(F.col("copies") >= HOT_COPIES)
    n = hot.limit(BROADCAST_ROWS + 1).count()
    if not 0 < n <= BROADCAST_ROWS:
        return rows.join(sets, SET)
    many = rows.join(F.broadcast(hot), SET)
    few = rows.join(F.broadcast(hot.select(*SET)), SET, "left_anti").join(sets.where(F.col("copies") < HOT_COPIES), SET)
    return many.unionByName(few)
