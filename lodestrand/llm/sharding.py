"""Resharding by minimum-cost flow: the fewest bytes move, and only shards that change are written."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import cut

#: Blocks that each old shard is dealt into at least, and rows of a block aimed at; block sums, not documents, meet in the running totals.
BLOCKS, BLOCK_ROWS = 1024, 100_000
#: Names of repeated rows up to which they are broadcast.
BROADCAST_ROWS = 200_000

LOWEST = -(1 << 63)


def min_cost_flow(supply: list[int], capacity: list[int], cost: list[list[int]]) -> list[list[int]]:
    """Flow from sources to sinks of least cost, by shortest augmenting paths. Ties go to the lower source, then sink.

    The graph has a node for each shard, never for a document. The capacities must hold the supply."""
    if sum(supply) > sum(capacity):
        raise ValueError("the new shards are too small")
    n, m = len(supply), len(capacity)
    flow = [[0] * m for _ in range(n)]
    left, room = list(supply), list(capacity)
    far = float("inf")
    while any(left):
        to_source = [0 if s else far for s in left]
        to_sink = [far] * m
        before_source: list[int | None] = [None] * n
        before_sink: list[int | None] = [None] * m
        changed = True
        while changed:  # Bellman-Ford, with backward edges where flow runs
            changed = False
            for i in range(n):
                for j in range(m):
                    if to_source[i] + cost[i][j] < to_sink[j]:
                        to_sink[j], before_sink[j], changed = to_source[i] + cost[i][j], i, True
                    if flow[i][j] and to_sink[j] - cost[i][j] < to_source[i]:
                        to_source[i], before_source[i], changed = to_sink[j] - cost[i][j], j, True
        sink = min((j for j in range(m) if room[j]), key=lambda j: (to_sink[j], before_sink[j], j))
        path, j = [], sink
        while True:
            i = before_sink[j]
            path.append((i, j, 1))
            if before_source[i] is None:
                break
            j = before_source[i]
            path.append((i, j, -1))
        amount = min([left[i], room[sink], *(flow[a][b] for a, b, sign in path if sign < 0)])
        for a, b, sign in path:
            flow[a][b] += sign * amount
        left[i] -= amount
        room[sink] -= amount
    return flow


def equal_capacities(total: int, shards: int) -> list[int]:
    return [total // shards + (j < total % shards) for j in range(shards)]


def reshard(docs: DataFrame, old_shard: Column, shards: int = 8, law: str = "bytes", capacities: list[int] | None = None, id_col: str = "doc_id", text_col: str = "text", blocks: int | None = None) -> DataFrame:
    """(doc_id, size, text_crc32, law, old_shard, shard, slot): where each row goes and its place there.

    ``old_shard`` gives the present shard, any number (null: 0); the new ones are 0 to ``shards`` - 1, be they more or fewer than the old. ``law`` says what
    is evened out: ``bytes`` (UTF-8 bytes of the text plus 1) or ``rows``. Flows between shards come from ``min_cost_flow`` with cost 1 for what moves and 0 for what stays.
    Each old shard is laid out in a fixed order (block, id); a row goes to the flow in whose stretch its middle lies, so a shard is off its
    capacity by a row's size for each stretch at most (by ``rows``: exactly as planned). Null texts have size 1; repeated rows are placed each;
    an empty table gives an empty plan; other columns are ignored. Only ids, sizes and checksums are shuffled."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    size = F.octet_length(text).cast("long") + 1
    rows = cut(
        docs.select(
            F.col(id_col).cast("long").alias("doc_id"),
            size.alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            (size if law == "bytes" else F.lit(1).cast("long")).alias("weight"),
            F.coalesce(old_shard.cast("int"), F.lit(0)).alias("old_shard"),
            F.xxhash64(F.col(id_col), text).alias("hash"),
        )
    )
    totals = rows.groupBy("old_shard").agg(F.sum("weight").alias("weight"), F.count("*").alias("n")).orderBy("old_shard").collect()  # a row for each shard
    blocks = blocks or max(BLOCKS, max((x["n"] for x in totals), default=0) // BLOCK_ROWS + 1)
    rows = rows.withColumn("block", F.pmod("hash", F.lit(blocks)).cast("int")).drop("hash")
    sums = rows.groupBy("old_shard", "block").agg(F.sum("weight").alias("weight"))
    olds, supply = [x["old_shard"] for x in totals], [x["weight"] for x in totals]
    capacities = capacities or equal_capacities(sum(supply), shards)
    flow = min_cost_flow(supply, capacities, [[int(i != j) for j in range(len(capacities))] for i in olds])
    stretches = []
    for old, sent in zip(olds, flow, strict=True):
        at = 0
        for j in sorted(range(len(sent)), key=lambda j: (j != old, j)):
            if sent[j]:
                stretches.append((old, 2 * at, 2 * (at + sent[j]), j))
                at += sent[j]
    plan = docs.sparkSession.createDataFrame(stretches or [(0, 0, 1, 0)], "old_shard int, low long, high long, shard int")
    first = Window.partitionBy("old_shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("old_shard", "block", F.coalesce(F.sum("weight").over(first), F.lit(0)).alias("start"))
    inside = Window.partitionBy("old_shard", "block").orderBy("doc_id", "text_crc32", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = (
        rows.join(starts, ["old_shard", "block"])
        .withColumn("middle", 2 * (F.col("start") + F.coalesce(F.sum("weight").over(inside), F.lit(0))) + F.col("weight"))
        .join(F.broadcast(plan), "old_shard")  # a stretch for each pair of shards at most
        .where("middle >= low and middle < high")
    )
    placed = cut(placed.select("doc_id", "size", "text_crc32", "old_shard", "block", "shard"))
    counts = placed.groupBy("shard", "old_shard", "block").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("shard").orderBy("old_shard", "block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "old_shard", "block", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("offset"))
    here = Window.partitionBy("shard", "old_shard", "block").orderBy("doc_id", "text_crc32", "size")
    return placed.join(offsets, ["shard", "old_shard", "block"]).select(
        "doc_id", "size", "text_crc32", F.lit(law).alias("law"), "old_shard", "shard", (F.col("offset") + F.row_number().over(here) - 1).alias("slot")
    )


def rewrite_affected(docs: DataFrame, placed: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> list[int]:
    """Writes the shards that gain or lose rows under ``path`` as shard=N folders, and returns their numbers; others keep their files.

    ``placed`` is what ``reshard`` returned for ``docs``. A row finds its place by id (null ids too), checksum and size; rows that agree in all
    three take their places in the order of their texts' digests and other columns, each its own; only they are numbered, so other rows are shuffled once. Columns of
    ``docs`` named shard or slot are written as shard_before and slot_before (with one more _before where these are taken). Old
    shards that the new ones lack are among the numbers and have no rows. The write replaces only the folders that it makes."""
    moved = placed.where("shard <> old_shard")
    affected = sorted({x[0] for x in moved.select(F.explode(F.array("shard", "old_shard"))).distinct().collect()})  # shards, not rows
    if not affected:
        return []
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    taken = {c.lower() for c in docs.columns} | {"shard", "slot"}

    def free(name: str, more: str) -> str:
        while name.lower() in taken:
            name += more
        taken.add(name.lower())
        return name

    names = [free(c, "_") for c in ("_id", "_size", "_crc")]
    twin, order = free("_twin", "_"), free("_order", "_")
    key = [F.coalesce(F.col(id_col).cast("long"), F.lit(LOWEST)).alias(names[0]), (F.octet_length(text).cast("long") + 1).alias(names[1]), F.crc32(text.cast("binary")).alias(names[2])]
    kept = [F.col(c).alias(free(f"{c}_before", "_before") if c.lower() in ("shard", "slot") else c) for c in docs.columns]
    rows = docs.select(*kept, *key, F.struct(F.sha2(text.cast("binary"), 256), F.xxhash64(*docs.columns)).alias(order))
    place = placed.select(F.coalesce("doc_id", F.lit(LOWEST)).alias(names[0]), F.col("size").alias(names[1]), F.col("text_crc32").alias(names[2]), "shard", "slot")
    twins = cut(place.groupBy(*names).agg(F.count("*").alias("n")).where("n > 1").select(*names))
    n = twins.limit(BROADCAST_ROWS + 1).count()

    def chosen(of: DataFrame) -> DataFrame:
        return of.where(F.col("shard").isin(affected))

    if not n:
        rows = rows.join(chosen(place), names).drop(order)
    else:
        some = F.broadcast(twins) if n <= BROADCAST_ROWS else twins
        counted = lambda *by: F.row_number().over(Window.partitionBy(*names).orderBy(*by)).alias(twin)  # noqa: E731  in an order that a second attempt finds again
        several = [of.join(some, names, "left_semi").select("*", counted(*by)) for of, by in ((rows, (order,)), (place, ("shard", "slot")))]
        single = rows.join(some, names, "left_anti").join(chosen(place), names)
        rows = single.unionByName(several[0].join(chosen(several[1]), [*names, twin]).drop(twin)).drop(order)
    rows = rows.drop(*names)
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("shard").parquet(path)
    return affected
