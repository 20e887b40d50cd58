"""The candidate and feedback jobs over streams."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import batched

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..lineage import kept
from ..operators.candidates import parsed_candidates
from ..operators.feedback import KEEP, fold
from ..profiles import LATIN, TextProfile
from ..operators.results import assemble_results
from ..sources.crawl import PAGES, url_list_explode, write_results


def stream_candidates(spark: SparkSession, source: str, target: str, checkpoint: str, profile: TextProfile = LATIN, pattern: str = "*.parquet") -> None:
    """Candidates, of descriptions first, of pages in new files under ``source``, appended under ``target`` by batch: a batch that runs again replaces its own folder.

    A page's windows need the whole page, which lies in one file row, so each micro-batch is a batch job of its own."""
    pages = spark.readStream.schema(PAGES).option("pathGlobFilter", pattern).parquet(source)

    def one(batch: DataFrame, number: int) -> None:
        parsed_candidates(batch, profile, kept)[1].write.mode("overwrite").parquet(f"{target}/batch={number}")

    pages.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


RING = "owner string, key string, id string, recency int"
_PENDING = T.StructType([T.StructField(n, T.LongType() if n == "at" else T.StringType()) for n in ("at", "id", "op", "key")])
#: The same as Arrow columns; 64-bit offsets, so that an owner may have any number of them.
_COLUMNS = pa.schema([(n, pa.int64() if n == "at" else pa.large_string()) for n in ("at", "id", "op", "key")])
_HELD = T.StructType([T.StructField("key", T.StringType()), T.StructField("id", T.StringType())])


#: Events that are handled as Python objects at once.
EVENTS_AT_ONCE = 10_000


class Ring(StatefulProcessor):
    """An owner's ring in event time. State is the ring as of the watermark, at most ``keep`` entries, and the events after it.

    Events may come in any order while they are within the watermark's delay: what the ring holds after a batch is the fold of all events so far in time
    order. Events older than the watermark are late and left out. A batch's events are held as Arrow columns, sorted there and folded some thousands at a
    time. ``delay`` behind an owner's last event the next watermark is passed in any case, so what is older is folded now and not kept."""

    def __init__(self, keep: int, delay_ms: int):
        self.keep, self.delay_ms = keep, delay_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.ring, self.pending = handle.getListState("ring", _HELD), handle.getListState("pending", _PENDING)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        reached = timerValues.getCurrentWatermarkInMs() * 1000
        held = [pa.Table.from_arrays([pa.array(c, k) for c, k in zip(zip(*part, strict=True), _COLUMNS.types, strict=True)], schema=_COLUMNS) for part in batched(self.pending.get(), EVENTS_AT_ONCE)]
        for frame in rows:
            at = frame["ts"].astype("datetime64[us]").astype("int64")
            fresh = at > reached if reached > 0 else at == at
            held.append(pa.Table.from_pandas(frame.assign(at=at)[fresh], _COLUMNS, preserve_index=False))
        events = pa.concat_tables(held).combine_chunks()
        held.clear()
        order = pc.sort_indices(events, [("at", "ascending"), ("id", "ascending")])
        last = (pc.max(events["at"]).as_py() or 0) // 1000 - self.delay_ms
        ripe = pc.sum(pc.less_equal(events["at"], max(reached, last * 1000))).as_py() or 0 if reached > 0 or last > 0 else 0

        def parts(begin: int, end: int) -> Iterator[list[tuple]]:
            for k in range(begin, end, EVENTS_AT_ONCE):
                some = events.take(order.slice(k, min(EVENTS_AT_ONCE, end - k)))
                yield list(zip(*(some[c].to_pylist() for c in _COLUMNS.names), strict=True))

        ring = [tuple(x) for x in self.ring.get()]
        for part in parts(0, ripe):
            ring = fold([(e[2], e[3], e[1]) for e in part], ring, self.keep)
        self.ring.put(ring) if ring else self.ring.clear()
        self.pending.clear()
        for part in parts(ripe, len(order)):
            self.pending.appendList(part)
            ring = fold([(e[2], e[3], e[1]) for e in part], ring, self.keep)
        yield pd.DataFrame([(key[0], k, i, n) for n, (k, i) in enumerate(reversed(ring), 1)] or [(key[0], None, None, 0)], columns=["owner", "key", "id", "recency"])

    def close(self) -> None:
        pass


def ring_updates(events: DataFrame, keep: int = KEEP, delay: str = "1 hour") -> DataFrame:
    """The ring of each owner after every micro-batch in which it has events, from a stream of (owner, key, id, ts, op); a row of recency 0 says that it is empty.

    ``delay`` is how late an event may come; it also bounds the events that state holds."""
    timed = events.select("owner", "key", "id", F.col("ts").cast("timestamp").alias("ts"), "op").withWatermark("ts", delay)
    return timed.groupBy("owner").transformWithStateInPandas(Ring(keep, int(pd.Timedelta(delay).total_seconds() * 1000)), RING, "Update", "EventTime")


ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stream_feedback(events: DataFrame, target: str, checkpoint: str, keep: int = KEEP, delay: str = "1 hour") -> None:
    """Writes each batch's rings under ``target``; the last batch in which an owner occurs has its present ring. State lies in RocksDB, so it may exceed memory."""

    def one(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch_no", F.lit(number)).write.mode("overwrite").parquet(f"{target}/batch={number}")

    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    ring_updates(events, keep, delay).writeStream.outputMode("update").foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def present_rings(spark: SparkSession, target: str) -> DataFrame:
    rows = spark.read.parquet(target)
    last = rows.groupBy("owner").agg(F.max("batch_no").alias("batch_no"))
    return rows.join(last, ["owner", "batch_no"]).where("recency > 0").select("owner", "key", "id", "recency")


def stream_results(requests: DataFrame, results: Callable[[], DataFrame], target: str, checkpoint: str) -> None:
    """Results of a stream of (request_id, urls) under ``target``, in a folder for each batch, failures apart in each.

    A row for each url of a request with its ordinal, and for each result of that url, joined with what ``results`` gives at the time of the batch (url, title,
    line2, line3, error_code). A batch that runs again, as after a loss between its write and its commit, replaces its own folder, so that each result stands once."""

    def one(batch: DataFrame, number: int) -> None:
        write_results(assemble_results(url_list_explode(batch), results()), f"{target}/batch={number}")

    requests.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
