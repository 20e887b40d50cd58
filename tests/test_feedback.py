"""The ring of an owner's entries, in batch and over a stream, against a plain fold over all events."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from lodestrand.operators import feedback as B
from lodestrand.plans import inputs as N
from lodestrand.plans import queries as Q
from lodestrand.streaming import jobs

SMALL = "/root/testdata/sf0.001"
EVENT = "id string, owner string, key string, ts timestamp_ntz, op string"


def rings(rows, keep):
    out = {}
    for r in sorted(rows, key=lambda r: (r["ts"], r["id"])):
        ring = out.setdefault(r["owner"], [])
        held = [x for x in ring if x[0] == r["key"]]
        ring[:] = [x for x in ring if x[0] != r["key"]]
        if r["op"] == "add" or r["op"] == "toggle" and not held:
            ring.append((r["key"], r["id"]))
            del ring[:-keep]
    return {(o, k, i, n) for o, ring in out.items() for n, (k, i) in enumerate(reversed(ring), 1)}


def log(n, owners, keys, ops, seed=1):
    rng = random.Random(seed)
    start = datetime.datetime(2026, 1, 1)
    return [{"id": f"{k:06d}", "owner": rng.choice(owners), "key": rng.choice(keys), "ts": start + datetime.timedelta(seconds=rng.randint(0, n)), "op": rng.choice(ops)} for k in range(n)]


def found(df):
    return {(r.owner, r.key, r.id, r.recency) for r in df.collect()}


def test_ring_of_every_owner(spark):
    rows = [r.asDict() for r in N.feedback_log(spark, SMALL, deletes=True).collect()]
    assert {r["op"] for r in rows} == {"add", "delete"}
    for keep, ring in ((B.KEEP, Q.QUERIES["feedback_ring"](spark, SMALL)), (3, B.feedback_ring(N.feedback_log(spark, SMALL, deletes=True), 3))):
        assert found(ring) == rings(rows, keep)


@pytest.mark.parametrize(
    ("keys", "ops", "keep"),
    [(15, ["add", "delete"], 10), (12, ["add", "add", "delete"], 10), (40, ["add"] * 5 + ["delete"], 3), (5, ["add", "delete", "delete"], 1), (3, ["add", "delete"], 4)],
)
def test_ring_of_random_logs(spark, keys, ops, keep):
    """One owner has nearly all events, so its stretches lie in several tasks; a null owner and a null key count as any other."""
    rows = log(3000, ["hot"] * 30 + ["cold", None], [f"k{k}" for k in range(keys)] + [None], ops, seed=keys)
    ring = B.feedback_ring(spark.createDataFrame([tuple(r[c] for c in ("id", "owner", "key", "ts", "op")) for r in rows], EVENT), keep)
    assert found(ring) == rings(rows, keep)


def test_stretches_of_one_owner(spark):
    rows = spark.createDataFrame([tuple(r[c] for c in ("id", "owner", "key", "ts", "op")) for r in log(4000, ["hot"], ["a", "b"], ["add", "delete"])], EVENT)
    stretches = rows.withColumn("at", B._in_order()).repartitionByRange(8, "owner", "at").groupBy(F.spark_partition_id()).count().collect()
    assert len(stretches) == 8 and max(r["count"] for r in stretches) < 1000


@pytest.mark.parametrize("keep", [10, 2])
def test_toggles(spark, keep):
    rows = log(800, ["a", "a", "b"], [f"k{k}" for k in range(14)] + ["fixed"], ["toggle"])
    table = spark.createDataFrame([tuple(r[c] for c in ("id", "owner", "key", "ts", "op")) for r in rows], EVENT)
    got = found(B.feedback_toggle(table, spark.createDataFrame([("fixed",)], "key string"), keep))
    assert got == rings([r for r in rows if r["key"] != "fixed"], keep)


def test_ring_without_events(spark):
    none = N.feedback_log(spark, SMALL).where("1 = 0")
    assert B.feedback_ring(none).count() == 0 and B.feedback_toggle(none).count() == 0


def test_stream_in_event_time(spark, tmp_path):
    """Micro-batches that hold the events in another order give the ring of the whole log; what comes after the watermark is left out."""
    rows = log(900, ["a", "b"], [f"k{k}" for k in range(13)], ["add", "add", "delete"], seed=7)
    random.Random(2).shuffle(rows)
    for k in range(6):
        part = rows[k::6]
        spark.createDataFrame([tuple(r[c] for c in ("id", "owner", "key", "ts", "op")) for r in part], EVENT).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    stream = lambda: spark.readStream.schema(EVENT).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    jobs.stream_feedback(stream(), f"{tmp_path}/out", f"{tmp_path}/state", delay="2 hours")
    assert found(jobs.present_rings(spark, f"{tmp_path}/out")) == rings(rows, B.KEEP)
    assert spark.read.parquet(f"{tmp_path}/out").select("batch_no").distinct().count() > 3
    late = {"id": "zz", "owner": "a", "key": "new", "ts": datetime.datetime(2025, 1, 1), "op": "add"}
    fresh = {"id": "zzz", "owner": "a", "key": "last", "ts": datetime.datetime(2026, 1, 2), "op": "add"}
    for k, r in ((7, fresh), (8, late)):
        spark.createDataFrame([tuple(r[c] for c in ("id", "owner", "key", "ts", "op"))], EVENT).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
        jobs.stream_feedback(stream(), f"{tmp_path}/out", f"{tmp_path}/state", delay="2 hours")
    assert found(jobs.present_rings(spark, f"{tmp_path}/out")) == rings([*rows, fresh], B.KEEP)
