"""State files of every kind in one folder; streamed results when a batch is lost between its write and its commit."""

import pytest
from pyspark.sql import functions as F

from lodestrand.sources import crawl as S
from lodestrand.sources import state as A
from lodestrand.streaming import jobs

FILES = {
    "good.json": '{"version":1,"examples":[{"id":"1","title":"t","line2":"a","line3":"b"},{"title":"old","catchphrase_parts":["x","y"]},{"title":"one","catchphrase_parts":["x"],"line2":"own"},7,null],"presets":[{"name":"n","prompt":"p"}],"active_prompt":"on"}',
    "cut.json": '{"examples":[{"title":"lost"',
    "trailing.json": '{"examples":[]} and more',
    "list.json": '[{"title":"no state"}]',
    "types.json": '{"examples":{"title":"x"},"presets":"no","active_prompt":5,"selected_model_id":"m"}',
    "twice.json": '{"active_prompt":"a","active_prompt":"b","examples":[{"title":"d"}]}',
    "empty.json": "",
}


def test_state_files(spark, tmp_path):
    for name, text in FILES.items():
        (tmp_path / name).write_text(text)
    files = A.state_files(spark, str(tmp_path)).withColumn("name", F.element_at(F.split("file", "/"), -1)).cache()
    rows = {r.name: r for r in files.collect()}
    assert {n for n, r in rows.items() if r.quarantined} == {"cut.json", "trailing.json"} | ({"empty.json"} & set(rows))
    assert {n: (r.active_prompt, r.selected_model_id) for n, r in rows.items() if r.active_prompt or r.selected_model_id} == {"good.json": ("on", ""), "types.json": ("", "m"), "twice.json": ("b", "")}
    assert [(p.name, p.prompt) for p in rows["good.json"].presets] == [("n", "p")] and not rows["types.json"].presets
    got = [(r.name, r.place, r.title, r.line2, r.line3) for r in A.examples_of(files).withColumn("name", F.element_at(F.split("file", "/"), -1)).orderBy("name", "place").collect()]
    assert got == [("good.json", 0, "t", "a", "b"), ("good.json", 1, "old", "x", "y"), ("good.json", 2, "one", "own", ""), ("twice.json", 0, "d", "", "")]
    A.set_aside(spark, files, str(tmp_path), str(tmp_path / "aside"))
    kept = {r.file.rsplit("/", 1)[1]: bytes(r.content).decode() for r in spark.read.parquet(str(tmp_path / "aside")).collect()}
    assert kept["cut.json"] == FILES["cut.json"] and "good.json" not in kept


def test_batch_lost_before_its_commit(spark, tmp_path, monkeypatch):
    requests = spark.createDataFrame([(k, f"http://a/{k}\nhttp://b/{k}\n\nhttp://a/{k}") for k in range(6)], "request_id long, urls string")
    for k in range(3):
        requests.where(f"request_id % 3 = {k}").coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    done = spark.createDataFrame([(f"http://a/{k}", f"T{k}", "x", "y", None) for k in range(6)] + [(f"http://b/{k}", None, None, None, "fetch_error") for k in range(6)], "url string, title string, line2 string, line3 string, error_code string")
    stream = lambda: spark.readStream.schema("request_id long, urls string").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    write, calls = S.write_results, []

    def lost(results, path):
        write(results, path)
        calls.append(path)
        if len(calls) == 2:
            raise RuntimeError("lost between write and commit")

    monkeypatch.setattr(jobs, "write_results", lost)
    with pytest.raises(Exception, match="lost between"):
        jobs.stream_results(stream(), lambda: done, f"{tmp_path}/out", f"{tmp_path}/state")
    jobs.stream_results(stream(), lambda: done, f"{tmp_path}/out", f"{tmp_path}/state")
    assert len(calls) == 4 and calls[1] == calls[2]  # the second batch ran twice
    rows = spark.read.parquet(f"{tmp_path}/out").collect()
    assert sorted((r.request_id, r.ordinal) for r in rows) == [(k, n) for k in range(6) for n in range(3)]
    assert all((str(r.failed).lower() == "true") == (r.error_code is not None) for r in rows) and sum(r.error_code is not None for r in rows) == 6
    assert {(r.title, r.line2) for r in rows if r.request_id == 2 and r.error_code is None} == {("T2", "x")}


def test_release(spark):
    from lodestrand import lineage

    lineage.release(spark)
    table = lineage.kept(spark.range(5).toDF("n"))
    path = lineage.MADE[-1]
    assert table.count() == 5 and spark.read.parquet(path).count() == 5
    assert lineage.release(spark) == 1 and lineage.MADE == []
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(path)
