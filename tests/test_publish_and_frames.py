"""Versions of published tables, clips as streams, and their progress."""

import json

import pytest
from pyspark.sql import functions as F

from obsengine.sources import frames, publish
from obsengine.sources.publish import Part
from obsengine.streaming.progress import ProgressRow, file_store

RUNS, CLAUSES = "id string, n int", "chunk_id string, text string, embedding array<double>"


def rows(spark, found, schema):
    return spark.createDataFrame(found, schema)


def test_versions_are_whole(spark, tmp_path, monkeypatch):
    target = str(tmp_path / "out")
    assert publish.manifest(spark, target) == {"version": 0, "tables": {}}
    one = {"runs": Part(rows(spark, [("a", 1), ("b", 1)], RUNS), ("id",)), "incidents": Part(rows(spark, [], RUNS), ("id",)), "clauses": Part(rows(spark, [("c", "t", [1.0])], CLAUSES), ("chunk_id",), ("embedding",))}
    assert publish.publish(spark, target, one, dry_run=True) == {"runs": 2, "incidents": 0, "clauses": 1}
    assert publish.manifest(spark, target)["version"] == 0
    assert publish.publish(spark, target, one) == {"runs": 2, "incidents": 0, "clauses": 1}
    assert sorted(publish.manifest(spark, target)["tables"]) == ["clauses", "runs"]  # empty ones are skipped
    two = {"runs": Part(rows(spark, [("b", 2), ("c", 2)], RUNS), ("id",)), "clauses": Part(rows(spark, [], CLAUSES), ("chunk_id",), ("embedding",))}
    publish.publish(spark, target, two)
    now = publish.manifest(spark, target)
    assert now["version"] == 2 and now["tables"]["runs"]["rows"] == 3
    assert sorted(map(tuple, publish.published(spark, target, "runs").collect())) == [("a", 1), ("b", 2), ("c", 2)]
    assert publish.published(spark, target, "clauses").count() == 1

    no_vector = {"runs": Part(rows(spark, [("z", 9)], RUNS), ("id",)), "clauses": Part(rows(spark, [("d", "t", None)], CLAUSES), ("chunk_id",), ("embedding",))}
    with pytest.raises(ValueError, match="1 rows without embedding"):
        publish.publish(spark, target, no_vector)
    with pytest.raises(ValueError, match="1 keys with several rows"):
        publish.publish(spark, target, {"runs": Part(rows(spark, [("z", 9), ("z", 8)], RUNS), ("id",))})
    counted = publish._counted
    monkeypatch.setattr(publish, "_counted", lambda s, path: counted(s, path) - ("clauses" in path))
    with pytest.raises(RuntimeError, match="the version before stands"):
        publish.publish(spark, target, {"runs": Part(rows(spark, [("z", 9)], RUNS), ("id",)), "clauses": Part(rows(spark, [("d", "t", [2.0])], CLAUSES), ("chunk_id",))})
    assert publish.manifest(spark, target) == now and publish.published(spark, target, "runs").filter("id = 'z'").count() == 0


def test_two_writers_of_one_version(spark, tmp_path):
    target = str(tmp_path)
    publish._commit(spark, target, {"version": 1, "tables": {}})
    with pytest.raises(Exception, match="exist"):
        publish._commit(spark, target, {"version": 1, "tables": {"late": {}}})
    assert publish.manifest(spark, target) == {"version": 1, "tables": {}}


def run_stream(stream, out, checkpoint, stop_after=None):
    """Batches written one by one; after `stop_after` of them the query fails, as a lost driver would."""
    done = []

    def write(batch, number):
        if stop_after is not None and len(done) == stop_after:
            raise RuntimeError("lost")
        batch.drop("content").withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/batch={number}")
        done.append(number)

    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).start()
    try:
        query.processAllAvailable()
    except Exception:
        assert stop_after is not None
    query.stop()
    return done


def test_frames_stopped_and_restarted(spark, tmp_path):
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "checkpoint")
    clip = lambda: frames.frames(spark, "r", "clip.mp4", 100, native_fps="30", target_fps="15", batch="30", tasks="3")
    rounds = [run_stream(clip(), out, checkpoint, 1), run_stream(clip(), out, checkpoint, 1), run_stream(clip(), out, checkpoint)]
    got = [tuple(r) for r in spark.read.parquet(out).select("run_id", "sample_index", "n", "video_time_s").orderBy("n").collect()]
    assert got == [("r", i, 2 * i, 2 * i / 30) for i in range(50)]  # each frame once, none left out
    by_batch = {r.batch: (r.a, r.b) for r in spark.read.parquet(out).groupBy("batch").agg(F.min("n").alias("a"), F.max("n").alias("b")).collect()}
    ends = [by_batch[k] for k in sorted(by_batch)]
    assert all(b < a for (_, b), (a, _) in zip(ends, ends[1:])) and len(ends) == 4  # in order
    assert rounds == [[0], [1], [2, 3]]


def test_a_clip_that_grows_goes_on_where_it_ended(spark, tmp_path):
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "checkpoint")
    clip = lambda n: frames.frames(spark, "r", "clip.mp4", n, native_fps="30", target_fps="30", batch="30")
    assert run_stream(clip(60), out, checkpoint) == [0, 1] and run_stream(clip(60), out, checkpoint) == []
    assert run_stream(clip(100), out, checkpoint) == [2, 3]
    assert [r.n for r in spark.read.parquet(out).orderBy("n").collect()] == list(range(100))


def decoded(path, n):
    return f"{path}:{n}".encode()


def test_frames_are_decoded_in_tasks(spark, tmp_path):
    reader = frames.FrameReader({"run_id": "r", "path": "p", "frames": "10", "native_fps": "0", "decoder": f"{__name__}:decoded"})
    assert reader.step == 2 and reader.initialOffset() == {"n": 0} and reader.latestOffset() == {"n": 10}
    parts = reader.partitions({"n": 3}, {"n": 10})
    assert [(p.start, p.end) for p in parts] == [(3, 5), (5, 7), (7, 9), (9, 10)] and reader.partitions({"n": 10}, {"n": 10}) == []
    assert [r for p in parts for r in reader.read(p)] == [("r", n // 2, n, n / 25, f"p:{n}".encode()) for n in (4, 6, 8)]


def test_progress_is_one_row_written_over(spark, tmp_path):
    seen = []
    keep = file_store(spark, str(tmp_path))
    row = ProgressRow(lambda run, r: (seen.append(r), keep(run, r)), {"clip": 12})
    spark.streams.addListener(row)
    try:
        spark.createDataFrame([(i,) for i in range(12)], "k int").repartition(3).write.parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("k int").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        stream.writeStream.foreachBatch(lambda b, n: b.count()).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).queryName("clip").start().awaitTermination(120)
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(20_000)
    finally:
        spark.streams.removeListener(row)
    mine = [r for r in seen if r["run_id"] == "clip"]
    assert [r["rows"] for r in mine] == sorted(r["rows"] for r in mine) and len({r["batch_id"] for r in mine}) >= 4
    last = json.loads((tmp_path / "clip.json").read_text())
    assert last == mine[-1] and (last["status"], last["rows"], last["progress"]) == ("succeeded", 12, 1.0)
    assert [p.name for p in tmp_path.glob("*.json")] == ["clip.json"]
