"""Readers, sinks and streams on small files."""

import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from obsengine.operators import sequence
from obsengine.sources import readers, sinks
from obsengine.streaming import observations as streams


def test_readers(spark, tmp_path):
    (tmp_path / "labels/images").mkdir(parents=True)
    (tmp_path / "labels/a.txt").write_text("0 .5 .5 .2 .2\n1 .1 .1 .1 .1\nbad line\n7 .5 .5 .1 .1\nx .5 .5 .1 .1\n")
    (tmp_path / "labels/classes.txt").write_text("0 0 0 0 0\n")
    (tmp_path / "labels/images/b.txt").write_text("0 .5 .5 .2 .2\n")
    labels = readers.box_labels(spark, str(tmp_path / "labels"), {0: "person", 1: "vehicle"})
    assert sorted((r["stem"], r["class"]) for r in labels.collect()) == [("a", "person"), ("a", "vehicle")]
    sized = readers.pixels(labels.withColumns({"width": F.lit(100), "height": F.lit(50)})).filter("class = 'person'").first().box
    assert [round(v, 6) for v in sized] == [40, 20, 60, 30]
    (tmp_path / "rows.txt").write_text("1 2 person 10 20 30 40\n1 2 person extra 1 2 3 4\n\nno box\n")
    good, bad = readers.annotation_rows(spark, str(tmp_path / "rows.txt"))
    assert sorted((r.x1, r.y2) for r in good.collect()) == [(1, 4), (10, 40)] and bad.count() == 1
    (tmp_path / "doc.json").write_text(json.dumps({"run_id": "r", "incidents": [{"a": 1}, {"a": 2}]}, indent=2))
    assert sorted(map(tuple, readers.nested(spark, str(tmp_path / "doc.json"), "incidents", "a:int", "run_id string").collect())) == [("r", 1), ("r", 2)]
    (tmp_path / "cache.json").write_text('{"k": 1}\nnot json\n')
    assert [r.k for r in readers.cached(spark, str(tmp_path / "cache.json"), "k int").collect()] == [1]
    assert readers.json_lines(spark, str(tmp_path / "nothing"), "k int").count() == 0
    (tmp_path / "obs.json").write_text('{"run_id": "r", "frame_index": 3, "helmet": {"state": "helmet"}}\n\n')
    assert readers.observations(spark, str(tmp_path / "obs.json")).filter("helmet.state = 'helmet'").count() == 1
    frames = readers.strided(spark.range(10).withColumnRenamed("id", "n"), 30.0, 15.0)
    assert [(r.sample_index, r.n) for r in frames.orderBy("n").collect()] == [(i, 2 * i) for i in range(5)]
    vectors = spark.createDataFrame([("[1, 2]",), (None,), ("[0.5]",)], "embedding string")
    assert readers.vectors(vectors).count() == 2
    (tmp_path / "clip.mp4").write_bytes(b"abc")
    assert readers.media_listing(spark, str(tmp_path)).first().length == 3


def test_resumable_append_and_upsert(spark, tmp_path):
    todo = spark.createDataFrame([(i,) for i in range(10)], "id int")
    work = lambda df: df.withColumn("done", F.lit(True))
    path = str(tmp_path / "out")
    assert sinks.append_pending(todo.filter("id < 4"), work, path, "id", "id int, done boolean").count() == 4
    sinks.append_pending(todo, work, path, "id", "id int, done boolean")
    assert sorted(r.id for r in spark.read.json(path).collect()) == list(range(10))
    rows = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "c", 1)], "k int, v string, n int")
    sinks.upsert(rows, str(tmp_path / "none"), str(tmp_path / "one"), ["k"], "n")
    sinks.upsert(spark.createDataFrame([(2, "d", 0)], "k int, v string, n int"), str(tmp_path / "one"), str(tmp_path / "two"), ["k"], "n")
    assert sorted((r.k, r.v) for r in spark.read.json(str(tmp_path / "two")).collect()) == [(1, "b"), (2, "d")]
    one = spark.createDataFrame([("i", "r", "R1", "<b>", None, 1.0, 0.5)], "incident_id string, run_id string, rule_id string, severity string, canonical_track_id string, first_seen_s double, confidence double")
    assert "&lt;b&gt;" in sinks.report_rows(one).first().html


def test_cache_is_written_only_with_answers(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1), ("b", 2), ("b", 3), (None, 4)], "crop string, n int")
    path = str(tmp_path / "cache")

    def load():
        return lambda frame: pd.DataFrame({"key": frame["key"], "state": frame["key"] + "!"})

    def failing():
        raise RuntimeError("no model")

    ask = lambda df, model: sorted(map(tuple, sinks.through_cache(df, path, F.col("crop"), model, "state string").collect()))
    with pytest.raises(Exception, match="no model"):
        ask(rows.filter("n > 0"), failing)
    assert readers.json_lines(spark, path, "key string").count() == 0
    assert ask(rows, load) == [("a", "a!"), ("b", "b!")] and ask(rows.filter("crop = 'b'"), failing) == [("b", "b!")]
    (tmp_path / "cache" / "part-torn.json").write_text('{"key": "c", "sta')
    assert ask(rows.union(spark.createDataFrame([("c", 5)], rows.schema)), load) == [("a", "a!"), ("b", "b!"), ("c", "c!")]


def test_streams_come_to_the_batch_answer(spark, tmp_path):
    base = 1_700_000_000_000_000
    rows = [(k, base + t * 1_000_000, float(t % 7)) for k in range(3) for t in (0, 3, 6, 20, 21, 40, 100_000)]
    df = spark.createDataFrame(rows, "k int, us long, v double").withColumn("ts", F.timestamp_micros("us"))
    for i, part in enumerate((df.filter("us % 2 = 0 AND us < 1700000010000000"), df.filter("NOT (us % 2 = 0 AND us < 1700000010000000)"))):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = lambda: spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = streams.sessions(source(), ["k"], "ts", 3_000_000, "10 seconds")
    q = out.writeStream.format("memory").queryName("runs").outputMode("append").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = sorted((r.k, r.first.timestamp(), r.n) for r in spark.table("runs").collect())
    batch = sequence.runs(df.filter("us < 1700050000000000"), ["k"], "us", 3_000_000)
    assert got == sorted((r.k, r.first / 1e6, r.n) for r in batch.collect())  # the last row of each key only moves the watermark
    averages = streams.running_average(source(), "k", "us", "v")
    q = averages.writeStream.format("memory").queryName("averages").outputMode("update").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    last = {r.k: r.average for r in spark.table("averages").collect() if r.n == 7}
    whole = df.groupBy("k").agg(sequence.recursive_average(sequence.ordered_list(["us"], F.col("v")), 0.35).alias("a"))
    assert {r.k: round(r.a, 9) for r in whole.collect()} == {k: round(a, 9) for k, a in last.items()}


def test_spacing_and_trailing_ranges_on_streams(spark, tmp_path):
    rows = [(k, i, 10 * i + (i * i * 7 + k) % 9, float((i * 37) % 11)) for k in range(3) for i in range(30)]
    df = spark.createDataFrame(rows, "k int, i int, t long, v double")
    for part in ("i < 11", "i >= 11 AND i < 12", "i >= 12"):
        df.filter(part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = lambda: spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))

    def run(stream, name):
        q = stream.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(120)
        return spark.table(name)

    kept = run(streams.spaced(source(), "k", "t", "i", 35), "kept")
    batch = sequence.greedy_spacing(df, ["k"], "t", "i", 35)
    assert sorted((r.k, r.id, r.t) for r in kept.collect()) == sorted((r.k, r.id, r.t) for r in batch.collect())
    moved = run(streams.trailing(source(), "k", "t", "i", "v", 60), "moved")
    whole = sequence.trailing_motion(df.withColumn("y", F.lit(0.0)), ["k"], "t", "v", "y", 60)
    assert sorted((r.k, r.id, r.n_trailing, round(r["shift"], 9)) for r in moved.collect()) == sorted((r.k, r.i, r.n_trailing, round(r.displacement, 9)) for r in whole.collect())
