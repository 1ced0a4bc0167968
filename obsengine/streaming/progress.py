"""The state of a stream as one row, written over after each batch, for whoever waits for it."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import SparkSession
from pyspark.sql.streaming.listener import StreamingQueryListener


class ProgressRow(StreamingQueryListener):
    """Keeps one row a query name: run_id, status, batch_id, rows so far, progress from 0 to 1 (of the expected rows, null if unknown) and a message.

    store(run_id, row) puts it over the one before. A batch that is told of twice counts once.
    """

    def __init__(self, store: Callable[[str, dict], None], expected: dict[str, int] | None = None):
        self.store, self.expected = store, expected or {}
        self.names: dict[str, str] = {}
        self.rows: dict[str, dict[int, int]] = {}

    def _put(self, run: str, status: str, message: str) -> None:
        batches = self.rows.get(run, {})
        done, all_ = sum(batches.values()), self.expected.get(run)
        share = None if not all_ else 1.0 if status == "succeeded" else min(1.0, done / all_)
        self.store(run, {"run_id": run, "status": status, "batch_id": max(batches, default=-1), "rows": done, "progress": share, "message": message})

    def onQueryStarted(self, event) -> None:
        run = event.name or str(event.id)
        self.names[str(event.id)] = run
        self._put(run, "running", "started")

    def onQueryProgress(self, event) -> None:
        p = event.progress
        run = p.name or str(p.id)
        self.names[str(p.id)] = run
        if p.numInputRows:
            self.rows.setdefault(run, {})[p.batchId] = p.numInputRows
        self._put(run, "running", f"batch {p.batchId}")

    def onQueryIdle(self, event) -> None:
        return None

    def onQueryTerminated(self, event) -> None:
        failed = event.exception is not None
        self._put(self.names.get(str(event.id), str(event.id)), "failed" if failed else "succeeded", str(event.exception) if failed else "done")


def file_store(spark: SparkSession, folder: str) -> Callable[[str, dict], None]:
    """A store that keeps each row as folder/run_id.json: written beside it and moved over it, so that readers see a whole row."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def put(run: str, row: dict) -> None:
        path = jvm.org.apache.hadoop.fs.Path
        beside, place = path(f"{folder}/.{run}.new"), path(f"{folder}/{run}.json")
        store = jvm.org.apache.hadoop.fs.FileContext.getFileContext(place.toUri(), conf)
        files = place.getFileSystem(conf)
        out = files.create(beside, True)
        out.write(bytearray(json.dumps(row), "utf-8"))
        out.close()
        over = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        over[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        store.rename(beside, place, over)

    return put
