"""Frames of a clip as a stream: in order, in batches of frame numbers, resumable from the checkpoint.

A Python data source. Its offset is the number of the next native frame, so a restarted query goes on where the last committed batch
ended. With the availableNow trigger a start gives one batch; others go on to the clip's end. Each batch is cut into ranges that tasks decode apart; decoding is a seam, `decoder`, that gives a frame's bytes.
"""

from __future__ import annotations

import importlib
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

FRAMES = "run_id string, sample_index long, n long, video_time_s double, content binary"


@dataclass
class Stretch(InputPartition):
    """Native frames from `start` up to `end`."""

    start: int
    end: int


class FrameReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.run, self.path, self.decoder = options["run_id"], options["path"], options.get("decoder")
        self.total, self.batch = int(options["frames"]), int(options.get("batch", "256"))
        self.cuts = int(options.get("tasks", "4"))
        native = float(options.get("native_fps", "0")) or 25.0
        self.fps, self.step = native, max(1, round(native / float(options.get("target_fps", "15"))))
        self.given: int | None = None

    def initialOffset(self) -> dict:
        return {"n": 0}

    def latestOffset(self) -> dict:
        """One batch on from what was given last. After a restart Spark first asks for the partitions of the last offset, which sets it."""
        self.given = min(self.total, (self.given or 0) + self.batch)
        return {"n": self.given}

    def partitions(self, start: dict, end: dict) -> list[Stretch]:
        self.given = max(self.given or 0, end["n"])
        size = -(-(end["n"] - start["n"]) // self.cuts)
        return [Stretch(a, min(a + size, end["n"])) for a in range(start["n"], end["n"], max(1, size))]

    def read(self, partition: Stretch) -> Iterator[tuple]:
        first = -(-partition.start // self.step) * self.step
        decode = None
        if self.decoder:
            module, _, name = self.decoder.partition(":")
            decode = getattr(importlib.import_module(module), name)
        for n in range(first, partition.end, self.step):
            yield self.run, n // self.step, n, n / self.fps, decode(self.path, n) if decode else None

    def commit(self, end: dict) -> None:
        return None


class FrameSource(DataSource):
    """Format `clip_frames`; options run_id, path, frames (of the clip), native_fps, target_fps, batch (native frames), tasks, decoder (module:function)."""

    @classmethod
    def name(cls) -> str:
        return "clip_frames"

    def schema(self) -> str:
        return FRAMES

    def streamReader(self, schema) -> FrameReader:
        return FrameReader(self.options)


def frames(spark: SparkSession, run_id: str, path: str, n_frames: int, **options: str):
    """A stream of FRAMES: every step-th native frame, step being the nearest whole number of native over target rate."""
    spark.dataSource.register(FrameSource)
    return spark.readStream.format("clip_frames").options(run_id=run_id, path=path, frames=str(n_frames), **options).load()
