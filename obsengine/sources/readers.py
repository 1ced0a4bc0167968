"""Readers: observation lines, documents with nested arrays, box labels, media folders, JDBC tables."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from obsengine import schema

#: Bytes: files that are hashed whole, the head and tail of others, and what is read at once. The first two are fixed values.
WHOLE_BELOW, SAMPLE, PIECE = 64 * 1024 * 1024, 16 * 1024 * 1024, 4 << 20
ANNOTATION = "name:string,x1:int,y1:int,x2:int,y2:int,size:struct<width:int,height:int>"


def observations(spark: SparkSession, path: str, run_id: str | None = None) -> DataFrame:
    """JSON lines of schema.OBSERVATIONS; blank lines are skipped, malformed ones are an error."""
    rows = spark.read.schema(schema.OBSERVATIONS).option("mode", "FAILFAST").json(path)
    return rows if run_id is None else rows.withColumn("run_id", F.lit(run_id))


def json_lines(spark: SparkSession, path: str, columns: str) -> DataFrame:
    """JSON lines, or an empty table where nothing is."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.schema(columns).json(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], columns)


def nested(spark: SparkSession, path: str, array: str, element: str, header: str) -> DataFrame:
    """One row for each element of an array inside JSON documents, after the documents' header columns."""
    doc = spark.read.schema(f"{header}, {array} array<struct<{element}>>").option("multiLine", True).json(path)
    names = [f.split()[0] for f in header.split(", ")]
    return doc.select(*names, F.explode(array).alias("_e")).select(*names, "_e.*")


def cached(spark: SparkSession, path: str, columns: str) -> DataFrame:
    """What of a JSON cache can be parsed; any other row is a miss."""
    rows = spark.read.schema(f"{columns}, _corrupt_record string").option("mode", "PERMISSIVE").json(path)
    return rows.filter("_corrupt_record IS NULL").drop("_corrupt_record")


def file_stem(path: str = "path"):
    return F.regexp_extract(F.col(path), r"([^/]+?)(?:\.[^./]*)?$", 1)


def box_labels(spark: SparkSession, path: str, classes: dict[int, str]) -> DataFrame:
    """(stem, class, xc, yc, w, h) of label files `id xc yc w h` in shares of the image; other lines and classes are left out."""
    rows = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.txt").text(path).withColumn("path", F.col("_metadata.file_path"))
    rows = rows.filter(~F.col("path").rlike("(/images/|/(classes|notes)\\.txt$)"))
    f = F.split(F.trim("value"), r"\s+")
    parsed = rows.filter(F.size(f) == 5).select(file_stem().alias("stem"), F.expr("try_cast(split(trim(value), '\\\\s+')[0] AS int)").alias("id"), *(F.expr(f"try_cast(split(trim(value), '\\\\s+')[{i + 1}] AS double)").alias(n) for i, n in enumerate(("xc", "yc", "w", "h"))))
    names = F.create_map(*(F.lit(x) for pair in classes.items() for x in pair))
    return parsed.withColumn("class", names[F.col("id")]).dropna().select("stem", "class", "xc", "yc", "w", "h")


def pixels(labels: DataFrame, width: str = "width", height: str = "height") -> DataFrame:
    """Box labels joined with their image sizes, as corner boxes in pixels."""
    x, y, w, h = (F.col(c) for c in ("xc", "yc", "w", "h"))
    box = F.struct(
        ((x - w / 2) * F.col(width)).alias("x1"), ((y - h / 2) * F.col(height)).alias("y1"),
        ((x + w / 2) * F.col(width)).alias("x2"), ((y + h / 2) * F.col(height)).alias("y2"),
    )
    return labels.withColumn("box", box)


def annotation_rows(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(frame, track, class, x1, y1, x2, y2) of lines read from the right, whose last four are the box; and the others."""
    rows = spark.read.text(path).filter(F.trim("value") != "")
    f = F.split(F.trim("value"), r"\s+")
    cut = rows.select("value", F.size(f).alias("n"), f.alias("f"))
    number = lambda c: c.try_cast("int")
    parsed = cut.select("value", number(F.get("f", F.lit(0))).alias("frame"), number(F.get("f", F.lit(1))).alias("track"), F.get("f", F.lit(2)).alias("class"), *(number(F.get("f", F.col("n") - 4 + i)).alias(c) for i, c in enumerate(("x1", "y1", "x2", "y2"))), "n")
    fine = (F.col("n") >= 7) & ~F.isnull(F.col("frame") + F.col("track") + F.col("x1") + F.col("y1") + F.col("x2") + F.col("y2"))
    return parsed.filter(fine).drop("value", "n"), parsed.filter(~fine).select("value")


def media_listing(spark: SparkSession, path: str, suffixes: tuple[str, ...] = ("mp4", "mov", "avi")) -> DataFrame:
    """(path, length, modificationTime) of files with these suffixes, contents unread."""
    glob = "*.{" + ",".join(suffixes) + "}"
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path).select("path", "length", "modificationTime")


def fingerprints(spark: SparkSession, path: str, whole_below: int = WHOLE_BELOW, sample: int = SAMPLE) -> DataFrame:
    """(path, length, sha256, complete) of files, whatever their length: each is read in its task, in pieces of no more than PIECE bytes.

    Files of up to whole_below bytes are hashed whole. Of longer ones it is their length, a line's end, their first and their last `sample`
    bytes, and complete is false. Files are listed without their contents; the store has to be one that pyarrow opens. Empty files aren't listed.
    """
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length")

    def pieces(f, start: int, end: int) -> Iterator[bytes]:
        f.seek(start)
        while start < end and (piece := f.read(min(PIECE, end - start))):
            start += len(piece)
            yield piece

    def digest(name: str, length: int) -> tuple[str, bool]:
        store, at = fs.FileSystem.from_uri(name)
        whole = length <= whole_below
        ranges = [(0, length)] if whole else [(0, min(sample, length)), (max(0, length - sample), length)][: 2 if length > sample else 1]
        found = hashlib.sha256(b"" if whole else f"{length}\n".encode())
        with store.open_input_file(at) as f:
            for start, end in ranges:
                for piece in pieces(f, start, end):
                    found.update(piece)
        return found.hexdigest(), whole

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            read = [digest(p, n) for p, n in zip(frame["path"], frame["length"], strict=True)]
            yield frame.assign(sha256=[r[0] for r in read], complete=[r[1] for r in read])

    return listed.mapInPandas(run, "path string, length long, sha256 string, complete boolean")


def annotations(spark: SparkSession, documents: str, images: str) -> tuple[DataFrame, DataFrame]:
    """Annotation documents (stem, labels) of a folder of JSON files, and the images (stem, sha256) of another, for intake.converted."""
    labels = spark.read.schema(f"labels array<struct<{ANNOTATION}>>").option("multiLine", True).option("mode", "FAILFAST").option("pathGlobFilter", "*.json").json(documents)
    pictures = fingerprints(spark, images, whole_below=1 << 62).filter("path ILIKE '%.jpg'")
    return labels.select(file_stem("_metadata.file_path").alias("stem"), "labels"), pictures.select(file_stem("path").alias("stem"), "sha256")


def strided(frames: DataFrame, native_fps: float, target_fps: float) -> DataFrame:
    """(sample_index, n, video_time_s): every step-th native frame n."""
    fps = native_fps or 25.0
    step = max(1, round(fps / target_fps))
    return frames.filter(F.pmod("n", F.lit(step)) == 0).select((F.col("n") / step).cast("long").alias("sample_index"), "n", (F.col("n") / fps).alias("video_time_s"))


def jdbc(spark: SparkSession, url: str, table: str, **options: str) -> DataFrame:
    """A database table; filters, columns and limits are pushed to the server."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()


def vectors(rows: DataFrame, column: str = "embedding") -> DataFrame:
    """rows with string vectors parsed, and without those that have none."""
    parsed = F.from_json(column, "array<float>") if dict(rows.dtypes)[column] == "string" else F.col(column).cast("array<float>")
    return rows.withColumn(column, parsed).filter(F.col(column).isNotNull())
