"""What the training-data operators share: reading tables, mapping Arrow batches, staging.

Every operator takes a DataFrame and the names of the columns it reads, selects just those,
and so is indifferent to extra columns, whatever they are called.
"""

from __future__ import annotations

import ctypes
import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SLICE_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors see. A temporary one only where the session names none and has one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="obsengine-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def staging_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/obsengine/{name}-{uuid.uuid4().hex}"


#: While a table is written, Spark removes the shuffle files of the job when it ends: nothing reads them again.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def staged(df: DataFrame, name: str) -> DataFrame:
    """df as a written table: cuts lineage, and survives lost executors. dropped() removes it."""
    spark = df.sparkSession
    path = staging_path(spark, name)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    table = spark.read.schema(df.schema).parquet(path)
    table.staged_at = path
    return table


def dropped(*tables: DataFrame) -> None:
    """Removes staged tables whose last reader has been written."""
    for table in tables:
        path = table.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(table.staged_at)
        path.getFileSystem(table.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def give_back() -> None:
    """What this worker has freed goes back to the system: workers are kept, and what they hold adds up over a pipeline's stages."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc has it
        trim(0)


def map_rows(
    df: DataFrame, fn: Callable[[dict[str, list]], dict[str, Any]], schema: str, rows: int = 512, done: Callable[[], None] | None = None
) -> DataFrame:
    """fn over slices of at most `rows` rows, as columns of Python lists, to columns of lists or arrays.

    Slices bound the worker's memory, however large Spark's Arrow batches are: one that holds several rows
    has no more than SLICE_BYTES. done: called at a task's end, to drop what fn has kept.
    """
    target = df.sparkSession.createDataFrame([], schema).schema
    fields = [(f.name, _arrow_type(f.dataType)) for f in target.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, rows):
                out = fn({n: part.column(i).to_pylist() for i, n in enumerate(part.schema.names)})
                yield pa.RecordBatch.from_arrays([_array(out[n], t) for n, t in fields], [n for n, _ in fields])
        if done:
            done()
        give_back()

    return df.mapInArrow(run, target)


def filter_rows(
    df: DataFrame, text_column: str, keep: Callable[[list[str | None]], list[bool]], rows: int = 64, done: Callable[[], None] | None = None
) -> DataFrame:
    """df, all columns, without the rows whose texts `keep` denies. Columns go by position: any names will do. done: as in map_rows."""
    at = df.columns.index(text_column)
    numbered = df.toDF(*(f"c{i}" for i in range(len(df.columns))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, rows):
                yield part.filter(pa.array(keep(part.column(at).to_pylist()), pa.bool_()))
        if done:
            done()
        give_back()

    return numbered.mapInArrow(run, numbered.schema).toDF(*df.columns)


def slices(batch: pa.RecordBatch, rows: int) -> Iterator[pa.RecordBatch]:
    for at in range(0, batch.num_rows, rows):
        part = batch.slice(at, rows)
        if part.num_rows > 1 and part.nbytes > SLICE_BYTES:
            yield from slices(part, (part.num_rows + 1) // 2)
        else:
            yield part


def _array(values: Any, kind: pa.DataType) -> pa.Array:
    return values.cast(kind) if isinstance(values, pa.Array) else pa.array(values, kind)


def _arrow_type(kind) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def crc_mod(id_column: str, by: int) -> Column:
    """crc32 of the id written as text, mod `by`: what splits documents into folds. Null ids are in fold 0."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string").cast("binary")) % by, F.lit(0))


def crc32(data: bytes) -> int:
    return zlib.crc32(data) & 0xFFFFFFFF


def require_small(count: int, limit: int, what: str) -> int:
    """Guards what is broadcast or brought to the driver: an error, never a silent cut."""
    if count > limit:
        raise ValueError(f"{what}: {count} is more than the documented bound of {limit}")
    return count
