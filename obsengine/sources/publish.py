"""Publishing: several tables as one version, which readers see whole or not at all.

A version is a manifest, a small JSON file that names the folder of each table and its rows. Tables are written to new folders, counted
again from what was written, and only then is the next manifest created, in one step that fails if another writer was first. Readers go by
the highest manifest. So a failed count, a refused row or a lost driver leaves the version before as it was.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Part:
    """What is published of a table: rows over old ones of equal keys. Rows without one of the `required` columns are refused."""

    rows: DataFrame
    keys: tuple[str, ...]
    required: tuple[str, ...] = ()


def _folder(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def manifest(spark: SparkSession, target: str) -> dict:
    """The version that readers see: {version, tables: {name: {path, rows}}}; version 0 without tables if nothing is published."""
    store, at = _folder(spark, target)
    names = [f.getPath().getName() for f in store.listStatus(at)] if store.exists(at) else []
    versions = sorted(int(n.removeprefix("manifest-").removesuffix(".json")) for n in names if n.startswith("manifest-") and n.endswith(".json"))
    if not versions:
        return {"version": 0, "tables": {}}
    (row,) = spark.read.option("wholetext", True).text(f"{target}/manifest-{versions[-1]:08d}.json").collect()
    return json.loads(row[0])


def published(spark: SparkSession, target: str, name: str) -> DataFrame:
    """A table of the version that readers see now."""
    return spark.read.parquet(manifest(spark, target)["tables"][name]["path"])


def _commit(spark: SparkSession, target: str, content: dict) -> None:
    path = f"{target}/manifest-{content['version']:08d}.json"
    store, at = _folder(spark, path)
    out = store.create(at, False)  # an error if another writer was first
    out.write(bytearray(json.dumps(content), "utf-8"))
    out.close()


def _counted(spark: SparkSession, path: str) -> int:
    return spark.read.parquet(path).count()


def publish(spark: SparkSession, target: str, parts: Mapping[str, Part], dry_run: bool = False) -> dict[str, int]:
    """Rows written of each table; those without any are skipped, and keep what they have. With dry_run, what would be written, and nothing is.

    Refused are rows without a required column, and two rows of one key: an error, after which the old version stands.
    """
    now = manifest(spark, target)
    tables, found = dict(now["tables"]), {}
    for name, part in parts.items():
        counted = part.rows.groupBy(*part.keys).agg(F.count("*").alias("n"), F.count_if(lacks(part.required)).alias("bad"))
        n, bad, twice = counted.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("bad"), F.lit(0)), F.count_if(F.col("n") > 1)).first()
        if bad or twice:
            raise ValueError(f"{name}: refused, {bad} rows without {', '.join(part.required)}, {twice} keys with several rows")
        found[name] = n
    if dry_run:
        return found
    for name, part in parts.items():
        if not found[name]:
            continue
        rows = part.rows
        if name in tables:
            old = spark.read.parquet(tables[name]["path"])
            rows = rows.unionByName(old.join(rows.select(*part.keys), list(part.keys), "left_anti"), allowMissingColumns=True)
        path, seen = f"{target}/{name}-{uuid.uuid4().hex}", Observation()
        rows.observe(seen, F.count("*").alias("n")).write.parquet(path)
        if (there := _counted(spark, path)) != seen.get["n"]:
            raise RuntimeError(f"{name}: {there} rows are there, {seen.get['n']} were written; the version before stands")
        tables[name] = {"path": path, "rows": there}
    _commit(spark, target, {"version": now["version"] + 1, "tables": tables})
    return found


def lacks(columns: tuple[str, ...]):
    """Whether any of the columns is null."""
    missing = F.lit(False)
    for c in columns:
        missing |= F.col(c).isNull()
    return missing
