"""Sinks: JSON lines and documents, resumable appends, keyed upserts, reports."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from obsengine.functions.text import html_escaped
from obsengine.operators.joins import pending
from obsengine.operators.review import predicted
from obsengine.operators.selection import upserted
from obsengine.sources.readers import cached, json_lines


def write_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_splits(df: DataFrame, path: str, split: str = "split") -> None:
    df.write.mode("overwrite").partitionBy(split).json(path)


def write_sheet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def append_pending(todo: DataFrame, work, path: str, key: str, columns: str) -> DataFrame:
    """Appends work(rows) for the rows of todo whose key isn't at path yet; returns what was pending."""
    left = pending(todo, json_lines(todo.sparkSession, path, columns), [key])
    work(left).write.mode("append").json(path)
    return left


def through_cache(rows: DataFrame, path: str, key: Column, load: Callable, values: str) -> DataFrame:
    """(key, values) for rows: what the cache at path lacks is asked of the model, each key once, and appended before anything is returned.

    A model that fails leaves the cache as it was; lines of the cache that can't be parsed are misses.
    """
    spark = rows.sparkSession
    columns = f"key string, {values}"
    keyed = rows.select(key.alias("key"), *rows.columns)
    known = json_lines(spark, path, f"{columns}, _corrupt_record string").filter("_corrupt_record IS NULL").select("key")
    fresh = pending(keyed, known, ["key"]).filter("key IS NOT NULL").dropDuplicates(["key"])
    predicted(fresh, load, columns).write.mode("append").json(path)
    return cached(spark, path, columns).join(keyed.select("key").distinct(), "key", "left_semi")


def upsert(new: DataFrame, path: str, target: str, keys: list[str], sequence: str) -> None:
    """Writes at target the table at path (none at first) with new rows over old ones of equal keys."""
    old = json_lines(new.sparkSession, path, ", ".join(f"{n} {t}" for n, t in new.dtypes))
    upserted(old, new, keys, sequence).write.mode("overwrite").json(target)


def upsert_jdbc(df: DataFrame, table: str, keys: list[str], connect) -> None:
    """INSERT ... ON CONFLICT by partition; connect() gives a DB-API connection on the executor."""
    names = df.columns
    sets = ", ".join(f"{c} = excluded.{c}" for c in names if c not in keys)
    marks = ", ".join(["%s"] * len(names))
    sql = f"INSERT INTO {table} ({', '.join(names)}) VALUES ({marks}) ON CONFLICT ({', '.join(keys)}) DO UPDATE SET {sets}"

    def send(rows) -> None:
        connection = connect()
        with connection, connection.cursor() as cursor:
            cursor.executemany(sql, [tuple(r) for r in rows])
        connection.close()

    df.foreachPartition(send)


def report_rows(incidents: DataFrame) -> DataFrame:
    """(run_id, html): one escaped table row for each incident."""
    cells = [F.concat(F.lit("<td>"), html_escaped(F.coalesce(F.col(c).cast("string"), F.lit(""))), F.lit("</td>")) for c in ("rule_id", "severity", "canonical_track_id", "first_seen_s", "confidence")]
    return incidents.select("run_id", "incident_id", F.concat(F.lit("<tr>"), *cells, F.lit("</tr>")).alias("html"))
