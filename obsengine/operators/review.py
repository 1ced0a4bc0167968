"""Model seams and the review of findings: predictions in Arrow batches, cached verdicts, verdicts that patch rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from obsengine.operators.joins import band, pending


def predicted(rows: DataFrame, load: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]], schema: str) -> DataFrame:
    """A model over rows: load() once for each task that has rows, then its predictions batch by batch."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = None
        for frame in frames:
            if len(frame):
                model = model or load()
                yield model(frame)

    return rows.mapInPandas(run, schema)


def with_cache(rows: DataFrame, cache: DataFrame, key: Column, load: Callable, values: str) -> DataFrame:
    """(key, values) for rows: from the cache where it has the key, else from the model, each key once."""
    keyed = rows.withColumn("key", key)
    fresh = pending(keyed, cache, ["key"]).dropDuplicates(["key"])
    found = predicted(fresh, load, f"key string, {values}")
    known = cache.join(keyed.select("key").distinct(), "key", "left_semi").select(found.columns)
    return known.unionByName(found)


def patched(rows: DataFrame, verdicts: DataFrame, keys: Sequence[str], time: str, at: str, half: float, state: str, unsure: str = "unknown") -> DataFrame:
    """rows with `state` overridden by the last definite verdict within `half` of them, and `overridden`.

    verdicts (keys, at, verdict_id, verdict). An unsure verdict changes nothing; one that agrees leaves the row as it was.
    """
    numbered = rows.withColumn("_row", F.struct(*rows.columns))  # a row is named by itself: rows that are alike get the same verdict
    definite = verdicts.filter(F.col("verdict") != unsure).select(*keys, at, "verdict_id", "verdict")
    pairs = band(numbered.select(*keys, time, "_row").distinct(), definite, keys, time, at, half)
    last = pairs.groupBy("_row").agg(F.max_by("verdict", F.struct(at, "verdict_id")).alias("_verdict"))
    joined = numbered.join(last, "_row", "left")
    changed = F.col("_verdict").isNotNull() & ~F.col("_verdict").eqNullSafe(F.col(state))
    kept = [F.when(changed, F.col("_verdict")).otherwise(F.col(c)).alias(c) if c == state else F.col(c) for c in rows.columns]
    return joined.select(*kept, changed.alias("overridden"))


def single_vote(df: DataFrame, keys: Sequence[str], vote: str, ignore: int = -100) -> DataFrame:
    """(keys, label): what all votes agree on; `ignore` if they conflict."""
    return df.groupBy(*keys).agg(F.when(F.count_distinct(vote) == 1, F.min(vote)).otherwise(F.lit(ignore)).alias("label"))


def review_plan(crops: DataFrame, keys: Sequence[str], height: str, order: Sequence[Column], least: float = 160.0) -> DataFrame:
    """crops with their `route`: reviewed, over the budget of 12, or too small."""
    from obsengine.operators.selection import budgeted

    large = budgeted(crops.filter(F.col(height) >= least), keys, order, 12)
    routed = large.select(*crops.columns, F.when(F.col("reviewed"), "review").otherwise("over_budget").alias("route"))
    return routed.unionByName(crops.filter(~(F.col(height) >= least)).withColumn("route", F.lit("too_small")))
