"""Top rows under a budget, deterministic samples and splits, first-wins de-duplication, keyed upserts."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

def budgeted(df: DataFrame, keys: Sequence[str], order: Sequence[Column], budget: int) -> DataFrame:
    """df with `rank` in the order and `reviewed` for the first `budget` of each key."""
    ranked = df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.withColumn("reviewed", F.col("rank") <= budget)


def hash_order(value: Column, seed: int) -> Column:
    """A reproducible shuffle: the hex SHA-256 of `seed:value`."""
    return F.sha2(F.concat_ws(":", F.lit(str(seed)), value.cast("string")), 256)


def grouped_split(df: DataFrame, group: str, ratios: dict[str, float], seed: int) -> DataFrame:
    """(group, n, split): whole groups, in hash order, each to the split that is furthest below its share, the first on ties.

    Each choice depends on the counts so far, so the counted groups stream through one task, which keeps a sum for each split.
    """
    names = list(ratios)
    want = df.count() * np.array(list(ratios.values())) / sum(ratios.values())
    sizes = df.groupBy(group).agg(F.count("*").alias("n")).withColumn("_h", hash_order(F.col(group), seed))

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        have = np.zeros(len(names))
        for frame in frames:
            splits = []
            for n in frame["n"]:
                at = int((want - have).argmax())
                have[at] += n
                splits.append(names[at])
            yield frame[[group, "n"]].assign(split=splits)

    kind = dict(sizes.dtypes)[group]
    return sizes.repartition(1).sortWithinPartitions("_h").mapInPandas(fold, f"`{group}` {kind}, n long, split string")


def first_copies(df: DataFrame, content: Column, order: Sequence[str]) -> DataFrame:
    """df with `copy`: 1 for the first row of each content by the order, then on."""
    return df.withColumn("copy", F.row_number().over(Window.partitionBy(F.sha2(content, 256)).orderBy(*order)))


def upserted(old: DataFrame, new: DataFrame, keys: Sequence[str], sequence: str) -> DataFrame:
    """One row for each key: new over old, of several new ones the last by the sequence."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    last = both.groupBy(*keys).agg(F.max_by(F.struct(*old.columns), F.struct("_new", sequence)).alias("_r"))
    return last.select("_r.*")
