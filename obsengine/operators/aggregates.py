"""Aggregates with explicit ties, three-valued roll-ups, and quantiles of both kinds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def mode(df: DataFrame, keys: Sequence[str], value: str, first_by: str) -> DataFrame:
    """(keys, value, n): the most frequent value, the one seen first on ties."""
    counts = df.groupBy(*keys, value).agg(F.count("*").alias("n"), F.min(first_by).alias("_first"))
    return counts.groupBy(*keys).agg(F.max_by(F.struct(value, "n"), F.struct("n", -F.col("_first"))).alias("_m")).select(*keys, f"_m.{value}", "_m.n")


def majority(value: Column) -> Column:
    """True or false if strictly over half of all rows, nulls included, say so; else null."""
    n = F.count("*")
    return F.when(2 * F.count_if(value) > n, True).when(2 * F.count_if(~value) > n, False)


def nearest_rank(df: DataFrame, keys: Sequence[str], value: str, share: float) -> DataFrame:
    """(keys, quantile): sorted[min(n - 1, int(n * share))], counting from zero."""
    w = Window.partitionBy(*keys)
    ranked = df.withColumn("_i", F.row_number().over(w.orderBy(value)) - 1).withColumn("_n", F.count("*").over(w))
    at = F.least(F.col("_n") - 1, F.floor(F.col("_n") * F.lit(share)))
    return ranked.filter(F.col("_i") == at).select(*keys, F.col(value).alias("quantile"))


def linear_quantiles(df: DataFrame, keys: Sequence[str], value: str, shares: dict[str, float]) -> DataFrame:
    """(keys, a column for each share): quantiles between the two nearest ranks, nulls left out.

    Values are counted first, so that only distinct ones are ranked, in a window that sorts and spills; nothing holds a
    group in memory, as the built-in exact percentile does.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_n"))
    up_to = F.sum("_n").over(Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    totals = counts.groupBy(*keys).agg(F.sum("_n").alias("_all"))
    ranked = counts.withColumn("_up", up_to).join(totals, list(keys))
    columns = []
    for name, share in shares.items():
        place = share * (F.col("_all") - 1)
        at = lambda i: F.min(F.when(F.col("_up") > i, F.col(value)))
        low, part = at(F.floor(place)), F.max(place - F.floor(place))
        columns.append((low + part * (F.coalesce(at(F.floor(place) + 1), low) - low)).alias(name))
    return ranked.groupBy(*keys).agg(*columns)


def rolled_up(statuses: DataFrame, keys: Sequence[str], status: str) -> DataFrame:
    """(keys, status, reason): an alert wins, then what stayed below the debounce; all without evidence is inconclusive."""
    some = lambda v: F.coalesce(F.bool_or(F.col(status) == v), F.lit(False))
    alert, below = some("alert"), some("below_debounce")
    blind = F.coalesce(F.bool_and(F.col(status) == "no_evidence"), F.lit(True))
    return statuses.groupBy(*keys).agg(
        F.when(alert, "alert").when(below | blind, "inconclusive").otherwise("clear").alias("status"),
        F.when(alert, "detected").when(below, "below_debounce").when(blind, "no_evidence").otherwise("none_detected").alias("reason"),
    )


def leakage(df: DataFrame, value: str, split: str) -> DataFrame:
    """(leaked): number of values found in more than one split."""
    seen = df.groupBy(value).agg(F.count_distinct(split).alias("n"))
    return seen.agg(F.count_if(F.col("n") > 1).alias("leaked"))


def rate(condition: Column, base: Column | None = None) -> Column:
    """Share of the base's rows that meet the condition, to four decimals; null on an empty base."""
    hits = F.count_if(condition if base is None else condition & base)
    return F.round(F.try_divide(hits.cast("double"), F.count("*") if base is None else F.count_if(base)), 4)


def class_weights(df: DataFrame, label: str, cap: float = 3.0) -> DataFrame:
    """(label, n, weight): the square root of how much rarer than the most frequent label, up to a cap."""
    counts = df.groupBy(label).agg(F.count("*").alias("n"))
    most = counts.agg(F.max("n").alias("_most"))
    return counts.join(F.broadcast(most)).select(label, "n", F.least(F.sqrt(F.col("_most") / F.col("n")), F.lit(cap)).alias("weight"))
