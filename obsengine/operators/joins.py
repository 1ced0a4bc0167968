"""Joins of observations with what happens around them: context, bands, nearest in time, intervals, containment."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def in_context(rows: DataFrame, context: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rows whose keys occur in context."""
    return rows.join(context.select(*keys), list(keys), "left_semi")


def pending(rows: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rows whose keys aren't done yet."""
    return rows.join(done.select(*keys), list(keys), "left_anti")


def lookup(rows: DataFrame, table: DataFrame, keys: Sequence[str], defaults: dict[str, Column], last_by: str | None = None) -> DataFrame:
    """rows with the columns `defaults` of table, by keys; of several the last by `last_by`, of none the default."""
    values = F.struct(*defaults)
    chosen = table.groupBy(*keys).agg((F.max_by(values, last_by) if last_by else F.max(values)).alias("_v"))
    joined = rows.join(chosen, list(keys), "left")
    return joined.select(*rows.columns, *(F.coalesce(F.col(f"_v.{c}"), d).alias(c) for c, d in defaults.items()))


def band(left: DataFrame, right: DataFrame, keys: Sequence[str], left_time: str, right_time: str, half: float, how: str = "inner") -> DataFrame:
    """Pairs of equal keys whose times differ by at most `half`: an equi-join on time buckets of that width.

    right also goes into the two neighbouring buckets, so the join never compares a key's whole history.
    """
    l = left.withColumn("_bucket", F.floor(F.col(left_time) / half))
    b = F.floor(F.col(right_time) / half)
    r = right.withColumn("_bucket", F.explode(F.array(b - 1, b, b + 1)))
    on = [l[k] == r[k] for k in keys] + [l["_bucket"] == r["_bucket"], F.abs(l[left_time] - r[right_time]) <= half]
    condition = on[0]
    for c in on[1:]:
        condition = condition & c
    joined = l.join(r, condition, how)
    return joined.drop(*(r[k] for k in keys), l["_bucket"], r["_bucket"]) if how in ("inner", "left") else joined.drop("_bucket")


def nearest(left: DataFrame, right: DataFrame, keys: Sequence[str], left_time: str, right_time: str, right_id: str, within: float) -> DataFrame:
    """Each left row with the right row nearest in time and no further than `within`; the later on ties, then the larger id."""
    values = [c for c in right.columns if c not in keys]
    numbered = left.withColumn("_row", F.struct(*left.columns))
    pairs = band(numbered, right, keys, left_time, right_time, within)
    distance = F.abs(F.col(left_time) - F.col(right_time))
    best = pairs.groupBy("_row").agg(F.min_by(F.struct(*values), F.struct(distance, -F.col(right_time), -F.col(right_id))).alias("_best"))
    matched = best.select("_row.*", *(F.col(f"_best.{c}").alias(c) for c in values))
    same = [left[c].eqNullSafe(matched[c]) for c in left.columns]  # null columns match too
    return left.join(matched, same, "left").select(*(left[c] for c in left.columns), *values)


def active_at(moments: DataFrame, intervals: DataFrame, keys: Sequence[str], time: str, start: str, end: Column, step: float) -> DataFrame:
    """Pairs of a moment and an interval that holds it, ends included: by buckets of `step`, of which an interval is in several."""
    m = moments.withColumn("_bucket", F.floor(F.col(time) / step))
    i = intervals.withColumn("_end", end).withColumn(
        "_bucket", F.explode(F.sequence(F.floor(F.col(start) / step), F.floor(F.col("_end") / step)))
    )
    return m.join(i, [*keys, "_bucket"]).filter(F.col(time).between(F.col(start), F.col("_end"))).drop("_bucket", "_end")


def smallest_container(items: DataFrame, boxes: DataFrame, keys: Sequence[str], inside: Column, area: Column, item_id: str, box_id: str) -> DataFrame:
    """Each item with the smallest box that holds it, the first on ties; items in no box are left out."""
    pairs = items.join(boxes, list(keys)).filter(inside).withColumn("_area", area)
    best = Window.partitionBy(*keys, item_id).orderBy("_area", box_id)
    return pairs.withColumn("_r", F.row_number().over(best)).filter("_r = 1").drop("_r", "_area")


def fused(lists: dict[str, DataFrame], item: str, k: int = 60) -> DataFrame:
    """(item, rrf, first_list, first_rank): reciprocal-rank fusion of (item, rank) lists; ties go by the first list, then rank."""
    parts = [df.select(item, "rank", F.lit(i).alias("_list")) for i, df in enumerate(lists.values())]
    together = parts[0]
    for p in parts[1:]:
        together = together.unionByName(p)
    return together.groupBy(item).agg(
        F.sum(1.0 / (k + F.col("rank"))).alias("rrf"), F.min("_list").alias("first_list"), F.min_by("rank", "_list").alias("first_rank")
    )


def membership(rows: DataFrame, row_key: str, table: DataFrame, array: str) -> DataFrame:
    """Pairs where rows' key is an element of table's array: an equi-join on the exploded array."""
    exploded = table.withColumn(row_key, F.explode(F.array_distinct(array)))
    return rows.join(exploded, row_key)


def orphans(rows: DataFrame, key: str, parents: DataFrame, parent_key: str) -> DataFrame:
    """The rows whose non-null key has no parent: empty if references are whole."""
    return rows.filter(F.col(key).isNotNull()).join(parents.select(F.col(parent_key).alias(key)), key, "left_anti")
