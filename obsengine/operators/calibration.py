"""Temperatures of classifier heads: one scalar each, that divides its logits, fitted to the labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from obsengine.session import written

#: Bounds of a temperature, and the label of rows that don't count. Fixed values.
COLDEST, HOTTEST, IGNORED = 0.25, 10.0, -1
#: Places that a pass looks at, and passes: the bracket shrinks to 1 / (PLACES + 1) by each.
PLACES, PASSES = 16, 6


def slope(logits: Column, label: Column, b: Column) -> Column:
    """Derivative of a row's cross-entropy by b, the inverse temperature: the mean logit under the softmax of b times the logits, less the label's own.

    It grows with b, whatever the logits.
    """
    top = F.array_max(logits)
    zero = F.struct(F.lit(0.0).alias("w"), F.lit(0.0).alias("z"))

    def add(s: Column, z: Column) -> Column:
        weight = F.exp(b * (z - top))
        return F.struct((s["w"] + weight).alias("w"), (s["z"] + weight * z).alias("z"))

    return F.aggregate(logits, zero, add, lambda s: s["z"] / s["w"]) - F.element_at(logits, label + 1)


def temperatures(rows: DataFrame, head: str, logits: str, label: str) -> DataFrame:
    """(head, n, temperature) that makes the cross-entropy of the head's labelled rows least, within COLDEST and HOTTEST.

    The loss is convex in the inverse temperature, so the sign of its slope says on which side the least lies. Each pass over
    the rows sums the slopes at PLACES inside of each head's bracket; heads are fitted together, a row is never sent anywhere, and what a pass leaves is one row a head.
    Labels count from 0; rows without label or logits, or whose label is IGNORED, don't count, and heads without others are left out. A null head is a head.
    Where the slope is 0 everywhere (all logits alike) the temperature is COLDEST.
    """
    z = F.transform(logits, lambda x: x.cast("double"))
    known = rows.select(F.col(head).alias("head"), z.alias("z"), F.col(label).cast("int").alias("y")).filter((F.col("y") != IGNORED) & F.col("z").isNotNull())
    known = written(known, "labelled-logits")
    brackets = known.groupBy("head").agg(F.count("*").alias("n")).withColumns({"low": F.lit(1 / HOTTEST), "high": F.lit(1 / COLDEST)})
    for _ in range(PASSES):
        brackets = written(brackets, "temperature-brackets")
        step = (F.col("high") - F.col("low")) / (PLACES + 1)
        asked = brackets.withColumn("places", F.transform(F.sequence(F.lit(1), F.lit(PLACES)), lambda k: F.col("low") + k * step))
        named = asked.select(F.col("head").alias("_head"), "places")
        met = known.join(named, F.col("head").eqNullSafe(F.col("_head"))).drop("_head")
        slopes = met.select("head", F.posexplode(F.transform("places", lambda b: slope(F.col("z"), F.col("y"), b))).alias("at", "slope"))
        signs = slopes.groupBy("head", "at").agg(F.sum("slope").alias("slope"))
        uphill = signs.groupBy("head").agg(F.coalesce(F.min(F.when(F.col("slope") > 0, F.col("at"))), F.lit(PLACES)).alias("first"))
        moved = asked.join(uphill.withColumnRenamed("head", "_head"), F.col("head").eqNullSafe(F.col("_head")))
        brackets = moved.select("head", "n", (F.col("low") + F.col("first") * step).alias("low"), (F.col("low") + (F.col("first") + 1) * step).alias("high"))
    return brackets.select(F.col("head").alias(head), "n", (2 / (F.col("low") + F.col("high"))).alias("temperature"))
