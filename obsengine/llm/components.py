"""Connected components of a table of links, by alternating large and small stars.

Every round is two grouped minima and two joins over the links, written as a table in the shared folder, so
that lost executors cost at most one round. Minima are combined before they are shuffled and the joins are
plain equi-joins, whose hot keys (hubs) Spark splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from obsengine.llm.common import dropped, staged

MOST_ROUNDS = 100


def _hang(links: DataFrame, larger: bool) -> DataFrame:
    """One star operation: each node's larger (or smaller) neighbours, and itself, get linked to its smallest neighbour."""
    if larger:
        both = links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    hung = both.join(least, "u")
    if larger:
        out = hung.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = hung.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return out.filter("u != v").distinct()


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """(node, root) for each node of links (u long, v long): root is the smallest node that it is linked to, by any path.

    Links of a node to itself are left out, as are those with a null end; no links give an empty table.
    """
    now = staged(links.select(F.col("u").cast("long"), F.col("v").cast("long")).filter("u != v"), name)
    before = None
    for _ in range(MOST_ROUNDS):
        last, now = now, staged(_hang(_hang(now, True), False), name)
        dropped(last)
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
                now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            )
        before = state
    raise RuntimeError(f"components did not settle in {MOST_ROUNDS} rounds")
