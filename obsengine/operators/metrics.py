"""Detection and classification metrics as windows and grouped sums."""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from obsengine.operators.sequence import in_order
from obsengine.session import written


def average_precision(ranked: DataFrame, keys: Sequence[str], score: str, hit: str, row_id: str, truths: Column) -> DataFrame:
    """(keys, ap): area under the precision envelope over recall, all points; null without truths. A null key is a key.

    Ranks go through all keys' rows: stretches of the order are partitions, however many rows a key has. What lies before a stretch is
    added to its own counts, and the envelope of what follows to its own, by one row for each stretch and key.
    """
    same = lambda a, b: functools.reduce(lambda x, y: x & y, (F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in keys), F.lit(True))
    total = ranked.groupBy(*keys).agg(truths.alias("_truths"))
    rows = ranked.select(*keys, F.col(score).alias("_score"), F.col(row_id).alias("_id"), F.col(hit).cast("int").alias("_hit"))
    dealt = written(rows.repartitionByRange(*keys, F.desc("_score"), "_id").withColumn("_part", F.spark_partition_id()), "ranked")
    order = Window.partitionBy("_part", *keys).orderBy(F.desc("_score"), "_id")
    seen = order.rowsBetween(Window.unboundedPreceding, 0)
    local = dealt.withColumns({"_tp": F.coalesce(F.sum("_hit").over(seen), F.lit(0)), "_n": F.row_number().over(order)})
    sums = dealt.groupBy("_part", *keys).agg(F.coalesce(F.sum("_hit"), F.lit(0)).alias("_tp"), F.count("*").alias("_n"))
    past = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select("_part", *keys, *(F.coalesce(F.sum(c).over(past), F.lit(0)).alias(f"_past{c}") for c in ("_tp", "_n")))
    placed = local.filter("_hit = 1").alias("l").join(before.alias("b"), same("l", "b") & (F.col("l._part") == F.col("b._part")))
    precision = (F.col("_tp") + F.col("_past_tp")) / (F.col("_n") + F.col("_past_n"))  # highest at hits: those between them lower it only
    curve = placed.select("l._part", *(F.col(f"l.{k}").alias(k) for k in keys), F.col("_n"), precision.alias("_p"))
    heights = curve.groupBy("_part", *keys).agg(F.max("_p").alias("_top"))
    coming = Window.partitionBy(*keys).orderBy(F.desc("_part")).rowsBetween(Window.unboundedPreceding, -1)
    ahead = heights.select("_part", *keys, F.max("_top").over(coming).alias("_ahead"))
    # from the last row on: a frame of all that follows would be gone through anew for every row
    envelope = F.max("_p").over(Window.partitionBy("_part", *keys).orderBy(F.desc("_n")).rowsBetween(Window.unboundedPreceding, 0))
    raised = curve.withColumn("_p", envelope).alias("l").join(ahead.alias("a"), same("l", "a") & (F.col("l._part") == F.col("a._part")))
    gained = raised.groupBy(*(F.col(f"l.{k}").alias(k) for k in keys)).agg(F.sum(F.greatest("_p", "_ahead")).alias("_area"))
    ap = F.when(F.col("_truths") > 0, F.coalesce("_area", F.lit(0.0)) / F.col("_truths")).alias("ap")
    return total.alias("t").join(gained.alias("g"), same("t", "g"), "left").select(*(F.col(f"t.{k}").alias(k) for k in keys), ap)


def precision_recall(df: DataFrame, keys: Sequence[str], predicted: Column, actual: Column) -> DataFrame:
    """(keys, precision, recall): null where nothing is predicted, or nothing is there."""
    tp = F.count_if(predicted & actual).cast("double")
    return df.groupBy(*keys).agg(F.try_divide(tp, F.count_if(predicted)).alias("precision"), F.try_divide(tp, F.count_if(actual)).alias("recall"))


def calibration_error(df: DataFrame, keys: Sequence[str], confidence: str, correct: Column, bins: int = 10) -> DataFrame:
    """(keys, ece): over bins (low, high] of the confidence; a confidence of 0 is in none, but counts in the total."""
    total = df.groupBy(*keys).agg(F.count("*").alias("_all"))
    binned = df.filter(F.col(confidence) > 0).withColumn("_bin", F.ceil(F.col(confidence) * bins))
    parts = binned.groupBy(*keys, "_bin").agg(F.count("*").alias("_n"), F.abs(F.avg(correct.cast("double")) - F.avg(confidence)).alias("_gap"))
    return parts.join(total, list(keys)).groupBy(*keys).agg((F.sum(F.col("_n") * F.col("_gap")) / F.max("_all")).alias("ece"))


def binary_report(df: DataFrame, keys: Sequence[str], predicted: str, actual: str) -> DataFrame:
    """(keys, n, precision, recall and f1 of 0 and of 1, macro_f1, abstained): predictions of 0 and 1, null for abstaining, which counts as a miss.

    0 where nothing is predicted, or nothing is there.
    """
    p, a = F.col(predicted), F.col(actual)
    hits = {c: F.count_if((p == c) & (a == c)).cast("double") for c in (0, 1)}
    share = lambda c, of: F.coalesce(F.try_divide(hits[c], of), F.lit(0.0))
    measures = [F.count("*").alias("n")]
    for c in (0, 1):
        measures += [share(c, F.count_if(p == c)).alias(f"precision_{c}"), share(c, F.count_if(a == c)).alias(f"recall_{c}")]
        measures.append(F.coalesce(F.try_divide(2 * hits[c], F.count_if(p == c) + F.count_if(a == c)), F.lit(0.0)).alias(f"f1_{c}"))
    out = df.groupBy(*keys).agg(*measures, F.try_divide(F.count_if(p.isNull()).cast("double"), F.count("*")).alias("abstained"))
    return out.withColumn("macro_f1", (F.col("f1_0") + F.col("f1_1")) / 2)


class GreedyMatch:
    """Truths come first, then detections from the most confident on; each takes the free truth that it overlaps most."""

    def __init__(self, least: float):
        self.least = least

    def start(self):
        return {}

    def step(self, key, free, row):
        if row.kind == 0:
            free[row.id] = row.box
            return free, []
        best = max(((overlap(row.box, b), i) for i, b in free.items()), default=(0.0, None))
        if best[1] is None or best[0] < self.least:
            return free, []
        del free[best[1]]
        return free, [(*key, row.id, best[1])]

    def end(self, key, free):
        return []


def greedy_match(detections: DataFrame, truths: DataFrame, image: str, least: float = 0.5) -> DataFrame:
    """(image, det_id, truth_id): one to one, by GreedyMatch. Of truths with equal overlap the later, by id, is taken."""
    d = detections.select(image, F.col("det_id").alias("id"), (-F.col("confidence")).alias("turn"), "box", F.lit(1).alias("kind"))
    g = truths.select(image, F.col("truth_id").alias("id"), F.lit(0.0).alias("turn"), "box", F.lit(0).alias("kind"))
    types = dict(d.dtypes)
    schema = f"{image} {types[image]}, det_id {types['id']}, truth_id {types['id']}"
    return in_order(d.unionByName(g), [image], ["kind", "turn", "id", "box"], GreedyMatch(least), schema)


def overlap(a: dict, b: dict) -> float:
    w = max(0.0, min(a["x2"], b["x2"]) - max(a["x1"], b["x1"]))
    h = max(0.0, min(a["y2"], b["y2"]) - max(a["y1"], b["y1"]))
    union = (a["x2"] - a["x1"]) * (a["y2"] - a["y1"]) + (b["x2"] - b["x1"]) * (b["y2"] - b["y1"]) - w * h
    return w * h / union if union > 0 else 0.0


def promoted(criteria: DataFrame, keys: Sequence[str], passed: str) -> DataFrame:
    """(keys, promoted, unmeasured): only if every criterion is measured and passed."""
    return criteria.groupBy(*keys).agg(F.bool_and(F.coalesce(passed, F.lit(False))).alias("promoted"), F.count_if(F.col(passed).isNull()).alias("unmeasured"))
