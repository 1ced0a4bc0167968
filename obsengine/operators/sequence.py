"""Operators on a key's rows in order of time: runs, recursive state, trailing ranges, spacing, thinning.

Times are numbers. Runs are found within blocks of time first and stitched by their ends, so that a key with very
many rows is spread over tasks, and only its block summaries meet. Folds (spacing, anchored segments)
depend on what was kept before, so they take a key's rows in order, one Arrow batch after the other.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from obsengine.operators.aggregates import linear_quantiles


def runs(df: DataFrame, keys: Sequence[str], time: str, max_gap: float, block: float | None = None) -> DataFrame:
    """(keys, first, last, n): maximal chains whose neighbours are at most max_gap apart, the gap included."""
    length = block or 100 * max_gap
    rows = df.select(*keys, F.col(time).alias("_t"), F.floor(F.col(time) / length).alias("_block"))
    in_block = Window.partitionBy(*keys, "_block").orderBy("_t")
    fresh = F.when(F.col("_t") - F.lag("_t").over(in_block) <= max_gap, 0).otherwise(1)
    local = rows.withColumn("_fresh", fresh).withColumn("_run", F.sum("_fresh").over(in_block.rowsBetween(Window.unboundedPreceding, 0)))
    parts = local.groupBy(*keys, "_block", "_run").agg(F.min("_t").alias("first"), F.max("_t").alias("last"), F.count("*").alias("n"))
    by_key = Window.partitionBy(*keys).orderBy("first")
    fresh = F.when(F.col("first") - F.lag("last").over(by_key) <= max_gap, 0).otherwise(1)
    joined = parts.withColumn("_fresh", fresh).withColumn("_chain", F.sum("_fresh").over(by_key.rowsBetween(Window.unboundedPreceding, 0)))
    return joined.groupBy(*keys, "_chain").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.sum("n").alias("n")).drop("_chain")


def longest_run(df: DataFrame, keys: Sequence[str], time: str, max_gap: float, block: float | None = None) -> DataFrame:
    """(keys, first, last, span): each key's longest run, the earliest on ties; if all are points, the first point."""
    best = runs(df, keys, time, max_gap, block).groupBy(*keys).agg(
        F.min_by(F.struct("first", "last"), F.struct(F.col("first") - F.col("last"), "first")).alias("r")
    )
    return best.select(*keys, F.col("r.first").alias("first"), F.col("r.last").alias("last"), (F.col("r.last") - F.col("r.first")).alias("span"))


def debounced(df: DataFrame, keys: Sequence[str], time: str, debounce: float) -> DataFrame:
    """The longest runs, at gaps of up to twice the debounce, that last at least the debounce."""
    return longest_run(df, keys, time, 2 * debounce).filter(F.col("span") >= debounce)


def ordered_list(order: Sequence[str], value: Column) -> Column:
    """A group's values in the order of the named columns."""
    packed = F.array_sort(F.collect_list(F.struct(*order, value.alias("_v"))))
    return F.transform(packed, lambda r: r["_v"])


def recursive_average(values: Column, alpha: float) -> Column:
    """Exponential average of an ordered array: the first value starts it, then (1 - alpha) e + alpha x."""
    start = F.struct(F.lit(None).cast("double").alias("e"), F.lit(0).alias("n"))
    step = lambda s, x: F.struct(F.when(s["n"] == 0, x).otherwise((1 - alpha) * s["e"] + alpha * x).alias("e"), (s["n"] + 1).alias("n"))
    return F.aggregate(values, start, step, lambda s: s["e"])


def last_average(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, alpha: float) -> DataFrame:
    """(keys, n, average): the recursive average after each key's last row.

    Weights fall by 1 - alpha a row, so that beyond the last `reach` rows they are below a double's precision: no more
    rows of a key are sorted into place, however many it has (a rank limit, which Spark also applies before shuffling).
    """
    reach = max(2, math.ceil(math.log(1e-20) / math.log(1 - alpha))) if alpha < 1 else 2
    counts = df.groupBy(*keys).agg(F.count("*").alias("n"))
    newest = Window.partitionBy(*keys).orderBy(*(F.desc(c) for c in order))
    tail = df.select(*keys, *order, F.col(value).alias("_v")).withColumn("_r", F.row_number().over(newest)).filter(F.col("_r") <= reach)
    weight = F.pow(F.lit(1 - alpha), F.col("_r") - 1) * F.when(F.col("_r") == F.col("n"), 1.0).otherwise(alpha)
    return tail.join(counts, list(keys)).groupBy(*keys).agg(F.max("n").alias("n"), F.sum(weight * F.col("_v")).alias("average"))


def gated_state(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, accepted: Column, alpha: float, least: int, floor: float) -> DataFrame:
    """(keys, n, average, state): `yes` or `no` only from `least` accepted values on, and beyond the confidence floor."""
    known = last_average(df.filter(accepted), keys, order, value, alpha)
    enough = (F.col("n") >= least) & (F.greatest("average", 1 - F.col("average")) >= floor)
    return known.withColumn("state", F.when(enough & (F.col("average") >= 0.5), "yes").when(enough, "no").otherwise("unknown"))


def carry_forward(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column, name: str) -> DataFrame:
    """Each row with the last non-null value up to it."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.last(value, ignorenulls=True).over(w))


def every_kth_moment(df: DataFrame, run: Sequence[str], order: str, k: int) -> DataFrame:
    """The rows of every k-th distinct moment of a run, whatever their keys; moments without rows don't count."""
    moments = df.select(*run, order).distinct()
    numbered = moments.withColumn("_n", F.row_number().over(Window.partitionBy(*run).orderBy(order)) - 1)
    return df.join(numbered.filter(F.pmod("_n", F.lit(k)) == 0).drop("_n"), [*run, order], "left_semi")


def median_of(values: Column) -> Column:
    """Median of a non-empty array, between the middle two if they are two."""
    n, s = F.size(values), F.array_sort(values)
    at = lambda i: F.element_at(s, i.cast("int"))
    return (at(F.floor((n + 1) / 2)) + at(F.floor(n / 2) + 1)) / 2


def trailing_motion(df: DataFrame, keys: Sequence[str], time: str, x: str, y: str, length: int) -> DataFrame:
    """Each row with the count of its trailing range (length of whole time units, ends included) and the shift from the
    medians of that range's first third to those of its last.

    Blocks of time are partitions; rows also go into the next block as its past, so a busy key is spread.
    """
    wide = 50 * length
    base = df.withColumn("_block", F.floor(F.col(time) / wide))
    late = F.col(time) - F.col("_block") * wide >= wide - length
    copies = F.when(late, F.array(F.col("_block"), F.col("_block") + 1)).otherwise(F.array("_block"))
    spread = base.withColumn("_at", F.explode(copies))
    w = Window.partitionBy(*keys, "_at").orderBy(time).rangeBetween(-length, 0)
    lists = spread.withColumn("_r", F.array_sort(F.collect_list(F.struct(F.col(time).alias("t"), F.col(x).alias("x"), F.col(y).alias("y"))).over(w)))
    n = F.size("_r")
    third = F.greatest(F.lit(1), F.floor(n / 3)).cast("int")
    part = lambda name, start: median_of(F.transform(F.slice("_r", start, third), lambda r: r[name]))
    moved = F.hypot(part("x", n - third + 1) - part("x", F.lit(1)), part("y", n - third + 1) - part("y", F.lit(1)))
    return lists.filter("_at = _block").select(*df.columns, n.alias("n_trailing"), moved.alias("displacement"))


def operating_state(moved: DataFrame, seconds: float, speed: float = 0.15, displacement: float = 0.25, least: int = 4) -> DataFrame:
    """`active` where the trailing range has enough rows and moves fast or far enough, else `unknown`."""
    active = (F.col("n_trailing") >= least) & ((F.col("displacement") / seconds >= speed) | (F.col("displacement") >= displacement))
    return moved.withColumn("operating_state", F.when(active, "active").otherwise("unknown"))


def in_order(df: DataFrame, keys: Sequence[str], order: Sequence[str], fold, schema: str) -> DataFrame:
    """fold(key, batches) over each key's rows in order, as Arrow batches of bounded size; one task a key."""
    ordered = df.repartition(*keys).sortWithinPartitions(*keys, *order)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state, last = None, None
        for frame in frames:
            out = []
            for row in frame.itertuples(index=False):
                key = tuple(getattr(row, k) for k in keys)
                if key != last:
                    if last is not None:
                        out += fold.end(last, state)
                    state, last = fold.start(), key
                state, rows = fold.step(key, state, row)
                out += rows
            yield pd.DataFrame(out, columns=names)
        if last is not None:
            yield pd.DataFrame(fold.end(last, state), columns=names)

    names = [f.split()[0] for f in schema.split(", ")]
    return ordered.mapInPandas(run, schema)


class Spacing:
    """Keeps a row if it is at least `spacing` after the last one kept."""

    def __init__(self, spacing: float):
        self.spacing = spacing

    def start(self):
        return None

    def step(self, key, state, row):
        if state is None or row.t - state >= self.spacing:
            return row.t, [(*key, row.id, row.t)]
        return state, []

    def end(self, key, state):
        return []


class AnchoredSegments:
    """Closes a segment at the first row further than `tolerance` from its anchor, which then anchors the next."""

    def __init__(self, tolerance: float, least: float):
        self.tolerance, self.least = tolerance, least

    def start(self):
        return None

    def step(self, key, state, row):
        if state is None:
            return (row.v, row.t, row.t, 1), []
        anchor, first, last, n = state
        if abs(row.v - anchor) > self.tolerance:
            return (row.v, row.t, row.t, 1), self.end(key, state)
        return (anchor, first, row.t, n + 1), []

    def end(self, key, state):
        _, first, last, n = state
        return [(*key, first, last, n)] if last - first >= self.least else []


def greedy_spacing(df: DataFrame, keys: Sequence[str], time: str, row_id: str, spacing: float) -> DataFrame:
    """(keys, id, t) of the rows kept: each at least `spacing` after the one kept before it."""
    rows = df.select(*keys, F.col(row_id).alias("id"), F.col(time).alias("t"))
    types = dict(rows.dtypes)
    schema = ", ".join(f"{c} {types[c]}" for c in rows.columns)
    return in_order(rows, keys, ["t", "id"], Spacing(spacing), schema)


def throttled(df: DataFrame, keys: Sequence[str], time: str, row_id: str, usable: Column, spacing: float) -> DataFrame:
    """(keys, id, t) of usable rows, each at least `spacing` after the one kept before it: others are left out, and don't move the clock."""
    return greedy_spacing(df.filter(F.coalesce(usable, F.lit(False))), keys, time, row_id, spacing)


def anchored_segments(df: DataFrame, keys: Sequence[str], time: str, value: str, tolerance: float, least: float) -> DataFrame:
    """(keys, first, last, n): stretches that stay within tolerance of their first value, at least `least` long."""
    rows = df.select(*keys, F.col(time).alias("t"), F.col(value).alias("v"))
    types = dict(rows.dtypes)
    schema = ", ".join([*(f"{k} {types[k]}" for k in keys), f"first {types['t']}", f"last {types['t']}", "n bigint"])
    return in_order(rows, keys, ["t", "v"], AnchoredSegments(tolerance, least), schema)


def evenly_thinned(df: DataFrame, keys: Sequence[str], order: Sequence[str], n: int) -> DataFrame:
    """At most n rows a key: those nearest to n evenly spaced places, first and last included (half to even)."""
    w = Window.partitionBy(*keys)
    ranked = df.withColumn("_i", F.row_number().over(w.orderBy(*order)) - 1).withColumn("_n", F.count("*").over(w))
    # places of more rows than n are over one apart, so the nearest to a row is the only one that can round to it
    k = F.rint(F.col("_i") * (n - 1) / F.greatest(F.col("_n") - 1, F.lit(1))).cast("long")
    place = F.bround(k * (F.col("_n") - 1) / F.lit(max(1, n - 1))).cast("long")
    return ranked.filter((F.col("_n") <= n) | (place == F.col("_i"))).drop("_i", "_n")


def stride_sample(df: DataFrame, keys: Sequence[str], order: Sequence[str], limit: int) -> DataFrame:
    """At most `limit` rows a key: those at places int(i * n / limit)."""
    w = Window.partitionBy(*keys)
    ranked = df.withColumn("_i", (F.row_number().over(w.orderBy(*order)) - 1).cast("long")).withColumn("_n", F.count("*").over(w))
    # the place p is taken if some i has floor(i * n / limit) = p, that is, if ceil(p * limit / n) * n < (p + 1) * limit
    i = F.floor((F.col("_i") * limit + F.col("_n") - 1) / F.col("_n"))
    return ranked.filter((F.col("_n") <= limit) | (F.floor(i * F.col("_n") / F.lit(limit)) == F.col("_i"))).drop("_i", "_n")


def bin_best(df: DataFrame, keys: Sequence[str], order: Sequence[str], score: Column, bins: int) -> DataFrame:
    """One row for each of `bins` equal stretches of a key's rows: the best score, then nearest to its middle, then first."""
    w = Window.partitionBy(*keys)
    ranked = df.withColumn("_i", F.row_number().over(w.orderBy(*order)) - 1).withColumn("_n", F.count("*").over(w))
    placed = ranked.withColumn("bin", F.floor(F.col("_i") * bins / F.col("_n")).cast("int")).withColumn("_score", score)
    centre = (F.col("bin") + 0.5) * F.col("_n") / bins
    best = Window.partitionBy(*keys, "bin").orderBy(F.desc("_score"), F.abs(F.col("_i") - centre), "_i")
    return placed.withColumn("_r", F.row_number().over(best)).filter("_r = 1").drop("_i", "_n", "_r", "_score")


def keyframes(seen: DataFrame, runs: DataFrame, run: str, count: int) -> DataFrame:
    """(run, bin, frame): one frame for each of `count` equal bins of a run's samples, those of the most people and machines first.

    seen (run, frame, people, machines), runs (run, total). The most is min(people, 3) + 2 if there are machines; then the nearest to the bin's
    middle, then the first. A bin in which nothing is seen has its middle, half to even. A frame counts for the first bin that picks it.
    """
    b, total = F.col("bin"), F.col("total")
    bins = runs.filter("total > 0").select(run, "total", F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias("bin"))
    bins = bins.withColumn("start", F.floor(b * total / count)).withColumn("stop", F.greatest(F.col("start") + 1, F.floor((b + 1) * total / count)))
    bins = bins.withColumn("centre", (F.col("start") + F.col("stop") - 1) / 2)
    worth = F.least(F.col("people"), F.lit(3)) + F.when(F.col("machines") > 0, 2).otherwise(0)
    inside = (F.col("frame") >= F.col("start")) & (F.col("frame") < F.col("stop"))
    placed = seen.select(F.col(run).alias("_run"), "frame", worth.alias("worth"))
    met = bins.join(placed, (F.col(run) == F.col("_run")) & inside, "left")
    order = F.struct("worth", -F.abs(F.col("frame") - F.col("centre")), -F.col("frame"))
    best = met.groupBy(run, "bin", "total", "centre").agg(F.max_by("frame", F.when(F.col("frame").isNotNull(), order)).alias("frame"))
    frame = F.least(F.coalesce("frame", F.bround("centre").cast("long")), F.col("total") - 1)
    return best.groupBy(run, frame.alias("frame")).agg(F.min("bin").alias("bin")).select(run, "bin", "frame")


def median_halves(df: DataFrame, keys: Sequence[str], time: str, value: str) -> DataFrame:
    """(keys, early, late): a value's averages up to and after the key's median time."""
    middle = linear_quantiles(df, keys, time, {"_m": 0.5})
    both = df.join(middle, list(keys))
    late = F.col(time) > F.col("_m")
    return both.groupBy(*keys).agg(F.avg(F.when(~late, F.col(value))).alias("early"), F.avg(F.when(late, F.col(value))).alias("late"))


def largest_gap_split(df: DataFrame, keys: Sequence[str], value: str, row_id: str) -> DataFrame:
    """(keys, n, n_low, gap, low, high): the widest gap between sorted values, the lowest on ties."""
    w = Window.partitionBy(*keys).orderBy(value, row_id)
    stepped = df.withColumn("_next", F.lead(value).over(w)).withColumn("_i", F.row_number().over(w)).withColumn("_n", F.count("*").over(Window.partitionBy(*keys)))
    best = stepped.filter(F.col("_next").isNotNull()).groupBy(*keys).agg(
        F.max_by(F.struct(F.col(value).alias("low"), F.col("_next").alias("high"), F.col("_i").alias("n_low"), F.col("_n").alias("n")), F.struct(F.col("_next") - F.col(value), -F.col("_i"))).alias("b")
    )
    return best.select(*keys, F.col("b.n").cast("long").alias("n"), F.col("b.n_low").cast("long").alias("n_low"), (F.col("b.high") - F.col("b.low")).alias("gap"), F.col("b.low").alias("low"), F.col("b.high").alias("high"))
