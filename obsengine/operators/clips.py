"""Clips as one job: from observations, proposals and upright people to planes, distances, incidents and coverage, for many runs at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from obsengine.functions import geometry as g
from obsengine.functions.predicates import pose_candidate
from obsengine.operators import ground, rules
from obsengine.operators.sequence import evenly_thinned, greedy_spacing, median_of
from obsengine.session import written

#: Seconds and the plane's unit: trailing range, speed and displacement of a machine at work; samples of a track and a run, and their spacing. Fixed values.
STATE_SECONDS, ACTIVE_SPEED, ACTIVE_SHIFT, LEAST_POINTS, LEAST_SHARE = 2.0, 0.15, 0.25, 4, 0.70
SPACING, TRACK_SAMPLES, RUN_SAMPLES = 0.5, 20, 150


def sampled(obs: DataFrame, frame: ground.Frame) -> DataFrame:
    """The people whose pose is worth looking at: upright, whole, spaced in time, no more than TRACK_SAMPLES a track and RUN_SAMPLES a run.

    Thinning is even, over a track's time and then over the run's.
    """
    fit = rules.people(obs).filter(pose_candidate(F.col("box"), frame.width, frame.height))
    spaced = greedy_spacing(fit, ["run_id", "canonical_track_id"], "video_time_s", "frame_index", SPACING)
    kept = spaced.select("run_id", "canonical_track_id", F.col("id").alias("frame_index"), F.col("t").alias("video_time_s"))
    few = evenly_thinned(kept, ["run_id", "canonical_track_id"], ["video_time_s", "frame_index"], TRACK_SAMPLES)
    few = evenly_thinned(few, ["run_id"], ["video_time_s", "canonical_track_id", "frame_index"], RUN_SAMPLES)
    return fit.join(few.select("run_id", "canonical_track_id", "frame_index"), ["run_id", "canonical_track_id", "frame_index"], "left_semi")


def trailing_states(spots: DataFrame, keys: list[str], length: float = STATE_SECONDS) -> DataFrame:
    """spots (keys, t, x, y; x null off the plane) with operating_state: `active` where the trailing range moves fast or far enough, else `unknown`.

    The shift is that of the medians of the first and the last third of the range's points on the plane, of which there have to be
    LEAST_POINTS, and LEAST_SHARE of its rows. Blocks of time are partitions, with the rows at a block's end as the next one's past.
    """
    reach = round(1000 * length)  # milliseconds, to which ranges are exact
    wide = 50 * reach
    at = F.col("_ms")
    base = spots.withColumn("_ms", F.round(F.col("t") * 1000).cast("long")).withColumn("_block", F.floor(at / wide))
    late = at - F.col("_block") * wide >= wide - reach
    spread = base.withColumn("_at", F.explode(F.when(late, F.array(F.col("_block"), F.col("_block") + 1)).otherwise(F.array("_block"))))
    w = Window.partitionBy(*keys, "_at").orderBy("_ms").rangeBetween(-reach, 0)
    every = F.array_sort(F.collect_list(F.struct("t", "x", "y")).over(w))
    lists = spread.withColumns({"_all": every}).filter("_at = _block").withColumn("_r", F.filter("_all", lambda p: p["x"].isNotNull() & p["y"].isNotNull()))
    n = F.size("_r")
    third = F.greatest(F.lit(1), F.floor(n / 3)).cast("int")
    first, last = F.slice("_r", F.lit(1), third), F.slice("_r", n - third + 1, third)
    of = lambda part, c: F.transform(part, lambda p: p[c])
    mean = lambda part: F.aggregate(of(part, "t"), F.lit(0.0), lambda s, v: s + v) / F.size(part)
    shift = F.hypot(median_of(of(last, "x")) - median_of(of(first, "x")), median_of(of(last, "y")) - median_of(of(first, "y")))
    elapsed = mean(last) - mean(first)
    moving = (F.when(elapsed > 0, shift / elapsed) >= ACTIVE_SPEED) | (shift >= ACTIVE_SHIFT)
    enough = (n >= LEAST_POINTS) & (n >= LEAST_SHARE * F.size("_all"))
    active = F.when(enough, F.coalesce(moving, F.lit(False))).otherwise(False)
    return lists.select(*spots.columns, F.when(active, "active").otherwise("unknown").alias("operating_state"))


def machine_states(obs: DataFrame, planes: DataFrame, frame: ground.Frame) -> DataFrame:
    """(FRAME, object_id, operating_state) of every machine's rows in runs with a plane, by where the middle of its lower edge stands."""
    flat = planes.filter("ready").select("run_id", "focal", "pitch", "height")
    middle = rules.vehicles(obs).join(flat, "run_id")
    spot = g.ground_point((F.col("box.x1") + F.col("box.x2")) / 2, F.col("box.y2"), F.col("focal"), F.col("pitch"), F.col("height"), frame.cx, frame.cy)
    rows = middle.select(*rules.FRAME, F.col("canonical_track_id").alias("object_id"), F.col("video_time_s").alias("t"), spot.alias("_p"))
    spots = rows.select(*rules.FRAME, "object_id", "t", F.col("_p.x").alias("x"), F.col("_p.y").alias("y"))
    return trailing_states(spots, ["run_id", "shot_id", "object_id"]).drop("t", "x", "y")


def planes_of(verticals: DataFrame, frame: ground.Frame, gates: ground.Gates = ground.Gates()) -> tuple[DataFrame, DataFrame]:
    """Fitted planes with all gates and their support, and their replicates: two written tables, since fits are read several times."""
    seen = written(verticals, "verticals")
    fitted = written(ground.fit_planes(seen, frame, gates), "fitted-planes")
    ensemble = written(ground.bootstrap(seen, fitted, frame, gates), "plane-replicates")
    return written(ground.with_support(ground.gated(fitted, ensemble, frame, gates), gates), "planes"), ensemble


def evaluated(
    obs: DataFrame, runs: DataFrame, scenes: DataFrame, proposals: DataFrame, planes: DataFrame, ensemble: DataFrame, frame: ground.Frame,
    content_bottom: float, s: rules.Settings = rules.Settings(), gates: ground.Gates = ground.Gates(),
) -> tuple[DataFrame, DataFrame]:
    """Incidents and coverage of all rules; planes and ensemble of planes_of. Measures and states are written, since rules read them several times.
    obs has one row for each track and frame: see one_row_a_frame."""
    workers = rules.people(obs)
    machines = rules.vehicles(obs).withColumnRenamed("canonical_track_id", "object_id")
    near = ground.machine_pairs(workers, machines, planes, rules.FRAME, frame, content_bottom, s.inflation)
    keys = ["shot_id", "frame_index", "canonical_track_id", "object_id"]
    bounds = [*rules.FRAME, "canonical_track_id", "object_id", "compatible", "distance", "lower", "median", "upper"]
    to_machines = written(ground.measured(near, ensemble, keys, frame, s.candidate, s.inflation, gates).select(*bounds), "machine-measures")
    edges = proposals.filter("proposal_type = 'open_edge'").select("run_id", F.col("proposal_id").alias("object_id"), "points")
    held = ground.edge_support(edges, planes, frame)
    by_edge = ground.measured(ground.edge_pairs(workers, held, planes, rules.FRAME, frame), ensemble, keys, frame, s.candidate, 0.0, gates)
    to_edges, states = written(by_edge.select(*bounds), "edge-measures"), written(machine_states(obs, planes, frame), "machine-states")
    flags = planes.select("run_id", "unstable", "ready", "inlier_ratio")
    return rules.all_rules(obs, runs, scenes, proposals, flags, to_machines, held.drop("points"), to_edges, states, s)


def one_row_a_frame(obs: DataFrame) -> DataFrame:
    """obs with one row for each track and frame, the surest, the one of the smallest box on ties: trackers may report more."""
    keys = [*rules.FRAME, "canonical_track_id"]
    best = F.max_by(F.struct(*obs.columns), F.struct(F.col("confidence"), -F.col("box.x1"), -F.col("box.y1")))
    return obs.groupBy(*keys).agg(best.alias("_r")).select("_r.*")
