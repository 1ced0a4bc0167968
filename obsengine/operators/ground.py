"""Ground plane: fit of a pitched pinhole camera to upright people, its gates, its block bootstrap, and distance intervals.

A vertical observation (run, track, t, head and foot pixel, sigma) says where a person of height one stands. The fit
works on one run's observations, which sampling bounds (no more than 150 a run), so runs are groups of bounded
size. All starts, both halves of a run, and all replicates of a group are solved at once, as arrays. Random numbers are seeded by
what they are drawn for, never by order.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from obsengine.functions import geometry as g
from obsengine.functions.predicates import contact_visible, contacts
from obsengine.operators import support
from obsengine.schema import POINT
from obsengine.session import written


@dataclass(frozen=True)
class Frame:
    """The visible image: size and principal point in pixels."""

    width: float
    height: float
    cx: float
    cy: float


@dataclass(frozen=True)
class Gates:
    """What a fit has to meet, in pixels, seconds and the plane's unit. Fixed values."""

    pairs: int = 12
    tracks: int = 5
    focal: tuple[float, float] = (0.5, 3.0)
    inlier_sigma: float = 3.0
    inliers: float = 0.65
    rms: float = 3.0
    condition: float = 1e8
    horizon_shift: float = 5.0
    replicates: int = 500
    least_replicates: int = 350
    block_seconds: float = 2.0
    margin: float = 0.5


#: Pitch in radians, focal length over width, height. Fixed values of the fit.
LOWEST, HIGHEST = (np.radians(-5.0), 0.3, 0.5), (np.radians(85.0), 6.0, 60.0)
STARTS = [(p, f, h) for p in (0.1, 0.4, 0.8, 1.2) for f in (0.7, 1.2, 2.0) for h in (2.0, 4.0, 8.0)]
HUBER = 2.0
#: Replicates that are solved together, and pairs of a run that are measured in one group.
CHUNK, SLICE = 50, 1024
PLANES = (
    "run_id string, focal double, pitch double, height double, horizon double, n_observations long, n_tracks long, inlier_ratio double,"
    f" rms double, condition double, horizon_shift double, status string, unstable boolean, accepted array<{POINT}>"
)
ENSEMBLE = "run_id string, replicate int, focal double, pitch double, height double"


def spread(df: DataFrame, keys: list[str], groups: int, each: int) -> DataFrame:
    """df by keys in a stated number of partitions, of `each` groups or fewer while cores are free: groups of few bytes and much work, which adaptive
    execution would put in a task or two."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(1, min(groups, max(4 * cores, groups // each))), *keys)


def seeded(*parts) -> np.random.Generator:
    return np.random.default_rng(xxhash.xxh64_intdigest("\x1f".join(map(str, parts)), 0))


def backproject(camera: np.ndarray, px: np.ndarray, py: np.ndarray, cx: float, cy: float) -> tuple[np.ndarray, np.ndarray]:
    """Ground (x, z) of pixels for cameras (..., 3) of focal, pitch and height; NaN at or above the horizon."""
    focal, pitch, height = camera[..., 0], np.radians(camera[..., 1]), camera[..., 2]
    dy = (py - cy) / focal
    down = dy + np.tan(pitch)
    with np.errstate(divide="ignore", invalid="ignore"):
        scale = np.where(down > 1e-9, height / (np.cos(pitch) * down), np.nan)
    return scale * (px - cx) / focal, scale * (np.cos(pitch) - dy * np.sin(pitch))


def project(camera: np.ndarray, x: np.ndarray, z: np.ndarray, lift: float, cx: float, cy: float) -> tuple[np.ndarray, np.ndarray]:
    focal, pitch, below = camera[..., 0], np.radians(camera[..., 1]), camera[..., 2] - lift
    with np.errstate(divide="ignore", invalid="ignore"):
        depth = z * np.cos(pitch) + below * np.sin(pitch)
        return cx + focal * x / depth, cy + focal * (below * np.cos(pitch) - z * np.sin(pitch)) / depth


def cameras(p: np.ndarray) -> np.ndarray:
    """Focal, pitch in degrees and height of parameters (pitch, log focal, height)."""
    return np.stack([np.exp(p[..., 1]), np.degrees(p[..., 0]), p[..., 2]], -1)


def parameters(camera: np.ndarray) -> np.ndarray:
    return np.stack([np.radians(camera[..., 1]), np.log(camera[..., 0]), camera[..., 2]], -1)


def residuals(p: np.ndarray, o: dict[str, np.ndarray], frame: Frame) -> np.ndarray:
    """(solutions, observations, 2): head positions predicted from the feet against those seen, over sigma."""
    pitch, focal, height = p[:, None, 0], np.exp(p[:, None, 1]), p[:, None, 2]
    u, v = o["fx"] - frame.cx, o["fy"] - frame.cy
    level, sine = focal * np.cos(pitch), np.sin(pitch)
    r = np.empty((len(p), 2, len(u))).transpose(0, 2, 1)  # each direction's observations in a row
    with np.errstate(divide="ignore", invalid="ignore"):
        below = v * np.cos(pitch) + focal * sine
        depth = np.where(below > 1e-9 * level, height * focal / below, np.nan)  # of the feet; `project` of `backproject`, in fewer steps
        r[..., 0] = depth * u
        r[..., 1] = depth * v - level
        r /= (depth - sine)[..., None]
    r -= np.stack([o["hx"] - frame.cx, o["hy"] - frame.cy], -1)
    r /= o["sigma"][:, None]
    return r if np.isfinite(r).all() else np.nan_to_num(r, copy=False, nan=1e3, posinf=1e3, neginf=-1e3)


def slopes(p: np.ndarray, o: dict[str, np.ndarray], frame: Frame) -> np.ndarray:
    """(solutions, 3, 2, observations): derivatives of residuals by pitch, log focal and height; 0 where a foot is not below the horizon."""
    pitch, focal, height = p[:, None, 0], np.exp(p[:, None, 1]), p[:, None, 2]
    u, v, by_sigma = o["fx"] - frame.cx, o["fy"] - frame.cy, 1 / o["sigma"]
    level, rise, cosine, sine = focal * np.cos(pitch), focal * np.sin(pitch), np.cos(pitch), np.sin(pitch)
    out = np.empty((len(p), 3, 2, len(u)))
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        below = v * cosine + rise
        depth = np.where(below > 1e-9 * level, height * focal / below, np.nan)
        scale = 1 / (depth - sine)
        x, y = depth * u * scale, (depth * v - level) * scale  # of the heads
        scale *= by_sigma
        ahead, aside = (v - y) * scale, (u - x) * scale
        by_pitch, by_focal = depth * (v * sine - level) / below, depth - depth * rise / below  # of the depth
        out[:, 0, 0], out[:, 0, 1] = by_pitch * aside + cosine * x * scale, by_pitch * ahead + (rise + cosine * y) * scale
        out[:, 1, 0], out[:, 1, 1] = by_focal * aside, by_focal * ahead - level * scale
        depth /= height
        out[:, 2, 0], out[:, 2, 1] = depth * aside, depth * ahead
    if not np.isfinite(out).all():
        out *= np.isfinite(out).all((1, 2))[:, None, None]
        np.nan_to_num(out, copy=False, nan=0, posinf=0, neginf=0)
    return out


def solve(starts: np.ndarray, o: dict[str, np.ndarray], frame: Frame, weights: np.ndarray | None = None, steps: int = 100) -> tuple[np.ndarray, np.ndarray]:
    """Bounded Levenberg-Marquardt with Huber weights from each start at once: parameters and costs. weights: (starts, observations)."""
    logs = lambda v: np.array([v[0], np.log(v[1] * frame.width), v[2]])
    low, high = logs(LOWEST), logs(HIGHEST)
    w = np.ones((len(starts), len(o["fx"]))) if weights is None else weights

    def cost(r: np.ndarray) -> np.ndarray:
        far = abs(r)
        near = np.minimum(far, HUBER)
        return (w[..., None] * (near * (2 * far - near))).sum((1, 2))

    p = np.clip(np.array(starts, float), low + 1e-6, high - 1e-6)
    costs = np.full(len(p), np.nan)
    ended, going = p.copy(), np.arange(len(p))  # those that have come to rest take no further steps
    r = residuals(p, o, frame)
    now, damping = cost(r), np.full(len(p), 1e-2)
    for _ in range(steps):
        jacobian = slopes(p, o, frame).reshape(len(p), 3, -1)
        across = np.ascontiguousarray(r.transpose(0, 2, 1))
        pull = w[:, None] * (HUBER / np.maximum(abs(across), HUBER))
        pulled = jacobian * pull.reshape(len(p), 1, -1)
        a = pulled @ jacobian.transpose(0, 2, 1)
        b = (pulled @ across.reshape(len(p), -1, 1))[..., 0]
        lift = damping[:, None] * (np.einsum("bkk->bk", a) + 1e-9)
        moved = np.clip(p - np.linalg.solve(a + lift[:, :, None] * np.eye(3), b[..., None])[..., 0], low, high)
        after = residuals(moved, o, frame)
        then = cost(after)
        better = then < now
        small = better & (now - then < 1e-10 * (1 + now))
        p, r, now = np.where(better[:, None], moved, p), np.where(better[:, None, None], after, r), np.where(better, then, now)
        damping = np.where(better, damping / 3, damping * 4)
        on = ~small & (damping < 1e8)
        ended[going], costs[going] = p, now
        p, r, now, damping, w, going = p[on], r[on], now[on], damping[on], w[on], going[on]
        if not len(going):
            break
    return ended, costs


def _arrays(frame: pd.DataFrame) -> dict[str, np.ndarray]:
    return {c: frame[c].to_numpy(float) for c in ("hx", "hy", "fx", "fy", "sigma", "t")}


def homography_condition(camera: np.ndarray, frame: Frame) -> float:
    """Condition number of the map from the ground (x, z, 1) to pixels."""
    focal, pitch, height = camera[0], np.radians(camera[1]), camera[2]
    k = np.array([[focal, 0, frame.cx], [0, focal, frame.cy], [0, 0, 1]])
    return float(np.linalg.cond(k @ [[1, 0, 0], [0, -np.sin(pitch), height * np.cos(pitch)], [0, np.cos(pitch), height * np.sin(pitch)]]))


def horizon(camera: np.ndarray, frame: Frame) -> np.ndarray:
    return frame.cy - camera[..., 0] * np.tan(np.radians(camera[..., 1]))


def horizon_shift(p: np.ndarray, o: dict[str, np.ndarray], frame: Frame, least: int) -> float | None:
    """How far apart the horizons of the earlier and the later half are; None if one has too few observations."""
    early = o["t"] <= np.median(o["t"])
    halves = np.stack([early, ~early]).astype(float)
    if halves.sum(1).min() < least:
        return None
    fitted, _ = solve(np.stack([p, p]), o, frame, halves)
    return float(abs(np.diff(horizon(cameras(fitted), frame))[0]))


def _fitted(own: pd.DataFrame, frame: Frame, gates: Gates) -> dict:
    """One run's plane, up to the first gate that fails."""
    out = dict.fromkeys((f.split()[0] for f in PLANES.split(", ")), None)
    out |= {"run_id": own["run_id"].iloc[0], "n_observations": len(own), "n_tracks": own["track"].nunique(), "unstable": False}
    if len(own) < gates.pairs:
        return out | {"status": "insufficient_vertical_observations"}
    if out["n_tracks"] < gates.tracks:
        return out | {"status": "insufficient_distinct_tracks"}
    o = _arrays(own.sort_values(["t", "track"]))
    solved, cost = solve(np.array([[p, np.log(f * frame.width), h] for p, f, h in STARTS]), o, frame)
    ended = np.isfinite(solved).all(1) & np.isfinite(cost)
    if not ended.any():
        return out | {"status": "fit_did_not_converge"}
    p = solved[np.where(ended, cost, np.inf).argmin()]
    camera = cameras(p)
    out |= {"focal": camera[0], "pitch": camera[1], "height": camera[2], "horizon": float(horizon(camera, frame))}
    r = residuals(p[None], o, frame)[0]
    near = np.hypot(*r.T) <= gates.inlier_sigma
    out["inlier_ratio"] = float(near.mean())
    if near.any():
        out["rms"] = float(np.sqrt(((r * o["sigma"][:, None])[near] ** 2).sum(1).mean()))
    x, z = backproject(camera, o["fx"], o["fy"], frame.cx, frame.cy)
    out["accepted"] = [{"x": a, "y": b} for a, b in zip(x[near].tolist(), z[near].tolist(), strict=True)]
    out["condition"] = homography_condition(camera, frame)
    checks = {
        "focal_length_out_of_range": lambda: not gates.focal[0] <= camera[0] / frame.width <= gates.focal[1],
        "low_inlier_ratio": lambda: out["inlier_ratio"] < gates.inliers,
        "reprojection_error_too_high": lambda: out["rms"] > gates.rms,
        "plane_not_in_front_of_camera": lambda: not np.isfinite(x[near]).all() or not (z[near] > 0).all(),
        "homography_ill_conditioned": lambda: out["condition"] > gates.condition,
    }
    for status, fails in checks.items():
        if fails():
            return out | {"status": status, "unstable": True}
    out["horizon_shift"] = horizon_shift(p, o, frame, gates.pairs)
    moved = out["horizon_shift"] is not None and out["horizon_shift"] > gates.horizon_shift
    return out | ({"status": "horizon_unstable_over_time", "unstable": True} if moved else {"status": "ok"})


def fit_planes(verticals: DataFrame, frame: Frame, gates: Gates = Gates()) -> DataFrame:
    """PLANES, one row a run; verticals (run_id, track, t, hx, hy, fx, fy, sigma).

    status: `ok`, or the first gate that fails; unstable: the feed itself has no steady plane, as opposed to too little to see.
    The gates on replicates follow in `gated`. accepted: ground points of the inliers, x and z.
    """
    names = [f.split()[0] for f in PLANES.split(", ")]

    def fit(own: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([_fitted(own, frame, gates)], columns=names)

    groups = verticals.select("run_id").distinct().count()
    return spread(verticals, ["run_id"], groups, 64).groupBy("run_id").applyInPandas(fit, PLANES)


def block_counts(own: pd.DataFrame, rng: np.random.Generator, seconds: float) -> np.ndarray:
    """How often each row is drawn: tracks with replacement, then within each drawn track blocks of time with replacement."""
    return next(_counts(own, [rng], seconds))


def _counts(own: pd.DataFrame, generators: Iterable[np.random.Generator], seconds: float) -> Iterator[np.ndarray]:
    """block_counts for each generator: a draw is of numbers of blocks, whose rows are looked up at the end."""
    tracks, at = np.unique(own["track"].to_numpy(), return_inverse=True)
    blocks = np.floor(own["t"].to_numpy() / seconds).astype(int)
    cells, cell = np.unique(np.stack([at, blocks]), axis=1, return_inverse=True)
    first = np.searchsorted(cells[0], np.arange(len(tracks) + 1))
    sizes = np.diff(first)
    for rng in generators:
        drawn = rng.integers(0, len(tracks), len(tracks))
        many = sizes[drawn]  # of each drawn track, as many blocks as it has: all in one draw
        taken = np.repeat(first[drawn], many) + rng.integers(0, np.repeat(many, many))
        yield np.bincount(taken, minlength=cells.shape[1])[cell.ravel()].astype(float)


def bootstrap(verticals: DataFrame, planes: DataFrame, frame: Frame, gates: Gates = Gates()) -> DataFrame:
    """ENSEMBLE: refits on resampled observations of the runs that are `ok` so far, started from the plane, those of a focal length in range.

    Each (run, part of its replicates) is a group of its own: as many parts as cores need where runs are few, one where they are many, so that rows are
    sent on once. CHUNK replicates at a time, which differ in the weights of the run's rows only, are solved together.
    """
    ready = planes.filter("status = 'ok'").select("run_id", "focal", "pitch", "height")
    chunks, runs = -(-gates.replicates // CHUNK), ready.count()
    parts = min(chunks, -(-8 * planes.sparkSession.sparkContext.defaultParallelism // max(1, runs)))
    drawn = ready.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    rows = verticals.select("run_id", "track", "t", "hx", "hy", "fx", "fy", "sigma").join(drawn, "run_id")
    names = [f.split()[0] for f in ENSEMBLE.split(", ")]

    def refit(own: pd.DataFrame) -> pd.DataFrame:
        run, part = own["run_id"].iloc[0], int(own["part"].iloc[0])
        own = own.sort_values(["track", "t"])
        numbers = np.concatenate([np.arange(at * CHUNK, min(gates.replicates, (at + 1) * CHUNK)) for at in range(part, chunks, parts)])
        draws = _counts(own, (seeded(run, n) for n in numbers), gates.block_seconds)
        first, seen = parameters(own[["focal", "pitch", "height"]].iloc[0].to_numpy(float)), _arrays(own)
        fine, found = np.zeros(len(numbers), bool), np.empty((len(numbers), 3))
        for at in range(0, len(numbers), CHUNK):
            weights = np.stack(list(islice(draws, CHUNK)))
            p, cost = solve(np.repeat(first[None], len(weights), 0), seen, frame, weights)
            some = slice(at, at + len(weights))
            found[some] = cameras(p)
            ratio = found[some, 0] / frame.width
            fine[some] = (weights.sum(1) >= 6) & np.isfinite(cost) & np.isfinite(p).all(1) & (ratio >= gates.focal[0]) & (ratio <= gates.focal[1])
        return pd.DataFrame({"run_id": run, "replicate": numbers[fine], **{c: found[fine, i] for i, c in enumerate(names[2:])}}, columns=names)

    return spread(rows, ["run_id", "part"], runs * parts, max(1, 64 * parts // chunks)).groupBy("run_id", "part").applyInPandas(refit, ENSEMBLE)


def two_clusters(values: DataFrame, keys: list[str], value: str, least_gap: float, least_spread: float = 1.0) -> DataFrame:
    """(keys, n, split): whether each key's values fall into two groups, apart at their widest gap.

    Each has a tenth of the values at least, of 20 or more; the gap is wider than four times the larger of their spreads and than least_gap.
    """
    ordered = Window.partitionBy(*keys).orderBy(value)
    gaps = values.withColumns({"_gap": F.col(value) - F.lag(value).over(ordered), "_at": F.row_number().over(ordered)})
    widest = gaps.groupBy(*keys).agg(F.count("*").alias("n"), F.max(F.struct("_gap", (-F.col("_at")).alias("_at"))).alias("_w"))
    sided = gaps.join(widest, keys).withColumn("_low", F.col("_at") < -F.col("_w._at"))
    spread = lambda side: F.coalesce(F.stddev_pop(F.when(side, F.col(value))), F.lit(0.0))
    found = sided.groupBy(*keys).agg(
        F.first("n").alias("n"), F.first("_w._gap").alias("_gap"), F.count_if("_low").alias("_below"), F.greatest(spread(F.col("_low")), spread(~F.col("_low")), F.lit(least_spread)).alias("_spread")
    )
    few = F.least("_below", F.col("n") - F.col("_below")) < 0.1 * F.col("n")
    apart = F.col("_gap") > F.greatest(4 * F.col("_spread"), F.lit(least_gap))
    return found.select(*keys, "n", ((F.col("n") >= 20) & ~few & apart).alias("split"))


def gated(planes: DataFrame, ensemble: DataFrame, frame: Frame, gates: Gates = Gates()) -> DataFrame:
    """planes with the gates on their replicates: `bootstrap_failed` if too few are left, `multimodal_bootstrap_solution` if their horizons are in two groups.

    Adds n_replicates and ready.
    """
    horizons = ensemble.withColumn("_h", F.lit(frame.cy) - F.col("focal") * F.tan(F.radians("pitch")))
    modes = two_clusters(horizons, ["run_id"], "_h", 0.1 * frame.height)
    joined = planes.join(modes, "run_id", "left").withColumn("n_replicates", F.coalesce("n", F.lit(0)))
    fails = F.when(F.col("n_replicates") < gates.least_replicates, "bootstrap_failed").when(F.col("split"), "multimodal_bootstrap_solution")
    late = F.when(F.col("status") == "ok", fails)
    out = joined.withColumns({"unstable": F.col("unstable") | late.isNotNull(), "status": F.coalesce(late, "status")}).drop("n", "split")
    return out.withColumn("ready", F.col("status") == "ok")


def with_support(planes: DataFrame, gates: Gates = Gates()) -> DataFrame:
    """planes with `region`, in which they hold: the hull of the accepted ground points, grown by the margin; null without a plane."""
    spots = planes.filter("ready").select("run_id", F.inline("accepted"))
    return planes.join(support.hulls(spots, ["run_id"], "x", "y", gates.margin, salts=1).select("run_id", "region"), "run_id", "left")


def _placed(pairs: DataFrame, frame: Frame, visible: Column, inflation: float) -> DataFrame:
    """pairs (wx, wy, targets, focal, pitch, height, region) with compatible and distance, the point estimate less the inflation."""
    at = lambda x, y: g.ground_point(x, y, F.col("focal"), F.col("pitch"), F.col("height"), frame.cx, frame.cy)
    spots = pairs.withColumns({"_w": at(F.col("wx"), F.col("wy")), "_t": F.transform("targets", lambda t: at(t["x"], t["y"]))})
    inside = support.supports(F.col("region"), F.col("_w")) & F.forall("_t", lambda t: support.supports(F.col("region"), t))
    apart = F.greatest(g.to_polyline(F.col("_w"), F.col("_t")) - inflation, F.lit(0.0))
    placed = spots.withColumn("compatible", F.coalesce(visible & inside, F.lit(False)))
    return placed.withColumn("distance", F.when(F.col("compatible"), apart)).drop("_w", "_t", "focal", "pitch", "height", "region")


def machine_pairs(workers: DataFrame, machines: DataFrame, planes: DataFrame, keys: list[str], frame: Frame, content_bottom: float, inflation: float, noise: float = 0.02) -> DataFrame:
    """Workers and machines of a frame (keys), on the plane: wx, wy, w_noise, targets, t_noise, compatible, distance.

    A machine stands on the lower corners of its box. A pair is compatible if these are in view, and they and the worker's feet in
    the plane's support. workers (keys, canonical_track_id, anchor, box), machines (keys, object_id, box), planes of with_support.
    """
    tall = lambda b: noise * (F.col(b)["y2"] - F.col(b)["y1"])
    left = workers.select(*keys, "canonical_track_id", F.col("anchor.x").alias("wx"), F.col("anchor.y").alias("wy"), tall("box").alias("w_noise"))
    right = machines.select(*keys, "object_id", contacts(F.col("box")).alias("targets"), tall("box").alias("t_noise"), contact_visible(F.col("box"), content_bottom).alias("_seen"))
    flat = planes.filter("ready").select("run_id", "focal", "pitch", "height", "region")
    return _placed(left.join(right, keys).join(flat, "run_id"), frame, F.col("_seen"), inflation).drop("_seen")


def edge_support(edges: DataFrame, planes: DataFrame, frame: Frame) -> DataFrame:
    """edges (run_id, object_id, points) with compatible: whether all their points are in the plane's support."""
    flat = planes.filter("ready").select("run_id", "focal", "pitch", "height", "region")
    at = lambda p: g.ground_point(p["x"], p["y"], F.col("focal"), F.col("pitch"), F.col("height"), frame.cx, frame.cy)
    joined = edges.select("run_id", "object_id", "points").join(flat, "run_id", "left")
    inside = F.forall("points", lambda p: support.supports(F.col("region"), at(p)))
    return joined.select("run_id", "object_id", "points", F.coalesce(inside, F.lit(False)).alias("compatible"))


def edge_pairs(workers: DataFrame, edges: DataFrame, planes: DataFrame, keys: list[str], frame: Frame, noise: float = 0.02, edge_noise: float = 0.005) -> DataFrame:
    """As machine_pairs, for workers and the compatible edges of edge_support. An edge is as sure as a share of the image's diagonal."""
    left = workers.select(*keys, "canonical_track_id", F.col("anchor.x").alias("wx"), F.col("anchor.y").alias("wy"), (noise * (F.col("box.y2") - F.col("box.y1"))).alias("w_noise"))
    right = edges.filter("compatible").select("run_id", "object_id", F.col("points").alias("targets"), F.lit(edge_noise * float(np.hypot(frame.width, frame.height))).alias("t_noise"))
    flat = planes.filter("ready").select("run_id", "focal", "pitch", "height", "region")
    return _placed(left.join(right, "run_id").join(flat, "run_id"), frame, F.lit(True), 0.0)


def measured(pairs: DataFrame, ensemble: DataFrame, keys: list[str], frame: Frame, farthest: float, inflation: float, gates: Gates = Gates()) -> DataFrame:
    """pairs with lower, median and upper: intervals of the compatible pairs whose point estimate is no farther than `farthest`.

    The others have null bounds and never meet the replicates. Pairs are written first, since they are counted, measured and passed on.
    """
    pairs = written(pairs, "pairs")
    worth = F.coalesce(F.col("compatible") & (F.col("distance") <= farthest), F.lit(False))
    near = distance_intervals(pairs.filter(worth), ensemble, keys, frame.cx, frame.cy, inflation, least=gates.least_replicates)
    return near.unionByName(pairs.filter(~worth), allowMissingColumns=True)


def distance_intervals(
    pairs: DataFrame, ensemble: DataFrame, keys: list[str], cx: float, cy: float, inflation: float = 0.5, level: float = 0.95,
    least: int = Gates.least_replicates,
) -> DataFrame:
    """pairs (run_id, keys, wx, wy, w_noise, targets array of x and y, t_noise) with lower, median and upper distance.

    Each replicate's camera places worker and target, shaken by their pixel noise; distances shrink by the
    inflation, not below 0; null with fewer than `least` finite ones. A run's pairs are dealt into slices of about SLICE,
    each of which meets the run's ensemble once, so pairs are not multiplied by replicate; a slice's are measured as arrays.
    """
    sizes = pairs.groupBy("run_id").agg(F.ceil(F.count("*") / SLICE).alias("_slices"))
    groups = sizes.agg(F.coalesce(F.sum("_slices"), F.lit(1))).first()[0]
    dealt = pairs.join(sizes, "run_id", "left").withColumn("_slice", F.coalesce(F.pmod(F.xxhash64(*keys), F.col("_slices")), F.lit(0))).drop("_slices")
    cameras = ensemble.join(sizes, "run_id").withColumn("_slice", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_slices") - 1))).drop("_slices")
    by = ["run_id", "_slice"]
    shares = [(1 - level) / 2, 0.5, (1 + level) / 2]

    def together(own: pd.DataFrame, camera: np.ndarray) -> np.ndarray:
        """Bounds of pairs of one run with equally many targets."""
        many = len(own["targets"].iloc[0])
        noise = np.stack([seeded(*k).normal(size=(2 + 2 * many, len(camera))) for k in own[["run_id", *keys]].itertuples(index=False)])
        column = lambda c: own[c].to_numpy(float)[:, None]
        x, z = backproject(camera, column("wx") + column("w_noise") * noise[:, 0], column("wy") + column("w_noise") * noise[:, 1], cx, cy)
        target = np.array([[[p["x"], p["y"]] for p in t] for t in own["targets"]], float)
        shaken = lambda k, i: target[:, k, i, None] + column("t_noise") * noise[:, 2 + 2 * k + i]
        spots = [backproject(camera, shaken(k, 0), shaken(k, 1), cx, cy) for k in range(many)]
        d = np.maximum(to_path(x, z, spots) - inflation, 0)
        d[~np.isfinite(d)] = np.nan
        enough = np.isfinite(d).sum(1) >= least
        out = np.full((len(own), 3), np.nan)
        whole = np.isfinite(d).all(1)
        for rows, bounds in ((enough & whole, np.quantile), (enough & ~whole, np.nanquantile)):  # the latter goes row by row, and is slow
            if rows.any():
                out[rows] = bounds(d[rows], shares, axis=1).T
        return out

    def measure(own: pd.DataFrame, drawn: pd.DataFrame) -> pd.DataFrame:
        camera = drawn.sort_values("replicate")[["focal", "pitch", "height"]].to_numpy(float)
        own = own.drop(columns="_slice").reset_index(drop=True)
        bounds = np.full((len(own), 3), np.nan)
        if len(camera) >= least and len(own):
            for _, alike in own.groupby(own["targets"].map(len)):
                for at in range(0, len(alike), 512):  # 512 pairs of 500 replicates are a few MB an array
                    part = alike.iloc[at : at + 512]
                    bounds[part.index] = together(part, camera)
        nulls = lambda v: [None if np.isnan(x) else float(x) for x in v]
        return own.assign(lower=nulls(bounds[:, 0]), median=nulls(bounds[:, 1]), upper=nulls(bounds[:, 2]))

    types = dict(pairs.dtypes)
    schema = ", ".join([*(f"{c} {types[c]}" for c in pairs.columns), "lower double", "median double", "upper double"])
    left, right = (spread(df, by, groups, 8) for df in (dealt, cameras))
    return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInPandas(measure, schema)


def to_path(x: np.ndarray, z: np.ndarray, spots: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Distance of points, one for each camera, from the polyline through spots; a single spot is a point."""
    if len(spots) == 1:
        return np.hypot(x - spots[0][0], z - spots[0][1])
    best = np.full(np.shape(x), np.inf)
    for (ax, az), (bx, bz) in zip(spots, spots[1:]):
        dx, dz = bx - ax, bz - az
        t = np.clip(((x - ax) * dx + (z - az) * dz) / np.maximum(dx * dx + dz * dz, 1e-12), 0, 1)
        best = np.minimum(best, np.hypot(x - ax - t * dx, z - az - t * dz))  # NaN if any spot is
    return best
