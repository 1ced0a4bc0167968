"""Ground plane: every gate, hulls and support against brute force, intervals, and a clip as one job."""

import itertools
from dataclasses import replace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from obsengine import schema, session
from obsengine.functions import geometry as g
from obsengine.operators import clips, ground, rules, support
from obsengine.plans import plane_queries

FRAME = ground.Frame(1920.0, 1080.0, 960.0, 540.0)
CAMERA = np.array([1700.0, 28.0, 3.4])
VERTICALS = "run_id string, track string, t double, hx double, hy double, fx double, fy double, sigma double"


def verticals(rng, tracks, each, camera=CAMERA, noise=0.5, sigma=2.0, z=(4, 11), run="r", start=0.0):
    rows = []
    for k in range(tracks):
        for i in range(each):
            x, d = rng.uniform(-3, 3), rng.uniform(*z)
            fx, fy = ground.project(camera, np.array(x), np.array(d), 0.0, FRAME.cx, FRAME.cy)
            hx, hy = ground.project(camera, np.array(x), np.array(d), 1.0, FRAME.cx, FRAME.cy)
            n = rng.normal(0, noise, 4)
            rows.append((run, f"t{k}", start + i * 1.0, *(float(v) for v in (hx + n[0], hy + n[1], fx + n[2], fy + n[3])), sigma))
    return rows


def own(rows):
    return pd.DataFrame(rows, columns=[f.split()[0] for f in VERTICALS.split(", ")])


def test_fit_finds_the_camera_and_replicates_surround_it(spark):
    rng = np.random.default_rng(1)
    rows = verticals(rng, 8, 15) + verticals(rng, 6, 20, np.array([1300.0, 40.0, 5.0]), run="steep") + verticals(rng, 3, 8, run="few tracks") + verticals(rng, 8, 1, run="few")
    df = spark.createDataFrame(rows, VERTICALS)
    gates = replace(ground.Gates(), replicates=60, least_replicates=40)
    planes, ensemble = clips.planes_of(df, FRAME, gates)
    got = {p.run_id: p for p in planes.collect()}
    for run, (focal, pitch, height) in {"r": CAMERA, "steep": (1300.0, 40.0, 5.0)}.items():
        p = got[run]
        assert p.status == "ok" and p.ready and not p.unstable and p.n_replicates == 60 and len(p.region) >= 12
        assert abs(p.focal / focal - 1) < 0.05 and abs(p.pitch - pitch) < 1.5 and abs(p.height / height - 1) < 0.05 and p.inlier_ratio > 0.95
    assert (got["few tracks"].status, got["few"].status) == ("insufficient_distinct_tracks", "insufficient_vertical_observations")
    assert not got["few"].unstable and got["few"].region is None
    spread = ensemble.groupBy("run_id").agg(F.median("pitch").alias("m"), F.stddev("pitch").alias("s"), F.count("*").alias("n")).collect()
    assert {r.run_id: r.n for r in spread} == {"r": 60, "steep": 60}
    assert all(abs(r.m - got[r.run_id].pitch) < 0.5 and 0 < r.s < 2 for r in spread)
    again = ground.bootstrap(df.repartition(7), planes, FRAME, gates)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, ensemble.collect()))  # whatever the partitions


def test_fits_are_spread_over_tasks_and_stop_when_at_rest(spark, monkeypatch):
    """Groups of few bytes and much work are not put in one task; starts that are at rest are not solved on; draws are those of rows looked at one by one."""
    rng = np.random.default_rng(4)
    df = spark.createDataFrame([r for k in range(6) for r in verticals(rng, 6, 10, run=f"r{k}")], VERTICALS)
    gates = replace(ground.Gates(), replicates=100, least_replicates=40)
    fitted = session.written(ground.fit_planes(df, FRAME, gates), "fitted")
    refits = ground.bootstrap(df, fitted, FRAME, gates)
    pairs = spark.range(6000).selectExpr("concat('r', id % 6) AS run_id", "CAST(id AS INT) AS id", "960D AS wx", "700D AS wy", "1D AS w_noise", "array(named_struct('x', 900D, 'y', 800D)) AS targets", "1D AS t_noise")
    bounds = ground.distance_intervals(pairs, session.written(refits, "refits"), ["id"], FRAME.cx, FRAME.cy, least=40)
    for out in (ground.fit_planes(df, FRAME, gates), refits, bounds):
        assert out.select(F.spark_partition_id().alias("p")).distinct().count() > 2
    assert bounds.filter("lower <= median AND median <= upper").count() == 6000
    rows = own(verticals(rng, 6, 10)).sort_values(["track", "t"])
    tracks, at = np.unique(rows["track"], return_inverse=True)
    blocks, draws, want = (rows["t"] // 2.0).to_numpy(int), ground.seeded("r", 7), np.zeros(len(rows))
    for k in draws.integers(0, len(tracks), len(tracks)):
        labels = np.unique(blocks[at == k])
        for label in draws.choice(labels, len(labels)):
            want += (at == k) & (blocks == label)
    assert (ground.block_counts(rows, ground.seeded("r", 7), 2.0) == want).all() and want.sum() > 0
    sizes, real = [], ground.residuals
    monkeypatch.setattr(ground, "residuals", lambda p, *a: sizes.append(len(p)) or real(p, *a))
    ground.solve(np.array([[p, np.log(f * FRAME.width), h] for p, f, h in ground.STARTS]), ground._arrays(rows), FRAME)
    assert sizes[0] == len(ground.STARTS) and min(sizes) < len(ground.STARTS) / 2


def test_slopes_are_the_residuals_and_replicates_are_solved_with_few_residuals(monkeypatch):
    """Derivatives against differences, also where feet are above the horizon; a step takes one pass over the residuals, not four, and a replicate two draws."""
    rng = np.random.default_rng(8)
    rows = own(verticals(rng, 6, 25)).sort_values(["track", "t"])
    o = ground._arrays(rows)
    p, h = np.array([[0.5, 7.3, 3.0], [0.2, 7.0, 5.0], [-0.05, 6.5, 2.0]]), 1e-6
    assert (ground.residuals(p[2:], o, FRAME) > 100).any()
    differences = np.stack([(ground.residuals(p + h * e, o, FRAME) - ground.residuals(p - h * e, o, FRAME)) / (2 * h) for e in np.eye(3)], 1)
    assert np.allclose(ground.slopes(p, o, FRAME), differences.transpose(0, 1, 3, 2), rtol=1e-5, atol=1e-4)
    passes, steps, real, draws = [], [], ground.residuals, []
    linear = np.linalg.solve
    monkeypatch.setattr(ground, "residuals", lambda *a: passes.append(1) or real(*a))
    monkeypatch.setattr(np.linalg, "solve", lambda *a: steps.append(1) or linear(*a))

    class Counted:
        def __init__(self, seed):
            self.rng = np.random.default_rng(seed)

        def integers(self, *a):
            draws.append(1)
            return self.rng.integers(*a)

    weights = np.stack(list(ground._counts(rows, [Counted(i) for i in range(20)], 2.0)))
    ground.solve(np.repeat(ground.parameters(CAMERA)[None], 20, 0), o, FRAME, weights)
    assert len(passes) == len(steps) + 1 and len(draws) == 40


def test_solutions_beat_a_grid():
    """The robust cost of the fit is no higher than that of any camera on a grid around the true one."""
    o = ground._arrays(own(verticals(np.random.default_rng(2), 6, 5, noise=3.0)))
    starts = np.array([[p, np.log(f * FRAME.width), h] for p, f, h in ground.STARTS])
    solved, cost = ground.solve(starts, o, FRAME)
    grid = np.array([[np.radians(p), np.log(f), h] for p in np.linspace(20, 40, 21) for f in np.linspace(1200, 2400, 25) for h in np.linspace(2.5, 4.5, 21)])
    r = ground.residuals(grid, o, FRAME)
    costs = np.where(abs(r) <= 2, r * r, 4 * abs(r) - 4).sum((1, 2))
    assert cost.min() <= costs.min() + 1e-9
    w = np.random.default_rng(3).integers(0, 3, (2, len(o["fx"]))).astype(float)
    repeated = {k: np.repeat(v, w[0].astype(int)) for k, v in o.items()}
    best = solved[cost.argmin()][None]
    a, b = ground.solve(best, o, FRAME, w[:1])[0], ground.solve(best, repeated, FRAME)[0]
    assert np.allclose(a, b, atol=1e-4)  # weights are repeated rows


def fixture(name):
    """Verticals and gates that reach a reason; the gates are the real ones where they can be reached so."""
    rng, gates = np.random.default_rng(5), ground.Gates()
    rows = verticals(rng, 6, 6)
    if name == "focal_length_out_of_range":
        return verticals(rng, 8, 8, np.array([0.42 * 1920, 28.0, 3.4]), noise=0.02), gates
    if name == "low_inlier_ratio":
        return [(*r[:3], r[3] + rng.normal(0, 60), r[4] + rng.normal(0, 60), *r[5:]) for r in rows], gates
    if name == "reprojection_error_too_high":
        return verticals(rng, 8, 8, noise=4.0, sigma=12.0), gates
    if name == "plane_not_in_front_of_camera":
        return verticals(rng, 8, 8, np.array([1000.0, 80.0, 6.0]), noise=0.1, z=(-1.5, 3.5)), gates
    if name == "homography_ill_conditioned":
        return rows, replace(gates, condition=1e3)
    if name == "horizon_unstable_over_time":
        return verticals(rng, 6, 6, noise=0.1) + verticals(rng, 6, 6, np.array([1700.0, 28.6, 3.4]), noise=0.1, start=50.0), gates
    return rows, gates


LATE = ("focal_length_out_of_range", "low_inlier_ratio", "reprojection_error_too_high", "plane_not_in_front_of_camera", "homography_ill_conditioned", "horizon_unstable_over_time")


@pytest.mark.parametrize("name", LATE)
def test_gates_of_the_fit(name):
    rows, gates = fixture(name)
    got = ground._fitted(own(rows), FRAME, gates)
    assert (got["status"], got["unstable"]) == (name, True)


def test_gates_that_need_no_plane(monkeypatch):
    rows = own(fixture("")[0])
    assert ground._fitted(rows, FRAME, ground.Gates())["status"] == "ok"
    assert ground._fitted(rows[:11], FRAME, ground.Gates())["status"] == "insufficient_vertical_observations"
    assert ground._fitted(rows[rows["track"] < "t4"], FRAME, ground.Gates())["status"] == "insufficient_distinct_tracks"
    monkeypatch.setattr(ground, "solve", lambda starts, *a: (np.full((len(starts), 3), np.nan), np.full(len(starts), np.nan)))
    got = ground._fitted(rows, FRAME, ground.Gates())
    assert (got["status"], got["unstable"]) == ("fit_did_not_converge", False)


def test_gates_on_replicates(spark):
    planes = spark.createDataFrame([(r, "ok", False) for r in ("one", "two", "few", "none", "rare")] + [("off", "low_inlier_ratio", True)], "run_id string, status string, unstable boolean")
    rng = np.random.default_rng(6)
    pitches = {"one": rng.normal(28, 0.5, 400), "two": np.r_[rng.normal(28, 0.1, 200), rng.normal(36, 0.1, 200)], "few": rng.normal(28, 0.5, 349), "rare": np.r_[rng.normal(28, 0.1, 380), rng.normal(36, 0.1, 20)]}
    rows = [(r, i, 1700.0, float(p), 3.4) for r, own_ in pitches.items() for i, p in enumerate(own_)]
    got = {r.run_id: (r.status, r.unstable, r.ready, r.n_replicates) for r in ground.gated(planes, spark.createDataFrame(rows, ground.ENSEMBLE), FRAME).collect()}
    assert got == {
        "one": ("ok", False, True, 400), "two": ("multimodal_bootstrap_solution", True, False, 400), "few": ("bootstrap_failed", True, False, 349),
        "none": ("bootstrap_failed", True, False, 0), "rare": ("ok", False, True, 400), "off": ("low_inlier_ratio", True, False, 0),
    }


def slow_hull(points):
    """Corners by definition: points that are in no triangle or segment of others (as few as the test has)."""
    points = sorted(set(map(tuple, points)))
    turn = lambda a, b, c: (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])
    sides = [(a, b) for a, b in itertools.permutations(points, 2) if all(turn(a, b, c) > 0 or turn(a, b, c) == 0 and min(a, b) <= c <= max(a, b) for c in points)]
    return {p for s in sides for p in s} or set(points)


def test_hulls_of_parts_are_hulls(spark):
    rng = np.random.default_rng(7)
    sets = {k: rng.integers(-9, 10, (n, 2)).astype(float) for k, n in enumerate((1, 2, 3, 8, 40))} | {5: np.array([[1.0, 1], [2, 2], [3, 3], [3, 3]]), 6: rng.integers(0, 30, (300, 2)).astype(float)}
    rows = [(k, float(x), float(y), "u") for k, p in sets.items() for x, y in p] + [(None, 0.0, 0.0, "u"), (7, float("nan"), 1.0, "u"), (8, None, 1.0, "u"), (3, float("inf"), 0.0, "u")]
    df = spark.createDataFrame(rows, "k int, x double, y double, corners string").repartition(5)
    got = {r.k: r for r in support.hulls(df, ["k"], "x", "y", 0.5).collect()}
    assert set(got) == {*sets, None} and got[None].n_points == 1
    for k, points in sets.items():
        assert got[k].n_points == len(points) and len(got[k].region) >= 12
        assert {(c.x, c.y) for c in got[k].corners} == slow_hull(points)
    assert support.hulls(df.limit(0), ["k"], "x", "y").count() == 0


def test_support_of_points(spark):
    rng = np.random.default_rng(8)
    corners = support.hull(rng.normal(0, 2, (30, 2)))
    region = support.grown(corners, 0.5)
    asked = rng.normal(0, 3, (400, 2))
    ring = 0.5 * np.stack([np.cos(np.arange(12) * np.pi / 6), np.sin(np.arange(12) * np.pi / 6)], 1)
    cloud = (corners[:, None] + ring).reshape(-1, 2)
    angles = np.linspace(0, 2 * np.pi, 7200)
    ways = np.stack([np.cos(angles), np.sin(angles)], 1)
    inside = ((asked @ ways.T) <= (cloud @ ways.T).max(0) + 1e-3).all(1)  # no direction has it outside
    near = np.abs((asked @ ways.T - (cloud @ ways.T).max(0)).max(1)) < 5e-3
    shown = F.array(*(g.point(*p) for p in region))
    df = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(asked)], "i int, x double, y double")
    got = {r.i: r.s for r in df.select("i", support.supports(shown, F.struct("x", "y")).alias("s")).collect()}
    assert all(got[i] == inside[i] for i in range(400) if not near[i]) and 50 < sum(got.values()) < 350
    odd = spark.createDataFrame([(float("nan"), 0.0), (None, 0.0), (0.0, float("inf")), tuple(map(float, region[0]))], "x double, y double")
    assert [r[0] for r in odd.select(support.supports(shown, F.struct("x", "y"))).collect()] == [False, False, False, True]
    none = F.lit(None).cast(f"array<{schema.POINT}>")
    assert not df.select(support.supports(none, F.struct("x", "y")).alias("s")).filter("s").count()


PAIRS = f"run_id string, id int, wx double, wy double, w_noise double, targets array<{schema.POINT}>, t_noise double"


def test_intervals_of_batches(spark):
    rng = np.random.default_rng(9)
    cams = [("r", i, float(1700 + rng.normal(0, 20)), float(28 + rng.normal(0, 0.3)), 3.4) for i in range(400)]
    ensemble = spark.createDataFrame(cams, ground.ENSEMBLE)
    spot = lambda x, z: dict(zip("xy", map(float, ground.project(CAMERA, np.array(x), np.array(z), 0.0, FRAME.cx, FRAME.cy)), strict=True))
    rows = []
    for i in range(60):
        w = spot(rng.uniform(-3, 3), rng.uniform(4, 9))
        rows.append(("r", i, w["x"], w["y"], 1.0, [spot(0.0, 6.0 + k) for k in range(1 + i % 3)], 1.0))
    rows += [("r", 60, 960.0, -2000.0, 1.0, [spot(0.0, 6.0)], 1.0), ("other", 61, 960.0, 700.0, 1.0, [spot(0.0, 6.0)], 1.0)]
    df = spark.createDataFrame(rows, PAIRS)
    got = {r.id: r for r in ground.distance_intervals(df, ensemble, ["id"], FRAME.cx, FRAME.cy).collect()}
    again = {r.id: r for r in ground.distance_intervals(df.repartition(5), ensemble, ["id"], FRAME.cx, FRAME.cy).collect()}
    assert got == again and got[60].lower is None and got[61].lower is None
    cameras = np.array([c[2:] for c in cams])
    for _, i, wx, wy, _, targets, _ in rows[:60]:  # without noise, the point estimates of all cameras
        x, z = ground.backproject(cameras, wx, wy, FRAME.cx, FRAME.cy)
        d = ground.to_path(x, z, [ground.backproject(cameras, t["x"], t["y"], FRAME.cx, FRAME.cy) for t in targets])
        assert abs(got[i].median - max(np.median(d) - 0.5, 0)) < 0.05 and got[i].lower <= got[i].median <= got[i].upper


def test_trailing_states(spark):
    still = [(1, k * 0.25, 5.0, 5.0) for k in range(30)]
    moving = [(2, k * 0.25, 0.1 * k, 5.0) for k in range(30)]
    off = [(3, k * 0.25, None if k % 3 else 0.5 * k, 5.0) for k in range(30)]
    got = clips.trailing_states(spark.createDataFrame(still + moving + off, "k int, t double, x double, y double"), ["k"]).collect()
    state = {(r.k, r.t): r.operating_state for r in got}
    assert {s for (k, _), s in state.items() if k != 2} == {"unknown"}
    assert [state[2, k * 0.25] for k in range(30)] == ["unknown"] * 3 + ["active"] * 27


def by_hand(rows, planes, cameras_of, s):
    """Point distances and support of every pair of a frame, by NumPy."""
    out = {}
    for frame in sorted({(r.run_id, r.frame_index) for r in rows}):
        here = [r for r in rows if (r.run_id, r.frame_index) == frame]
        p = planes[frame[0]]
        camera = np.array([p.focal, p.pitch, p.height])
        at = lambda x, y: np.array(ground.backproject(camera, x, y, FRAME.cx, FRAME.cy))  # noqa: B023, E731
        region = np.array([[c.x, c.y] for c in p.region])
        after = np.roll(region, -1, 0)
        holds = lambda q: np.isfinite(q).all() and (((after - region)[:, 0] * (q[1] - region[:, 1]) - (after - region)[:, 1] * (q[0] - region[:, 0])) >= 0).all()  # noqa: B023, E731
        for w, m in itertools.product([r for r in here if r.object_class == "person"], [r for r in here if r.object_class != "person"]):
            foot, ends = at(w.anchor.x, w.anchor.y), [at(m.box.x1, m.box.y2), at(m.box.x2, m.box.y2)]
            fits = m.box.y2 <= FRAME.height - 3 and holds(foot) and all(map(holds, ends))
            d = float(ground.to_path(*foot[:, None], [e[:, None] for e in ends])[0]) if fits else None
            out[*frame, w.canonical_track_id, m.canonical_track_id] = (fits, None if d is None else round(max(d - s.inflation, 0), 6))
    return out


def test_clip_as_one_job(spark):
    """The query's own parts over a small table: fitted planes near the camera, pairs as by hand, and rules that agree with their measures."""
    sf = "/root/testdata/sf0.001"
    obs, runs, scenes, proposals, planes, ensemble = plane_queries.clip_parts(spark, sf)
    found = {p.run_id: p for p in planes.collect()}
    assert found and all(p.status == "ok" and abs(p.focal / 1700 - 1) < 0.05 and abs(p.pitch - 28) < 1 for p in found.values())
    workers, machines = rules.people(obs), rules.vehicles(obs).withColumnRenamed("canonical_track_id", "object_id")
    s = rules.Settings()
    near = ground.machine_pairs(workers, machines, planes, rules.FRAME, FRAME, FRAME.height, s.inflation)
    got = {(r.run_id, r.frame_index, r.canonical_track_id, r.object_id): (r.compatible, r.distance and round(r.distance, 6)) for r in near.collect()}
    want = by_hand(obs.collect(), found, None, s)
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()} and len(got) > 30 and {v[0] for v in got.values()} == {True, False}
    assert all(v[1] is None and want[k][1] is None or abs(v[1] - want[k][1]) < 1e-5 for k, v in got.items())
    incidents, coverage = clips.evaluated(obs, runs, scenes, proposals, planes, ensemble, FRAME, FRAME.height)
    rows = coverage.collect()
    assert sorted((r.run_id, r.rule_id) for r in rows) == sorted(itertools.product(found, schema.DOMAINS["rule_id"]))
    assert {r.reason_code for r in rows if r.rule_id in ("R4", "R5")} <= {"operating_state_unknown", "inconclusive_distance", "outside_active_near_band", "active_machine_near_band", "visible_unguarded_edge", "guarded_or_outside_edge_band"}
    alerted = {(r.run_id, r.rule_id) for r in rows if r.status == "alert"}
    assert {(i.run_id, i.rule_id) for i in incidents.collect()} == alerted
