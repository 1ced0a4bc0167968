"""Rules, scene consensus and ground plane on small fixtures."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from obsengine import schema
from obsengine.operators import rules, scene

W, H, CX, CY = 1920.0, 1080.0, 960.0, 540.0
MEASURES = "run_id string, shot_id string, frame_index int, canonical_track_id string, object_id string, compatible boolean, distance double, lower double, median double, upper double"
STATES = "run_id string, shot_id string, frame_index int, object_id string, operating_state string"


def row(t, track=1, kind="person", helmet="unknown", vest="unknown", anchor=(45.0, 180.0), run="r", shot="s0"):
    gear = lambda s, c: {"state": s, "confidence": c, "visible": True}
    x, y = anchor
    return (run, shot, round(t * 10), float(t), track, f"{shot}/{kind}-{track}", kind, 0.9, {"x1": x - 20, "y1": y - 100, "x2": x + 20, "y2": y}, {"x": x, "y": y}, gear(helmet, 0.9), gear(vest, 0.88))


def run_rule(spark, rule, rows, *more):
    obs = spark.createDataFrame(rows, schema.OBSERVATIONS)
    found, coverage = rule(obs, spark.createDataFrame([("r",)], "run_id string"), *more)
    c = coverage.collect()
    assert len(c) == 1
    return found.collect(), (c[0].status, c[0].reason_code)


STEPS = [i / 10 for i in range(31)]
HELMET = {
    "alert": ([row(t, helmet="no_helmet") for t in STEPS], ("alert", "detected_missing_helmet")),
    "worn": ([row(t, helmet="helmet") for t in STEPS], ("clear", "no_helmet_alerts_detected")),
    "one row": ([row(0, helmet="no_helmet")], ("inconclusive", "no_helmet_below_debounce")),
    "no rows": ([], ("inconclusive", "no_person_tracks")),
    "unknown": ([row(t) for t in STEPS], ("inconclusive", "no_ppe_evidence")),
    "null gear": ([row(0)[:10] + (None, None)], ("inconclusive", "no_ppe_evidence")),
    "gap": ([row(t, helmet="no_helmet") for t in (0, 1, 9, 10)], ("inconclusive", "no_helmet_below_debounce")),
}


@pytest.mark.parametrize("name", HELMET)
def test_missing_helmet(spark, name):
    rows, want = HELMET[name]
    found, got = run_rule(spark, rules.missing_helmet, rows)
    assert got == want and len(found) == (want[0] == "alert")
    if found:
        assert (found[0].first_seen_s, found[0].confirmed_at_s, found[0].resolved_at_s) == (0.0, 1.5, 3.0)


VEST = {
    "alert": ([row(t, kind=k, vest="no_vest") for t in range(5) for k in ("person", "vehicle")], ("alert", "detected_missing_vest_near_vehicle")),
    "no gap rule": ([row(t, kind=k, vest="no_vest") for t in (0, 100) for k in ("person", "vehicle")], ("alert", "detected_missing_vest_near_vehicle")),
    "no vehicle": ([row(t, vest="no_vest") for t in range(5)], ("inconclusive", "no_machinery_tracks")),
    "other shot": ([row(t, vest="no_vest") for t in range(5)] + [row(t, kind="vehicle", shot="s1") for t in range(5)], ("inconclusive", "no_ppe_evidence")),
    "worn": ([row(t, kind=k, vest="vest") for t in range(5) for k in ("person", "vehicle")], ("clear", "no_vest_alerts_near_vehicle")),
}


@pytest.mark.parametrize("name", VEST)
def test_missing_vest(spark, name):
    rows, want = VEST[name]
    found, got = run_rule(spark, rules.missing_vest, rows)
    assert got == want and len(found) == (want[0] == "alert")


SQUARE = [{"x": float(x), "y": float(y)} for x, y in ((100, 100), (500, 100), (500, 500), (100, 500))]
ZONE = {
    "inside": ((300.0, 400.0), STEPS, "ok", True, ("alert", "restricted_zone_entry")),
    "outside": ((900.0, 900.0), STEPS, "ok", True, ("clear", "worker_outside_restricted_zone")),
    "brief": ((300.0, 400.0), STEPS[:5], "ok", True, ("clear", "worker_outside_restricted_zone")),
    "edge": ((502.0, 300.0), STEPS, "ok", True, ("inconclusive", "zone_boundary_uncertain")),
    "no scene": ((300.0, 400.0), STEPS, None, True, ("inconclusive", "restricted_zone_scene_state_unavailable")),
    "no zones": ((300.0, 400.0), STEPS, "ok", False, ("not_applicable", "no_supported_restricted_zone")),
    "nobody": ((300.0, 400.0), [], "ok", True, ("not_applicable", "no_person_tracks")),
}


@pytest.mark.parametrize("name", ZONE)
def test_restricted_zone(spark, name):
    anchor, times, status, there, want = ZONE[name]
    scenes = spark.createDataFrame([("r", status)], "run_id string, scene_status string")
    zone = ("r", "restricted_zone-1", "restricted_zone", "polygon", SQUARE, None, None, None, 0.8, [1], 8)
    zones = spark.createDataFrame([zone] if there else [], schema.PROPOSALS)
    found, got = run_rule(spark, rules.restricted_zone, [row(t, anchor=anchor) for t in times], scenes, zones)
    assert got == want and [(f.object_id, f.proposal_ids, f.confidence) for f in found] == [(None, ["restricted_zone-1"], 0.8)] * (want[0] == "alert")


PLANE = (False, True)
PLANE_ROWS = "run_id string, unstable boolean, ready boolean, inlier_ratio double"
NEAR = {
    "alert": (PLANE, (0.2, 1.4), "active", True, ("alert", "active_machine_near_band")),
    "far": (PLANE, (9.0, 9.5), "active", True, ("clear", "outside_active_near_band")),
    "idle": (PLANE, (0.2, 1.4), None, True, ("inconclusive", "operating_state_unknown")),
    "vague": (PLANE, (0.9, 2.2), "active", True, ("inconclusive", "inconclusive_distance")),
    "unstable": ((True, True), (0.2, 1.4), "active", True, ("unsupported", "geometry_unstable_for_feed")),
    "no plane": ((False, False), (0.2, 1.4), "active", True, ("inconclusive", "relative_plane_unavailable")),
    "no vehicle": (PLANE, (0.2, 1.4), "active", False, ("not_applicable", "no_machinery_tracks")),
    "no bounds": (PLANE, (None, None), "active", True, ("inconclusive", "inconclusive_distance")),
    "no bounds, no state": (PLANE, (None, None), None, True, ("inconclusive", "operating_state_unknown")),
    "off plane": (PLANE, None, "active", True, ("inconclusive", "target_plane_incompatible")),
    "beyond candidates": (PLANE, (8.5, None), "active", True, ("clear", "outside_active_near_band")),
}


def measures(spark, to, bounds, frames):
    """One pair's measures; bounds None: off the plane's support; upper None: no bounds."""
    lower, upper = bounds or (None, None)
    known = (lower, (lower + upper) / 2, upper) if upper is not None else (None, None, None)
    return spark.createDataFrame([("r", "s0", f, "s0/person-1", to, bounds is not None, None if bounds is None else lower or 0.0, *known) for f in frames], MEASURES)


@pytest.mark.parametrize("name", NEAR)
def test_proximity(spark, name):
    plane, bounds, state, vehicle, want = NEAR[name]
    rows = [row(t) for t in STEPS] + [row(t, 50, "vehicle") for t in STEPS if vehicle]
    planes = spark.createDataFrame([("r", *plane, 0.81)], PLANE_ROWS)
    frames = [round(t * 10) for t in STEPS]
    states = spark.createDataFrame([("r", "s0", f, "s0/vehicle-50", state) for f in frames if state], STATES)
    found, got = run_rule(spark, rules.proximity, rows, planes, measures(spark, "s0/vehicle-50", bounds, frames), states)
    assert got == want and [(f.object_id, f.confidence) for f in found] == [("s0/vehicle-50", 0.81)] * (want[0] == "alert")


def test_doubts_of_proximity_have_to_last(spark):
    rows = [row(t) for t in STEPS] + [row(t, 50, "vehicle") for t in STEPS]
    planes = spark.createDataFrame([("r", False, True, 0.81)], PLANE_ROWS)
    frames = [round(t * 10) for t in STEPS]
    states = spark.createDataFrame([("r", "s0", f, "s0/vehicle-50", "idle" if f > frames[0] else "unknown") for f in frames], STATES)
    assert run_rule(spark, rules.proximity, rows, planes, measures(spark, "s0/vehicle-50", (0.2, 1.4), frames), states) == ([], ("clear", "outside_active_near_band"))


def test_repeated_rows_make_no_more_pairs(spark, monkeypatch):
    """Rows of a track that stand in a frame several times, on both sides, change nothing and are not multiplied."""
    rows = [row(t) for t in STEPS] + [row(t, 50, "vehicle") for t in STEPS]
    planes = spark.createDataFrame([("r", False, True, 0.81)], PLANE_ROWS)
    frames = [round(t * 10) for t in STEPS]
    states = spark.createDataFrame([("r", "s0", f, "s0/vehicle-50", "active") for f in frames], STATES)
    seen, real = [], rules.joins.lookup
    monkeypatch.setattr(rules.joins, "lookup", lambda pairs, *a: seen.append(pairs.count()) or real(pairs, *a))
    once, often = (run_rule(spark, rules.proximity, rows * n, planes, measures(spark, "s0/vehicle-50", (0.2, 1.4), frames), states) for n in (1, 20))
    assert once == often and once[1] == ("alert", "active_machine_near_band") and len(once[0]) == 1
    assert seen == [len(STEPS)] * 2


EDGE = {
    "alert": ((True, "sufficient", "unguarded_or_inadequate"), (0.0, 0.7), ("alert", "visible_unguarded_edge")),
    "far": ((True, "sufficient", "unguarded_or_inadequate"), (2.0, 3.0), ("clear", "guarded_or_outside_edge_band")),
    "no drop": ((None, "sufficient", "unguarded_or_inadequate"), (0.0, 0.7), ("inconclusive", "edge_semantics_unknown")),
    "no view": ((True, "insufficient", "unguarded_or_inadequate"), (0.0, 0.7), ("inconclusive", "protection_visibility_insufficient")),
    "unknown": ((True, "sufficient", None), (0.0, 0.7), ("inconclusive", "protection_state_unknown")),
    "guarded": ((True, "sufficient", "guarded"), (0.0, 0.7), ("clear", "guarded_or_outside_edge_band")),
    "vague": ((True, "sufficient", "unguarded_or_inadequate"), (0.5, 1.5), ("inconclusive", "inconclusive_distance")),
    "none": (None, (0.0, 0.7), ("not_applicable", "no_visible_open_edge_candidate")),
    "no bounds": ((True, "sufficient", "unguarded_or_inadequate"), (0.0, None), ("inconclusive", "inconclusive_distance")),
    "worker off plane": ((True, "sufficient", "unguarded_or_inadequate"), None, ("clear", "guarded_or_outside_edge_band")),
    "edge off plane": ((True, "sufficient", "unguarded_or_inadequate"), (0.0, 0.7), ("inconclusive", "target_plane_incompatible")),
    "beyond candidates": ((True, "sufficient", "unguarded_or_inadequate"), (8.5, None), ("clear", "guarded_or_outside_edge_band")),
}


@pytest.mark.parametrize("name", EDGE)
def test_open_edge(spark, name):
    flags, bounds, want = EDGE[name]
    scenes = spark.createDataFrame([("r", "ok")], "run_id string, scene_status string")
    edges = spark.createDataFrame([("r", "open_edge-1", "open_edge", "polyline", SQUARE[:2], *flags, 0.7, [1], 8)] if flags else [], schema.PROPOSALS)
    planes = spark.createDataFrame([("r", False, True, 0.81)], PLANE_ROWS)
    held = spark.createDataFrame([("r", "open_edge-1", name != "edge off plane")], "run_id string, object_id string, compatible boolean")
    found, got = run_rule(spark, rules.open_edge, [row(t) for t in STEPS], scenes, edges, planes, held, measures(spark, "open_edge-1", bounds, [round(t * 10) for t in STEPS]))
    assert got == want and [f.confidence for f in found] == [0.81] * (want[0] == "alert")


def test_all_rules_cover_each_run(spark):
    obs = spark.createDataFrame([row(t, helmet="no_helmet") for t in STEPS], schema.OBSERVATIONS)
    runs = spark.createDataFrame([("r",), ("empty",)], "run_id string")
    none = lambda s: spark.createDataFrame([], s)
    found, coverage = rules.all_rules(obs, runs, none("run_id string, scene_status string"), none(schema.PROPOSALS), none(PLANE_ROWS), none(MEASURES), none("run_id string, object_id string, compatible boolean"), none(MEASURES), none(STATES))
    rows = coverage.collect()
    assert sorted((r.run_id, r.rule_id) for r in rows) == sorted(itertools.product(("r", "empty"), schema.DOMAINS["rule_id"]))
    assert all(r.status in schema.DOMAINS["status"] for r in rows) and [f.rule_id for f in found.collect()] == ["R1"]
    assert [(n, t) for n, t in found.dtypes] == none(schema.INCIDENTS).dtypes


def test_validation(spark):
    bad = list(row(0.0))
    bad[10] = {"state": "hat", "confidence": 2.0, "visible": True}
    good, rest = schema.validate(spark.createDataFrame([row(0.0), tuple(bad)], schema.OBSERVATIONS), schema.observation_checks())
    assert good.count() == 1 and rest.select("failed").collect()[0][0] == ["helmet"]


def test_scene_validation_and_consensus(spark):
    kinds = "run_id string, keyframe int, place int, row int, proposal_type string, points array<struct<x:double,y:double>>, visible_drop_or_open_side boolean"
    square = lambda d: [{"x": x + d, "y": y + d} for x, y in ((100.0, 100.0), (500.0, 100.0), (500.0, 500.0), (100.0, 500.0))]
    far = [{"x": p["x"] + 450, "y": p["y"] + 450} for p in square(0.0)]
    rows = [("r", k, 0, k, "restricted_zone", square(float(k)), None) for k in range(8)] + [("r", k, 1, 20 + k, "restricted_zone", far, None) for k in range(2)]
    rows += [("r", k, 2, 40 + k, "open_edge", [{"x": 0.0, "y": 900.0}, {"x": 900.0, "y": 900.0 + k}], k != 3) for k in range(8)]
    bow = [{"x": x, "y": y} for x, y in ((0.0, 0.0), (500.0, 500.0), (500.0, 0.0), (0.0, 500.0))]
    rows += [("r", 0, 0, 99, "restricted_zone", square(0.0), None), ("r", 1, 9, 100, "pit", square(0.0), None), ("r", 2, 9, 101, "restricted_zone", bow, None), ("r", 3, 9, 102, "open_edge", square(0.0)[:2], None), ("r", 4, 9, 103, "restricted_zone", None, None)]
    accepted, rejected = scene.validated(spark.createDataFrame(rows, kinds), W, H)
    assert sorted((r.row, r.reason) for r in rejected.collect()) == [(99, "duplicate"), (100, "unknown_type"), (101, "self_intersecting"), (102, "missing_drop_flag"), (103, "too_few_points")]
    got = scene.consensus(accepted, spark.createDataFrame([("r", 8)], "run_id string, eligible int"), W, H).collect()
    assert sorted((r.proposal_id, r.frames, r.kept, r.visible_drop_or_open_side) for r in got) == [("open_edge-1", 8, True, True), ("restricted_zone-1", 8, True, None), ("restricted_zone-2", 2, False, None)]
    assert abs(scene.mask_iou(*(scene.rasterized(np.array([[p["x"] + d, p["y"]] for p in square(0.0)]), W, H) for d in (0, 200))) - 1 / 3) < 0.03
    assert abs(scene.chamfer(np.array([[0.0, 0], [100, 0]]), np.array([[0.0, 10], [100, 10]])) - 10) < 0.5


def test_zones_have_the_outline_that_half_of_the_masks_hold(spark):
    kinds = "run_id string, keyframe int, place int, proposal_type string, points array<struct<x:double,y:double>>, visible_drop_or_open_side boolean"
    zone = lambda x, y, w, h: [{"x": a, "y": b} for a, b in ((x, y), (x + w, y), (x + w, y + h), (x, y + h))]
    boxes = [(200.0, 200.0, 400.0, 300.0)] * 3 + [(280.0, 160.0, 400.0, 340.0)] * 3  # their outline is no member's
    rows = [("r", k, 0, "restricted_zone", zone(*b), None) for k, b in enumerate(boxes[:1] + boxes[3:5] + boxes[1:3])]
    rows += [("thin", k, 0, "restricted_zone", zone(3.0, 3.0, 1.0, 1.0), None) for k in range(6)]
    rows += [("half", k, 0, "restricted_zone", zone(*b), None) for k, b in enumerate(boxes)]
    eligible = spark.createDataFrame([("r", 5), ("thin", 6), ("half", 6)], "run_id string, eligible int")
    got = {r.run_id: r for r in scene.consensus(spark.createDataFrame(rows, kinds), eligible, W, H).collect()}
    assert {k: r.kept for k, r in got.items()} == {"r": True, "thin": False, "half": True}
    points = lambda k: {(p["x"], p["y"]) for p in got[k].points}
    assert points("r") == {(200, 200), (600, 200), (600, 500), (200, 500)}  # three of five
    assert {(680, 160), (280, 160), (200, 500), (680, 500), (200, 200)} <= points("half")  # three of six: the union
    assert abs(scene.outline_area(np.array([[p["x"], p["y"]] for p in got["half"].points])) - 160_000) <= 0.02 * 160_000


def test_outlines_are_external_and_simplified():
    ring = np.zeros((40, 60), bool)
    ring[5:35, 10:50], ring[10:30, 20:40], ring[0, 0] = True, False, True
    single, outer = sorted(scene.outlines(ring), key=len)
    assert single.tolist() == [[0, 0]] and scene.outline_area(outer) == 39 * 29
    assert {tuple(p) for p in scene.simplified(outer)} == {(10, 5), (49, 5), (49, 34), (10, 34)}
    assert scene.rasterized(np.zeros((3, 2)), W, H).shape == (108, 192) and scene.voted([np.zeros((9, 9), bool)]) is None
