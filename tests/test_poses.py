"""Crown, sole and doubts of people from keypoints, against plain Python."""

import math
import random

import pytest
from pyspark.sql import functions as F

from obsengine.functions import pose
from obsengine.operators import poses
from obsengine.plans.plane_queries import FIGURE

RNG = random.Random(16)
KEYPOINTS = "keypoints array<struct<x:double,y:double,c:double>>"


def middle(points, places):
    use = [points[i] for i in places if points[i][2] >= 0.6]
    total = sum(c for _, _, c in use)
    return use and (sum(x * c for x, _, c in use) / total, sum(y * c for _, y, c in use) / total)


def plain(points):
    eyes, shoulders, hips, ankles = (middle(points, p) for p in (range(5), (5, 6), (11, 12), (15, 16)))
    if not (eyes and shoulders and hips and ankles):
        return None
    crown = tuple(e + 0.54 * (e - s) for e, s in zip(eyes, shoulders, strict=True))
    sole = tuple(a + 0.039 / 0.961 * (a - c) for a, c in zip(ankles, crown, strict=True))
    height = math.dist(crown, sole)
    if not (height > 0 and math.isfinite(height)):
        return None
    torso, legs = math.dist(shoulders, hips), math.dist(hips, ankles)
    if min(torso, legs) < 1e-6:
        standing = 0.0
    else:
        along = sum((h - s) * (a - h) for s, h, a in zip(shoulders, hips, ankles, strict=True)) / (torso * legs)
        standing = min(min(max((along - 0.8) / 0.15, 0), 1), min(max((legs / torso - 0.8) / 0.6, 0), 1))
    mean = lambda places: (lambda c: sum(c) / len(c))([points[i][2] for i in places if points[i][2] >= 0.6])
    head, foot = mean(range(5)), mean((15, 16))
    hv, fv = (0.03 * height / max(head, 0.5)) ** 2, (0.015 * height / max(foot, 0.5)) ** 2
    spread = [hv, 0, 0, 0, 0, hv, 0, 0, 0, 0, fv, 0, 0, 0, 0, fv]
    return [*crown, *sole, head, foot, standing, sum(c < 0.5 for _, _, c in points) / 17, height, *spread]


def figures():
    whole = [(100 * x, 100 * y, 0.9) for x, y in FIGURE]
    yield whole
    for _ in range(150):
        yield [(100 * x + RNG.gauss(0, 6), 100 * y + RNG.gauss(0, 6), RNG.uniform(0.3, 1)) for x, y in FIGURE]
    for missing in ((0, 1, 2, 3, 4), (5, 6), (11, 12), (15, 16), (1, 5, 11, 15)):
        yield [(x, y, 0.1 if i in missing else c) for i, (x, y, c) in enumerate(whole)]
    yield [(5.0, 5.0, 0.9)] * 17
    yield [(5.0, 5.0 if i < 15 else 90.0, 0.9) for i in range(17)]
    yield [(x, y if i < 13 else y - 40, 0.9) for i, (x, y, _) in enumerate(whole)]
    yield [(float("nan"), y, c) for _, y, c in whole]


def test_vertical_pairs(spark):
    rows = list(figures())
    df = spark.createDataFrame([(i, p) for i, p in enumerate(rows)] + [(999, None)], f"i int, {KEYPOINTS}")
    got = {r.i: r.v for r in df.select("i", pose.vertical_pair(F.col("keypoints")).alias("v")).collect()}
    assert got[999] is None
    for i, points in enumerate(rows):
        want = plain(points)
        if want is None:
            assert got[i] is None
        else:
            v = got[i]
            assert [*v[:9], *(x for line in v.covariance for x in line)] == pytest.approx(want, abs=1e-9)
    assert sum(v is None for v in got.values()) >= 7


def test_only_standing_people_in_view_are_used(spark):
    rows = [("r", "s", i, i * 0.5, f"t{i}", p, 10.0, 20.0) for i, p in enumerate(figures())]
    df = spark.createDataFrame(rows, f"run_id string, shot_id string, frame_index int, video_time_s double, canonical_track_id string, {KEYPOINTS}, crop_x double, crop_y double")
    got = {r.observation_id: r for r in poses.verticals(df).collect()}
    want = {f"t{i}-{i}": v for i, p in enumerate([r[5] for r in rows]) if (v := plain(p)) and v[6] >= 0.8 and v[7] <= 0.25 and min(v[4:6]) >= 0.6 and abs(v[1] - v[3]) >= 40}
    assert set(got) == set(want) and 5 < len(want) < 150
    for k, v in want.items():
        assert (got[k].hx - 10, got[k].hy - 20, got[k].sigma) == pytest.approx((v[0], v[1], max(2.0, 0.03 * v[8])))


