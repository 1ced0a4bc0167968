"""Queries on the ground plane: support regions, groups of values, and whole clips whose planes are fitted to what is seen.

Users are tracks, 40 of them a clip; an event is an observation of its user, an hour a frame of a tenth of a second.
"""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from obsengine import schema
from obsengine.functions import geometry as g
from obsengine.operators import clips, ground, poses, rules, support
from obsengine.plans.common import HOUR, events, table
from obsengine.plans.rule_queries import EPOCH, reported
from obsengine.session import written

FRAME = ground.Frame(1920.0, 1080.0, 960.0, 540.0)
CAMERA = g.Camera(1700.0, 28.0, 3.4, FRAME.cx, FRAME.cy)
CLIP_USERS, MARGIN = 40, 0.5
EDGE_POINTS = [(-1.0, 7.0), (1.0, 7.0)]


def support_region(spark, sf_dir):
    """Each event type's support of values and hours of day, of all but each tenth event, and how many of those tenths it holds."""
    e = events(spark, sf_dir).select("event_type", (F.col("value") / 100).alias("x"), (F.floor(F.col("us") / HOUR) % 24 / 4).alias("y"), (F.col("event_id") % 10 == 0).alias("asked"))
    regions = support.hulls(e.filter("NOT asked"), ["event_type"], "x", "y", MARGIN)
    asked = e.filter("asked").withColumn("y", F.col("y") * 1.15)  # some late hours are beyond all others
    held = asked.join(regions, "event_type").withColumn("held", support.supports(F.col("region"), F.struct("x", "y")))
    found = held.groupBy("event_type").agg(F.count("*").alias("n_asked"), F.count_if("held").alias("n_held"))
    lowest = F.array_min(F.transform("corners", lambda c: c["x"]))
    shown = regions.select("event_type", "n_points", F.size("corners").cast("long").alias("n_corners"), F.round(g.area(F.col("corners")), 6).alias("area"), F.round(lowest, 6).alias("lowest"))
    return shown.join(found, "event_type")


def split_values(spark, sf_dir):
    """Whether the prices of each supplier's parts of a size fall into two groups. Sizes are in tens."""
    lines = table(spark, sf_dir, "lineitem").select("l_suppkey", (F.col("l_extendedprice") * F.when(F.col("l_quantity") > 25, 1).otherwise(F.lit(0.2))).alias("v"))
    return ground.two_clusters(lines, ["l_suppkey"], "v", 1000.0)


def seen_people(spark, sf_dir):
    """schema.OBSERVATIONS of events, as CAMERA sees a user's place: every fifth user is a machine, which moves."""
    e = events(spark, sf_dir).withColumn("frame", F.floor((F.col("us") - EPOCH) / HOUR).cast("int"))
    user, frame, event = F.col("user_id"), F.col("frame"), F.col("event_id")
    machine = user % 5 == 0
    x = (user * 37 % 80) / 10.0 - 4 + F.when(machine, frame % 40 * 0.05).otherwise(0.0)
    z = 4 + (user * 53 % 60) / 10.0
    shaken = lambda k: ((event * k) % 11 - 5) / 10.0
    placed = e.withColumns({"_foot": CAMERA.pixel(x, z), "_head": CAMERA.pixel(x, z, 1.0)})
    fx, fy = F.col("_foot.x") + shaken(3), F.col("_foot.y") + shaken(5)
    hx, hy = F.col("_head.x") + shaken(7), F.col("_head.y") + shaken(9)
    half = F.when(machine, 60.0).otherwise(0.2 * (fy - hy))
    gear = lambda state: F.struct(state.alias("state"), F.lit(0.9).alias("confidence"), F.lit(True).alias("visible"))
    name = F.when(machine, "vehicle").otherwise("person")
    return placed.select(
        F.concat(F.lit("clip"), F.floor(user / CLIP_USERS).cast("string")).alias("run_id"), F.lit("s0").alias("shot_id"), "frame", (frame / 10.0).alias("video_time_s"),
        user.cast("long").alias("track_id"), F.concat(F.lit("s0/"), name, F.lit("-"), user.cast("string")).alias("canonical_track_id"), name.alias("object_class"), F.lit(0.9).alias("confidence"),
        F.struct((fx - half).alias("x1"), F.when(machine, fy - 200).otherwise(hy).alias("y1"), (fx + half).alias("x2"), fy.alias("y2")).alias("box"), F.struct(fx.alias("x"), fy.alias("y")).alias("anchor"),
        gear(F.when(F.col("event_type") == "error", "no_helmet").otherwise("unknown")).alias("helmet"), gear(F.when(F.col("value") < 10, "no_vest").otherwise("vest")).alias("vest"), hx.alias("hx"), hy.alias("hy"),
    ).withColumnRenamed("frame", "frame_index")


def upright(obs):
    """Vertical observations of the sampled rows of `seen_people`: its heads and feet, as sure as a share of their distance."""
    tall = F.hypot(F.col("hx") - F.col("anchor.x"), F.col("hy") - F.col("anchor.y"))
    return clips.sampled(obs, FRAME).select(
        "run_id", F.col("canonical_track_id").alias("track"), F.col("video_time_s").alias("t"), "hx", "hy", F.col("anchor.x").alias("fx"), F.col("anchor.y").alias("fy"), F.greatest(F.lit(2.0), 0.03 * tall).alias("sigma")
    )


def pixel_of(x: float, z: float) -> dict[str, float]:
    tilt = math.radians(CAMERA.pitch)
    depth = z * math.cos(tilt) + CAMERA.height * math.sin(tilt)
    return {"x": CAMERA.cx + CAMERA.focal * x / depth, "y": CAMERA.cy + CAMERA.focal * (CAMERA.height * math.cos(tilt) - z * math.sin(tilt)) / depth}


def clip_parts(spark, sf_dir):
    """Observations, runs, scenes, proposals, planes and replicates, the last two as written tables."""
    rows = written(clips.one_row_a_frame(seen_people(spark, sf_dir)), "clip-rows")
    runs = rows.select("run_id").distinct()
    edge = [F.struct(F.lit(p["x"]).alias("x"), F.lit(p["y"]).alias("y")) for p in (pixel_of(*p) for p in EDGE_POINTS)]
    given = {"proposal_id": "edge-1", "proposal_type": "open_edge", "geometry_type": "line", "points": F.array(*edge), "visible_drop_or_open_side": True, "protection_visibility": "sufficient", "protection_state": "unguarded_or_inadequate", "agreement_score": 0.75, "supporting_keyframes": F.array(F.lit(1), F.lit(2)), "eligible_keyframes": 3}
    proposals = runs.select("run_id", *((v if hasattr(v, "alias") else F.lit(v)).alias(k) for k, v in given.items()))
    planes, ensemble = clips.planes_of(upright(rows), FRAME)
    return rows.drop("hx", "hy"), runs, runs.withColumn("scene_status", F.lit("ok")), proposals, planes, ensemble


def clip_rules(spark, sf_dir):
    """All rules over clips, from fitted planes on."""
    return reported(clips.evaluated(*clip_parts(spark, sf_dir), FRAME, FRAME.height))


def clip_planes(spark, sf_dir):
    """The planes of clips, their gates, and the area of their support."""
    planes = clip_parts(spark, sf_dir)[4]
    return planes.select("run_id", "status", "unstable", "focal", "pitch", "height", "n_observations", "n_tracks", "inlier_ratio", "rms", "condition", "horizon_shift", "n_replicates", F.round(g.area(F.col("region")), 6).alias("support"))


#: Keypoints of a standing figure of height 1, from the crown down: (across, down).
FIGURE = [
    (0.0, 0.09), (-0.02, 0.07), (0.02, 0.07), (-0.04, 0.08), (0.04, 0.08), (-0.12, 0.19), (0.12, 0.19), (-0.16, 0.33), (0.16, 0.33),
    (-0.17, 0.46), (0.17, 0.46), (-0.08, 0.52), (0.08, 0.52), (-0.08, 0.74), (0.08, 0.74), (-0.08, 0.96), (0.08, 0.96),
]


def pose_verticals(spark, sf_dir):
    """Upright people of figures made of events: as tall as the value, of varied confidence; clicks crouch, and errors lean."""
    e = events(spark, sf_dir)
    event, kind, tall = F.col("event_id"), F.col("event_type"), 40 + F.col("value")
    down = lambda i, y: y * F.when((kind == "click") & (F.lit(i) > 12), 0.75).otherwise(1.0)
    lean = lambda y: F.when(kind == "error", 0.4 * y).otherwise(0.0)
    points = [
        F.struct(((x + lean(y)) * tall + event % 7).alias("x"), (down(i, y) * tall + event % (i + 2)).alias("y"), (0.4 + 0.6 * ((event * (i + 3)) % 50) / 50).alias("c"))
        for i, (x, y) in enumerate(FIGURE)
    ]
    seen = e.select(
        F.lit("r").alias("run_id"), F.lit("s0").alias("shot_id"), event.alias("frame_index"), (event / 10).alias("video_time_s"), F.col("user_id").cast("string").alias("canonical_track_id"),
        F.array(*points).alias("keypoints"), (F.col("user_id") % 100).alias("crop_x"), (F.col("user_id") % 50).alias("crop_y"),
    )
    v = poses.verticals(seen)
    whole = lambda v: F.floor(v * 1000 + 0.5001)  # thousandths; off the ties, where engines differ
    some = [whole(F.col(c)).alias(c) for c in ("hx", "hy", "fx", "fy", "head", "foot", "standing", "occlusion", "pixels", "sigma")]
    spread = F.col("covariance")
    off = F.aggregate(F.flatten(spread), F.lit(0.0), lambda s, x: s + x) - 2 * spread[0][0] - 2 * spread[3][3]
    return v.select("observation_id", *some, whole(spread[1][1]).alias("head_variance"), whole(spread[2][2]).alias("foot_variance"), whole(off).alias("between"))


QUERIES = {f.__name__: f for f in (support_region, split_values, clip_rules, clip_planes, pose_verticals)}

#: Corners are found one by one, from the lowest on: the next is the one that has all others to its left, the farthest on ties.
#: A point is held if it is no farther out than the corners and the margin's ring, along the normals of the sides of both.
ORACLE_SQL = {
    "support_region": f"""WITH RECURSIVE e AS (SELECT event_type AS k, value / 100 AS x, epoch_us(ts) // {HOUR} % 24 / 4 AS y, event_id % 10 = 0 AS asked FROM events),
p AS (SELECT DISTINCT k, x, y FROM e WHERE NOT asked),
few AS (SELECT DISTINCT k, x, y FROM (SELECT k, y, unnest([min(x), max(x)]) AS x FROM p GROUP BY k, y)),
start AS (SELECT k, x, y FROM few QUALIFY row_number() OVER (PARTITION BY k ORDER BY x, y) = 1),
walk AS (SELECT k, 0 AS n, x, y, x AS sx, y AS sy, 0::DOUBLE AS heading FROM (SELECT k, x, y FROM start)
  UNION ALL SELECT k, n + 1, x, y, sx, sy, heading FROM (
    SELECT w.k, w.n, q.x, q.y, w.sx, w.sy, atan2(q.y - w.y, q.x - w.x) AS heading
    FROM walk w JOIN few q ON q.k = w.k AND (q.x <> w.x OR q.y <> w.y)
    WHERE w.n = 0 OR w.x <> w.sx OR w.y <> w.sy
    QUALIFY row_number() OVER (PARTITION BY w.k ORDER BY round((atan2(q.y - w.y, q.x - w.x) - CASE WHEN w.n = 0 THEN -pi() / 2 ELSE w.heading END + 4 * pi()) % (2 * pi()), 12) % round(2 * pi(), 12), (q.x - w.x) ** 2 + (q.y - w.y) ** 2 DESC) = 1)),
corner AS (SELECT k, n, x, y, lead(x) OVER (PARTITION BY k ORDER BY n) AS nx, lead(y) OVER (PARTITION BY k ORDER BY n) AS ny FROM walk),
side AS (SELECT * FROM corner WHERE nx IS NOT NULL),
shape AS (SELECT k, count(*) AS n_corners, abs(sum(x * ny - nx * y)) / 2 AS area, min(x) AS lowest FROM side GROUP BY k),
ring AS (SELECT {MARGIN} * cos(i * pi() / 6) AS x, {MARGIN} * sin(i * pi() / 6) AS y, cos((i + 0.5) * pi() / 6) AS ux, sin((i + 0.5) * pi() / 6) AS uy FROM range(12) AS t(i)),
way AS (SELECT k, ny - y AS ux, x - nx AS uy FROM side UNION ALL SELECT k, ux, uy FROM shape, ring),
far AS (SELECT w.k, w.ux, w.uy, max(s.x * w.ux + s.y * w.uy) + (SELECT max(r.x * w.ux + r.y * w.uy) FROM ring r) AS most FROM way w JOIN side s USING (k) GROUP BY w.k, w.ux, w.uy),
held AS (SELECT a.k, count(*) AS n_asked, count(*) FILTER (NOT EXISTS (SELECT 1 FROM far f WHERE f.k = a.k AND a.x * f.ux + a.y * f.uy > f.most + 1e-9)) AS n_held
  FROM (SELECT k, x, y * 1.15 AS y FROM e WHERE asked) a GROUP BY a.k)
SELECT k AS event_type, (SELECT count(*) FROM e WHERE e.k = shape.k AND NOT asked) AS n_points, n_corners, round(area, 6) AS area, round(lowest, 6) AS lowest, n_asked, n_held FROM shape JOIN held USING (k)""",
    "split_values": """WITH v AS (SELECT l_suppkey, l_extendedprice * if(l_quantity > 25, 1, 0.2) AS v FROM lineitem),
g AS (SELECT *, v - lag(v) OVER w AS gap, row_number() OVER w AS i, count(*) OVER (PARTITION BY l_suppkey) AS n FROM v WINDOW w AS (PARTITION BY l_suppkey ORDER BY v)),
c AS (SELECT l_suppkey, i AS cut, gap FROM g WHERE gap IS NOT NULL QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY gap DESC, i) = 1),
s AS (SELECT l_suppkey, any_value(n) AS n, count(*) FILTER (i < cut) AS low,
  greatest(coalesce(stddev_pop(v) FILTER (i < cut), 0), coalesce(stddev_pop(v) FILTER (i >= cut), 0), 1) AS spread FROM g LEFT JOIN c USING (l_suppkey) GROUP BY l_suppkey)
SELECT l_suppkey, n, n >= 20 AND least(low, n - low) >= 0.1 * n AND coalesce(gap > greatest(4 * spread, 1000), false) AS split FROM (SELECT l_suppkey, n, low, spread, (SELECT c.gap FROM c WHERE c.l_suppkey = s.l_suppkey) AS gap FROM s)""",
    "pose_verticals": f"""WITH k AS (SELECT event_id, user_id, list_transform(range(17), lambda i: {{
    'x': (f[i + 1][1] + if(event_type = 'error', 0.4 * f[i + 1][2], 0)) * (40 + value) + event_id % 7 + user_id % 100,
    'y': f[i + 1][2] * if(event_type = 'click' AND i > 12, 0.75, 1) * (40 + value) + event_id % (i + 2) + user_id % 50, 'c': 0.4 + 0.6 * ((event_id * (i + 3)) % 50) / 50}}) AS p
  FROM events, (SELECT {[list(p) for p in FIGURE]} AS f)),
m AS (SELECT event_id, user_id, list_filter(p, lambda q: q.c < 0.5).len() / 17 AS occlusion, list_filter(p[1:5], lambda q: q.c >= 0.6) AS h, list_filter(p[6:7], lambda q: q.c >= 0.6) AS s,
  list_filter(p[12:13], lambda q: q.c >= 0.6) AS g, list_filter(p[16:17], lambda q: q.c >= 0.6) AS a FROM k),
c AS (SELECT event_id, user_id, occlusion, list_avg(list_transform(h, lambda q: q.c)) AS head, list_avg(list_transform(a, lambda q: q.c)) AS foot, {", ".join(f"list_sum(list_transform({n}, lambda q: q.{d} * q.c)) / list_sum(list_transform({n}, lambda q: q.c)) AS {n}{d}" for n in "hsga" for d in "xy")} FROM m),
t AS (SELECT *, hx + 0.54 * (hx - sx) AS kx, hy + 0.54 * (hy - sy) AS ky, sqrt((gx - sx) ** 2 + (gy - sy) ** 2) AS torso, sqrt((ax - gx) ** 2 + (ay - gy) ** 2) AS legs FROM c),
u AS (SELECT *, ax + 0.039 / 0.961 * (ax - kx) AS fx, ay + 0.039 / 0.961 * (ay - ky) AS fy,
  least(greatest(0, least(1, (((gx - sx) * (ax - gx) + (gy - sy) * (ay - gy)) / (torso * legs) - 0.8) / 0.15)), greatest(0, least(1, (legs / torso - 0.8) / 0.6))) AS standing FROM t),
w AS (SELECT *, sqrt((kx - fx) ** 2 + (ky - fy) ** 2) AS pixels FROM u WHERE hx + sx + gx + ax IS NOT NULL)
SELECT user_id || '-' || event_id AS observation_id, floor(kx * 1000 + 0.5001)::BIGINT AS hx, floor(ky * 1000 + 0.5001)::BIGINT AS hy, floor(fx * 1000 + 0.5001)::BIGINT AS fx, floor(fy * 1000 + 0.5001)::BIGINT AS fy, floor(head * 1000 + 0.5001)::BIGINT AS head, floor(foot * 1000 + 0.5001)::BIGINT AS foot, floor(standing * 1000 + 0.5001)::BIGINT AS standing,
  floor(occlusion * 1000 + 0.5001)::BIGINT AS occlusion, floor(pixels * 1000 + 0.5001)::BIGINT AS pixels, floor(greatest(2, 0.03 * pixels) * 1000 + 0.5001)::BIGINT AS sigma, floor(((0.03 * pixels / greatest(head, 0.5)) ** 2) * 1000 + 0.5001)::BIGINT AS head_variance,
  floor(((0.015 * pixels / greatest(foot, 0.5)) ** 2) * 1000 + 0.5001)::BIGINT AS foot_variance, 0::BIGINT AS between
FROM w WHERE standing >= 0.8 AND occlusion <= 0.25 AND least(head, foot) >= 0.6 AND abs(ky - fy) >= 40""",
}
