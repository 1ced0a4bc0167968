"""Queries on the hazard rules: observations made of events, an hour a frame, and each rule's coverage and incidents."""

from __future__ import annotations

from pyspark.sql import functions as F

from obsengine import schema
from obsengine.operators import rules
from obsengine.plans.common import HOUR, events

EPOCH = 1_704_067_200_000_000  # microseconds of frame 0
RUNS = 12
ZONE = (300.0, 50.0, 200.0)  # width, top, bottom
EMPTY, UNKNOWN_GEAR, NO_VEHICLES, SAFE, APART, NO_SCENE, UNMEASURED, UNSTABLE, NO_PLANE, FAR, FAR_EDGE = 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11
#: (run, proposal, left side of a zone)
ZONES = [(r, "z1", 5000.0 if r == 0 else 100.0) for r in range(RUNS) if r != UNMEASURED]
#: (run, proposal, drop or open side, visibility of the protection, state of the protection)
OPEN = (True, "sufficient", "unguarded_or_inadequate")
EDGES = [(r, "e1", *OPEN) for r in (0, EMPTY, NO_SCENE, UNMEASURED, UNSTABLE, NO_PLANE, FAR, FAR_EDGE)] + [
    (UNKNOWN_GEAR, "e1", True, "sufficient", "guarded"),
    (SAFE, "e1", None, "sufficient", "guarded"),
    (APART, "e1", True, "insufficient", "guarded"),
    (FAR, "e2", True, "sufficient", "unknown"),
    (NO_VEHICLES, "e1", *OPEN),
]
#: Frames in which nobody stands in a plane's support.
OFF = 7


def run_number():
    return F.substring("run_id", 4, 9).cast("int")


def observations(spark, sf_dir):
    """schema.OBSERVATIONS of events: users are tracks in two shots of each of RUNS runs, purchases vehicles."""
    e = events(spark, sf_dir).withColumns({"r": F.col("user_id") % RUNS, "shot": F.floor(F.col("user_id") / RUNS) % 2, "k": F.floor(F.col("user_id") / (2 * RUNS)) % 2})
    e = e.withColumn("frame", F.floor((F.col("us") - EPOCH) / HOUR)).filter(F.col("r") != EMPTY)
    r, kind = F.col("r"), F.col("event_type")
    vehicle = F.when(r == APART, F.col("shot") == 0).otherwise((kind == "purchase") & (r != NO_VEHICLES))
    helmet = (
        F.when(r == UNKNOWN_GEAR, "unknown").when(r == NO_VEHICLES, "helmet").when(r == SAFE, F.when(F.col("frame") % 100 == 0, "no_helmet").otherwise("unknown"))
        .when(kind == "error", "no_helmet").when(kind == "click", "helmet").otherwise("unknown")
    )
    vest = F.when(r == UNKNOWN_GEAR, "unknown").when(r == SAFE, "vest").when(F.col("value") < 10, "no_vest").when(F.col("value") < 20, "vest").otherwise("unknown")
    x = F.when(r == UNSTABLE, 101).otherwise(40 + F.col("user_id") * 37 % 560).cast("double")
    y = (60 + F.col("user_id") * 53 % 130 + F.col("event_id") % 5).cast("double")
    gear = lambda state: F.struct(state.alias("state"), (0.5 + F.col("event_id") % 50 / 100).alias("confidence"), F.lit(True).alias("visible"))
    name = F.when(vehicle, "vehicle").otherwise("person")
    return e.select(
        F.concat(F.lit("run"), r).alias("run_id"), F.concat(F.lit("s"), "shot").alias("shot_id"), F.col("frame").cast("int").alias("frame_index"),
        (F.col("frame") / 10.0).alias("video_time_s"), F.col("k").alias("track_id"), F.concat(F.lit("s"), "shot", F.lit("/"), name, F.lit("-"), "k").alias("canonical_track_id"),
        name.alias("object_class"), F.lit(0.9).alias("confidence"), F.struct((x - 10).alias("x1"), (y - 40).alias("y1"), (x + 10).alias("x2"), y.alias("y2")).alias("box"),
        F.struct(x.alias("x"), y.alias("y")).alias("anchor"), gear(helmet).alias("helmet"), gear(vest).alias("vest"),
    )


def all_runs(spark, sf_dir):
    return events(spark, sf_dir).select(F.concat(F.lit("run"), F.col("user_id") % RUNS).alias("run_id")).distinct()


def scenes(runs):
    return runs.withColumn("scene_status", F.when(run_number() == NO_SCENE, "failed").otherwise("ok"))


def planes(runs):
    r = run_number()
    return runs.select("run_id", (r == UNSTABLE).alias("unstable"), (r != NO_PLANE).alias("ready"), (0.8 + r / 100).alias("inlier_ratio"))


def proposals(spark):
    point = lambda x, y: {"x": x, "y": y}
    width, top, bottom = ZONE
    zones = [
        (f"run{r}", name, "restricted_zone", "polygon", [point(x, top), point(x + width, top), point(x + width, bottom), point(x, bottom)], None, None, None, 0.75, [], 3)
        for r, name, x in ZONES
    ]
    edges = [(f"run{r}", name, "open_edge", "line", [point(0.0, 0.0), point(9.0, 0.0)], *seen, 0.75, [], 3) for r, name, *seen in EDGES]
    return spark.createDataFrame(zones + edges, schema.PROPOSALS)


def reported(found_and_covered):
    """One table of a rule's coverage rows and incidents."""
    found, covered = found_and_covered
    both = covered.withColumn("kind", F.lit("coverage")).unionByName(found.withColumn("kind", F.lit("incident")), allowMissingColumns=True)
    seconds = [F.round(c, 6).alias(c) for c in ("first_seen_s", "confirmed_at_s", "resolved_at_s", "confidence")]
    about = F.coalesce("object_id", F.get("proposal_ids", F.lit(0))).alias("object_id")
    closest = F.round("distance.median", 6).alias("closest")
    return both.select("kind", "run_id", "canonical_track_id", about, "severity", "status", "reason_code", *seconds, closest, "source_frame_index", "observation_text", "action_code", "evidence_path")


def rule_missing_helmet(spark, sf_dir):
    return reported(rules.missing_helmet(observations(spark, sf_dir), all_runs(spark, sf_dir)))


def rule_missing_vest(spark, sf_dir):
    return reported(rules.missing_vest(observations(spark, sf_dir), all_runs(spark, sf_dir)))


def rule_restricted_zone(spark, sf_dir):
    runs = all_runs(spark, sf_dir)
    return reported(rules.restricted_zone(observations(spark, sf_dir), runs, scenes(runs), proposals(spark)))


def rule_proximity(spark, sf_dir):
    obs, runs = observations(spark, sf_dir), all_runs(spark, sf_dir)
    machines = rules.vehicles(obs).select(*rules.FRAME, F.col("canonical_track_id").alias("object_id"), F.col("track_id").alias("k")).distinct()
    r, frame, states = run_number(), F.col("frame_index"), (F.col("k") + run_number()) % 3
    known = machines.filter(states != 2).select(*rules.FRAME, "object_id", F.when(states == 0, "stationary").otherwise("active").alias("operating_state"))
    pairs = rules.people(obs).select(*rules.FRAME, "canonical_track_id", "track_id").distinct().join(machines, rules.FRAME)
    apart = (F.col("track_id") * 7 + F.col("k") * 3 + r) % 6 / 2.0 + F.when(r == FAR, 50.0).otherwise(0.0)
    bound = lambda more: F.when(r != UNKNOWN_GEAR, apart + more)
    compatible = (r != UNMEASURED) & (frame % OFF != 0)
    spans = pairs.select(*rules.FRAME, "canonical_track_id", "object_id", compatible.alias("compatible"), apart.alias("distance"), bound(F.lit(0.0)).alias("lower"), bound(frame % 3 * 0.25).alias("median"), bound(frame % 3 * 0.5).alias("upper"))
    return reported(rules.proximity(obs, runs, planes(runs), spans, known))


def rule_open_edge(spark, sf_dir):
    obs, runs, seen = observations(spark, sf_dir), all_runs(spark, sf_dir), proposals(spark)
    r, frame = run_number(), F.col("frame_index")
    held = seen.filter("proposal_type = 'open_edge'").select("run_id", F.col("proposal_id").alias("object_id"), (r != UNMEASURED).alias("compatible"))
    pairs = rules.people(obs).select(*rules.FRAME, "canonical_track_id", "track_id").distinct().join(held.drop("compatible"), "run_id")
    apart = (F.col("track_id") * 5 + frame % 4 + r) % 5 / 4.0 + F.when(r == FAR, 5.0).when(r == FAR_EDGE, 50.0).otherwise(0.0)
    bound = lambda more: F.when(r != NO_VEHICLES, apart + more)
    spans = pairs.select(*rules.FRAME, "canonical_track_id", "object_id", (frame % OFF != 0).alias("compatible"), apart.alias("distance"), bound(F.lit(0.0)).alias("lower"), bound(frame % 2 * 0.125).alias("median"), bound(frame % 2 * 0.25).alias("upper"))
    return reported(rules.open_edge(obs, runs, scenes(runs), seen, planes(runs), held, spans))


QUERIES = {f.__name__: f for f in (rule_missing_helmet, rule_missing_vest, rule_restricted_zone, rule_proximity, rule_open_edge)}

O = f"""o AS (
  SELECT *, 'run' || r AS run_id, 's' || shot AS shot_id, frame / 10 AS t, 's' || shot || '/' || class || '-' || k AS track, 0.5 + event_id % 50 / 100 AS conf,
    CASE WHEN r = 2 THEN 'unknown' WHEN r = 3 THEN 'helmet' WHEN r = 4 THEN CASE WHEN frame % 100 = 0 THEN 'no_helmet' ELSE 'unknown' END
         WHEN event_type = 'error' THEN 'no_helmet' WHEN event_type = 'click' THEN 'helmet' ELSE 'unknown' END AS helmet,
    CASE WHEN r = 2 THEN 'unknown' WHEN r = 4 THEN 'vest' WHEN value < 10 THEN 'no_vest' WHEN value < 20 THEN 'vest' ELSE 'unknown' END AS vest,
    CASE WHEN r = 8 THEN 101 ELSE 40 + user_id * 37 % 560 END AS x, 60 + user_id * 53 % 130 + event_id % 5 AS y
  FROM (SELECT *, CASE WHEN CASE WHEN r = 5 THEN shot = 0 ELSE event_type = 'purchase' AND r <> 3 END THEN 'vehicle' ELSE 'person' END AS class
    FROM (SELECT *, user_id % 12 AS r, user_id // 12 % 2 AS shot, user_id // 24 % 2 AS k, (epoch_us(ts) - {EPOCH}) // {HOUR} AS frame FROM events))
  WHERE r <> 1),
runs AS (SELECT DISTINCT 'run' || (user_id % 12) AS run_id, user_id % 12 AS r FROM events),
p AS (SELECT * FROM o WHERE class = 'person'), v AS (SELECT * FROM o WHERE class = 'vehicle')"""


def _longest(name: str, rows: str, keys: str, gap: float) -> str:
    """name: the longest run of each key in rows (keys, t), the earliest on ties."""
    return f"""{name} AS (
  SELECT {keys}, min(t) AS first, max(t) AS last, max(t) - min(t) AS span FROM (
    SELECT *, sum(fresh) OVER (PARTITION BY {keys} ORDER BY t ROWS UNBOUNDED PRECEDING) AS chain FROM (
      SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY {keys} ORDER BY t) <= {gap} THEN 0 ELSE 1 END AS fresh FROM (SELECT DISTINCT {keys}, t FROM ({rows}))))
  GROUP BY {keys}, chain QUALIFY row_number() OVER (PARTITION BY {keys} ORDER BY max(t) - min(t) DESC, min(t)) = 1)"""


def _reported(found: str, severity: str, reason: str, debounce: float, coverage: str, rule: str, text: str, action: str, machine: bool = False) -> str:
    """found: run_id, shot_id, track, object_id, first, last, span, confidence, closest and frame; text over these."""
    named = "replace(replace({}, '/', '-'), ' ', '_')"
    about = f" || '-' || {named.format('object_id')}" if machine else ""
    return f"""SELECT 'coverage' AS kind, run_id, NULL::VARCHAR AS canonical_track_id, NULL::VARCHAR AS object_id, NULL::VARCHAR AS severity,
  split_part(verdict, ' ', 1) AS status, split_part(verdict, ' ', 2) AS reason_code, NULL::DOUBLE AS first_seen_s, NULL::DOUBLE AS confirmed_at_s,
  NULL::DOUBLE AS resolved_at_s, NULL::DOUBLE AS confidence, NULL::DOUBLE AS closest, NULL::INTEGER AS source_frame_index, NULL::VARCHAR AS observation_text,
  NULL::VARCHAR AS action_code, NULL::VARCHAR AS evidence_path FROM ({coverage})
UNION ALL SELECT 'incident', run_id, track, object_id, '{severity}', 'alert', '{reason}', round(first, 6), round(first + {debounce}, 6), round(last, 6), round(confidence, 6),
  round(closest, 6), frame::INTEGER, {text}, '{action}', 'evidence/' || run_id || '-' || {named.format("track")} || '-{rule}-' || printf('%.1f', first) || '-' || printf('%.1f', last){about} || '.jpg'
FROM ({found})"""


def _closest(rows: str) -> str:
    """Of a found run x: its bounds of the least median, in rows (PLACE_KEYS, t, frame, lower, upper, mid)."""
    return f"(SELECT arg_min({{'l': lower, 'm': mid, 'u': upper}}, (mid, frame)) FROM {rows} AS q WHERE (q.run_id, q.shot_id, q.track, q.object_id) = (x.run_id, x.shot_id, x.track, x.object_id) AND q.t BETWEEN x.first AND x.last)"


_SPAN = "printf('%.1fs to %.1fs', first, last)"
_SURE = "printf('%.2f', round_even(confidence, 2))"


def _has(table: str, condition: str = "true") -> str:
    return f"EXISTS (SELECT 1 FROM {table} AS q WHERE q.run_id = runs.run_id AND {condition})"


PLACE_KEYS = "run_id, shot_id, track, object_id"
_EDGES = ", ".join(f"({r}, '{e}', {'NULL' if d is None else d}, '{v}', '{s}')" for r, e, d, v, s in EDGES)
ORACLE_SQL = {
    "rule_missing_helmet": f"""WITH {O}, {_longest("l", "SELECT * FROM p WHERE helmet = 'no_helmet'", "run_id, shot_id, track", 3)},
j AS (SELECT * FROM (SELECT run_id, shot_id, track, bool_or(helmet = 'helmet') AS worn, avg(conf) FILTER (helmet = 'no_helmet') AS confidence
  FROM p GROUP BY ALL) LEFT JOIN l USING (run_id, shot_id, track))
{_reported("SELECT *, NULL AS object_id, NULL AS closest, round(first * 10) AS frame FROM j WHERE span >= 1.5", "medium", "detected_missing_helmet", 1.5, f'''SELECT run_id,
  CASE WHEN NOT {_has("p")} THEN 'inconclusive no_person_tracks' WHEN {_has("j", "span >= 1.5")} THEN 'alert detected_missing_helmet'
  WHEN {_has("j", "span < 1.5")} THEN 'inconclusive no_helmet_below_debounce' WHEN NOT {_has("j", "(worn OR span IS NOT NULL)")} THEN 'inconclusive no_ppe_evidence'
  ELSE 'clear no_helmet_alerts_detected' END AS verdict FROM runs''',
  "R1", f"track || ' detected without helmet from ' || {_SPAN} || printf(' (%.1fs window, Gemini confidence ', span) || {_SURE} || ').'", "review_ppe")}""",
    "rule_missing_vest": f"""WITH {O}, n AS (SELECT * FROM p WHERE (run_id, shot_id, frame) IN (SELECT (run_id, shot_id, frame) FROM v)),
f AS (SELECT run_id, track, min(t) AS first, max(t) AS last, avg(conf) AS confidence FROM n WHERE vest = 'no_vest' GROUP BY ALL HAVING max(t) - min(t) >= 1.5)
{_reported("SELECT *, NULL AS object_id, NULL AS closest, round(first * 10) AS frame FROM f", "medium", "detected_missing_vest_near_vehicle", 1.5, f'''SELECT run_id,
  CASE WHEN NOT {_has("v")} THEN 'inconclusive no_machinery_tracks' WHEN {_has("f")} THEN 'alert detected_missing_vest_near_vehicle'
  WHEN NOT {_has("n", "vest <> 'unknown'")} THEN 'inconclusive no_ppe_evidence' ELSE 'clear no_vest_alerts_near_vehicle' END AS verdict FROM runs''',
  "R2", f"track || ' detected without hi-vis vest in proximity of vehicle from ' || {_SPAN} || ' (confidence ' || {_SURE} || ').'", "review_ppe")}""",
    "rule_restricted_zone": f"""WITH {O}, z AS (SELECT *, 'run' || zr AS run_id FROM (VALUES {", ".join(map(str, ZONES))}) AS t(zr, object_id, x0)),
d AS (SELECT *, CASE WHEN x > x0 AND x < x0 + 300 AND y > 50 AND y < 200 THEN least(x - x0, x0 + 300 - x, y - 50, 200 - y)
  ELSE -sqrt(greatest(x0 - x, 0, x - x0 - 300) ** 2 + greatest(50 - y, 0, y - 200) ** 2) END AS d FROM p JOIN z USING (run_id)),
{_longest("i", "SELECT * FROM d WHERE d > 2", PLACE_KEYS, 2)},
{_longest("m", f"SELECT * FROM d WHERE d >= -2 AND ({PLACE_KEYS}) IN (SELECT ({PLACE_KEYS}) FROM d WHERE abs(d) <= 2)", PLACE_KEYS, 2)}
{_reported("SELECT *, 0.75 AS confidence, NULL AS closest, round(first * 10) AS frame FROM i WHERE span >= 1 AND run_id <> 'run6'", "high", "restricted_zone_entry", 1, f'''SELECT run_id,
  CASE WHEN r = 6 THEN 'inconclusive restricted_zone_scene_state_unavailable' WHEN NOT {_has("z")} THEN 'not_applicable no_supported_restricted_zone'
  WHEN NOT {_has("p")} THEN 'not_applicable no_person_tracks' WHEN {_has("i", "span >= 1")} THEN 'alert restricted_zone_entry'
  WHEN {_has("m", "span >= 1")} THEN 'inconclusive zone_boundary_uncertain' ELSE 'clear worker_outside_restricted_zone' END AS verdict FROM runs''',
  "R3", f"track || ' appears inside inferred restricted zone ' || object_id || ' from ' || {_SPAN} || printf(' (%.1fs; zone agreed by 0 of 3 keyframes).', span)", "review_zone_access")}""",
    "rule_proximity": f"""WITH {O}, w AS (SELECT p.run_id, p.r, p.shot_id, p.track, v.track AS object_id, p.t, p.frame,
    ['stationary', 'active', 'unknown'][1 + (v.k + p.r) % 3] AS state, (p.k * 7 + v.k * 3 + p.r) % 6 / 2 + if(p.r = 10, 50, 0) AS apart, p.r <> 7 AND p.frame % 7 <> 0 AS fits
  FROM p JOIN v ON p.run_id = v.run_id AND p.shot_id = v.shot_id AND p.frame = v.frame),
b AS (SELECT *, CASE WHEN r <> 2 THEN apart END AS lower, CASE WHEN r <> 2 THEN apart + frame % 3 * 0.25 END AS mid, CASE WHEN r <> 2 THEN apart + frame % 3 * 0.5 END AS upper FROM w),
c AS (SELECT *, coalesce(upper <= 1.5, false) AS near FROM b WHERE fits AND apart <= 8 AND NOT coalesce(lower > 3 OR lower > 1.5 AND upper <= 3, false)),
u AS (SELECT *, CASE WHEN state = 'unknown' THEN 'operating_state_unknown' WHEN NOT near THEN 'inconclusive_distance' END AS reason FROM c),
{_longest("a", "SELECT * FROM c WHERE state = 'active' AND near", PLACE_KEYS, 2)},
{_longest("d", "SELECT * FROM u WHERE reason IS NOT NULL", PLACE_KEYS + ", reason", 2)},
s AS (SELECT run_id, reason FROM d WHERE span >= 1 GROUP BY run_id, reason QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY count(*) DESC, reason DESC) = 1)
{_reported(f"SELECT *, struct_extract(d, 'm') AS closest FROM (SELECT x.*, 0.8 + r / 100 AS confidence, {_closest('(SELECT * FROM c WHERE near)')} AS d, round(first * 10) AS frame FROM a AS x JOIN runs USING (run_id) WHERE span >= 1 AND r NOT IN (8, 9))", "high", "active_machine_near_band", 1, f'''
  SELECT run_id, CASE WHEN r = 8 THEN 'unsupported geometry_unstable_for_feed' WHEN NOT {_has("v")} THEN 'not_applicable no_machinery_tracks'
  WHEN NOT {_has("w")} THEN 'not_applicable no_worker_machinery_overlap' WHEN r = 9 THEN 'inconclusive relative_plane_unavailable'
  WHEN {_has("a", "span >= 1")} THEN 'alert active_machine_near_band' WHEN {_has("s")} THEN 'inconclusive ' || (SELECT reason FROM s WHERE s.run_id = runs.run_id)
  WHEN NOT {_has("w", "fits")} THEN 'inconclusive target_plane_incompatible' ELSE 'clear outside_active_near_band' END AS verdict FROM runs''',
  "R4", f"track || printf(' stayed within %.1f worker-heights (upper bound, 95%% interval %.1f-%.1f WH) of moving machinery ', round_even(d.u, 1), round_even(d.l, 1), round_even(d.u, 1)) || object_id || ' from ' || {_SPAN} || printf(' (%.1fs).', span)", "review_machinery_separation", machine=True)}""",
    "rule_open_edge": f"""WITH {O}, g AS (SELECT *, 'run' || er AS run_id, CASE WHEN side IS DISTINCT FROM true THEN 'edge_semantics_unknown'
    WHEN view <> 'sufficient' THEN 'protection_visibility_insufficient' WHEN guard = 'unguarded_or_inadequate' THEN 'none' WHEN guard = 'guarded' THEN 'guarded'
    ELSE 'protection_state_unknown' END AS blocker FROM (VALUES {_EDGES}) AS t(er, object_id, side, view, guard)),
b AS (SELECT p.*, object_id, (k * 5 + frame % 4 + r) % 5 / 4 + CASE r WHEN 10 THEN 5 WHEN 11 THEN 50 ELSE 0 END AS apart FROM p JOIN g USING (run_id) WHERE blocker = 'none' AND r <> 7 AND frame % 7 <> 0),
c AS (SELECT *, CASE WHEN r <> 3 THEN apart END AS lower, CASE WHEN r <> 3 THEN apart + frame % 2 * 0.125 END AS mid, CASE WHEN r <> 3 THEN apart + frame % 2 * 0.25 END AS upper FROM b WHERE apart <= 8),
{_longest("a", "SELECT * FROM c WHERE upper <= 0.8", PLACE_KEYS, 2)}, {_longest("d", "SELECT * FROM c WHERE lower IS NULL OR upper > 0.8 AND lower <= 0.8", PLACE_KEYS, 2)}
{_reported(f"SELECT *, struct_extract(d, 'm') AS closest FROM (SELECT x.*, 0.8 + r / 100 AS confidence, {_closest('(SELECT * FROM c WHERE upper <= 0.8)')} AS d, round(first * 10) AS frame FROM a AS x JOIN runs USING (run_id) WHERE span >= 1 AND r NOT IN (6, 8, 9))", "high", "visible_unguarded_edge", 1, f'''
  SELECT run_id, CASE WHEN r = 8 THEN 'unsupported geometry_unstable_for_feed' WHEN r = 6 THEN 'inconclusive scene_state_unavailable'
  WHEN NOT {_has("g")} THEN 'not_applicable no_visible_open_edge_candidate'
  WHEN NOT {_has("g", "blocker <> 'guarded'")} THEN 'clear guarded_or_outside_edge_band'
  WHEN NOT {_has("g", "blocker = 'none'")} THEN 'inconclusive ' || (SELECT min(blocker) FROM g WHERE g.run_id = runs.run_id AND blocker <> 'guarded')
  WHEN NOT {_has("p")} THEN 'not_applicable no_person_tracks' WHEN r = 9 THEN 'inconclusive relative_plane_unavailable'
  WHEN NOT {_has("g", "blocker = 'none' AND er <> 7")} THEN 'inconclusive target_plane_incompatible' WHEN {_has("a", "span >= 1")} THEN 'alert visible_unguarded_edge'
  WHEN {_has("d", "span >= 1")} THEN 'inconclusive inconclusive_distance'
  WHEN {_has("g", "blocker NOT IN ('none', 'guarded')")} THEN 'inconclusive ' || (SELECT min(blocker) FROM g WHERE g.run_id = runs.run_id AND blocker NOT IN ('none', 'guarded'))
  ELSE 'clear guarded_or_outside_edge_band' END AS verdict FROM runs''',
  "R5", f"track || ' stayed within 0.8 worker-heights of ' || object_id || printf(', an open edge reported as unguarded or inadequately protected (95%% interval %.1f-%.1f WH), from ', round_even(d.l, 1), round_even(d.u, 1)) || {_SPAN} || printf(' (%.1fs).', span)", "review_edge_protection")}""",
}
