"""Hazard rules over tracked observations, as DataFrames: incidents and one coverage row for each run and rule.

Observations are rows of schema.OBSERVATIONS; everything is keyed by run and shot, so many clips go in one job.
Each rule works out a status for every (track, object) and rolls them up; unknown never counts as a negative.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from obsengine.functions import geometry as g
from obsengine.functions.text import safe_id
from obsengine.operators import joins
from obsengine.operators.sequence import longest_run

TRACK = ["run_id", "shot_id", "canonical_track_id"]
FRAME = ["run_id", "shot_id", "frame_index"]


@dataclass(frozen=True)
class Settings:
    """Seconds and the ground plane's unit. Fixed values of the rule set."""

    gear_debounce: float = 1.5
    place_debounce: float = 1.0
    near: float = 1.5
    caution: float = 3.0
    edge: float = 0.8
    inflation: float = 0.5
    candidate: float = 8.0
    zone_margin: float = 0.05
    catalogue_sha256: str = ""


def people(obs: DataFrame) -> DataFrame:
    return obs.filter("object_class = 'person'")


def vehicles(obs: DataFrame) -> DataFrame:
    return obs.filter("object_class != 'person'")


#: What to do about each rule's incidents: code and text. Fixed values.
ACTIONS = {
    "R1": ("review_ppe", "Verify this worker is wearing a compliant hardhat. Check evidence frame before raising a formal non-conformance."),
    "R2": ("review_ppe", "Verify this worker is wearing a high-visibility vest near moving machinery."),
    "R3": ("review_zone_access", "Check on site whether this region is restricted and whether the worker is authorised to be there. The zone is inferred from video, not surveyed."),
    "R4": ("review_machinery_separation", "Check on site that pedestrians are kept clear of the machine's working area. Distances are relative to worker height in this video, not metres."),
    "R5": ("review_edge_protection", "Check on site whether this edge is exposed and what protection is in place. The edge is inferred from video and distances are relative."),
}
DISTANCE = "struct<lower:double,median:double,upper:double>"


def tenths(seconds: str | Column) -> Column:
    return F.bround(seconds, 1).cast("string")


def incidents(found: DataFrame, rule: str, reason: str, severity: str, debounce: float, text: list[Column | str], s: Settings = Settings()) -> DataFrame:
    """Rows of (TRACK, first, last, confidence, source_frame_index, and object_id, proposal_id or distance where a rule has them) as schema.INCIDENTS.

    text: the parts of the observation, columns and words.
    """
    has = lambda name, kind: F.col(name).cast(kind) if name in found.columns else F.lit(None).cast(kind)
    parts = [F.col("run_id"), safe_id(F.col("canonical_track_id")), F.lit(rule), tenths("first"), tenths("last")]
    machine, proposal, distance = has("object_id", "string"), has("proposal_id", "string"), has("distance", DISTANCE)
    with_object = F.when(machine.isNotNull(), F.concat(F.lit("-"), safe_id(machine))).otherwise("")
    named = found.withColumn("incident_id", F.concat(F.concat_ws("-", *parts), with_object))
    code, advice = ACTIONS[rule]
    return named.select(
        "incident_id", "run_id", "shot_id", F.lit(s.catalogue_sha256).alias("catalogue_sha256"), F.lit(rule).alias("rule_id"), F.lit("alert").alias("status"),
        F.lit(reason).alias("reason_code"), F.lit("heuristic").alias("basis"), F.lit(severity).alias("severity"), "canonical_track_id", machine.alias("object_id"),
        F.when(proposal.isNull(), F.array().cast("array<string>")).otherwise(F.array(proposal)).alias("proposal_ids"),
        F.col("first").alias("first_seen_s"), (F.col("first") + debounce).alias("confirmed_at_s"), F.col("last").alias("resolved_at_s"),
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("confidence", F.lit(0.5)))).alias("confidence"),
        distance.alias("distance"), F.when(distance.isNotNull(), "near").alias("relative_band"),
        F.concat(*(F.lit(t) if isinstance(t, str) else t for t in text)).alias("observation_text"), F.lit(code).alias("action_code"), F.lit(advice).alias("action_text"),
        F.array().cast("array<string>").alias("references"), F.concat(F.lit("evidence/"), F.col("incident_id"), F.lit(".jpg")).alias("evidence_path"),
        F.col("source_frame_index").cast("int").alias("source_frame_index"),
    )


def _seen(found: DataFrame, rows: DataFrame, keys: list[str], distances: bool = False) -> DataFrame:
    """found, spans of rows by keys, with the frame each starts in and, with `distances`, its interval of the least median."""
    inside = rows.join(found.select(*keys, "first", "last"), keys).filter(F.col("video_time_s").between(F.col("first"), F.col("last")))
    picks = [F.min_by("frame_index", F.struct("video_time_s", "frame_index")).alias("source_frame_index")]
    if distances:
        picks.append(F.min_by(F.struct("lower", "median", "upper"), F.struct("median", "frame_index")).alias("distance"))
    return found.join(inside.groupBy(*keys).agg(*picks), keys)


def _coverage(runs: DataFrame, rule: str, facts: DataFrame, cases: list[tuple[Column, str, str]], default: tuple[str, str]) -> DataFrame:
    """One row a run: the first case that holds over its facts, of which a run may have none."""
    joined = runs.join(facts, "run_id", "left")
    status, reason = F.lit(default[0]), F.lit(default[1])
    for condition, s, r in reversed(cases):
        holds = F.coalesce(condition, F.lit(False))
        status, reason = F.when(holds, s).otherwise(status), F.when(holds, r).otherwise(reason)
    return joined.select("run_id", F.lit(rule).alias("rule_id"), status.alias("status"), reason.alias("reason_code"))


def _debounced(rows: DataFrame, keys: list[str], debounce: float) -> DataFrame:
    return longest_run(rows, keys, "video_time_s", 2 * debounce, 600.0)


def missing_helmet(obs: DataFrame, runs: DataFrame, s: Settings = Settings()) -> tuple[DataFrame, DataFrame]:
    """R1. The confidence averages all of a track's bare-headed rows, not just the run's."""
    persons = people(obs)
    bare = persons.filter("helmet.state = 'no_helmet'")
    spans = _debounced(bare, TRACK, s.gear_debounce)
    seen = persons.groupBy(*TRACK).agg(F.bool_or(F.col("helmet.state") == "helmet").alias("worn"), F.avg(F.when(F.col("helmet.state") == "no_helmet", F.col("helmet.confidence"))).alias("confidence"))
    tracks = seen.join(spans, TRACK, "left").withColumn("alert", F.col("span") >= s.gear_debounce)
    facts = tracks.groupBy("run_id").agg(
        F.count("*").alias("n"), F.bool_or("alert").alias("alert"), F.bool_or(~F.col("alert")).alias("below"),
        F.bool_and(F.col("span").isNull() & ~F.coalesce("worn", F.lit(False))).alias("blind"),
    )
    coverage = _coverage(runs, "R1", facts, [
        (F.col("n").isNull(), "inconclusive", "no_person_tracks"),
        (F.col("alert"), "alert", "detected_missing_helmet"),
        (F.col("below"), "inconclusive", "no_helmet_below_debounce"),
        (F.col("blind"), "inconclusive", "no_ppe_evidence"),
    ], ("clear", "no_helmet_alerts_detected"))
    found = _seen(tracks.filter("alert"), bare, TRACK)
    sure = F.format_string("%.2f", F.bround(F.coalesce("confidence", F.lit(0.5)), 2))
    text = [F.col("canonical_track_id"), " detected without helmet from ", tenths("first"), "s to ", tenths("last"), "s (", tenths("span"), "s window, Gemini confidence ", sure, ")."]
    return incidents(found, "R1", "detected_missing_helmet", "medium", s.gear_debounce, text, s), coverage


def missing_vest(obs: DataFrame, runs: DataFrame, s: Settings = Settings()) -> tuple[DataFrame, DataFrame]:
    """R2. Rows in frames with any vehicle; the span is first to last, gaps or not."""
    near = joins.in_context(people(obs), vehicles(obs), FRAME)
    bare = near.filter("vest.state = 'no_vest'").groupBy(*TRACK).agg(
        F.min("video_time_s").alias("first"), F.max("video_time_s").alias("last"), F.avg("vest.confidence").alias("confidence"),
        F.min_by("frame_index", F.struct("video_time_s", "frame_index")).alias("source_frame_index"),
    )
    found = bare.filter(F.col("last") - F.col("first") >= s.gear_debounce)
    facts = (
        vehicles(obs).groupBy("run_id").agg(F.count("*").alias("machines"))
        .join(found.groupBy("run_id").agg(F.count("*").alias("alerts")), "run_id", "left")
        .join(near.groupBy("run_id").agg(F.bool_or(F.col("vest.state").isin("vest", "no_vest")).alias("evidence")), "run_id", "left")
    )
    coverage = _coverage(runs, "R2", facts, [
        (F.col("machines").isNull(), "inconclusive", "no_machinery_tracks"),
        (F.col("alerts") > 0, "alert", "detected_missing_vest_near_vehicle"),
        (~F.coalesce("evidence", F.lit(False)), "inconclusive", "no_ppe_evidence"),
    ], ("clear", "no_vest_alerts_near_vehicle"))
    sure = F.format_string("%.2f", F.bround(F.coalesce("confidence", F.lit(0.5)), 2))
    text = [F.col("canonical_track_id"), " detected without hi-vis vest in proximity of vehicle from ", tenths("first"), "s to ", tenths("last"), "s (confidence ", sure, ")."]
    return incidents(found, "R2", "detected_missing_vest_near_vehicle", "medium", s.gear_debounce, text, s), coverage


def restricted_zone(obs: DataFrame, runs: DataFrame, scenes: DataFrame, zones: DataFrame, s: Settings = Settings()) -> tuple[DataFrame, DataFrame]:
    """R3. scenes (run_id, scene_status), zones of schema.PROPOSALS: feet beyond the margin inside, or too close to tell."""
    marked = zones.filter("proposal_type = 'restricted_zone'").select("run_id", F.col("proposal_id").alias("object_id"), "points", F.col("agreement_score").alias("confidence"), F.size("supporting_keyframes").alias("agreed"), "eligible_keyframes")
    persons = people(obs)
    placed = persons.join(marked, "run_id").withColumn("d", g.signed_distance(F.col("anchor"), F.col("points")))
    margin = s.zone_margin * (F.col("box.y2") - F.col("box.y1"))
    keys = [*TRACK, "object_id"]
    inside = placed.filter(F.col("d") > margin)
    possible = placed.filter(F.col("d") >= -margin)
    unsure = possible.filter(F.col("d") <= margin).select(*keys).distinct()
    found = _debounced(inside, keys, s.place_debounce).filter(F.col("span") >= s.place_debounce)
    found = found.join(marked.drop("points"), ["run_id", "object_id"])
    doubtful = _debounced(possible.join(unsure, keys, "left_semi"), keys, s.place_debounce).filter(F.col("span") >= s.place_debounce)
    count = lambda df, name: df.groupBy("run_id").agg(F.count("*").alias(name))
    facts = (
        runs.join(scenes.select("run_id", (F.col("scene_status") == "ok").alias("ok")), "run_id", "left")
        .join(count(marked, "zones"), "run_id", "left").join(count(persons, "rows"), "run_id", "left")
        .join(count(found, "alerts"), "run_id", "left").join(count(doubtful, "doubts"), "run_id", "left")
    )
    coverage = _coverage(runs, "R3", facts, [
        (~F.coalesce("ok", F.lit(False)), "inconclusive", "restricted_zone_scene_state_unavailable"),
        (F.col("zones").isNull(), "not_applicable", "no_supported_restricted_zone"),
        (F.col("rows").isNull(), "not_applicable", "no_person_tracks"),
        (F.col("alerts") > 0, "alert", "restricted_zone_entry"),
        (F.col("doubts") > 0, "inconclusive", "zone_boundary_uncertain"),
    ], ("clear", "worker_outside_restricted_zone"))
    usable = _seen(found.join(scenes.filter("scene_status = 'ok'"), "run_id", "left_semi"), inside, keys).withColumnRenamed("object_id", "proposal_id")
    text = [
        F.col("canonical_track_id"), " appears inside inferred restricted zone ", F.col("proposal_id"), " from ", tenths("first"), "s to ", tenths("last"), "s (", tenths("span"),
        "s; zone agreed by ", F.col("agreed").cast("string"), " of ", F.col("eligible_keyframes").cast("string"), " keyframes).",
    ]
    return incidents(usable, "R3", "restricted_zone_entry", "high", s.place_debounce, text, s), coverage


def proximity(
    obs: DataFrame, runs: DataFrame, planes: DataFrame, measures: DataFrame, states: DataFrame, s: Settings = Settings()
) -> tuple[DataFrame, DataFrame]:
    """R4. planes (run_id, unstable, ready, inlier_ratio); measures (FRAME, canonical_track_id, object_id, compatible, distance, lower, median,
    upper) of ground.measured; states (FRAME, object_id, operating_state), unknown where missing.

    Pairs that aren't compatible with the plane, or have no measure, don't count; nor do those whose point estimate is beyond s.candidate.
    A compatible pair without bounds is in no band. A track's rows of one frame and time count once: what is found depends on when pairs
    are seen, not on how often, and repeats on both sides would multiply.
    """
    workers = people(obs).select(*FRAME, "canonical_track_id", "video_time_s").distinct()
    machines = vehicles(obs).select(*FRAME, F.col("canonical_track_id").alias("object_id")).distinct()
    pairs = workers.join(machines, FRAME)
    known = joins.lookup(pairs, states, [*FRAME, "object_id"], {"operating_state": F.lit("unknown")}, "operating_state")
    measured = known.join(measures, [*FRAME, "canonical_track_id", "object_id"], "left")
    banded = measured.withColumn("band", g.distance_band(F.col("lower"), F.col("upper"), s.near, s.caution))
    close = banded.filter(F.col("compatible") & (F.col("distance") <= s.candidate) & ~F.col("band").isin("clear", "caution"))
    reason = F.when(F.col("operating_state") == "unknown", "operating_state_unknown").when(F.col("band") == "indeterminate", "inconclusive_distance")
    close = close.withColumn("reason", reason)
    alerts = close.filter("reason IS NULL AND operating_state = 'active'")
    keys = [*TRACK, "object_id"]
    lasting = lambda df, by: _debounced(df, by, s.place_debounce).filter(F.col("span") >= s.place_debounce)
    found = lasting(alerts, keys).join(planes.select("run_id", F.col("inlier_ratio").alias("confidence")), "run_id", "left")
    doubts = lasting(close.filter("reason IS NOT NULL"), [*keys, "reason"])
    by_reason = doubts.groupBy("run_id", "reason").agg(F.count("*").alias("n"))  # the most frequent counts, an unknown state on ties
    doubts = by_reason.groupBy("run_id").agg(F.max_by("reason", F.struct("n", "reason")).alias("doubt"))
    facts = (
        runs.join(planes, "run_id", "left")
        .join(vehicles(obs).groupBy("run_id").agg(F.count("*").alias("machines")), "run_id", "left")
        .join(banded.groupBy("run_id").agg(F.count("*").alias("pairs"), F.count_if("compatible").alias("checked")), "run_id", "left")
        .join(found.groupBy("run_id").agg(F.count("*").alias("alerts")), "run_id", "left")
        .join(doubts, "run_id", "left")
    )
    coverage = _coverage(runs, "R4", facts, [
        (F.col("unstable"), "unsupported", "geometry_unstable_for_feed"),
        (F.col("machines").isNull(), "not_applicable", "no_machinery_tracks"),
        (F.col("pairs").isNull(), "not_applicable", "no_worker_machinery_overlap"),
        (~F.coalesce("ready", F.lit(False)), "inconclusive", "relative_plane_unavailable"),
        (F.col("alerts") > 0, "alert", "active_machine_near_band"),
        (F.col("doubt") == "operating_state_unknown", "inconclusive", "operating_state_unknown"),
        (F.col("doubt") == "inconclusive_distance", "inconclusive", "inconclusive_distance"),
        (F.col("checked") == 0, "inconclusive", "target_plane_incompatible"),
    ], ("clear", "outside_active_near_band"))
    found = _seen(found.join(planes.filter("ready AND NOT coalesce(unstable, false)"), "run_id", "left_semi"), alerts, keys, distances=True)
    track, machine = F.col("canonical_track_id"), F.col("object_id")
    low, high = tenths("distance.lower"), tenths("distance.upper")
    text = [
        track, " stayed within ", high, " worker-heights (upper bound, 95% interval ", low, "-", high, " WH) of moving machinery ", machine,
        " from ", tenths("first"), "s to ", tenths("last"), "s (", tenths("span"), "s).",
    ]
    return incidents(found, "R4", "active_machine_near_band", "high", s.place_debounce, text, s), coverage


def edge_blocker(drop: Column, visibility: Column, protection: Column) -> Column:
    """Why an edge can't alert; null for one that is visibly unguarded. Unknown is not false."""
    return (
        F.when(~drop.eqNullSafe(True), "edge_semantics_unknown")
        .when(~visibility.eqNullSafe("sufficient"), "protection_visibility_insufficient")
        .when(protection.eqNullSafe("unguarded_or_inadequate"), None)
        .when(protection.eqNullSafe("guarded"), "guarded")
        .otherwise("protection_state_unknown")
    )


def open_edge(
    obs: DataFrame, runs: DataFrame, scenes: DataFrame, edges: DataFrame, planes: DataFrame, held: DataFrame, measures: DataFrame, s: Settings = Settings()
) -> tuple[DataFrame, DataFrame]:
    """R5. edges of schema.PROPOSALS; held (run_id, object_id, compatible) of ground.edge_support, object_id being the edge's proposal_id;
    measures as in R4, to edges. Workers off the plane's support don't count; edges of which a part is off it are left out."""
    seen = edges.filter("proposal_type = 'open_edge'").withColumn(
        "blocker", edge_blocker(F.col("visible_drop_or_open_side"), F.col("protection_visibility"), F.col("protection_state"))
    )
    open_ = seen.filter("blocker IS NULL").select("run_id", F.col("proposal_id").alias("object_id"))
    usable = open_.join(held.filter("compatible"), ["run_id", "object_id"], "left_semi")
    rows = people(obs).select(*FRAME, "canonical_track_id", "video_time_s").join(measures, [*FRAME, "canonical_track_id"])
    rows = rows.join(usable, ["run_id", "object_id"], "left_semi").filter(F.col("compatible") & (F.col("distance") <= s.candidate))
    rows = rows.withColumn("band", g.distance_band(F.col("lower"), F.col("upper"), s.edge, s.edge))
    keys = [*TRACK, "object_id"]
    lasting = lambda df: _debounced(df, keys, s.place_debounce).filter(F.col("span") >= s.place_debounce)
    close = rows.filter("band = 'near'")
    found = lasting(close).join(planes.select("run_id", F.col("inlier_ratio").alias("confidence")), "run_id", "left")
    vague = lasting(rows.filter("band = 'indeterminate'"))
    first = lambda b: F.bool_or(F.col("blocker") == b)
    facts = (
        runs.join(scenes.select("run_id", (F.col("scene_status") == "ok").alias("ok")), "run_id", "left").join(planes, "run_id", "left")
        .join(seen.groupBy("run_id").agg(F.count("*").alias("edges"), F.count_if(F.col("blocker").isNull()).alias("open"), F.bool_and(F.coalesce(F.col("blocker") == "guarded", F.lit(False))).alias("guarded"), first("edge_semantics_unknown").alias("no_drop"), first("protection_visibility_insufficient").alias("no_view"), first("protection_state_unknown").alias("no_state")), "run_id", "left")
        .join(people(obs).groupBy("run_id").agg(F.count("*").alias("rows")), "run_id", "left")
        .join(usable.groupBy("run_id").agg(F.count("*").alias("usable")), "run_id", "left")
        .join(found.groupBy("run_id").agg(F.count("*").alias("alerts")), "run_id", "left")
        .join(vague.groupBy("run_id").agg(F.count("*").alias("doubts")), "run_id", "left")
    )
    blocked = F.col("open") == 0
    coverage = _coverage(runs, "R5", facts, [
        (F.col("unstable"), "unsupported", "geometry_unstable_for_feed"),
        (~F.coalesce("ok", F.lit(False)), "inconclusive", "scene_state_unavailable"),
        (F.col("edges").isNull(), "not_applicable", "no_visible_open_edge_candidate"),
        (blocked & F.col("guarded"), "clear", "guarded_or_outside_edge_band"),
        (blocked & F.col("no_drop"), "inconclusive", "edge_semantics_unknown"),
        (blocked & F.col("no_view"), "inconclusive", "protection_visibility_insufficient"),
        (blocked, "inconclusive", "protection_state_unknown"),
        (F.col("rows").isNull(), "not_applicable", "no_person_tracks"),
        (~F.coalesce("ready", F.lit(False)), "inconclusive", "relative_plane_unavailable"),
        (F.col("usable").isNull(), "inconclusive", "target_plane_incompatible"),
        (F.col("alerts") > 0, "alert", "visible_unguarded_edge"),
        (F.col("doubts") > 0, "inconclusive", "inconclusive_distance"),
        (F.col("no_drop"), "inconclusive", "edge_semantics_unknown"),
        (F.col("no_view"), "inconclusive", "protection_visibility_insufficient"),
        (F.col("no_state"), "inconclusive", "protection_state_unknown"),
    ], ("clear", "guarded_or_outside_edge_band"))
    ready = found.join(scenes.filter("scene_status = 'ok'"), "run_id", "left_semi")
    ready = _seen(ready.join(planes.filter("ready AND NOT coalesce(unstable, false)"), "run_id", "left_semi"), close, keys, distances=True)
    ready = ready.withColumnRenamed("object_id", "proposal_id")
    low, high = tenths("distance.lower"), tenths("distance.upper")
    text = [
        F.col("canonical_track_id"), " stayed within ", tenths(F.lit(s.edge)), " worker-heights of ", F.col("proposal_id"),
        ", an open edge reported as unguarded or inadequately protected (95% interval ", low, "-", high, " WH), from ",
        tenths("first"), "s to ", tenths("last"), "s (", tenths("span"), "s).",
    ]
    return incidents(ready, "R5", "visible_unguarded_edge", "high", s.place_debounce, text, s), coverage


def all_rules(
    obs: DataFrame, runs: DataFrame, scenes: DataFrame, proposals: DataFrame, planes: DataFrame, machine_measures: DataFrame, edges_held: DataFrame,
    edge_measures: DataFrame, states: DataFrame, s: Settings = Settings(),
) -> tuple[DataFrame, DataFrame]:
    """Incidents of all rules, and five coverage rows for each run."""
    parts = [
        missing_helmet(obs, runs, s), missing_vest(obs, runs, s), restricted_zone(obs, runs, scenes, proposals, s),
        proximity(obs, runs, planes, machine_measures, states, s), open_edge(obs, runs, scenes, proposals, planes, edges_held, edge_measures, s),
    ]
    found, covered = parts[0]
    for f, c in parts[1:]:
        found, covered = found.unionByName(f), covered.unionByName(c)
    return found, covered
