"""Schemas of observations and findings, their domains, and the split into valid and quarantined rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

POINT = "struct<x:double,y:double>"
BOX = "struct<x1:double,y1:double,x2:double,y2:double>"
GEAR = "struct<state:string,confidence:double,visible:boolean>"
OBSERVATIONS = (
    "run_id string, shot_id string, frame_index int, video_time_s double, track_id bigint, canonical_track_id string,"
    f" object_class string, confidence double, box {BOX}, anchor {POINT}, helmet {GEAR}, vest {GEAR}"
)
PROPOSALS = (
    f"run_id string, proposal_id string, proposal_type string, geometry_type string, points array<{POINT}>,"
    " visible_drop_or_open_side boolean, protection_visibility string, protection_state string, agreement_score double,"
    " supporting_keyframes array<int>, eligible_keyframes int"
)
INCIDENTS = (
    "incident_id string, run_id string, shot_id string, catalogue_sha256 string, rule_id string, status string, reason_code string, basis string,"
    " severity string, canonical_track_id string, object_id string, proposal_ids array<string>, first_seen_s double, confirmed_at_s double,"
    " resolved_at_s double, confidence double, distance struct<lower:double,median:double,upper:double>, relative_band string,"
    " observation_text string, action_code string, action_text string, references array<string>, evidence_path string, source_frame_index int"
)
COVERAGE = "run_id string, rule_id string, status string, reason_code string"
CLAUSES = (
    "chunk_id string, rule_ids array<string>, source string, clause_ref string, title string, text string,"
    " source_url string, retrieved_on date, sha256 string"
)

#: Values of the string-typed enumerations. Fixed values.
DOMAINS = {
    "rule_id": ("R1", "R2", "R3", "R4", "R5"),
    "status": ("alert", "clear", "inconclusive", "not_applicable", "unsupported"),
    "helmet": ("helmet", "no_helmet", "unknown"),
    "vest": ("vest", "no_vest", "unknown"),
    "relative_band": ("near", "caution", "clear", "indeterminate"),
    "operating_state": ("active", "stationary", "unknown"),
}


def finite(value: Column) -> Column:
    return ~F.isnan(value) & (F.abs(value) < F.lit(float("inf")))


def observation_checks() -> dict[str, Column]:
    """Name to condition, true or null where a row is fine."""
    box = [F.col(f"box.{c}") for c in ("x1", "y1", "x2", "y2")]
    return {
        "frame_index": F.col("frame_index") >= 0,
        "video_time_s": finite(F.col("video_time_s")) & (F.col("video_time_s") >= 0),
        "confidence": F.col("confidence").between(0, 1),
        "box_finite": reduce(lambda a, b: a & b, map(finite, box)),
        "box_ordered": (box[0] <= box[2]) & (box[1] <= box[3]),
        "helmet": F.col("helmet.state").isin(*DOMAINS["helmet"]) & F.col("helmet.confidence").between(0, 1),
        "vest": F.col("vest.state").isin(*DOMAINS["vest"]) & F.col("vest.confidence").between(0, 1),
    }


def validate(df: DataFrame, checks: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """The rows that pass every check, and the others with the names of those that they fail."""
    named = [F.when(~check, F.lit(name)) for name, check in checks.items()]
    marked = df.withColumn("failed", F.filter(F.array(*named), lambda n: n.isNotNull()))
    return marked.filter(F.size("failed") == 0).drop("failed"), marked.filter(F.size("failed") > 0)
