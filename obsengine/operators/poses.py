"""Upright people from keypoints, as the ground plane's fit takes them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from obsengine.functions import pose
from obsengine.functions.predicates import upright_observation


def verticals(seen: DataFrame, floor: float = pose.FLOOR) -> DataFrame:
    """seen (run_id, shot_id, frame_index, video_time_s, canonical_track_id, keypoints, crop_x, crop_y) with a person's crown and sole, if they stand.

    One row for each accepted row: observation_id, the columns of pose.vertical_pair, and track, t and sigma for ground.fit_planes. A narrow map.
    """
    keypoints = pose.shifted(F.col("keypoints"), F.col("crop_x"), F.col("crop_y"))
    found = seen.withColumn("_v", pose.vertical_pair(keypoints, floor)).filter("_v IS NOT NULL")
    v = F.col("_v")
    fit = found.filter(upright_observation(v["standing"], v["occlusion"], v["head"], v["foot"], v["hy"] - v["fy"]))
    return fit.select(
        F.concat_ws("-", "canonical_track_id", "frame_index").alias("observation_id"), "run_id", "shot_id", "frame_index", F.col("video_time_s").alias("t"),
        F.col("canonical_track_id").alias("track"), "_v.*", F.greatest(F.lit(2.0), pose.HEAD_NOISE * v["pixels"]).alias("sigma"),
    )
