"""Profiles of labelled clips: who wears what, how crowded frames are, how steady the camera is. All by clip, many clips at once.

Boxes are rows (clip, frame, track, name, box); boxes of things are items of people where they lie on their bodies.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Seconds and pixels, shares of a body's height from the top: where an item's middle has to be, and how far over it still counts. Fixed values.
FRAMES_A_SECOND, LEAST_PERSON, STATIC_ROWS = 25, 40, 300
WEAR = {"helmet": (0.0, 0.45, 8.0), "vest": (0.15, 0.75, 0.0)}
#: Things that don't move of themselves. Fixed values.
STATIC = ("slogan", "ebox", "board", "hopper", "hook", "rebar")


def wearing(people: DataFrame, items: DataFrame, frame: Sequence[str], row_id: str, low: float, high: float, slack: float = 0.0, cell: float = 128.0) -> DataFrame:
    """The people (frame, row_id, box) with an item (frame, box) whose middle is between their sides, and in a band of their height.

    An exists-join on cells of `cell` pixels across: a person is looked up in the few cells that they reach over, an item in that of its
    middle, so a crowded frame spreads by place. row_id names a person in a frame; each comes once.
    """
    b = F.col("box")
    tall = b["y2"] - b["y1"]
    bands = people.select(*frame, row_id, b["x1"].alias("_x1"), b["x2"].alias("_x2"), (b["y1"] + tall * low - slack).alias("_lo"), (b["y1"] + tall * high).alias("_hi"))
    at = lambda x: F.floor(x / cell).cast("long")
    spread = bands.filter("_x1 <= _x2").withColumn("_cell", F.explode(F.sequence(at(F.col("_x1")), at(F.col("_x2")))))
    middles = items.select(*frame, ((b["x1"] + b["x2"]) / 2).alias("_cx"), ((b["y1"] + b["y2"]) / 2).alias("_cy")).withColumn("_cell", at(F.col("_cx")))
    s, m = spread.alias("s"), middles.alias("m")
    same = [F.col(f"s.{k}") == F.col(f"m.{k}") for k in (*frame, "_cell")]
    on_body = [F.col("_cx").between(F.col("_x1"), F.col("_x2")), F.col("_cy").between(F.col("_lo"), F.col("_hi"))]
    condition = same[0]
    for c in (*same[1:], *on_body):
        condition &= c
    return s.join(m, condition, "left_semi").select(*frame, row_id).distinct()


def sampled_frames(boxes: DataFrame, clip: str, frame: str, target: int) -> DataFrame:
    """(clip, frame): every n-th of a clip's different frames, where n is their number over the target, one at least."""
    frames = boxes.select(clip, frame).distinct()
    ranked = frames.withColumns({"_i": F.row_number().over(Window.partitionBy(clip).orderBy(frame)) - 1, "_n": F.count("*").over(Window.partitionBy(clip))})
    step = F.greatest(F.lit(1), F.floor(F.col("_n") / target))
    return ranked.filter(F.col("_i") % step == 0).select(clip, frame)


def compliance(boxes: DataFrame, clip: str = "clip", target: int = 4000) -> DataFrame:
    """(clip, sampled, n, helmet, vest, no_helmet, no_vest): of people tall enough in sampled frames, how many wear what, and the shares that don't."""
    key = [clip, "frame"]
    kept = sampled_frames(boxes, clip, "frame", target)
    inside = boxes.join(kept, key, "left_semi")
    people = inside.filter("name = 'person'").filter(F.col("box.y2") - F.col("box.y1") >= LEAST_PERSON)
    tally = kept.groupBy(clip).agg(F.count("*").alias("sampled")).join(people.groupBy(clip).agg(F.count("*").alias("n")), clip, "left")
    for item, (low, high, slack) in WEAR.items():
        worn = wearing(people, inside.filter(F.col("name") == item), key, "row_id", low, high, slack)
        tally = tally.join(worn.groupBy(clip).agg(F.count("*").alias(item)), clip, "left")
    share = lambda c: 1 - F.coalesce(F.try_divide(F.coalesce(c, F.lit(0)), F.col("n")), F.lit(0.0))
    counts = [F.coalesce(c, F.lit(0)).alias(c) for c in ("n", *WEAR)]
    return tally.select(clip, "sampled", *counts, *(share(F.col(c)).alias(f"no_{c}") for c in WEAR))


def nearest_ranks(rows: DataFrame, key: str, value: str, shares: dict[str, float]) -> DataFrame:
    """(key, one column a share): the value at place int(n * share) of each key's sorted values.

    Values are counted before they are ranked, so what is sorted are a key's different values.
    """
    counted = rows.groupBy(key, value).agg(F.count("*").alias("_c"))
    ordered = Window.partitionBy(key).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    ranked = counted.withColumns({"_upto": F.sum("_c").over(ordered), "_n": F.sum("_c").over(Window.partitionBy(key))})
    picks = [F.min(F.when(F.col("_upto") > F.floor(F.col("_n") * share), F.col(value))).alias(name) for name, share in shares.items()]
    return ranked.groupBy(key).agg(*picks)


def crowding(boxes: DataFrame, clip: str = "clip") -> DataFrame:
    """(clip, crowd_p90, crowd_max): people a frame, over the frames with any."""
    per_frame = boxes.filter("name = 'person'").groupBy(clip, "frame").agg(F.count("*").alias("n"))
    return nearest_ranks(per_frame, clip, "n", {"crowd_p90": 0.9}).join(per_frame.groupBy(clip).agg(F.max("n").alias("crowd_max")), clip)


def drift(boxes: DataFrame, clip: str = "clip", static: Sequence[str] = STATIC, least: int = STATIC_ROWS) -> DataFrame:
    """(clip, drift, name, track, n, camera): the worst spread of a long-lived static thing's corner, across or down, and what it says of the camera.

    Ties go to the name, then the track. Clips without such a thing are left out.
    """
    corners = boxes.filter(F.col("name").isin(*static)).groupBy(clip, "name", "track").agg(
        F.count("*").alias("n"), F.greatest(F.stddev_pop("box.x1"), F.stddev_pop("box.y1")).alias("drift")
    )
    first = Window.partitionBy(clip).orderBy(F.desc("drift"), "name", "track")
    worst = corners.filter(F.col("n") >= least).withColumn("_i", F.row_number().over(first)).filter("_i = 1")
    return worst.select(clip, "drift", "name", "track", "n", camera_verdict(F.col("drift")).alias("camera"))


def camera_verdict(spread: Column) -> Column:
    return F.when(spread < 5, "fixed").when(spread < 25, "check").otherwise("moving")


def profiled(boxes: DataFrame, clip: str = "clip", target: int = 4000) -> DataFrame:
    """One row a clip: boxes, frames, minutes, size, heights of people, crowding, the camera's drift, and what people don't wear. row_id names a box."""
    base = boxes.groupBy(clip).agg(
        F.count("*").alias("boxes"), F.count_distinct("frame").alias("frames"), (F.max("box.x2") + 1).alias("width"), (F.max("box.y2") + 1).alias("height")
    )
    tall = boxes.filter("name = 'person'").select(clip, (F.col("box.y2") - F.col("box.y1")).alias("tall"))
    heights = nearest_ranks(tall, clip, "tall", {"person_p10": 0.1, "person_p50": 0.5, "person_p90": 0.9})
    steady = drift(boxes, clip).select(clip, "drift", "camera")
    joined = base.join(heights, clip, "left").join(crowding(boxes, clip), clip, "left").join(steady, clip, "left").join(compliance(boxes, clip, target), clip, "left")
    return joined.withColumn("minutes", F.col("frames") / FRAMES_A_SECOND / 60)
