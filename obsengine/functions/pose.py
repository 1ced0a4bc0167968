"""Column functions on 17 body keypoints: crown and sole of a person, how surely they stand, and how sure both points are.

Keypoints are an array of structs x, y, c (confidence): nose, eyes, ears, shoulders, elbows, wrists, hips, knees, ankles.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Places in the array, counted from 0. Fixed values.
HEAD, SHOULDERS, HIPS, ANKLES = (0, 1, 2, 3, 4), (5, 6), (11, 12), (15, 16)
#: Shares of a body: the crown over the eyes, of their distance from the shoulders; the sole under the ankles, of theirs from the crown. Fixed values.
CROWN_ABOVE_EYES, SOLE_BELOW_ANKLES = 0.54, 0.039 / 0.961
#: Confidence that a keypoint has to have, and that under which it is hidden; noise of head and foot as shares of the height. Fixed values.
FLOOR, HIDDEN, HEAD_NOISE, FOOT_NOISE = 0.60, 0.5, 0.03, 0.015


def _usable(keypoints: Column, places: tuple[int, ...], floor: float) -> Column:
    return F.filter(F.array(*(keypoints[i] for i in places)), lambda p: p["c"] >= floor)


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, v: s + v)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is worked out once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def midpoint(parts: Column) -> Column:
    """Mean of keypoints weighted by their confidence; null fields if there are none."""
    return F.aggregate(
        parts, F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("c")),
        lambda s, p: F.struct((s["x"] + p["x"] * p["c"]).alias("x"), (s["y"] + p["y"] * p["c"]).alias("y"), (s["c"] + p["c"]).alias("c")),
        lambda s: F.struct(F.try_divide(s["x"], s["c"]).alias("x"), F.try_divide(s["y"], s["c"]).alias("y")),
    )


def _beyond(a: Column, b: Column, share: float) -> Column:
    """The point beyond a, seen from b, by a share of their distance."""
    return F.struct(*((a[n] + share * (a[n] - b[n])).alias(n) for n in ("x", "y")))


def _share(value: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), value))


def standing_probability(shoulders: Column, hips: Column, ankles: Column) -> Column:
    """The less of two: torso and legs in line, and legs of a standing person's length; 0 for a torso or legs of no length."""
    way = lambda a, b: F.struct((b["x"] - a["x"]).alias("x"), (b["y"] - a["y"]).alias("y"), F.hypot(b["x"] - a["x"], b["y"] - a["y"]).alias("n"))

    def least(both: Column) -> Column:
        torso, legs = both["torso"], both["legs"]
        aligned = F.try_divide(torso["x"] * legs["x"] + torso["y"] * legs["y"], torso["n"] * legs["n"])
        share = F.least(_share((aligned - 0.80) / 0.15), _share((F.try_divide(legs["n"], torso["n"]) - 0.8) / 0.6))
        return F.when((torso["n"] < 1e-6) | (legs["n"] < 1e-6), 0.0).otherwise(share)

    return let(F.struct(way(shoulders, hips).alias("torso"), way(hips, ankles).alias("legs")), least)


def covariance(head: Column, foot: Column) -> Column:
    """4 by 4, of head x, head y, foot x and foot y, from the variances of head and foot."""
    zero = F.lit(0.0)
    return F.array(*(F.array(*((head if i < 2 else foot) if i == j else zero for j in range(4))) for i in range(4)))


def vertical_pair(keypoints: Column, floor: float = FLOOR) -> Column:
    """Struct (hx, hy, fx, fy, head, foot, standing, occlusion, pixels, covariance): crown and sole, in pixels of the keypoints.

    head and foot are mean confidences, pixels the height. Null where head, shoulders, hips or ankles have no keypoint of the floor's
    confidence, where the height is 0, or a coordinate isn't finite.
    """
    sure = lambda parts: F.try_divide(_total(F.transform(parts, lambda p: p["c"])), F.size(parts).cast("double"))

    def joints(k: Column) -> Column:
        parts = {n: _usable(k, at, floor) for n, at in (("head", HEAD), ("foot", ANKLES), ("shoulders", SHOULDERS), ("hips", HIPS))}
        middles = [midpoint(p).alias(n) for n, p in parts.items()]
        hidden = F.size(F.filter(k, lambda p: p["c"] < HIDDEN)) / F.size(k)
        return F.struct(*middles, sure(parts["head"]).alias("head_c"), sure(parts["foot"]).alias("foot_c"), hidden.alias("hidden"))

    def with_crown(j: Column) -> Column:
        return let(_beyond(j["head"], j["shoulders"], CROWN_ABOVE_EYES), lambda crown: let(_beyond(j["foot"], crown, SOLE_BELOW_ANKLES), lambda sole: with_height(j, crown, sole)))

    def with_height(j: Column, crown: Column, sole: Column) -> Column:
        return let(F.hypot(crown["x"] - sole["x"], crown["y"] - sole["y"]), lambda pixels: whole(j, crown, sole, pixels))

    def whole(j: Column, crown: Column, sole: Column, pixels: Column) -> Column:
        variance = lambda share, c: F.pow(share * pixels / F.greatest(c, F.lit(0.5)), F.lit(2.0))
        return F.when((pixels > 0) & (pixels < float("inf")) & j["hips"]["x"].isNotNull(), F.struct(
            crown["x"].alias("hx"), crown["y"].alias("hy"), sole["x"].alias("fx"), sole["y"].alias("fy"), j["head_c"].alias("head"), j["foot_c"].alias("foot"),
            standing_probability(j["shoulders"], j["hips"], j["foot"]).alias("standing"), j["hidden"].alias("occlusion"), pixels.alias("pixels"),
            covariance(variance(HEAD_NOISE, j["head_c"]), variance(FOOT_NOISE, j["foot_c"])).alias("covariance"),
        ))

    return let(keypoints, lambda k: let(joints(k), with_crown))


def shifted(keypoints: Column, x: Column, y: Column) -> Column:
    """Keypoints of a crop in pixels of the image, for a crop that starts at (x, y)."""
    return F.transform(keypoints, lambda p: F.struct((p["x"] + x).alias("x"), (p["y"] + y).alias("y"), p["c"].alias("c")))
