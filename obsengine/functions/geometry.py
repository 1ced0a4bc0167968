"""Column functions on boxes, polygons, polylines and a pinhole camera over a ground plane.

Points are structs with x and y; polygons and polylines arrays of them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


def point(x: Column | float, y: Column | float) -> Column:
    as_column = lambda v: v if isinstance(v, Column) else F.lit(float(v))
    return F.struct(as_column(x).alias("x"), as_column(y).alias("y"))


def path(*points: tuple[float, float]) -> Column:
    return F.array(*(point(x, y) for x, y in points))


def box_area(b: Column) -> Column:
    return F.greatest(b["x2"] - b["x1"], F.lit(0.0)) * F.greatest(b["y2"] - b["y1"], F.lit(0.0))


def iou(a: Column, b: Column) -> Column:
    """Intersection over union; 0 for an empty union."""
    w = F.greatest(F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"]), F.lit(0.0))
    h = F.greatest(F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"]), F.lit(0.0))
    return F.coalesce(F.try_divide(w * h, box_area(a) + box_area(b) - w * h), F.lit(0.0))


def padded(b: Column, sides: float, top: float, bottom: float, width: Column, height: Column) -> Column:
    """A box grown by shares of its size, to whole pixels outward, within the image."""
    w, h = b["x2"] - b["x1"], b["y2"] - b["y1"]
    return F.struct(
        F.greatest(F.floor(b["x1"] - sides * w), F.lit(0)).alias("x1"), F.greatest(F.floor(b["y1"] - top * h), F.lit(0)).alias("y1"),
        F.least(F.ceil(b["x2"] + sides * w), width).alias("x2"), F.least(F.ceil(b["y2"] + bottom * h), height).alias("y2"),
    )


def sides(polygon: Column) -> Column:
    """Pairs (a, b) of neighbouring corners, the last with the first."""
    rest = F.concat(F.slice(polygon, 2, F.size(polygon)), F.slice(polygon, 1, 1))
    return F.zip_with(polygon, rest, lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def stretches(polyline: Column) -> Column:
    """Pairs (a, b) of neighbouring points; a single point is a pair with itself."""
    pairs = F.zip_with(F.slice(polyline, 1, F.greatest(F.size(polyline) - 1, F.lit(1))), F.slice(F.concat(F.slice(polyline, 2, F.size(polyline)), polyline), 1, F.greatest(F.size(polyline) - 1, F.lit(1))), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    return pairs


def area(polygon: Column) -> Column:
    """Shoelace, unsigned."""
    cross = F.transform(sides(polygon), lambda s: s["a"]["x"] * s["b"]["y"] - s["b"]["x"] * s["a"]["y"])
    return F.abs(F.aggregate(cross, F.lit(0.0), lambda t, v: t + v)) / 2


def to_segment(p: Column, s: Column) -> Column:
    """Distance of a point from a segment."""
    dx, dy = s["b"]["x"] - s["a"]["x"], s["b"]["y"] - s["a"]["y"]
    along = F.coalesce(F.try_divide((p["x"] - s["a"]["x"]) * dx + (p["y"] - s["a"]["y"]) * dy, dx * dx + dy * dy), F.lit(0.0))
    t = F.greatest(F.least(along, F.lit(1.0)), F.lit(0.0))
    return F.hypot(p["x"] - s["a"]["x"] - t * dx, p["y"] - s["a"]["y"] - t * dy)


def to_polyline(p: Column, polyline: Column) -> Column:
    return F.array_min(F.transform(stretches(polyline), lambda s: to_segment(p, s)))


def inside(p: Column, polygon: Column) -> Column:
    """Even-odd rule."""
    crosses = F.filter(
        sides(polygon),
        lambda s: ((s["a"]["y"] > p["y"]) != (s["b"]["y"] > p["y"]))
        & (p["x"] < s["a"]["x"] + (p["y"] - s["a"]["y"]) * F.try_divide(s["b"]["x"] - s["a"]["x"], s["b"]["y"] - s["a"]["y"])),
    )
    return F.size(crosses) % 2 == 1


def signed_distance(p: Column, polygon: Column) -> Column:
    """Distance from the outline, positive inside."""
    away = F.array_min(F.transform(sides(polygon), lambda s: to_segment(p, s)))
    return F.when(inside(p, polygon), away).otherwise(-away)


def segments_cross(s: Column, t: Column) -> Column:
    """Strictly: touching is no crossing."""
    turn = lambda a, b, c: (b["x"] - a["x"]) * (c["y"] - a["y"]) - (b["y"] - a["y"]) * (c["x"] - a["x"])
    apart = lambda q, r: turn(q["a"], q["b"], r["a"]) * turn(q["a"], q["b"], r["b"]) < 0
    return apart(s, t) & apart(t, s)


def self_intersects(polygon: Column) -> Column:
    return F.exists(sides(polygon), lambda s: F.exists(sides(polygon), lambda t: segments_cross(s, t)))


@dataclass(frozen=True)
class Camera:
    """Focal length and principal point in pixels, pitch in degrees (down), height over the ground in its own unit."""

    focal: float
    pitch: float
    height: float
    cx: float
    cy: float

    def ground(self, px: Column, py: Column) -> Column:
        """Struct (x, z) of the ground point under a pixel; null at or above the horizon."""
        import math

        tan, cos = math.tan(math.radians(self.pitch)), math.cos(math.radians(self.pitch))
        dy = (py - self.cy) / self.focal
        down = dy + tan
        z = self.height * (1 - dy * tan) / down
        depth = z * cos + self.height * math.sin(math.radians(self.pitch))
        return F.when(down > 1e-9, F.struct(((px - self.cx) / self.focal * depth).alias("x"), z.alias("z")))

    def pixel(self, x: Column, z: Column, lift: float = 0.0) -> Column:
        """Struct (x, y) of the pixel of a point above the ground; null behind the camera."""
        import math

        sin, cos = math.sin(math.radians(self.pitch)), math.cos(math.radians(self.pitch))
        below = self.height - lift
        depth = z * cos + below * sin
        return F.when(depth > 1e-9, F.struct((self.cx + self.focal * x / depth).alias("x"), (self.cy + self.focal * (below * cos - z * sin) / depth).alias("y")))


def ground_point(px: Column, py: Column, focal: Column, pitch: Column, height: Column, cx: float, cy: float) -> Column:
    """Struct (x, y) of the ground point under a pixel, y ahead, for a camera in columns (pitch in degrees); null at or above the horizon."""
    tilt = F.radians(pitch)
    dx, dy = (px - cx) / focal, (py - cy) / focal
    down = dy + F.tan(tilt)
    depth = height / (F.cos(tilt) * F.when(down > 1e-9, down))
    return F.when(down > 1e-9, F.struct((depth * dx).alias("x"), ((depth - height * F.sin(tilt)) / F.cos(tilt)).alias("y")))


def distance_band(lower: Column, upper: Column, near: float, caution: float) -> Column:
    """near, caution or clear only if the whole interval is; otherwise, and for a missing one, indeterminate."""
    return (
        F.when(upper <= near, "near")
        .when(lower > caution, "clear")
        .when((lower > near) & (upper <= caution), "caution")
        .otherwise("indeterminate")
    )
