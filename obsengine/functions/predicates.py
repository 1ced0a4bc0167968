"""Conditions on boxes, crops and clips, and projections between image spaces."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _size(b: Column) -> tuple[Column, Column]:
    return b["x2"] - b["x1"], b["y2"] - b["y1"]


def assessable(b: Column, least_height: float = 40.0, least_aspect: float = 1.6) -> Column:
    """Tall enough, and upright, for its gear to be judged."""
    w, h = _size(b)
    return (h >= least_height) & (h / F.greatest(w, F.lit(1e-6)) >= least_aspect)


def pose_candidate(b: Column, width: float, height: float, edge: float = 3.0) -> Column:
    """Upright, not too small, and not cut by the canvas edge."""
    w, h = _size(b)
    away = (b["x1"] > edge) & (b["y1"] > edge) & (b["x2"] < width - edge) & (b["y2"] < height - edge)
    return (h >= 40) & (w > 0) & (h / F.when(w > 0, w) >= 1.4) & away


def upright_observation(standing: Column, occlusion: Column, head: Column, foot: Column, dy: Column) -> Column:
    return (standing >= 0.80) & (occlusion <= 0.25) & (F.least(head, foot) >= 0.60) & (F.abs(dy) >= 40)


def contact_visible(b: Column, content_bottom: Column | float, edge: float = 3.0) -> Column:
    """Whether a machine's wheels are inside the content, not cut off at its bottom."""
    return b["y2"] <= content_bottom - edge


def contacts(b: Column) -> Column:
    """The bottom corners of a box."""
    corner = lambda x: F.struct(b[x].alias("x"), b["y2"].alias("y"))
    return F.array(corner("x1"), corner("x2"))


def negative_class(name: Column) -> Column:
    """Class names that say that something is missing."""
    return name.isin("head", "none") | name.rlike("no-|no_|without|bare")


def gear_colour(helmet: Column, vest: Column) -> Column:
    """The worse of both states: missing, unknown, worn."""
    return (
        F.when((helmet == "no_helmet") | (vest == "no_vest"), "missing")
        .when((helmet == "helmet") & (vest == "vest"), "worn")
        .otherwise("unknown")
    )


def clip_checks(width: Column, height: Column, seconds: Column, drift: Column) -> dict[str, Column]:
    """Named conditions that a clip has to meet; drift in pixels."""
    return {"aspect": width / height >= 1.3, "duration": seconds >= 60, "width": width >= 1280, "steady": drift <= 2, "usable_drift": drift <= 5}


def normalized(b: Column, width: Column, height: Column) -> Column:
    """Centre and size as shares of the image, clipped to it, to six decimals."""
    clip = lambda v, top: F.greatest(F.lit(0.0), F.least(v, top.cast("double")))
    x1, x2, y1, y2 = clip(b["x1"], width), clip(b["x2"], width), clip(b["y1"], height), clip(b["y2"], height)
    share = lambda v, top: F.round(v / top, 6)
    return F.struct(share((x1 + x2) / 2, width).alias("xc"), share((y1 + y2) / 2, height).alias("yc"), share(x2 - x1, width).alias("w"), share(y2 - y1, height).alias("h"))


def letterboxed(width: Column, height: Column, canvas_width: int, canvas_height: int) -> Column:
    """Struct (x, y, w, h): where an image lies, in whole pixels, when fitted into a canvas and centred."""
    scale = F.least(F.lit(canvas_width) / width, F.lit(canvas_height) / height)
    w, h = F.bround(width * scale).cast("int"), F.bround(height * scale).cast("int")
    half = lambda c, v: F.floor((F.lit(c) - v) / 2).cast("int")
    return F.struct(half(canvas_width, w).alias("x"), half(canvas_height, h).alias("y"), w.alias("w"), h.alias("h"))
