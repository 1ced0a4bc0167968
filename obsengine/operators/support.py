"""Support regions: the convex hull of each key's points, grown by a margin, and whether a point lies in it.

A hull is an aggregate: the hull of a union is the hull of the parts' hulls. Tasks send on the corners of what they have read,
not the points; corners meet in a few salted groups of each key, and then in one, so that a key with most of the
points is never gathered, only its corners are.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from obsengine.functions import geometry as g
from obsengine.schema import POINT, finite

#: Corners of the margin, and the groups that a key's partial hulls meet in first.
RING, SALTS = 12, 16


def hull(points: np.ndarray) -> np.ndarray:
    """Corners of the convex hull of (n, 2) points, counterclockwise from the leftmost; none on an edge, no repeats, NaN left out."""
    points = points[np.isfinite(points).all(1)]
    if len(points) > 50:  # what lies inside eight extreme points is no corner
        turns = np.array([[1, 0], [1, 1], [0, 1], [-1, 1], [-1, 0], [-1, -1], [0, -1], [1, -1]], float)
        extreme = points[(points @ turns.T).argmax(0)]
        after = np.roll(extreme, -1, 0)
        left = (after - extreme)[:, 0] * (points[:, None, 1] - extreme[:, 1]) - (after - extreme)[:, 1] * (points[:, None, 0] - extreme[:, 0])
        points = np.vstack([extreme, points[~(left > 0).all(1)]])
    ordered = np.unique(points, axis=0).tolist()

    def chain(way: list) -> list:
        out: list = []
        for p in way:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]):
                out.pop()
            out.append(p)
        return out[:-1]

    return np.array(chain(ordered) + chain(ordered[::-1]) if len(ordered) > 1 else ordered).reshape(-1, 2)


def grown(corners: np.ndarray, margin: float) -> np.ndarray:
    """The hull of a ring of RING points around every corner."""
    at = np.linspace(0, 2 * math.pi, RING, endpoint=False)
    return hull((corners[:, None] + margin * np.stack([np.cos(at), np.sin(at)], 1)).reshape(-1, 2)) if len(corners) else corners


def hulls(points: DataFrame, keys: Sequence[str], x: str, y: str, margin: float = 0.0, salts: int = SALTS) -> DataFrame:
    """(keys, n_points, corners, region): of each key's finite points their number, their hull's corners, and the hull grown by the margin.

    Keys without a finite point are left out; a null key is a key. Where every key has few points, `salts` of 1 leaves their first meeting out.
    """
    types = dict(points.dtypes)
    keyed = ", ".join(f"{k} {types[k]}" for k in keys)
    rows = points.select(*keys, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"), F.lit(1).cast("long").alias("_n"))
    rows = rows.filter(finite(F.col("_x")) & finite(F.col("_y")))

    def partial(frame: pd.DataFrame) -> pd.DataFrame:
        out = []
        for key, own in frame.groupby(list(keys), dropna=False, sort=False):
            corners = hull(own[["_x", "_y"]].to_numpy())
            out.append(pd.DataFrame({**dict(zip(keys, key, strict=True)), "_x": corners[:, 0], "_y": corners[:, 1], "_n": [own["_n"].sum(), *[0] * (len(corners) - 1)]}))
        return pd.concat(out) if out else frame.iloc[:0]

    def in_task(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield partial(frame)

    def whole(frame: pd.DataFrame) -> pd.DataFrame:
        corners = hull(frame[["_x", "_y"]].to_numpy())
        as_points = lambda a: [{"x": float(p[0]), "y": float(p[1])} for p in a]
        return pd.DataFrame([[*frame[list(keys)].iloc[0], frame["_n"].sum(), as_points(corners), as_points(grown(corners, margin) if margin else corners)]], columns=[*keys, "n_points", "corners", "region"])

    some = f"{keyed}, _x double, _y double, _n long"
    few = rows.mapInPandas(in_task, some)
    if salts > 1:
        salted = few.withColumn("_salt", F.pmod(F.xxhash64("_x", "_y"), F.lit(salts)))
        few = salted.groupBy(*keys, "_salt").applyInPandas(lambda f: partial(f.drop(columns="_salt")), some)
    return few.groupBy(*keys).applyInPandas(whole, f"{keyed}, n_points long, corners array<{POINT}>, region array<{POINT}>")


def supports(region: Column, p: Column) -> Column:
    """Whether a point is finite and inside or on a convex region, counterclockwise; false without a region or a point."""
    turn = lambda s: (s["b"]["x"] - s["a"]["x"]) * (p["y"] - s["a"]["y"]) - (s["b"]["y"] - s["a"]["y"]) * (p["x"] - s["a"]["x"])
    inside = (F.size(region) > 0) & F.forall(g.sides(region), lambda s: turn(s) >= 0)
    return F.coalesce(finite(p["x"]) & finite(p["y"]) & inside, F.lit(False))
