"""Scene proposals: validation with reasons, and consensus over keyframes."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from obsengine.functions import geometry as g

TYPES = ("restricted_zone", "open_edge", "walkway")
POLYGONS = ("restricted_zone", "walkway")
SAME_POLYGON, SAME_LINE, LEAST_FRAMES, SUPPORT = 0.35, 0.02, 5, 0.6
SCALE, AREA_TOLERANCE = 0.1, 0.02
AROUND = [(-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1)]  # clockwise: row, column
CONSENSUS = (
    "run_id string, proposal_type string, proposal_id string, points array<struct<x:double,y:double>>, frames int, eligible int,"
    " agreement_score double, kept boolean, visible_drop_or_open_side boolean"
)


def rejection(width: float, height: float) -> Column:
    """The first reason against a proposal (proposal_type, points on a 0 to 1000 scale, visible_drop_or_open_side); else null."""
    pts = F.col("points")
    polygon = F.col("proposal_type").isin(*POLYGONS)
    out_of_range = F.exists(pts, lambda p: ~p["x"].between(0, 1000) | ~p["y"].between(0, 1000))
    return (
        F.when(~F.coalesce(F.col("proposal_type").isin(*TYPES), F.lit(False)), "unknown_type")
        .when(F.coalesce(F.size(pts), F.lit(-1)) < F.when(polygon, 3).otherwise(2), "too_few_points")
        .when(out_of_range, "coordinates_out_of_range")
        .when(polygon & g.self_intersects(pts), "self_intersecting")
        .when(polygon & (g.area(pts) < 0.001 * 1e6), "too_small")
        .when((F.col("proposal_type") == "open_edge") & F.col("visible_drop_or_open_side").isNull(), "missing_drop_flag")
    )


def validated(proposals: DataFrame, width: float, height: float) -> tuple[DataFrame, DataFrame]:
    """Accepted proposals in pixels, and the others with their reason. Of repeated (run, keyframe, place) rows the first counts."""
    first = Window.partitionBy("run_id", "keyframe", "place").orderBy("row")
    once = proposals.withColumn("_n", F.row_number().over(first))
    judged = once.withColumn("reason", F.when(F.col("_n") > 1, "duplicate").otherwise(rejection(width, height))).drop("_n")
    to_pixels = F.transform("points", lambda p: g.point(p["x"] * width / 1000, p["y"] * height / 1000))
    return judged.filter("reason IS NULL").drop("reason").withColumn("points", to_pixels), judged.filter("reason IS NOT NULL")


def rasterized(points: np.ndarray, width: float, height: float) -> np.ndarray:
    """The pixels, at SCALE, that a polygon of rounded corners holds by the even-odd rule, and those of its edges."""
    rows, columns = max(1, round(height * SCALE)), max(1, round(width * SCALE))
    x, y = np.meshgrid(np.arange(columns), np.arange(rows))
    held = np.zeros(x.shape, bool)
    corners = np.round(points * SCALE)
    for (ax, ay), (bx, by) in zip(corners, np.roll(corners, -1, axis=0)):
        crosses = (ay > y) != (by > y)
        if ay != by:
            held ^= crosses & (x < ax + (y - ay) * (bx - ax) / (by - ay))
    for a, b in zip(corners, np.roll(corners, -1, axis=0)):
        n = max(1, int(np.abs(b - a).max()))
        on = np.floor(a + (b - a) * (np.arange(n + 1) / n)[:, None] + 0.5).astype(int)
        on = on[(on >= 0).all(1) & (on[:, 0] < columns) & (on[:, 1] < rows)]
        held[on[:, 1], on[:, 0]] = True
    return held


def outlines(mask: np.ndarray) -> list[np.ndarray]:
    """The external outlines, (x, y) of border pixels in order, of the mask's parts; pixels touch by sides or corners."""
    left, out = np.pad(mask, 1), []
    for start in zip(*(i.tolist() for i in np.nonzero(left))):
        if not left[start]:
            continue
        part, queue = np.zeros_like(left), [start]
        part[start], left[start] = True, False
        while queue:
            r, c = queue.pop()
            for dr, dc in AROUND:
                if left[r + dr, c + dc]:
                    left[r + dr, c + dc], part[r + dr, c + dc] = False, True
                    queue.append((r + dr, c + dc))
        at, looked, path, first = start, 6, [start], None  # the pixel west of the first one is empty
        while True:
            turn = next((k % 8 for k in range(looked + 1, looked + 9) if part[at[0] + AROUND[k % 8][0], at[1] + AROUND[k % 8][1]]), None)
            if turn is None or (at == start and turn == first):
                break
            first = turn if first is None else first
            at = at[0] + AROUND[turn][0], at[1] + AROUND[turn][1]
            path.append(at)
            looked = (turn + 5 if turn % 2 else turn + 6) % 8
        out.append(np.array(path[:-1] or path, float)[:, ::-1] - 1)
    return out


def outline_area(points: np.ndarray) -> float:
    x, y = points.T
    return abs(float((x * np.roll(y, -1) - np.roll(x, -1) * y).sum())) / 2


def thinned(line: np.ndarray, within: float) -> np.ndarray:
    """Douglas and Peucker's points of an open line, without its last."""
    kept, todo = {0}, [(0, len(line) - 1)]
    while todo:
        a, b = todo.pop()
        if b - a < 2:
            continue
        d, rest = line[b] - line[a], line[a + 1 : b] - line[a]
        size = np.hypot(*d)
        far = np.abs(d[0] * rest[:, 1] - d[1] * rest[:, 0]) / size if size else np.hypot(*rest.T)
        if far.max() > within:
            k = a + 1 + int(far.argmax())
            kept.add(k)
            todo += [(a, k), (k, b)]
    return line[sorted(kept)]


def simplified(outline: np.ndarray) -> np.ndarray:
    """The outline at the largest tolerance (in shares of its length) that keeps its area within AREA_TOLERANCE."""
    area, best = outline_area(outline), outline
    length = np.hypot(*(np.roll(outline, -1, axis=0) - outline).T).sum()
    one = 0
    for _ in range(3):  # two corners that are far from each other
        two, one = one, int(np.hypot(*(outline - outline[one]).T).argmax())
    turned = np.roll(outline, -one, axis=0)
    k = (two - one) % len(outline)
    for share in (0, 0.002, 0.004, 0.008, 0.016, 0.03):
        less = np.concatenate([thinned(turned[: k + 1], share * length), thinned(np.vstack([turned[k:], turned[:1]]), share * length)])
        if len(less) >= 3 and abs(outline_area(less) - area) <= AREA_TOLERANCE * area:
            best = less
    return best


def voted(masks: list[np.ndarray]) -> np.ndarray | None:
    """The simplified largest outline, in pixels, of what at least half of the masks hold; None where it collapses."""
    found = outlines(2 * np.sum(masks, axis=0) >= len(masks))
    if not found:
        return None
    points = simplified(max(found, key=outline_area)) / SCALE
    return points if len(points) >= 3 and outline_area(points) >= 1 else None


def mask_iou(a: np.ndarray, b: np.ndarray) -> float:
    union = (a | b).sum()
    return float((a & b).sum() / union) if union else 0.0


def densified(points: np.ndarray, step: float = 8.0) -> np.ndarray:
    parts = [points[:1]]
    for a, b in zip(points, points[1:]):
        n = max(1, int(np.ceil(np.hypot(*(b - a)) / step)))
        parts.append(a + (b - a) * (np.arange(1, n + 1) / n)[:, None])
    return np.concatenate(parts)


def chamfer(a: np.ndarray, b: np.ndarray) -> float:
    """Mean distance of each line's points from the other's, both ways."""
    d = np.hypot(*(densified(a)[:, None] - densified(b)[None]).transpose(2, 0, 1))
    return float((d.min(0).mean() + d.min(1).mean()) / 2)


def consensus(accepted: DataFrame, eligible: DataFrame, width: float, height: float) -> DataFrame:
    """CONSENSUS: clusters of like proposals over a run's keyframes, kept if enough of them have it.

    accepted (run_id, keyframe, place, proposal_type, points in pixels, visible_drop_or_open_side), eligible (run_id,
    eligible). Proposals come in order of keyframe and place; one joins the first cluster with any like member:
    polygons by mask overlap, lines by chamfer distance. A cluster of lines has the shape of its member nearest to the
    others; one of polygons has the outline of what at least half of its masks hold, and where that collapses it is not kept
    (its row has a member's shape). Its flag is what over half of all members say. A run has a few dozen proposals (8 to 12 keyframes), so it is one group.
    """
    rows = accepted.join(eligible, "run_id").select("run_id", "proposal_type", "keyframe", "place", "points", "visible_drop_or_open_side", "eligible")
    diagonal = float(np.hypot(width, height))

    def cluster(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["keyframe", "place"])
        run, kind, eligible_frames = frame["run_id"].iloc[0], frame["proposal_type"].iloc[0], int(frame["eligible"].iloc[0])
        polygon = kind in POLYGONS
        shapes = [np.array([[p["x"], p["y"]] for p in pts]) for pts in frame["points"]]
        masks = [rasterized(s, width, height) for s in shapes] if polygon else shapes
        like = lambda i, j: mask_iou(masks[i], masks[j]) >= SAME_POLYGON if polygon else chamfer(masks[i], masks[j]) <= SAME_LINE * diagonal
        far = lambda i, j: 1 - mask_iou(masks[i], masks[j]) if polygon else chamfer(masks[i], masks[j])
        clusters: list[list[int]] = []
        for i in range(len(shapes)):
            home = next((c for c in clusters if any(like(i, j) for j in c)), None)
            clusters.append([i]) if home is None else home.append(i)
        out, least = [], max(LEAST_FRAMES, int(np.ceil(SUPPORT * eligible_frames)))
        for c in clusters:
            agreed = voted([masks[i] for i in c]) if polygon else None
            middle = c[0] if len(c) <= 2 else min(c, key=lambda i: sum(far(i, j) for j in c))
            flags = [frame["visible_drop_or_open_side"].iloc[i] for i in c]
            flag = next((v for v in (True, False) if 2 * sum(f is not None and f == v for f in flags) > len(c)), None)
            shape = shapes[middle] if agreed is None else agreed
            frames = len({frame["keyframe"].iloc[i] for i in c})
            out.append([run, kind, "", [{"x": x, "y": y} for x, y in shape.tolist()], frames, eligible_frames, frames / max(1, eligible_frames), frames >= least and (agreed is not None or not polygon), flag])
        out.sort(key=lambda r: (not r[7], np.mean([p["x"] for p in r[3]])))
        for n, r in enumerate(out):
            r[2] = f"{kind}-{n + 1}"
        return pd.DataFrame(out, columns=names)

    names = ["run_id", "proposal_type", "proposal_id", "points", "frames", "eligible", "agreement_score", "kept", "visible_drop_or_open_side"]
    return rows.groupBy("run_id", "proposal_type").applyInPandas(cluster, CONSENSUS)
