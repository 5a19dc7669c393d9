"""Polygon measures that need clipping or fitting; numpy, convex polygons alone."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as g


def area(p: np.ndarray) -> float:
    return abs(float(np.dot(p[:, 0], np.roll(p[:, 1], -1)) - np.dot(p[:, 1], np.roll(p[:, 0], -1)))) / 2


def hull(points: np.ndarray) -> np.ndarray:
    p = sorted({(float(x), float(y)) for x, y in points})
    if len(p) < 3:
        return np.array(p)

    def half(seq):
        out = []
        for q in seq:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (q[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (q[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(q)
        return out[:-1]

    return np.array(half(p) + half(p[::-1]))


def least_rectangle(points: np.ndarray) -> np.ndarray:
    """Corners of a rectangle of least area around the points; of equal ones that of the first hull edge."""
    h = hull(np.asarray(points, float))
    if len(h) < 3:
        low, high = np.min(points, 0), np.max(points, 0)
        return np.array([[low[0], low[1]], [high[0], low[1]], [high[0], high[1]], [low[0], high[1]]], float)
    best = None
    for a, b in zip(h, np.roll(h, -1, axis=0), strict=True):
        u = (b - a) / np.hypot(*(b - a))
        v = np.array([-u[1], u[0]])
        s, t = h @ u, h @ v
        size = (s.max() - s.min()) * (t.max() - t.min())
        if best is None or size < best[0] - 1e-9:
            best = (size, np.array([u * x + v * y for x, y in ((s.min(), t.min()), (s.max(), t.min()), (s.max(), t.max()), (s.min(), t.max()))]))
    return best[1]


def clipped(subject: np.ndarray, window: np.ndarray) -> np.ndarray:
    """The common part of two convex polygons, corners in one direction of turn."""
    turn = float(np.dot(window[:, 0], np.roll(window[:, 1], -1)) - np.dot(window[:, 1], np.roll(window[:, 0], -1)))
    out = [tuple(p) for p in subject]
    for a, b in zip(window, np.roll(window, -1, axis=0), strict=True):
        side = lambda p, a=a, b=b: ((b[0] - a[0]) * (p[1] - a[1]) - (b[1] - a[1]) * (p[0] - a[0])) * (1 if turn > 0 else -1)
        held, out = out, []
        for p, q in zip(held, held[1:] + held[:1], strict=True):
            sp, sq = side(p), side(q)
            if sp >= 0:
                out.append(p)
            if (sp >= 0) != (sq >= 0):
                t = sp / (sp - sq)
                out.append((p[0] + t * (q[0] - p[0]), p[1] + t * (q[1] - p[1])))
        if not out:
            break
    return np.array(out).reshape(-1, 2)


def polygon_iou(a: np.ndarray, b: np.ndarray) -> float:
    if area(a) == 0 or area(b) == 0:
        return 0.0
    p = clipped(a, b)
    common = area(p) if len(p) > 2 else 0.0
    return common / (area(a) + area(b) - common)


def rotated_iou(a: np.ndarray, b: np.ndarray, over: str = "union") -> float:
    """Of the least rectangles; ``over`` the union or, for 'least', the smaller area."""
    p, q = least_rectangle(a), least_rectangle(b)
    if area(p) == 0 or area(q) == 0:
        return 0.0
    if (p.max(0) <= q.min(0)).any() or (q.max(0) <= p.min(0)).any():
        return 0.0
    part = clipped(p, q)
    common = area(part) if len(part) > 2 else 0.0
    return common / (area(p) + area(q) - common if over == "union" else min(area(p), area(q)))


def _cross(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return p[..., 0] * q[..., 1] - p[..., 1] * q[..., 0]


def least_rectangles(quads: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of many quadrilaterals (n, 4, 2) those whose corners all turn one way, and ``least_rectangle`` of each of them."""
    side = np.roll(quads, -1, axis=1) - quads
    turn = _cross(side, np.roll(side, -1, axis=1))
    kept = np.flatnonzero((turn > 0).all(1) | (turn < 0).all(1))
    h = np.where((turn[kept, 0] > 0)[:, None, None], quads[kept], quads[kept, ::-1])
    first = np.lexsort((h[..., 1], h[..., 0]), axis=1)[:, :1]  # the hull begins at the least corner
    h = np.take_along_axis(h, ((first + np.arange(4)) % 4)[..., None], axis=1)
    best, out = np.full(len(h), np.inf), np.zeros_like(h)
    for k in range(4):
        edge = h[:, (k + 1) % 4] - h[:, k]
        u = edge / np.hypot(edge[:, 0], edge[:, 1])[:, None]
        v = np.stack([-u[:, 1], u[:, 0]], axis=1)
        s, t = (h * u[:, None]).sum(2), (h * v[:, None]).sum(2)
        s, t = np.stack([s.min(1), s.max(1)], axis=1), np.stack([t.min(1), t.max(1)], axis=1)
        size = (s[:, 1] - s[:, 0]) * (t[:, 1] - t[:, 0])
        less = size < best - 1e-9
        corner = u[:, None] * s[:, [0, 1, 1, 0], None] + v[:, None] * t[:, [0, 0, 1, 1], None]
        best, out = np.where(less, size, best), np.where(less[:, None, None], corner, out)
    return kept, out


def areas(p: np.ndarray) -> np.ndarray:
    """Of many polygons (n, corners, 2)."""
    return np.abs(_cross(p, np.roll(p, -1, axis=1)).sum(1)) / 2


def common_areas(subject: np.ndarray, window: np.ndarray) -> np.ndarray:
    """Areas that pairs of quadrilaterals have in common, the windows' corners turning as ``least_rectangle`` gives them; ``clipped`` for many pairs."""
    held, count = subject, np.full(len(subject), 4)
    for k in range(4):
        a, b = window[:, k, None], window[:, (k + 1) % 4, None]
        place = np.arange(held.shape[1])
        after = np.take_along_axis(held, np.where(place + 1 < count[:, None], place + 1, 0)[..., None], axis=1)
        sp, sq = _cross(b - a, held - a), _cross(b - a, after - a)
        real, across = place < count[:, None], (sp >= 0) != (sq >= 0)
        t = np.divide(sp, sp - sq, out=np.zeros_like(sp), where=across)
        made = np.stack([held, held + t[..., None] * (after - held)], axis=2).reshape(len(held), 2 * held.shape[1], 2)
        there = np.stack([real & (sp >= 0), real & across], axis=2).reshape(len(held), 2 * held.shape[1])
        count = there.sum(1)
        order = np.argsort(~there, axis=1, kind="stable")[:, : max(1, int(count.max(initial=0)))]
        held = np.take_along_axis(made, order[..., None], axis=1)
        held = np.where((np.arange(held.shape[1]) < count[:, None])[..., None], held, held[:, :1])
    return np.where(count > 2, areas(held), 0.0)


def rotated_ious(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``rotated_iou`` of many pairs (n, 4, 2); what is not strictly convex goes one by one."""
    out, left, right = np.zeros(len(a)), np.full(len(a), -1), np.full(len(a), -1)
    (i, p), (j, q) = least_rectangles(a), least_rectangles(b)
    left[i], right[j] = np.arange(len(i)), np.arange(len(j))
    both = (left >= 0) & (right >= 0)
    for k in np.flatnonzero(~both).tolist():
        out[k] = rotated_iou(a[k], b[k])
    at = np.flatnonzero(both)
    p, q = p[left[at]], q[right[at]]
    near = ~((p.max(1) <= q.min(1)).any(1) | (q.max(1) <= p.min(1)).any(1))
    at, p, q = at[near], p[near], q[near]
    common = common_areas(p, q)
    out[at] = common / (areas(p) + areas(q) - common)
    return out


def rotated_overlaps(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Keys and ``iou`` of pairs of quadrilaterals ax1..ay4 and bx1..by4."""
    names = [[f"{s}{c}{k}" for k in range(1, 5) for c in "xy"] for s in "ab"]

    def kernel(batches):
        for rows in batches:
            a, b = (rows[n].to_numpy(float).reshape(-1, 4, 2) for n in names)
            yield rows[keys].assign(iou=rotated_ious(a, b))

    kinds = ", ".join(f"{k} long" for k in keys)
    return pairs.select(*[F.col(k).cast("long").alias(k) for k in keys], *names[0], *names[1]).mapInPandas(kernel, f"{kinds}, iou double")


def unclipped(quad: g.Quad, ratio: float = 1.5) -> dict[str, Column]:
    """The box of an upright rectangle grown on each side by area x ratio / perimeter."""
    x1, y1, x2, y2 = g.bounds(quad)
    d = F.try_divide(F.abs(g.shoelace(quad)) * ratio, g.perimeter(quad))
    return {"x1": x1 - d, "y1": y1 - d, "x2": x2 + d, "y2": y2 + d}


def shrunk(quad: g.Quad, ratio: float = 0.4) -> g.Quad:
    """Corners moved towards their mean."""
    mx = sum((x for x, _ in quad), F.lit(0.0)) / len(quad)
    my = sum((y for _, y in quad), F.lit(0.0)) / len(quad)
    return [(mx + (x - mx) * ratio, my + (y - my) * ratio) for x, y in quad]


def edge_distance(height: int, width: int, a: tuple[float, float], b: tuple[float, float], reach: float) -> np.ndarray:
    """Each cell's distance to the segment a-b over ``reach``, from 0 to 1."""
    ys, xs = np.mgrid[:height, :width].astype(float)
    d = np.array(b, float) - a
    size = float(d @ d)
    t = np.clip(((xs - a[0]) * d[0] + (ys - a[1]) * d[1]) / size, 0, 1) if size else np.zeros_like(xs)
    return np.clip(np.hypot(xs - a[0] - t * d[0], ys - a[1] - t * d[1]) / reach, 0, 1)


def boxes_from_bitmap(probability: np.ndarray, threshold: float = 0.3, cap: int = 1000, ratio: float = 1.5) -> list[tuple[np.ndarray, float]]:
    """(corners, score) of connected cells over the threshold: least rectangle, passed over if a side is under 2, mean probability over its cells, grown.

    Components stand in for traced contours; holes are not traced.
    """
    from .mask import labels

    number, parts = labels(probability > threshold)
    out = []
    for k in range(1, min(len(parts), cap) + 1):
        ys, xs = np.nonzero(number == k)
        r = least_rectangle(np.stack([xs, ys], 1))
        sides = np.hypot(*(r[1] - r[0])), np.hypot(*(r[2] - r[1]))
        if min(sides) < 2:
            continue
        d = area(r) * ratio / (2 * sum(sides))
        u, v = (r[1] - r[0]) / sides[0], (r[2] - r[1]) / sides[1]
        grown = r + d * np.array([-u - v, u - v, u + v, v - u])
        h, w = probability.shape
        out.append((np.clip(np.rint(grown), 0, (w, h)).astype(np.int16), float(probability[number == k].mean())))
    return out


def validated(quad: g.Quad, width: Column, height: Column, ignored: Column) -> dict[str, Column]:
    """Corners kept in the page and turned to one direction; polygons of an area under 1 are ignored."""
    kept = [(F.greatest(F.lit(0), F.least(x, width - 1)), F.greatest(F.lit(0), F.least(y, height - 1))) for x, y in quad]
    size = F.abs(g.shoelace(kept))
    out = {}
    for k, (x, y) in enumerate(kept, 1):
        back_x, back_y = kept[len(kept) - k]
        out[f"px{k}"], out[f"py{k}"] = F.when(size > 0, back_x).otherwise(x), F.when(size > 0, back_y).otherwise(y)
    return out | {"ignored": ignored | (size < 1)}


def validated_frame(polygons: DataFrame, pages: DataFrame) -> DataFrame:
    held = polygons.join(pages, "page_id")
    return held.select("page_id", "line_id", *[c.alias(n) for n, c in validated(g.quad(), F.col("width"), F.col("height"), F.col("ignored")).items()])


