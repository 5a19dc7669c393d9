"""Boxes and polygons as Column expressions.

A box is four columns x1, y1, x2, y2; a quadrilateral is eight: x and y of its corners in order.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

Box = tuple[Column, Column, Column, Column]
Quad = list[tuple[Column, Column]]


def box(prefix: str = "", suffix: str = "") -> Box:
    return tuple(F.col(f"{prefix}{c}{suffix}") for c in ("x1", "y1", "x2", "y2"))


def quad(prefix: str = "p") -> Quad:
    return [(F.col(f"{prefix}x{k}"), F.col(f"{prefix}y{k}")) for k in range(1, 5)]


def intersection(a: Box, b: Box) -> Column:
    """Common area; 0 if they touch, -1 if they are apart."""
    w = F.least(a[2], b[2]) - F.greatest(a[0], b[0])
    h = F.least(a[3], b[3]) - F.greatest(a[1], b[1])
    return F.when((w < 0) | (h < 0), F.lit(-1.0)).otherwise(w * h)


def area(a: Box) -> Column:
    return (a[2] - a[0]) * (a[3] - a[1])


def iou(a: Box, b: Box, floor: float | None = None) -> Column:
    """Common area over the union's; 0 where the union is 0.  floor: the least union that counts."""
    common = F.greatest(intersection(a, b), F.lit(0.0))
    union = area(a) + area(b) - common
    if floor is not None:
        return common / F.greatest(union, F.lit(floor))
    return F.coalesce(F.try_divide(common, union), F.lit(0.0))


def xywh_polygon(x: Column, y: Column, w: Column, h: Column) -> list[Column]:
    """Eight integers: the corners clockwise from the top left."""
    return [c.cast("long") for c in (x, y, x + w, y, x + w, y + h, x, y + h)]


def expanded(a: Box, width: Column, height: Column, part: int = 16, shrink: bool = False) -> Box:
    """Padded by three quarters of the short and a quarter of the long side over ``part``, kept in the page."""
    w, h = a[2] - a[0], a[3] - a[1]
    pad = F.bround((F.greatest(h, w) * 0.25 + F.least(h, w) * 0.75) / part)
    pad = -pad if shrink else pad
    zero = F.lit(0.0)
    return (F.greatest(zero, a[0] - pad), F.greatest(zero, a[1] - pad), F.least(width - 1, a[2] + pad), F.least(height - 1, a[3] + pad))


def ordered_corners(points: Quad) -> Column:
    """Four points as an array of structs: top left, top right, bottom right, bottom left; left and right by x, equal x in the order given."""
    keyed = F.array_sort(F.array(*[F.struct(x.cast("double").alias("x"), F.lit(k).alias("k"), y.cast("double").alias("y")) for k, (x, y) in enumerate(points)]))
    at = lambda k: F.struct(keyed[k]["x"].alias("x"), keyed[k]["y"].alias("y"))
    left = keyed[1]["y"] > keyed[0]["y"]
    right = keyed[3]["y"] > keyed[2]["y"]
    return F.array(F.when(left, at(0)).otherwise(at(1)), F.when(right, at(2)).otherwise(at(3)), F.when(right, at(3)).otherwise(at(2)), F.when(left, at(1)).otherwise(at(0)))


def bounds(points: Quad) -> Box:
    xs, ys = [x for x, _ in points], [y for _, y in points]
    return F.least(*xs), F.least(*ys), F.greatest(*xs), F.greatest(*ys)


def rotated(points: Quad, center: tuple[Column, Column], degrees: Column, whole: bool = True) -> Quad:
    """Turned about ``center`` in image axes; truncated to integers where ``whole``."""
    angle = F.radians(degrees)
    s, c = F.sin(angle), F.cos(angle)
    out = []
    for x, y in points:
        dx, dy = x - center[0], y - center[1]
        nx, ny = dy * s + dx * c + center[0], dy * c - dx * s + center[1]
        out.append((nx.cast("long"), ny.cast("long")) if whole else (nx, ny))
    return out


def vectors(points: Quad) -> dict[str, Column]:
    """The quadrilateral's vertical vector (vx, vy), horizontal one (hx, hy) and centre (cx, cy)."""
    (x1, y1), (x2, y2), (x3, y3), (x4, y4) = points
    half = lambda a, b: (a + b) / F.lit(2.0)
    return {
        "vx": half(x4, x3) - half(x2, x1), "vy": half(y4, y3) - half(y2, y1),
        "hx": half(x3, x2) - half(x1, x4), "hy": half(y3, y2) - half(y1, y4),
        "cx": half(x1, x3), "cy": half(y1, y3),
    }


def norm(x: Column, y: Column) -> Column:
    return F.sqrt(x * x + y * y)


def text_angle(x: Column, y: Column, vertical: Column) -> Column:
    """Whole degrees of a text direction, upright text less 90, under 3 as 0."""
    degrees = (F.atan2(y, x) / F.lit(math.pi) * 180).cast("int")
    turned = F.when(vertical, degrees - 90).otherwise(degrees)
    return F.when(F.abs(turned) < 3, F.lit(0)).otherwise(turned)


def shoelace(points: Quad) -> Column:
    """Signed area; positive for corners in clockwise order on the screen."""
    total = F.lit(0.0)
    for (x, y), (u, v) in zip(points, points[1:] + points[:1], strict=True):
        total = total + (x * v - u * y)
    return total / 2


def perimeter(points: Quad) -> Column:
    total = F.lit(0.0)
    for (x, y), (u, v) in zip(points, points[1:] + points[:1], strict=True):
        total = total + norm(u - x, v - y)
    return total


def letterbox(width: Column, height: Column, target: int = 1024, scale_up: bool = True) -> dict[str, Column]:
    """Ratio, scaled size (half to even) and padding on the right and at the bottom."""
    ratio = F.least(F.lit(float(target)) / height, F.lit(float(target)) / width)
    if not scale_up:
        ratio = F.least(ratio, F.lit(1.0))
    w, h = F.bround(width * ratio).cast("int"), F.bround(height * ratio).cast("int")
    return {"ratio": ratio, "new_w": w, "new_h": h, "dw": F.lit(target) - w, "dh": F.lit(target) - h}


def aspect_size(width: Column, height: Column, target: int, stride: int) -> dict[str, Column]:
    """Size kept in proportion to ``target``; the width, and the height if the target is not a multiple, are lifted by the rest to ``stride``."""
    size = letterbox(width, height, target)
    lift = (stride - target % stride) if target % stride else 0
    w = size["new_w"] + F.lit(lift)
    h = F.when(size["new_h"] % stride != 0, size["new_h"] + stride - size["new_h"] % stride).otherwise(size["new_h"])
    return {"new_w": w, "new_h": h}


def measures(b: Box) -> dict[str, Column]:
    """Centre, corner, sides and aspect of a box."""
    x1, y1, x2, y2 = b
    return {"cx": (x1 + x2) / 2, "cy": (y1 + y2) / 2, "x": x1, "y": y1, "w": x2 - x1, "h": y2 - y1, "aspect": (y2 - y1) / (x2 - x1)}


def min_rect(points: Quad) -> Quad:
    """Corners of the upright rectangle around a quadrilateral, clockwise from the left top."""
    x1, y1, x2, y2 = bounds(points)
    return [(x1, y1), (x2, y1), (x2, y2), (x1, y2)]


def to_unit(b: Box, width: Column, height: Column) -> dict[str, Column]:
    """Centre and sides as shares of the page."""
    ax, ay, bx, by = b[0] / width, b[1] / height, b[2] / width, b[3] / height
    return {"cx": ax + (bx - ax) / 2, "cy": ay + (by - ay) / 2, "w": bx - ax, "h": by - ay}


def from_unit(centre: Column, side: Column, size: Column) -> Column:
    """The lesser end of a side in whole pixels."""
    return ((centre - side / 2) * size).cast("long")


def hex_to_bgr(value: Column) -> dict[str, Column]:
    """Blue, green and red of a 24-bit colour; green and red lose their lowest bit."""
    return {"b": F.shiftright(value, 16), "g": F.shiftright(value.bitwiseAND(254 << 8), 8), "r": value.bitwiseAND(254)}


def stroke_width(text: list[Column], ground: list[Column], apart: int = 40, width: float = 0.2) -> Column:
    """``width`` where the summed differences of the two colours are over ``apart``, else 0."""
    far = F.abs(text[0] - ground[0])
    for a, b in zip(text[1:], ground[1:], strict=True):
        far = far + F.abs(a - b)
    return F.when(far > apart, width).otherwise(0.0)


def crop_size(points: Quad, height: int = 64) -> dict[str, Column]:
    """Width and height of a line's straightened crop: the shorter direction becomes ``height``."""
    v = vectors(points)
    up, along = norm(v["vx"], v["vy"]), norm(v["hx"], v["hy"])
    upright, ratio = up > along, up / along
    return {"w": F.when(upright, height).otherwise(F.bround(height / ratio)).cast("int"), "h": F.when(upright, F.bround(height * ratio)).otherwise(height).cast("int")}
