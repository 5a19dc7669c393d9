"""Probability grids and text masks.

A grid is rows (id, x, y, value); relational steps run on these, order-dependent ones in numpy on one
grid at a time.  Pixels outside a grid do not count in morphology.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as g

BINARY, DENSITY = 0.3, 0.1


def cells(grids: DataFrame, key: str, values: str, width: int) -> DataFrame:
    """(key, x, y, value) of an array held row by row."""
    return grids.select(key, F.posexplode(values).alias("i", "value")).select(key, (F.col("i") % width).alias("x"), F.expr(f"i div {width}").cast("int").alias("y"), "value")


def binarised(value: Column, threshold: float = BINARY) -> Column:
    return (value > threshold).cast("int")


def dense_boxes(boxes: DataFrame, grid: DataFrame, key: str, least: float = DENSITY) -> DataFrame:
    """Boxes (key, box_id, x1, y1, x2, y2; ends exclusive) with ``density``, the mean over 255 of the mask in them; sparse ones go, ones without a cell stay."""
    inside = (F.col("x") >= F.col("x1")) & (F.col("x") < F.col("x2")) & (F.col("y") >= F.col("y1")) & (F.col("y") < F.col("y2"))
    mean = boxes.join(grid, key).where(inside).groupBy(key, "box_id").agg((F.avg("value") / 255).alias("density"))
    out = boxes.join(mean, [key, "box_id"], "left")
    return out.where(F.col("density").isNull() | (F.col("density") >= least))


def column_density(grid: DataFrame, key: str) -> DataFrame:
    """(key, x, density): the sum of each column of cells."""
    return grid.groupBy(key, "x").agg(F.sum("value").alias("density"))


def large_components(parts: DataFrame, least: int) -> DataFrame:
    """Components (x, y, w, h, area) of more than ``least`` cells."""
    return parts.where(F.col("area") > least)


def histogram(pixels: DataFrame, key: str, value: str, bins: int = 255) -> DataFrame:
    """(key, bin, count) of non-empty bins of equal width between the least and the largest value, the last one closed."""
    ends = pixels.groupBy(key).agg(F.min(value).alias("low"), F.max(value).alias("high"))
    place = F.floor((F.col(value) - F.col("low")) / (F.col("high") - F.col("low")) * bins)
    at = F.when(F.col("high") == F.col("low"), F.lit(bins // 2)).otherwise(F.least(place, F.lit(bins - 1)))
    return pixels.join(ends, key).groupBy(key, at.cast("int").alias("bin")).count()


def otsu(pixels: DataFrame, key: str, value: str) -> DataFrame:
    """(key, threshold): the first level of 0 to 255 with the largest variance between classes."""
    counts = pixels.groupBy(key, F.col(value).cast("int").alias("level")).count()
    order = Window.partitionBy(key).orderBy("level").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(key)
    held = counts.withColumns({
        "w": F.sum("count").over(order).cast("double"), "m": F.sum(F.col("count") * F.col("level")).over(order).cast("double"),
        "n": F.sum("count").over(whole).cast("double"), "t": F.sum(F.col("count") * F.col("level")).over(whole).cast("double"),
    })
    d = F.col("m") * F.col("n") - F.col("t") * F.col("w")
    between = F.coalesce(F.try_divide(d * d, F.col("w") * (F.col("n") - F.col("w"))), F.lit(0.0))
    return held.withColumn("between", between).groupBy(key).agg((-F.max(F.struct("between", (-F.col("level")).alias("l")))["l"]).alias("threshold"))


def top_colours(histogram: DataFrame, key: str, k: int = 3, apart: int = 10, share: float = 0.001) -> DataFrame:
    """(key, colours): by falling count (equal: lower colour first) those over ``apart`` from all chosen; ends at k, or after a count under ``share`` of all."""
    rows = histogram.groupBy(key).agg(F.array_sort(F.collect_list(F.struct((-F.col("count")).alias("o"), "colour"))).alias("rows"), (F.sum("count") * F.lit(share)).alias("least"))
    start = F.struct(F.transform(F.slice("rows", 1, 1), lambda r: r["colour"]).alias("chosen"), F.lit(False).alias("over"))

    def step(s: Column, r: Column) -> Column:
        near = F.exists(s["chosen"], lambda c: F.abs(c - r["colour"]) <= apart)
        chosen = F.when(s["over"] | near, s["chosen"]).otherwise(F.concat(s["chosen"], F.array(r["colour"])))
        return F.struct(chosen.alias("chosen"), (s["over"] | (F.size(chosen) >= k) | (-r["o"] < F.col("least"))).alias("over"))

    return rows.select(key, F.aggregate(F.slice("rows", F.lit(2), F.greatest(F.size("rows") - 1, F.lit(0))), start, step, lambda s: s["chosen"]).alias("colours"))


def colour_band(value: Column, colour: Column, reach: int = 30) -> Column:
    """255 within the band around the colour; near white the band is moved down, not cut."""
    top = F.least(colour + reach, F.lit(255))
    return F.when(value.between(top - 2 * reach, top), 255).otherwise(0)


def least_xor(pixels: DataFrame, key: str, image: str, mask: str) -> DataFrame:
    """(key, cost, negative): XOR sum with the mask of the image, or of its negative where that is less."""
    sums = pixels.groupBy(key).agg(F.sum(F.col(image).bitwiseXOR(F.col(mask))).alias("own"), F.sum((255 - F.col(image)).bitwiseXOR(F.col(mask))).alias("other"))
    return sums.select(key, F.least("own", "other").alias("cost"), (F.col("other") < F.col("own")).alias("negative"))


def morphology(grid: DataFrame, key: str, width: int, height: int, grow: bool) -> DataFrame:
    """3 x 3 dilation or erosion: each cell is sent to its neighbours."""
    steps = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx in (-1, 0, 1) for dy in (-1, 0, 1)])
    sent = grid.withColumn("s", F.explode(steps)).select(key, (F.col("x") + F.col("s.dx")).alias("x"), (F.col("y") + F.col("s.dy")).alias("y"), "value")
    sent = sent.where(F.col("x").between(0, width - 1) & F.col("y").between(0, height - 1))
    return sent.groupBy(key, "x", "y").agg((F.max if grow else F.min)("value").alias("value"))


def undetected(parts: DataFrame, blocks: DataFrame, key: str, share: float = 0.5) -> DataFrame:
    """Components of whose box no block covers ``share`` or more; without any block all stay."""
    w, h = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    b = blocks.select(key, *[F.col(c).alias(f"b{c}") for c in ("x1", "y1", "x2", "y2")])
    common = F.when(F.col("bx1").isNotNull(), g.intersection(g.box(), g.box("b")))  # least() passes over nulls
    best = parts.join(b, key, "left").groupBy(*parts.columns).agg(F.coalesce(F.max(common), F.lit(-1.0)).alias("best"))
    return best.where(F.col("best") / w / h < share).select(*parts.columns)


def polygon_score(polygons: DataFrame, grid: DataFrame, key: str) -> DataFrame:
    """(key, score): mean of the grid over cells in a convex polygon, its edges included; corners in clockwise order on the screen."""
    inside = F.lit(True)
    q = g.quad()
    for (x, y), (u, v) in zip(q, q[1:] + q[:1], strict=True):
        inside = inside & ((u - x) * (F.col("y") - y) - (v - y) * (F.col("x") - x) >= 0)
    return polygons.join(grid, key).where(inside).groupBy(key).agg(F.avg("value").alias("score"))


# numpy kernels: one grid at a time


def labels(mask: np.ndarray, neighbours: int = 8) -> tuple[np.ndarray, list[tuple[int, int, int, int, int]]]:
    """Connected cells over 0, numbered from 1 in row order of their first cell, and (x, y, w, h, area) of each."""
    out, parts = np.zeros(mask.shape, int), []
    around = [(dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if (dy or dx) and (neighbours == 8 or not (dy and dx))]
    for y, x in zip(*np.nonzero(mask), strict=True):
        if out[y, x]:
            continue
        number, todo, found = len(parts) + 1, [(y, x)], []
        out[y, x] = number
        while todo:
            p = todo.pop()
            found.append(p)
            for dy, dx in around:
                q = (p[0] + dy, p[1] + dx)
                if 0 <= q[0] < mask.shape[0] and 0 <= q[1] < mask.shape[1] and mask[q] and not out[q]:
                    out[q] = number
                    todo.append(q)
        low, high = np.min(found, 0), np.max(found, 0)
        parts.append((int(low[1]), int(low[0]), int(high[1] - low[1] + 1), int(high[0] - low[0] + 1), len(found)))
    return out, parts


def _neighbourhood(mask: np.ndarray, pick, cross: bool, fill: int) -> np.ndarray:
    held = np.pad(mask, 1, constant_values=fill)
    h, w = mask.shape
    return pick.reduce([held[1 + dy : 1 + dy + h, 1 + dx : 1 + dx + w] for dy in (-1, 0, 1) for dx in (-1, 0, 1) if not (cross and dy and dx)])


def dilated(mask: np.ndarray, cross: bool = False) -> np.ndarray:
    return _neighbourhood(mask, np.maximum, cross, 0)


def eroded(mask: np.ndarray, cross: bool = False) -> np.ndarray:
    return _neighbourhood(mask, np.minimum, cross, 255)


def merged(candidates: list[tuple[np.ndarray, int]], predicted: np.ndarray, threshold: int = 60, inpaint: bool = True) -> np.ndarray:
    """Parts of the candidates, cheapest first, that bring the mask nearer to the eroded prediction; then holes under the second largest, by the same test."""
    goal = np.where(eroded(predicted, cross=True) > threshold, 255, 0).astype(np.uint8)
    out = np.zeros_like(goal)

    def take(where: np.ndarray) -> None:
        cost = lambda m: int((m[where] ^ goal[where]).astype(int).sum())
        with_it = out.copy()
        with_it[where] = 255
        if cost(with_it) < cost(out):
            out[where] = 255

    for candidate, _ in sorted(candidates, key=lambda c: c[1]):
        number, parts = labels(candidate)
        for k, (_, _, w, h, _) in enumerate(parts, 1):
            if w * h >= 3:
                take(number == k)
    if inpaint:
        out = dilated(out)
    number, parts = labels(255 - out)
    # the background counts as a part among the holes' areas
    sizes = sorted([int((out == 255).sum())] + [p[4] for p in parts])
    least = sizes[-2] if len(sizes) > 1 else sizes[-1]
    if (out == 255).sum() < least:
        take(out == 255)
    for k, part in enumerate(parts, 1):
        if part[4] < least:
            take(number == k)
    return out


def _otsu_level(values: np.ndarray) -> int:
    count = np.bincount(values.ravel(), minlength=256).astype(float)
    w, m = np.cumsum(count), np.cumsum(count * np.arange(256))
    with np.errstate(invalid="ignore", divide="ignore"):
        between = (m * w[-1] - m[-1] * w) ** 2 / (w * (w[-1] - w))
    return int(np.nan_to_num(between).argmax())


def _cheaper(image: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, int]:
    own, other = (int((x ^ mask).astype(int).sum()) for x in (image, 255 - image))
    return (255 - image, other) if other < own else (image, own)


def candidates_of(image: np.ndarray, predicted: np.ndarray) -> list[tuple[np.ndarray, int]]:
    """Bands around the commonest greys under the eroded prediction, and the cheapest channel's Otsu mask.  image: height x width x 3."""
    grey = np.rint(image @ np.array([0.114, 0.587, 0.299])).astype(np.uint8)
    out = []
    under = grey[eroded(predicted) > 127]
    if under.size:
        count, edge = np.histogram(under, bins=255)
        order = np.argsort(-count, kind="stable")
        chosen = [edge[order[0]]]
        for k in order[1:]:
            if min(abs(c - edge[k]) for c in chosen) > 10:
                chosen.append(edge[k])
            if len(chosen) >= 3 or count[k] < count.sum() * 0.001:
                break
        for c in chosen:
            top = min(c + 30, 255)
            out.append(_cheaper(np.where((grey >= top - 60) & (grey <= top), 255, 0).astype(np.uint8), predicted))
    channels = [_cheaper(np.where(image[..., c] > _otsu_level(image[..., c]), 255, 0).astype(np.uint8), predicted) for c in range(3)]
    return out + [min(channels, key=lambda x: x[1])]


def refined(image: np.ndarray, predicted: np.ndarray, boxes: list[tuple[int, int, int, int]]) -> np.ndarray:
    """Masks of the padded windows around the boxes, joined."""
    out = np.zeros_like(predicted)
    height, width = predicted.shape
    for x1, y1, x2, y2 in boxes:
        w, h = x2 - x1, y2 - y1
        pad = round((max(h, w) * 0.25 + min(h, w) * 0.75) / 16)
        a, b, c, d = max(0, x1 - pad), max(0, y1 - pad), min(width - 1, x2 + pad), min(height - 1, y2 + pad)
        part = predicted[b:d, a:c]
        if part.size:
            out[b:d, a:c] |= merged(candidates_of(image[b:d, a:c], part), part)
    return out


def refined_undetected(image: np.ndarray, predicted: np.ndarray, mask: np.ndarray, boxes: list[tuple[int, int, int, int]]) -> np.ndarray:
    """``mask`` with what the prediction has outside it and outside the boxes; the first large component is passed over when the background is not one."""
    rest = np.where(mask > 30, 0, predicted).astype(np.uint8)
    on = np.where(rest > 30, 255, 0).astype(np.uint8)
    _, parts = labels(on, 4)
    background = int((on == 0).sum())
    large = [p for p in parts if p[4] > 50]
    if background <= 50:
        large = large[1:]
    lone = []
    for x, y, w, h, _ in large:
        common = [-1 if min(b[2], x + w) < max(b[0], x) or min(b[3], y + h) < max(b[1], y) else (min(b[2], x + w) - max(b[0], x)) * (min(b[3], y + h) - max(b[1], y)) for b in boxes]
        if max(common, default=-1) / w / h < 0.5:
            lone.append((x, y, x + w, y + h))
    return mask | refined(image, rest, lone) if lone else mask


def components(grids: DataFrame, key: str, values: str, width: int, neighbours: int = 8) -> DataFrame:
    """(key, part, x, y, w, h, area) of the cells over 0 of each grid."""

    def kernel(batches):
        for rows in batches:
            out = [(k, n, *p) for k, v in zip(rows[key], rows[values], strict=True) for n, p in enumerate(labels(np.asarray(v).reshape(-1, width), neighbours)[1], 1)]
            yield pd.DataFrame(out, columns=[key, "part", "x", "y", "w", "h", "area"])

    return grids.select(key, values).mapInPandas(kernel, f"{key} long, part int, x int, y int, w int, h int, area int")


def merged_masks(grids: DataFrame, key: str, width: int) -> DataFrame:
    """(key, mask) from columns image and predicted, arrays of 0 to 255 held row by row; the candidate is the image's cheaper side."""

    def kernel(batches):
        for rows in batches:
            out = []
            for image, predicted in zip(rows["image"], rows["predicted"], strict=True):
                p = np.asarray(predicted, np.uint8).reshape(-1, width)
                out.append(merged([_cheaper(np.asarray(image, np.uint8).reshape(-1, width), p)], p).ravel().astype(int).tolist())
            yield pd.DataFrame({key: rows[key], "mask": out})

    return grids.select(key, "image", "predicted").mapInPandas(kernel, f"{key} long, mask array<int>")
