"""Detections: thresholds, arg-max classes and suppression of overlapping boxes."""

from __future__ import annotations

from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runs import by_page, edges

OBJECTNESS, CONFIDENCE, OVERLAP = 0.4, 0.4, 0.35
ROW_CAP, KEEP_CAP = 30_000, 300
LINE_SCORE = 0.6
CELLS = 1 << 18  # of a matrix that is held at once


def scored(det: DataFrame, classes: list[str], objectness: float = OBJECTNESS, confidence: float = CONFIDENCE) -> DataFrame:
    """Rows over both thresholds, with ``label`` (first best class) and ``conf``; objectness is tested before anything is multiplied."""
    scores = F.array(*[F.col(c) * F.col("obj") for c in classes])
    out = det.where(F.col("obj") > objectness).withColumn("__s", scores)
    best = F.array_max("__s")
    return out.withColumns({"conf": best, "label": (F.array_position("__s", best) - 1).cast("int")}).drop("__s").where(F.col("conf") > confidence)


def corners(det: DataFrame) -> DataFrame:
    """x1, y1, x2, y2 from centre and size."""
    return det.withColumns({"x1": F.col("cx") - F.col("w") / 2, "y1": F.col("cy") - F.col("h") / 2, "x2": F.col("cx") + F.col("w") / 2, "y2": F.col("cy") + F.col("h") / 2})


def rescaled(det: DataFrame, x_ratio: Column, y_ratio: Column) -> DataFrame:
    """Corners times the ratios, truncated; confidence to three digits, half to even."""
    x, y = (lambda c: (F.col(c) * x_ratio).cast("int")), (lambda c: (F.col(c) * y_ratio).cast("int"))
    return det.withColumns({"x1": x("x1"), "y1": y("y1"), "x2": x("x2"), "y2": y("y2"), "conf": F.bround("conf", 3)})


def suppression(box: np.ndarray, label: np.ndarray, overlap: float = OVERLAP, keep: int = KEEP_CAP) -> list[int]:
    """Places of the rows that stay, of rows in order; of the matrix of overlaps only some rows are held at once."""
    free, out, part = np.ones(len(box), bool), [], max(1, CELLS // max(1, len(box)))
    size = (box[:, 2] - box[:, 0]) * (box[:, 3] - box[:, 1])
    for i in range(0, len(box), part):
        rows = i + np.flatnonzero(free[i : i + part])
        side = np.minimum(box[rows, None, 2:], box[None, i:, 2:]) - np.maximum(box[rows, None, :2], box[None, i:, :2])
        common = np.where((side < 0).any(2), 0.0, side[..., 0] * side[..., 1])
        clash = (common / np.maximum(size[rows, None] + size[i:] - common, 1.0) > overlap) & (label[rows, None] == label[i:])
        for k, row in enumerate(rows.tolist()):
            if free[row]:
                out.append(row)
                if len(out) == keep:
                    return out
                free[i:] &= ~clash[k]
    return out


def suppressed(det: DataFrame, overlap: float = OVERLAP, cap: int = ROW_CAP, keep: int = KEEP_CAP) -> DataFrame:
    """Kept rows (page_id, det_id, label, conf, corners, rank) of each page.

    Rows in order of falling confidence, equal ones by det_id; a row goes if a kept row of its label
    overlaps it by more than ``overlap`` (the union counts as 1 at least).  ``cap`` rows enter, all
    labels together, and ``keep`` stay.  One shuffle, by page.
    """
    names = ["det_id", "label", "conf", "x1", "y1", "x2", "y2"]

    def kernel(table: pa.Table) -> list[tuple]:
        box = np.stack([table.column(c).to_numpy().astype(float) for c in names[3:]], axis=1)
        held, label, out = list(zip(*(table.column(c).to_pylist() for c in names), strict=True)), table.column("label").to_numpy(), []
        page = table.column("page_id").to_numpy()
        for i, j in pairwise(edges(page)):
            j = min(j, i + cap)
            out += [(int(page[i]), *held[i + k], rank) for rank, k in enumerate(suppression(box[i:j], label[i:j], overlap, keep))]
        return out

    kinds = ", ".join(f"{c} {det.schema[c].dataType.simpleString()}" for c in names)
    rows = det.select("page_id", *names, (-F.col("conf")).alias("falling"))
    return by_page([rows], ["falling", *names], kernel, f"page_id long, {kinds}, rank int")


def line_filter(lines: DataFrame, score: float = LINE_SCORE) -> DataFrame:
    return lines.where(F.col("score") > score)


def line_rescaled(lines: DataFrame, width: Column, height: Column, dw: Column, dh: Column, target: int = 1024) -> DataFrame:
    """Corners from the padded square back to the page, truncated."""
    x = lambda c: (F.col(c) * (width / (target - dw))).cast("int")
    y = lambda c: (F.col(c) * (height / (target - dh))).cast("int")
    return lines.withColumns({f"px{k}": x(f"px{k}") for k in range(1, 5)} | {f"py{k}": y(f"py{k}") for k in range(1, 5)})
