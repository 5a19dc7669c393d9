"""Comparing two sets of boxes and texts."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as g
from .runs import by_page, edges

MATCH, FIRST_FIT, DONT_CARE, SCORE = 0.5, 0.5, 0.5, 0.6
CELLS = 1 << 20  # of a matrix that is held at once


def iou_matrix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """IoU of each box (x1, y1, x2, y2) of a with each of b; 0 where both are empty."""
    w = np.minimum(a[:, None, 2], b[None, :, 2]) - np.maximum(a[:, None, 0], b[None, :, 0])
    h = np.minimum(a[:, None, 3], b[None, :, 3]) - np.maximum(a[:, None, 1], b[None, :, 1])
    common = np.where((w < 0) | (h < 0), 0.0, w * h)
    size = lambda x: (x[:, 2] - x[:, 0]) * (x[:, 3] - x[:, 1])
    union = size(a)[:, None] + size(b)[None, :] - common
    return np.divide(common, union, out=np.zeros_like(common), where=union != 0)


def _pick(rows: np.ndarray, columns: np.ndarray, overlap: np.ndarray, best: bool) -> list[tuple[int, int, float]]:
    """Of candidates in order of row and column, each row in turn takes a free column: the last one of largest overlap, or the first."""
    used, out, held = set(), [], None
    for i, j, v in zip(rows.tolist(), columns.tolist(), overlap.tolist(), strict=True):
        if held is not None and held[0] != i:
            out.append(held)
            used.add(held[1])
            held = None
        if j not in used and (held is None or best and v >= held[2]):
            held = (i, j, v)
    return out if held is None else [*out, held]


def greedy(overlap: np.ndarray, least: float = MATCH) -> list[tuple[int, int, float]]:
    """(row, column, overlap): each row in turn takes the free column of largest overlap, of equal ones the last, if it is ``least`` or more."""
    rows, columns = np.nonzero(overlap >= least)
    return _pick(rows, columns, overlap[rows, columns], True)


def first_fit(overlap: np.ndarray, over: float = FIRST_FIT) -> list[tuple[int, int, float]]:
    """Each row in turn takes the first free column whose overlap is over the limit."""
    rows, columns = np.nonzero(overlap > over)
    return _pick(rows, columns, overlap[rows, columns], False)


def _pairs(a: np.ndarray, b: np.ndarray, best: bool, limit: float) -> list[tuple[int, int, float]]:
    """Pairs of boxes by ``greedy`` or ``first_fit``; of the matrix only some rows are held at once, and then what passes the limit."""
    part, found = max(1, CELLS // max(1, len(b))), []
    for i in range(0, len(a), part):
        overlap = iou_matrix(a[i : i + part], b)
        rows, columns = np.nonzero(overlap >= limit if best else overlap > limit)
        found.append((rows + i, columns, overlap[rows, columns]))
    return _pick(*(np.concatenate(x) for x in zip(*found, strict=True)), best) if found else []


_CORNERS = ["x1", "y1", "x2", "y2"]


def _paired(table: pa.Table, best: bool, limit: float) -> Iterator[tuple[int, int, int, int, list[tuple[int, int, float]]]]:
    """(page, first row of ours, of the reference, end, pairs) of each page in a table of whole pages."""
    page, side = table.column("page_id").to_numpy(), table.column("side").to_numpy()
    box = np.stack([table.column(c).to_numpy().astype(float) for c in _CORNERS], axis=1)
    for i, j in pairwise(edges(page)):
        k = i + int(np.searchsorted(side[i:j], 1))
        yield int(page[i]), i, k, j, _pairs(box[i:k], box[k:j], best, limit)


def _side(df: DataFrame, *more: str) -> DataFrame:
    return df.select("page_id", F.col("id").cast("long").alias("id"), *[F.col(c).cast("double").alias(c) for c in _CORNERS], *more)


def _matched(ours: DataFrame, reference: DataFrame, best: bool, limit: float) -> DataFrame:
    """Both sides: page_id, id, x1, y1, x2, y2; order within a page is that of id."""

    def kernel(table: pa.Table) -> list[tuple]:
        ids = table.column("id").to_pylist()
        return [(page, ids[i + a], ids[k + b], v) for page, i, k, _, pairs in _paired(table, best, limit) for a, b, v in pairs]

    return by_page([_side(ours), _side(reference)], ["id", *_CORNERS], kernel, "page_id long, our_id long, ref_id long, overlap double")


def iou_match(ours: DataFrame, reference: DataFrame, least: float = MATCH) -> DataFrame:
    """One-to-one pairs by greedy best overlap; the kernel holds whole pages."""
    return _matched(ours, reference, True, least)


def first_fit_match(truth: DataFrame, found: DataFrame, over: float = FIRST_FIT) -> DataFrame:
    return _matched(truth, found, False, over)


def compared(ours: DataFrame, reference: DataFrame, least: float = MATCH) -> DataFrame:
    """``page_report`` of the pairs that ``iou_match`` finds, in the same pass over the pages; both sides have ``text``."""

    def kernel(table: pa.Table) -> list[tuple]:
        text, out = table.column("text").to_pylist(), []
        for page, i, k, j, pairs in _paired(table, True, least):
            told = [(text[i + a], text[k + b]) for a, b, _ in pairs]
            differ = [{"ours": x, "reference": y} for x, y in told if x is not None and y is not None and x != y]
            out.append((page, j - k, k - i, len(told), sum(x is not None and x == y for x, y in told), differ))
        return out

    schema = "page_id long, reference long, ours long, matched long, exact long, diffs array<struct<ours:string,reference:string>>"
    return by_page([_side(ours, "text"), _side(reference, "text")], ["id", *_CORNERS], kernel, schema)


def dont_care(found: DataFrame, ignored: DataFrame, over: float = DONT_CARE) -> DataFrame:
    """Rows of ``found`` of whose area an ignored box covers more than ``over``; an empty box never."""
    a, b = g.box("d."), g.box("i.")
    share = F.try_divide(F.greatest(g.intersection(a, b), F.lit(0.0)), g.area(a))
    return found.alias("d").join(ignored.alias("i"), (F.col("d.page_id") == F.col("i.page_id")) & (share > over), "left_semi")


def page_report(ours: DataFrame, reference: DataFrame, pairs: DataFrame) -> DataFrame:
    """Counts by page and the pairs whose texts differ, in order of our ids; all sides have ``text``."""
    both = pairs.join(ours.select("page_id", F.col("id").alias("our_id"), F.col("text").alias("ours")), ["page_id", "our_id"]).join(reference.select("page_id", F.col("id").alias("ref_id"), F.col("text").alias("reference")), ["page_id", "ref_id"])
    differ = F.struct("our_id", "ours", "reference")
    paired = both.groupBy("page_id").agg(F.count("*").alias("matched"), F.count_if(F.col("ours") == F.col("reference")).alias("exact"), F.sort_array(F.collect_list(F.when(F.col("ours") != F.col("reference"), differ))).alias("diffs"))
    counted = ours.select("page_id", F.lit(1).alias("o"), F.lit(0).alias("r")).unionByName(reference.select("page_id", F.lit(0).alias("o"), F.lit(1).alias("r")))
    sizes = counted.groupBy("page_id").agg(F.sum("r").alias("reference"), F.sum("o").alias("ours"))
    out = sizes.join(paired, "page_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    diffs = F.transform(F.coalesce("diffs", F.array().cast("array<struct<our_id:bigint,ours:string,reference:string>>")), lambda d: F.struct(d["ours"].alias("ours"), d["reference"].alias("reference")))
    return out.select("page_id", zero("reference"), zero("ours"), zero("matched"), zero("exact"), diffs.alias("diffs"))


def total_report(pages: DataFrame) -> DataFrame:
    total = pages.agg(F.count("*").alias("pages"), *[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in ("reference", "ours", "matched", "exact")])
    return total.withColumn("exact_rate", F.coalesce(F.try_divide(F.col("exact").cast("double"), F.col("matched").cast("double")), F.lit(0.0)))


def precision_recall(truth: Column, found: Column, matched: Column) -> dict[str, Column]:
    """Per sample; without truth recall is 1 and precision 1 only if nothing was found."""
    t, f, m = (c.cast("double") for c in (truth, found, matched))
    recall = F.when(truth == 0, 1.0).otherwise(F.try_divide(m, t))
    precision = F.when(truth == 0, F.when(found > 0, 0.0).otherwise(1.0)).when(found == 0, 0.0).otherwise(F.try_divide(m, f))
    return {"precision": precision, "recall": recall, "hmean": F.coalesce(F.try_divide(2.0 * precision * recall, precision + recall), F.lit(0.0))}


def micro_average(samples: DataFrame) -> DataFrame:
    """Of columns truth, found, matched over all samples; nothing to find or found gives 0."""
    s = samples.agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("double").alias(c) for c in ("truth", "found", "matched")])
    recall, precision = (F.coalesce(F.try_divide(F.col("matched"), F.col(c)), F.lit(0.0)) for c in ("truth", "found"))
    return s.select(precision.alias("precision"), recall.alias("recall"), F.coalesce(F.try_divide(2 * precision * recall, precision + recall), F.lit(0.0)).alias("hmean"))


def confident(predictions: DataFrame, score: str, least: float = SCORE) -> DataFrame:
    """Predictions with a score of ``least`` or more."""
    return predictions.where(F.col(score) >= least)


def f_measure(precision: Column, recall: Column) -> Column:
    return 2 * precision * recall / (precision + recall + 1e-8)


def weighted_mean(value: Column, weight: Column) -> Column:
    return F.try_divide(F.sum(value * weight), F.sum(weight))


def average_precision(rows: DataFrame, group: str, confidence: str, correct: str, tie: str, truth: str) -> DataFrame:
    """Running precision at each correct row in order of falling confidence, over the number of true ones; 0 without any."""
    order = Window.partitionBy(group).orderBy(F.col(confidence).desc(), F.col(tie))
    ranked = rows.withColumns({"__n": F.row_number().over(order), "__hit": F.sum(F.col(correct).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))})
    total = F.sum(F.when(F.col(correct), F.col("__hit") / F.col("__n")).otherwise(F.lit(0.0)))
    return ranked.groupBy(group).agg(F.coalesce(F.try_divide(total, F.max(truth).cast("double")), F.lit(0.0)).alias("average_precision"))


def max_deviation(a: DataFrame, b: DataFrame, limit: float = 1e-3) -> DataFrame:
    """By tensor the largest absolute difference of elements, and whether it is within the limit; both sides: tensor, idx, value."""
    joined = a.alias("a").join(b.alias("b"), ["tensor", "idx"])
    return joined.groupBy("tensor").agg(F.max(F.abs(F.col("a.value") - F.col("b.value"))).alias("max_abs")).withColumn("ok", F.col("max_abs") <= limit)
