"""Box, polygon, detection and layout queries over the fixtures, each with the SQL that DuckDB runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions import sql
from ..operators import detect, evaluate, layout, polygons
from .fixtures import Fixtures
from .registry import Registry

R = Registry()

_PAIR = "v_det d JOIN v_pred p ON d.page_id = p.page_id AND p.pred_id - p.pred_id % 2 = d.det_id - d.det_id % 2"


def _pairs(f: Fixtures) -> DataFrame:
    """Detections with predictions in buckets of two ids: equal, neighbouring and far boxes."""
    d = f.v_det.select("page_id", "det_id", "x1", "y1", "x2", "y2", (F.col("det_id") - F.col("det_id") % 2).alias("bucket"))
    p = f.v_pred.select("page_id", "pred_id", *[F.col(c).alias(f"p{c}") for c in ("x1", "y1", "x2", "y2")], (F.col("pred_id") - F.col("pred_id") % 2).alias("bucket"))
    return d.join(p, ["page_id", "bucket"])


@R.add(f"""
SELECT d.page_id, det_id, pred_id,
       CASE WHEN least(d.x2, p.x2) < greatest(d.x1, p.x1) OR least(d.y2, p.y2) < greatest(d.y1, p.y1) THEN -1
            ELSE (least(d.x2, p.x2) - greatest(d.x1, p.x1)) * (least(d.y2, p.y2) - greatest(d.y1, p.y1)) END AS inter FROM {_PAIR}""")
def box_intersection(f):
    return _pairs(f).select("page_id", "det_id", "pred_id", g.intersection(g.box(), g.box("p")).alias("inter"))


_COMMON = "greatest(0, least(d.x2, p.x2) - greatest(d.x1, p.x1)) * greatest(0, least(d.y2, p.y2) - greatest(d.y1, p.y1))"


@R.add(f"""
SELECT page_id, det_id, pred_id, CASE WHEN u = 0 THEN 0 ELSE c / u END AS iou FROM (
  SELECT *, a + b - c AS u FROM (SELECT d.page_id, det_id, pred_id, {_COMMON} AS c, (d.x2 - d.x1) * (d.y2 - d.y1) AS a, (p.x2 - p.x1) * (p.y2 - p.y1) AS b FROM {_PAIR}))""")
def box_iou(f):
    return _pairs(f).select("page_id", "det_id", "pred_id", g.iou(g.box(), g.box("p")).alias("iou"))


@R.add("""
SELECT page_id, det_id, CAST(trunc(x1) AS BIGINT) AS p0, CAST(trunc(y1) AS BIGINT) AS p1, CAST(trunc(x1 + w) AS BIGINT) AS p2, CAST(trunc(y1) AS BIGINT) AS p3,
       CAST(trunc(x1 + w) AS BIGINT) AS p4, CAST(trunc(y1 + h) AS BIGINT) AS p5, CAST(trunc(x1) AS BIGINT) AS p6, CAST(trunc(y1 + h) AS BIGINT) AS p7 FROM v_det""")
def xywh_poly(f):
    return f.v_det.select("page_id", "det_id", *[c.alias(f"p{k}") for k, c in enumerate(g.xywh_polygon(F.col("x1"), F.col("y1"), F.col("w"), F.col("h")))])


@R.add("""
SELECT page_id, det_id, greatest(0.0::DOUBLE, x1 - pad) AS x1, greatest(0.0::DOUBLE, y1 - pad) AS y1, least(width - 1, x2 + pad) AS x2, least(height - 1, y2 + pad) AS y2
FROM (SELECT d.*, width, height, round_even((greatest(h, w) * 0.25::DOUBLE + least(h, w) * 0.75::DOUBLE) / 16, 0) AS pad FROM v_det d JOIN v_page p ON d.page_id = p.page_id)""")
def expand_window(f):
    x1, y1, x2, y2 = g.expanded(g.box(), F.col("width"), F.col("height"))
    return f.v_det.join(f.v_page, "page_id").select("page_id", "det_id", x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2"))


@R.add("""
SELECT page_id, line_id,
       CAST(CASE WHEN b.y > a.y THEN a.x ELSE b.x END AS DOUBLE) AS tlx, CAST(CASE WHEN b.y > a.y THEN a.y ELSE b.y END AS DOUBLE) AS tly,
       CAST(CASE WHEN d.y > c.y THEN c.x ELSE d.x END AS DOUBLE) AS trx, CAST(CASE WHEN d.y > c.y THEN c.y ELSE d.y END AS DOUBLE) AS try,
       CAST(CASE WHEN d.y > c.y THEN d.x ELSE c.x END AS DOUBLE) AS brx, CAST(CASE WHEN d.y > c.y THEN d.y ELSE c.y END AS DOUBLE) AS bry,
       CAST(CASE WHEN b.y > a.y THEN b.x ELSE a.x END AS DOUBLE) AS blx, CAST(CASE WHEN b.y > a.y THEN b.y ELSE a.y END AS DOUBLE) AS bly
FROM (SELECT page_id, line_id, s[1] AS a, s[2] AS b, s[3] AS c, s[4] AS d FROM (
  SELECT page_id, line_id, list_sort([{'x': px1, 'k': 0, 'y': py1}, {'x': px2, 'k': 1, 'y': py2}, {'x': px3, 'k': 2, 'y': py3}, {'x': px4, 'k': 3, 'y': py4}]) AS s FROM v_line))""")
def order_corners(f):
    held = f.v_line.select("page_id", "line_id", g.ordered_corners(g.quad()).alias("c"))
    return held.select("page_id", "line_id", *[F.col("c")[k][a].alias(f"{n}{a}") for k, n in enumerate(("tl", "tr", "br", "bl")) for a in "xy"])


@R.add("""
SELECT page_id, line_id, least(px1, px2, px3, px4) AS x1, least(py1, py2, py3, py4) AS y1, greatest(px1, px2, px3, px4) AS x2, greatest(py1, py2, py3, py4) AS y2 FROM v_line""")
def poly_bbox(f):
    return f.v_line.select("page_id", "line_id", *[c.alias(n) for n, c in zip(("x1", "y1", "x2", "y2"), g.bounds(g.quad()), strict=True)])


_CANDIDATES = """
SELECT page_id, det_id, x1, y1, x2, y2, w, h, CASE WHEN s0 >= s1 THEN 0 ELSE 1 END AS label, greatest(s0, s1) AS conf
FROM (SELECT *, cls0 * obj AS s0, cls1 * obj AS s1 FROM v_det WHERE obj > 0.4) WHERE greatest(s0, s1) > 0.4"""


def _candidates(f: Fixtures) -> DataFrame:
    return detect.scored(f.v_det, ["cls0", "cls1"])


@R.add(f"""
SELECT page_id, det_id, label, CAST(trunc(x1 * 1.5::DOUBLE) AS INTEGER) AS x1, CAST(trunc(y1 * 1.25::DOUBLE) AS INTEGER) AS y1, CAST(trunc(x2 * 1.5::DOUBLE) AS INTEGER) AS x2, CAST(trunc(y2 * 1.25::DOUBLE) AS INTEGER) AS y2,
       round_even(conf, 3) AS conf FROM ({_CANDIDATES})""")
def det_filter(f):
    held = detect.corners(_candidates(f))
    return detect.rescaled(held, F.lit(1.5), F.lit(1.25)).select("page_id", "det_id", "label", "x1", "y1", "x2", "y2", "conf")


@R.add("SELECT page_id, line_id, score FROM v_line WHERE score > 0.6")
def line_filter(f):
    return detect.line_filter(f.v_line).select("page_id", "line_id", "score")


_LETTERBOX = """
SELECT page_id, width, height, ratio, CAST(nw AS INTEGER) AS new_w, CAST(nh AS INTEGER) AS new_h, CAST(1024 - nw AS INTEGER) AS dw, CAST(1024 - nh AS INTEGER) AS dh
FROM (SELECT *, round_even(width * ratio, 0) AS nw, round_even(height * ratio, 0) AS nh FROM (SELECT *, least(1024.0::DOUBLE / height, 1024.0::DOUBLE / width) AS ratio FROM v_page))"""


@R.add(_LETTERBOX)
def letterbox(f):
    return f.v_page.select("page_id", "width", "height", *[c.alias(n) for n, c in g.letterbox(F.col("width"), F.col("height")).items()])


@R.add(f"""
SELECT l.page_id, line_id, {', '.join(f"CAST(trunc(p{a}{k} * ({s} / (1024 - {d}))) AS INTEGER) AS p{a}{k}" for k in range(1, 5) for a, s, d in (("x", "width", "dw"), ("y", "height", "dh")))}
FROM v_line l JOIN ({_LETTERBOX}) b ON l.page_id = b.page_id""")
def line_rescale(f):
    held = f.v_line.join(letterbox(f), "page_id")
    out = detect.line_rescaled(held, F.col("width"), F.col("height"), F.col("dw"), F.col("dh"))
    return out.select("page_id", "line_id", *[f"p{a}{k}" for k in range(1, 5) for a in "xy"])


@R.add("""
SELECT page_id, CAST(nw + 0 AS INTEGER) AS new_w, CAST(CASE WHEN nh % 128 <> 0 THEN nh + 128 - nh % 128 ELSE nh END AS INTEGER) AS new_h
FROM (SELECT page_id, CAST(round_even(width * r, 0) AS BIGINT) AS nw, CAST(round_even(height * r, 0) AS BIGINT) AS nh
      FROM (SELECT *, least(640.0::DOUBLE / height, 640.0::DOUBLE / width) AS r FROM v_page))""")
def resize_keepasp(f):
    return f.v_page.select("page_id", *[c.alias(n) for n, c in g.aspect_size(F.col("width"), F.col("height"), 640, 128).items()])


# suppression and matching

_NMS = f"""
WITH RECURSIVE v_cand AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY conf DESC, det_id) AS rn FROM ({_CANDIDATES})),
v_kept AS (
  SELECT DISTINCT page_id, CAST(0 AS BIGINT) AS rn, CAST([] AS STRUCT(det_id BIGINT, label INTEGER, conf DOUBLE, x1 DOUBLE, y1 DOUBLE, x2 DOUBLE, y2 DOUBLE)[]) AS kept FROM v_cand
  UNION ALL
  SELECT k.page_id, c.rn, CASE WHEN len(kept) >= 300 OR len(list_filter(kept, lambda o: o.label = c.label AND
      greatest(0, least(o.x2, c.x2) - greatest(o.x1, c.x1)) * greatest(0, least(o.y2, c.y2) - greatest(o.y1, c.y1))
      / greatest((o.x2 - o.x1) * (o.y2 - o.y1) + (c.x2 - c.x1) * (c.y2 - c.y1) - greatest(0, least(o.x2, c.x2) - greatest(o.x1, c.x1)) * greatest(0, least(o.y2, c.y2) - greatest(o.y1, c.y1)), 1) > 0.35)) > 0
    THEN kept ELSE list_append(kept, {{'det_id': c.det_id, 'label': CAST(c.label AS INTEGER), 'conf': c.conf, 'x1': c.x1, 'y1': c.y1, 'x2': c.x2, 'y2': c.y2}}) END
  FROM v_kept k JOIN v_cand c ON c.page_id = k.page_id AND c.rn = k.rn + 1),
v_nms AS (SELECT page_id, unnest(kept, recursive := true), unnest(range(0, len(kept))) AS rank FROM (SELECT page_id, arg_max(kept, rn) AS kept FROM v_kept GROUP BY page_id))"""


def _kept(f: Fixtures) -> DataFrame:
    return detect.suppressed(_candidates(f))


@R.add(f"{_NMS} SELECT page_id, det_id, label, conf, x1, y1, x2, y2, CAST(rank AS INTEGER) AS rank FROM v_nms")
def nms(f):
    return _kept(f)


def _match(first: str, second: str, choose: str, condition: str) -> str:
    """A CTE chain that walks ``first`` (page_id, id, corners) in order of id and takes free rows of ``second``."""
    common = "greatest(0, least(o.x2, r.x2) - greatest(o.x1, r.x1)) * greatest(0, least(o.y2, r.y2) - greatest(o.y1, r.y1))"
    return f"""
v_first AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY id) AS rn FROM ({first})), v_second AS ({second}),
v_over AS (SELECT o.page_id, o.rn, o.id AS our_id, r.id AS ref_id, {common} / ((o.x2 - o.x1) * (o.y2 - o.y1) + (r.x2 - r.x1) * (r.y2 - r.y1) - {common}) AS overlap
           FROM v_first o JOIN v_second r ON o.page_id = r.page_id AND {common} > 0),
v_good AS (SELECT page_id, rn, our_id, list({{'v': overlap, 'r': ref_id}} ORDER BY ref_id) AS cands FROM v_over WHERE overlap {condition} GROUP BY page_id, rn, our_id),
v_walk AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY rn) AS step FROM v_good),
v_state AS (
  SELECT DISTINCT page_id, CAST(0 AS BIGINT) AS step, CAST([] AS BIGINT[]) AS used, CAST(NULL AS BIGINT) AS our_id, CAST(NULL AS STRUCT(v DOUBLE, r BIGINT)) AS took FROM v_walk
  UNION ALL
  SELECT page_id, step, CASE WHEN took IS NULL THEN used ELSE list_append(used, took.r) END, our_id, took
  FROM (SELECT s.page_id, w.step, s.used, w.our_id, {choose}(list_filter(w.cands, lambda c: NOT list_contains(s.used, c.r))) AS took
        FROM v_state s JOIN v_walk w ON w.page_id = s.page_id AND w.step = s.step + 1)),
v_match AS (SELECT page_id, our_id, took.r AS ref_id, took.v AS overlap FROM v_state WHERE took IS NOT NULL)"""


_IOU_MATCH = _NMS + "," + _match("SELECT page_id, det_id AS id, x1, y1, x2, y2 FROM v_nms", "SELECT page_id, pred_id AS id, x1, y1, x2, y2 FROM v_pred", "list_max", ">= 0.5")


def _sides(f: Fixtures) -> tuple[DataFrame, DataFrame]:
    ours = _kept(f).select("page_id", F.col("det_id").cast("long").alias("id"), "x1", "y1", "x2", "y2", (F.col("det_id") % 9).cast("string").alias("text"))
    return ours, f.v_pred.select("page_id", F.col("pred_id").cast("long").alias("id"), "x1", "y1", "x2", "y2", F.col("pred_text").alias("text"))


@R.add(f"{_IOU_MATCH} SELECT page_id, our_id, ref_id, overlap FROM v_match")
def iou_match(f):
    return evaluate.iou_match(*_sides(f))


_EVAL = f"""{_IOU_MATCH},
v_text2 AS (SELECT m.page_id, our_id, CAST(our_id % 9 AS VARCHAR) AS a, pred_text AS b FROM v_match m JOIN v_pred p ON m.page_id = p.page_id AND m.ref_id = p.pred_id),
v_report AS (
  SELECT r.page_id, r.n AS reference, coalesce(o.n, 0) AS ours, coalesce(x.matched, 0) AS matched, coalesce(x.exact, 0) AS exact, coalesce(x.diffs, '') AS diffs
  FROM (SELECT page_id, count(*) AS n FROM v_pred GROUP BY page_id) r
  LEFT JOIN (SELECT page_id, count(*) AS n FROM v_nms GROUP BY page_id) o ON r.page_id = o.page_id
  LEFT JOIN (SELECT page_id, count(*) AS matched, count(*) FILTER (a = b) AS exact, string_agg(a || '>' || b, ' ' ORDER BY our_id) FILTER (a <> b) AS diffs FROM v_text2 GROUP BY page_id) x ON r.page_id = x.page_id)"""


def _report(f: Fixtures) -> DataFrame:
    return evaluate.compared(*_sides(f))


@R.add(f"{_EVAL} SELECT * FROM v_report")
def eval_page(f):
    return _report(f).withColumn("diffs", F.array_join(F.transform("diffs", lambda d: F.concat(d["ours"], F.lit(">"), d["reference"])), " "))


@R.add(f"""{_EVAL} SELECT count(*) AS pages, CAST(sum(reference) AS BIGINT) AS reference, CAST(sum(ours) AS BIGINT) AS ours, CAST(sum(matched) AS BIGINT) AS matched, CAST(sum(exact) AS BIGINT) AS exact,
  CAST(sum(exact) AS DOUBLE) / CAST(sum(matched) AS DOUBLE) AS exact_rate FROM v_report""")
def eval_total(f):
    return evaluate.total_report(_report(f))


_TRUTH = "SELECT page_id, pred_id AS id, x1, y1, x2, y2 FROM v_pred WHERE pred_id % 3 = 0"
_FOUND = "SELECT page_id, det_id AS id, x1, y1, x2, y2 FROM v_det WHERE det_id % 2 = 0"


@R.add("WITH RECURSIVE " + _match(_TRUTH, _FOUND, "list_first", "> 0.5").lstrip() + " SELECT page_id, our_id, ref_id, overlap FROM v_match")
def first_fit_match(f):
    truth = f.v_pred.where("pred_id % 3 = 0").withColumn("id", F.col("pred_id").cast("long"))
    return evaluate.first_fit_match(truth, f.v_det.where("det_id % 2 = 0").withColumn("id", F.col("det_id").cast("long")))


@R.add(f"""SELECT DISTINCT d.page_id, det_id FROM v_det d JOIN v_pred p ON d.page_id = p.page_id AND p.pred_id % 10 = 0 WHERE {_COMMON} / ((d.x2 - d.x1) * (d.y2 - d.y1)) > 0.5""")
def dont_care_semi(f):
    return evaluate.dont_care(f.v_det, f.v_pred.where("pred_id % 10 = 0")).select("page_id", "det_id")


@R.add("SELECT page_id, det_id, obj FROM v_det WHERE obj >= 0.6")
def pred_filter(f):
    return evaluate.confident(f.v_det, "obj").select("page_id", "det_id", "obj")


_SAMPLES = """SELECT page_id, det_id % 20 AS part, count(*) FILTER (w > 180 AND h > 150) AS truth, count(*) FILTER (w > 150 AND h > 180) AS found, count(*) FILTER (w > 180 AND h > 180) AS matched
FROM v_det GROUP BY page_id, det_id % 20"""


def _samples(f: Fixtures) -> DataFrame:
    count = lambda a, b: F.count_if((F.col("w") > a) & (F.col("h") > b))
    return f.v_det.groupBy("page_id", (F.col("det_id") % 20).alias("part")).agg(count(180, 150).alias("truth"), count(150, 180).alias("found"), count(180, 180).alias("matched"))


@R.add(f"""
SELECT page_id, part, p AS precision, r AS recall, CASE WHEN p + r = 0 THEN 0 ELSE 2.0::DOUBLE * p * r / (p + r) END AS hmean FROM (
  SELECT *, CASE WHEN truth = 0 THEN 1.0::DOUBLE ELSE CAST(matched AS DOUBLE) / truth END AS r,
         CASE WHEN truth = 0 THEN CASE WHEN found > 0 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END WHEN found = 0 THEN 0.0::DOUBLE ELSE CAST(matched AS DOUBLE) / found END AS p FROM ({_SAMPLES}))""")
def prf_sample(f):
    return _samples(f).select("page_id", "part", *[c.alias(n) for n, c in evaluate.precision_recall(F.col("truth"), F.col("found"), F.col("matched")).items()])


@R.add(f"""
SELECT p AS precision, r AS recall, 2 * p * r / (p + r) AS hmean FROM (SELECT CAST(sum(matched) AS DOUBLE) / sum(found) AS p, CAST(sum(matched) AS DOUBLE) / sum(truth) AS r FROM ({_SAMPLES}))""")
def prf_micro(f):
    return evaluate.micro_average(_samples(f))


@R.add("SELECT page_id, round(sum(w * h) / sum(h), 6) AS mean FROM v_det GROUP BY page_id")
def weighted_mean(f):
    return f.v_det.groupBy("page_id").agg(F.round(evaluate.weighted_mean(F.col("w"), F.col("h")), 6).alias("mean"))


@R.add("""
SELECT page_id, round(coalesce(sum(hit / n) FILTER (ok), 0) / max(t), 9) AS average_precision FROM (
  SELECT page_id, ok, t, CAST(row_number() OVER (PARTITION BY page_id ORDER BY obj DESC, det_id) AS DOUBLE) AS n, CAST(sum(CASE WHEN ok THEN 1 ELSE 0 END) OVER (PARTITION BY page_id ORDER BY obj DESC, det_id ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS hit
  FROM (SELECT page_id, det_id, obj, det_id % 3 = 0 AS ok, count(*) OVER (PARTITION BY page_id) AS t FROM v_det)) GROUP BY page_id""")
def average_precision(f):
    rows = f.v_det.select("page_id", "det_id", "obj", (F.col("det_id") % 3 == 0).alias("ok"), F.count("*").over(Window.partitionBy("page_id")).alias("t"))
    return evaluate.average_precision(rows, "page_id", "obj", "ok", "det_id", "t").withColumn("average_precision", F.round("average_precision", 9))


# layout

_BLOCK = f"v_block AS (SELECT page_id, det_id AS block_id, CASE WHEN label = 1 THEN 'ja' ELSE 'eng' END AS language, x1, y1, x2, y2 FROM ({_CANDIDATES}) WHERE det_id % 5 = 0)"
_ASSIGNED = f"""
WITH {_BLOCK},
v_bb AS (SELECT *, CAST(least(px1, px2, px3, px4) AS DOUBLE) AS a, CAST(least(py1, py2, py3, py4) AS DOUBLE) AS b, CAST(greatest(px1, px2, px3, px4) AS DOUBLE) AS c, CAST(greatest(py1, py2, py3, py4) AS DOUBLE) AS d FROM v_line),
v_score AS (SELECT l.page_id, line_id, block_id, CASE WHEN least(c, x2) < greatest(a, x1) OR least(d, y2) < greatest(b, y1) THEN -1 ELSE (least(c, x2) - greatest(a, x1)) * (least(d, y2) - greatest(b, y1)) END / nullif((c - a) * (d - b), 0) AS share
            FROM v_bb l JOIN v_block k ON l.page_id = k.page_id),
v_best AS (SELECT page_id, line_id, block_id, share FROM (SELECT *, row_number() OVER (PARTITION BY page_id, line_id ORDER BY share DESC, block_id) AS n FROM v_score WHERE share > 0.4) WHERE n = 1),
v_assigned AS (SELECT l.*, block_id, share FROM v_line l LEFT JOIN v_best s ON l.page_id = s.page_id AND l.line_id = s.line_id)"""


def _blocks(f: Fixtures) -> DataFrame:
    return _candidates(f).where("det_id % 5 = 0").select("page_id", F.col("det_id").alias("block_id"), F.when(F.col("label") == 1, "ja").otherwise("eng").alias("language"), "x1", "y1", "x2", "y2")


def _assigned(f: Fixtures) -> DataFrame:
    return layout.assign_lines(f.v_line, _blocks(f))


@R.add(f"{_ASSIGNED} SELECT page_id, line_id, block_id, share FROM v_assigned")
def assign_lines(f):
    return _assigned(f).select("page_id", "line_id", "block_id", "share")


_VECTORS = """
       (px4 + px3) / 2.0::DOUBLE - (px2 + px1) / 2.0::DOUBLE AS vx, (py4 + py3) / 2.0::DOUBLE - (py2 + py1) / 2.0::DOUBLE AS vy,
       (px3 + px2) / 2.0::DOUBLE - (px1 + px4) / 2.0::DOUBLE AS hx, (py3 + py2) / 2.0::DOUBLE - (py1 + py4) / 2.0::DOUBLE AS hy"""
_ORIENTED = f"""{_ASSIGNED},
v_sum AS (SELECT a.page_id, a.block_id, language, count(*) AS n_lines, sum(vx) AS vx, sum(vy) AS vy, sum(hx) AS hx, sum(hy) AS hy
          FROM (SELECT page_id, block_id, {_VECTORS} FROM v_assigned WHERE block_id IS NOT NULL) a JOIN v_block b ON a.page_id = b.page_id AND a.block_id = b.block_id GROUP BY ALL),
v_dir AS (SELECT *, CASE WHEN language = 'ja' THEN nv > nh ELSE nv > nh * 2 END AS vertical FROM (SELECT *, sqrt(vx * vx + vy * vy) AS nv, sqrt(hx * hx + hy * hy) AS nh FROM v_sum)),
v_ori AS (SELECT page_id, block_id, language, n_lines, vertical, CAST(round_even(CASE WHEN vertical THEN nh ELSE nv END / n_lines, 0) AS INTEGER) AS font_size,
                 CASE WHEN vertical THEN vx ELSE hx END AS vec_x, CASE WHEN vertical THEN vy ELSE hy END AS vec_y, CASE WHEN vertical THEN nv ELSE nh END AS norm FROM v_dir),
v_orient AS (SELECT * EXCLUDE (t), CASE WHEN abs(t) < 3 THEN 0 ELSE t END AS angle FROM (SELECT *, CAST(trunc(atan2(vec_y, vec_x) / pi() * 180) AS INTEGER) - CASE WHEN vertical THEN 90 ELSE 0 END AS t FROM v_ori))"""


def _oriented(f: Fixtures) -> tuple[DataFrame, DataFrame]:
    """Lines of blocks with their language, and the blocks' orientation."""
    lines = _assigned(f).where("block_id is not null").join(_blocks(f).select("page_id", "block_id", "language"), ["page_id", "block_id"])
    return lines, layout.orientation(lines, ["page_id", "block_id"], F.col("language"))


@R.add(f"{_ORIENTED} SELECT page_id, block_id, n_lines, vertical, font_size, angle, round(norm, 6) AS norm FROM v_orient")
def block_orientation(f):
    return _oriented(f)[1].select("page_id", "block_id", "n_lines", "vertical", "font_size", "angle", F.round("norm", 6).alias("norm"))


@R.add(f"""{_ORIENTED},
v_far AS (SELECT a.page_id, a.block_id, line_id, vec_x, vec_y, norm, (px1 + px3) / 2.0::DOUBLE - CASE WHEN vertical THEN width ELSE 0 END AS dx, (py1 + py3) / 2.0::DOUBLE AS dy
          FROM v_assigned a JOIN v_orient o ON a.page_id = o.page_id AND a.block_id = o.block_id JOIN v_page p ON a.page_id = p.page_id),
v_dist AS (SELECT page_id, block_id, line_id, round(abs(sin(acos((dx * vec_x + dy * vec_y) / (sqrt(dx * dx + dy * dy) * norm))) * sqrt(dx * dx + dy * dy)), 6) AS distance FROM v_far)
SELECT *, CAST(row_number() OVER (PARTITION BY page_id, block_id ORDER BY distance, line_id) - 1 AS INTEGER) AS place FROM v_dist""")
def line_order(f):
    lines, blocks = _oriented(f)
    held = lines.join(blocks, ["page_id", "block_id"]).join(f.v_page, "page_id")
    far = F.round(layout.line_distance(F.col("vertical"), F.col("width"), F.col("vec_x"), F.col("vec_y"), F.col("norm")), 6)
    place = F.row_number().over(Window.partitionBy("page_id", "block_id").orderBy("distance", "line_id")) - 1
    return held.select("page_id", "block_id", "line_id", far.alias("distance")).withColumn("place", place)


@R.add(f"""{_ASSIGNED}
SELECT a.page_id, a.block_id, least(min(least(px1, px2, px3, px4)), any_value(x1)) AS x1, least(min(least(py1, py2, py3, py4)), any_value(y1)) AS y1,
       greatest(max(greatest(px1, px2, px3, px4)), any_value(x2)) AS x2, greatest(max(greatest(py1, py2, py3, py4)), any_value(y2)) AS y2
FROM v_assigned a JOIN v_block b ON a.page_id = b.page_id AND a.block_id = b.block_id GROUP BY a.page_id, a.block_id""")
def block_bbox(f):
    return layout.bounding_box(_assigned(f).where("block_id is not null"), ["page_id", "block_id"], _blocks(f))


@R.add(f"""
WITH {_BLOCK},
v_c AS (SELECT b.*, width, height, width > height AS wide, CASE WHEN width > height THEN width / 2.0::DOUBLE ELSE CAST(width AS DOUBLE) END AS w, (x1 + x2) / 2.0::DOUBLE AS cx0, (y1 + y2) / 2.0::DOUBLE AS cy,
               count(*) FILTER (language = 'ja') OVER (PARTITION BY b.page_id) > count(*) OVER (PARTITION BY b.page_id) / 2 AS flip FROM v_block b JOIN v_page p ON b.page_id = p.page_id),
v_g AS (SELECT *, trunc(cx / w * 3) AS gx, trunc(cy / height * 4) AS gy, height * w AS area FROM (SELECT *, CASE WHEN flip THEN CASE WHEN wide THEN width ELSE w END - cx0 ELSE cx0 END AS cx FROM v_c)),
v_w AS (SELECT page_id, block_id, (gy * 3 + gx) * area + (1.2::DOUBLE * (cx - gx * w / 3) + (cy - gy * CAST(height AS DOUBLE) / 4)) + CASE WHEN wide AND gx >= 3 THEN area * 4 * 3 ELSE 0 END AS weight FROM v_g)
SELECT page_id, block_id, round(weight, 6) AS weight, CAST(row_number() OVER (PARTITION BY page_id ORDER BY round(weight, 6), block_id) - 1 AS INTEGER) AS place FROM v_w""")
def reading_order(f):
    return layout.reading_order(_blocks(f).join(f.v_page, "page_id")).select("page_id", "block_id", F.round("weight", 6).alias("weight"), "place")


@R.add(f"""{_ORIENTED},
v_pad AS (SELECT a.*, font_size, greatest(CAST(trunc(font_size * 0.1::DOUBLE) AS INTEGER), 2) AS grow, sin(radians(angle)) AS s, cos(radians(angle)) AS c, width, height
          FROM v_assigned a JOIN v_orient o ON a.page_id = o.page_id AND a.block_id = o.block_id JOIN v_page p ON a.page_id = p.page_id WHERE language = 'eng' AND NOT vertical)
SELECT page_id, line_id, {', '.join(f"CAST(trunc(greatest(0, least(width - 1, px{k} + {sx} * s * grow))) AS BIGINT) AS px{k}, CAST(trunc(greatest(0, least(height - 1, py{k} + {sy} * c * grow))) AS BIGINT) AS py{k}" for k, (sx, sy) in enumerate(((-1, -1), (1, -1), (1, 1), (-1, 1)), 1))}, CAST(font_size + grow AS INTEGER) AS font_size FROM v_pad""")
def pad_eng(f):
    lines, blocks = _oriented(f)
    held = lines.where("language = 'eng'").join(blocks.where("not vertical"), ["page_id", "block_id"]).join(f.v_page, "page_id")
    return held.select("page_id", "line_id", *[c.alias(n) for n, c in layout.padded(F.col("font_size"), F.col("angle"), F.col("width"), F.col("height")).items()])


@R.add(f"""
SELECT page_id, line_id, {', '.join(f"round((py{k} - py1) * s + (px{k} - px1) * c + px1, 6) AS x{k}, round((py{k} - py1) * c - (px{k} - px1) * s + py1, 6) AS y{k}" for k in range(1, 5))}
FROM (SELECT *, sin(radians(line_id % 7 * 15)) AS s, cos(radians(line_id % 7 * 15)) AS c FROM v_line)""")
def rotate_poly(f):
    turned = g.rotated(g.quad(), (F.col("px1"), F.col("py1")), F.col("line_id") % 7 * 15, whole=False)
    return f.v_line.select("page_id", "line_id", *[F.round(c, 6).alias(f"{a}{k}") for k, p in enumerate(turned, 1) for a, c in zip("xy", p, strict=True)])


@R.add("""
SELECT page_id, det_id, (x1 + x2) / 2 AS cx, (y1 + y2) / 2 AS cy, x1 AS x, y1 AS y, x2 - x1 AS w, y2 - y1 AS h, round((y2 - y1) / (x2 - x1), 9) AS aspect FROM v_det""")
def block_measures(f):
    found = g.measures(g.box())
    return f.v_det.select("page_id", "det_id", *[(F.round(c, 9) if n == "aspect" else c).alias(n) for n, c in found.items()])


@R.add(f"""{_ASSIGNED}
SELECT page_id, block_id, CASE WHEN count(*) > 1 AND NOT (4 * (count(*) * sum(px1 * px1) - sum(px1) * sum(px1)) < count(*) * sum((px1 + px2) * (px1 + px2)) - sum(px1 + px2) * sum(px1 + px2)) THEN 1 ELSE 0 END AS alignment
FROM v_assigned WHERE block_id IS NOT NULL GROUP BY page_id, block_id""")
def alignment(f):
    return layout.alignment(_assigned(f).where("block_id is not null"), ["page_id", "block_id"])


@R.add("""
SELECT page_id, det_id, CASE WHEN abs(CAST(cx AS BIGINT) % 256 - CAST(cy AS BIGINT) % 256) + abs(CAST(w AS BIGINT) % 256 - CAST(h AS BIGINT) % 256) > 40 THEN 0.2::DOUBLE ELSE 0.0::DOUBLE END AS stroke FROM v_det""")
def stroke_width(f):
    level = lambda c: F.col(c).cast("long") % 256
    return f.v_det.select("page_id", "det_id", g.stroke_width([level("cx"), level("w")], [level("cy"), level("h")]).alias("stroke"))


# polygons


@R.add("""
SELECT page_id, det_id, CAST(trunc((cx2 - w2 / 2) * width) AS BIGINT) AS x1, CAST(trunc((cy2 - h2 / 2) * height) AS BIGINT) AS y1, round(cx2, 9) AS cx, round(cy2, 9) AS cy, round(w2, 9) AS w, round(h2, 9) AS h
FROM (SELECT page_id, det_id, width, height, ax + (bx - ax) / 2 AS cx2, ay + (b_y - ay) / 2 AS cy2, bx - ax AS w2, b_y - ay AS h2
      FROM (SELECT d.page_id, det_id, width, height, x1 / width AS ax, y1 / height AS ay, x2 / width AS bx, y2 / height AS b_y FROM v_det d JOIN v_page p ON d.page_id = p.page_id))""")
def yolo_roundtrip(f):
    unit = g.to_unit(g.box(), F.col("width"), F.col("height"))
    held = f.v_det.join(f.v_page, "page_id").select("page_id", "det_id", "width", "height", *[c.alias(n) for n, c in unit.items()])
    back = [g.from_unit(F.col(c), F.col(s), F.col(size)).alias(n) for n, c, s, size in (("x1", "cx", "w", "width"), ("y1", "cy", "h", "height"))]
    return held.select("page_id", "det_id", *back, *[F.round(c, 9).alias(c) for c in ("cx", "cy", "w", "h")])


@R.add("SELECT p_partkey, (v >> 16) AS b, ((v & 65024) >> 8) AS g, v & 254 AS r FROM (SELECT p_partkey, (p_partkey * 7919) % 16777216 AS v FROM part)")
def hex2bgr(f):
    return f.part.select("p_partkey", *[c.alias(n) for n, c in g.hex_to_bgr((F.col("p_partkey") * 7919) % 16777216).items()])


_SHOELACE = "((px1 * py2 - px2 * py1) + (px2 * py3 - px3 * py2) + (px3 * py4 - px4 * py3) + (px4 * py1 - px1 * py4)) / 2.0::DOUBLE"


@R.add(f"SELECT page_id, line_id, {_SHOELACE} AS area FROM v_line")
def poly_area(f):
    return f.v_line.select("page_id", "line_id", g.shoelace(g.quad()).alias("area"))


@R.add(f"""
SELECT page_id, line_id, abs({_SHOELACE}) < 1 OR ignored AS ignored, {', '.join(f"CASE WHEN abs({_SHOELACE}) > 0 THEN p{a}{5 - k} ELSE p{a}{k} END AS p{a}{k}" for k in range(1, 5) for a in "xy")}
FROM (SELECT l.page_id, line_id, line_id % 7 = 0 AS ignored, {', '.join(f"greatest(0, least({c}, {s} - 1)) AS {c}" for k in range(1, 5) for c, s in ((f"px{k}", "width"), (f"py{k}", "height")))}
      FROM v_line l JOIN v_page p ON l.page_id = p.page_id)""")
def validate_poly(f):
    return polygons.validated_frame(f.v_line.withColumn("ignored", F.col("line_id") % 7 == 0), f.v_page)


@R.add(f"""
SELECT page_id, line_id, {', '.join(f"round({e}, 6) AS {n}" for n, e in (("x1", "least(px1, px2, px3, px4) - d"), ("y1", "least(py1, py2, py3, py4) - d"), ("x2", "greatest(px1, px2, px3, px4) + d"), ("y2", "greatest(py1, py2, py3, py4) + d")))}
FROM (SELECT *, abs({_SHOELACE}) * 1.5::DOUBLE / ({' + '.join(f"sqrt((px{j} - px{k}) * (px{j} - px{k}) + (py{j} - py{k}) * (py{j} - py{k}))" for k, j in ((1, 2), (2, 3), (3, 4), (4, 1)))}) AS d FROM v_line)""")
def unclip_rect(f):
    return f.v_line.select("page_id", "line_id", *[F.round(c, 6).alias(n) for n, c in polygons.unclipped(g.quad()).items()])


@R.add(None)
def rot_iou(f):
    a = f.v_line.select("page_id", "line_id", *[F.col(f"p{c}{k}").alias(f"a{c}{k}") for k in range(1, 5) for c in "xy"])
    b = f.v_line.select("page_id", (F.col("line_id") - 2).alias("line_id"), *[F.col(f"p{c}{k}").alias(f"b{c}{k}") for k in range(1, 5) for c in "xy"])
    return polygons.rotated_overlaps(a.join(b, ["page_id", "line_id"]), ["page_id", "line_id"])


@R.add(f"""
SELECT page_id, line_id, CAST(CASE WHEN v THEN 64 ELSE round_even(64 / (nv / nh), 0) END AS INTEGER) AS w, CAST(CASE WHEN v THEN round_even(64 * (nv / nh), 0) ELSE 64 END AS INTEGER) AS h
FROM (SELECT *, nv > nh AS v FROM (SELECT page_id, line_id, sqrt(vx * vx + vy * vy) AS nv, sqrt(hx * hx + hy * hy) AS nh FROM (SELECT page_id, line_id, {_VECTORS} FROM v_line)))""")
def crop_size(f):
    return f.v_line.select("page_id", "line_id", *[c.alias(n) for n, c in g.crop_size(g.quad()).items()])


@R.add("""SELECT page_id, line_id, least(px1, px2, px3, px4) AS x1, least(py1, py2, py3, py4) AS y1, greatest(px1, px2, px3, px4) AS x3, greatest(py1, py2, py3, py4) AS y3 FROM v_line""")
def min_rect(f):
    q = g.min_rect(g.quad())
    return f.v_line.select("page_id", "line_id", q[0][0].alias("x1"), q[0][1].alias("y1"), q[2][0].alias("x3"), q[2][1].alias("y3"))


@R.add("""
SELECT page_id, id, c AS common, CASE WHEN s = greatest(c, 0) THEN NULL ELSE greatest(c, 0) / (s - greatest(c, 0)) END AS iou FROM (
  SELECT d.page_id, det_id AS id, CASE WHEN least(d.x2, p.x2) < greatest(d.x1, p.x1) OR least(d.y2, p.y2) < greatest(d.y1, p.y1) THEN -1.0::DOUBLE
         ELSE (least(d.x2, p.x2) - greatest(d.x1, p.x1)) * (least(d.y2, p.y2) - greatest(d.y1, p.y1)) END AS c,
         (d.x2 - d.x1) * (d.y2 - d.y1) + (p.x2 - p.x1) * (p.y2 - p.y1) AS s
  FROM v_det d JOIN v_pred p ON d.page_id = p.page_id AND d.det_id = p.pred_id)""")
def sql_functions(f):
    """Functions registered in the session, called from SQL."""
    sql.register(f.v_det.sparkSession)
    held = f.v_det.alias("d").join(f.v_pred.alias("p"), F.expr("d.page_id = p.page_id AND d.det_id = p.pred_id"))
    corners = ", ".join(f"{t}.{c}" for t in "dp" for c in ("x1", "y1", "x2", "y2"))
    return held.select("d.page_id", F.col("det_id").alias("id"), F.expr(f"page_box_common({corners})").alias("common"), F.expr(f"page_box_iou({corners})").alias("iou"))


# order-dependent layout: held against an independent loop in the tests


@R.add(None)
def split_blocks(f):
    lines, _ = _oriented(f)
    return layout.split_blocks(lines, f.v_page)


@R.add(None)
def merge_lines(f):
    return layout.merge_lines(_assigned(f).where("block_id is null"), f.v_page)


@R.add(None)
def page_layout(f):
    return layout.layout(_blocks(f), f.v_line, f.v_page)
