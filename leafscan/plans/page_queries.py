"""Text, score, mask, catalog and record queries over the fixtures, each with the SQL that DuckDB runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import arrays as a
from ..functions import text as t
from ..operators import catalog, decode, evaluate, mask, protocol
from ..sources import files
from .fixtures import Fixtures
from .registry import Registry

R = Registry()

# text

_STRIP = r"regexp_replace(raw_text, '[\s\p{Z}\x0b\x1c-\x1f\x{85}]', '', 'g')"


def _dots(text: str) -> str:
    """A dot beside another dot is a full stop: a character-wise transform, as RE2 has no lookaround."""
    return f"""array_to_string(list_transform(string_split({text}, ''), lambda c, i: CASE WHEN c = '・' AND ((i > 1 AND string_split({text}, '')[i - 1] IN ('・', '.')) OR string_split({text}, '')[i + 1] IN ('・', '.')) THEN '.' ELSE c END), '')"""


def _wide(text: str) -> str:
    half, full, _ = t._wide()
    return f"translate({text}, '{half[:94].replace(chr(39), chr(39) * 2)}', '{full[:94]}')"


@R.add(f"SELECT doc_id, {_STRIP} AS text FROM v_text")
def strip_ws(f):
    return f.v_text.select("doc_id", t.strip_white(F.col("raw_text")).alias("text"))


@R.add(f"""SELECT doc_id, array_to_string(list_transform(range(1, len(c) + 1), lambda i: CASE WHEN c[i] = '・' AND ((i > 1 AND c[i - 1] IN ('・', '.')) OR c[i + 1] IN ('・', '.')) THEN '.' ELSE c[i] END), '') AS text
FROM (SELECT doc_id, string_split(raw_text, '') AS c FROM v_text)""")
def dot_runs(f):
    return f.v_text.select("doc_id", t.dot_runs(F.col("raw_text")).alias("text"))


@R.add(f"SELECT doc_id, {_wide('raw_text')} AS text FROM v_text")
def h2z(f):
    return f.v_text.select("doc_id", t.half_to_full(F.col("raw_text")).alias("text"))


_NORMAL = f"""SELECT doc_id, {_wide("array_to_string(list_transform(range(1, len(c) + 1), lambda i: CASE WHEN c[i] = '・' AND ((i > 1 AND c[i - 1] IN ('・', '.')) OR c[i + 1] IN ('・', '.')) THEN '.' ELSE c[i] END), '')")} AS text
FROM (SELECT doc_id, string_split(replace({_STRIP}, '…', '...'), '') AS c FROM v_text)"""


@R.add(_NORMAL)
def normalise_text(f):
    return f.v_text.select("doc_id", t.normalised(F.col("raw_text")).alias("text"))


_VOCABULARY = "SELECT p_partkey - 1 AS id, CASE WHEN p_partkey % 10 = 1 THEN '[SEP]' ELSE substr(p_type, 1, 2) END AS token FROM part WHERE p_partkey <= 60"


@R.add(f"""SELECT crop_id, coalesce(string_agg(token, '' ORDER BY seq) FILTER (token IS NOT NULL AND NOT starts_with(token, '[')), '') AS text
FROM v_token t LEFT JOIN ({_VOCABULARY}) v ON t.token_id = v.id GROUP BY crop_id""")
def detokenise(f):
    vocabulary = f.part.where("p_partkey <= 60").select((F.col("p_partkey") - 1).alias("token_id"), F.when(F.col("p_partkey") % 10 == 1, "[SEP]").otherwise(F.substring("p_type", 1, 2)).alias("token"))
    held = f.v_token.join(vocabulary, "token_id", "left").groupBy("crop_id").agg(F.array_sort(F.collect_list(F.struct("seq", "token"))).alias("t"))
    return held.select("crop_id", t.detokenised(F.transform("t", lambda x: x["token"])).alias("text"))


@R.add("SELECT conv_id, md5(string_agg(text, '' ORDER BY turn)) AS digest FROM conversations GROUP BY conv_id")
def join_pieces(f):
    return f.conversations.groupBy("conv_id").agg(F.md5(t.joined_in_order(F.col("turn"), F.col("text")).cast("binary")).alias("digest"))


@R.add("""SELECT page_id, string_agg(concat_ws(' ', det_id % 2, CAST(cx AS BIGINT), CAST(cy AS BIGINT), CAST(w AS BIGINT), CAST(h AS BIGINT)), chr(10) ORDER BY det_id) AS labels FROM v_det GROUP BY page_id""")
def yolo_labels(f):
    line = t.label_line(F.col("det_id") % 2, *map(F.col, ("cx", "cy", "w", "h")))
    return f.v_det.groupBy("page_id").agg(t.joined_in_order(F.col("det_id"), line, "\n").alias("labels"))


@R.add("SELECT conv_id, trim(string_agg(text, ' ' ORDER BY turn)) AS text FROM conversations GROUP BY conv_id")
def get_text(f):
    held = f.conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("l"))
    return held.select("conv_id", t.block_text(F.transform("l", lambda x: x["text"])).alias("text"))


_CONFIG = "SELECT s_suppkey, concat(s_name, chr(10), CASE s_suppkey % 4 WHEN 0 THEN concat('import site', chr(10)) WHEN 1 THEN concat('..', chr(92), 'ocr', chr(10), 'import site') WHEN 2 THEN concat('x', chr(10), chr(10)) ELSE 'y' END) AS config FROM supplier"


@R.add(f"""SELECT s_suppkey, CASE WHEN list_contains(list_transform(l, lambda s: trim(s)), v) THEN config ELSE array_to_string(list_concat(list_concat(l[1:p], [v]), l[p + 1:]), concat(chr(13), chr(10))) END AS config
FROM (SELECT *, CASE WHEN list_position(list_transform(l, lambda s: trim(s)), 'import site') > 0 THEN list_position(list_transform(l, lambda s: trim(s)), 'import site') - 1
                     ELSE list_max(list_transform(range(1, len(l) + 1), lambda i: CASE WHEN l[i] <> '' THEN i ELSE 0 END)) END AS p
      FROM (SELECT s_suppkey, config, string_split(config, chr(10)) AS l, concat('..', chr(92), 'ocr') AS v FROM ({_CONFIG})))""")
def insert_line(f):
    k = F.col("s_suppkey") % 4
    end = F.when(k == 0, "import site\n").when(k == 1, "..\\ocr\nimport site").when(k == 2, "x\n\n").otherwise("y")
    return f.supplier.select("s_suppkey", t.with_line(F.concat("s_name", F.lit("\n"), end), "..\\ocr", "import site").alias("config"))


# scores


def _scores(f: Fixtures, column) -> DataFrame:
    return f.embeddings.select("vec_id", F.transform("embedding", column).alias("s"))


_ROWS = "SELECT vec_id, unnest(embedding)::DOUBLE AS e, unnest(range(0, 64)) AS i FROM embeddings"


@R.add(f"SELECT vec_id, string_agg(CAST(i AS VARCHAR), ',' ORDER BY n) AS best FROM (SELECT vec_id, i, row_number() OVER (PARTITION BY vec_id ORDER BY trunc(e * 20) DESC, i DESC) AS n FROM ({_ROWS})) WHERE n <= 5 GROUP BY vec_id")
def topk_tie(f):
    held = _scores(f, lambda e: (e.cast("double") * 20).cast("int"))
    return held.select("vec_id", F.array_join(a.top_k(F.col("s"), 5).cast("array<string>"), ",").alias("best"))


@R.add(f"""SELECT vec_id, CAST(i AS INTEGER) AS i, round(e - m - ln(sum(exp(e - m)) OVER (PARTITION BY vec_id)), 6) AS value FROM (SELECT *, max(e) OVER (PARTITION BY vec_id) AS m FROM ({_ROWS}))""")
def log_softmax(f):
    held = _scores(f, lambda e: e.cast("double"))
    return held.select("vec_id", F.posexplode(a.log_softmax(F.col("s"))).alias("i", "v")).select("vec_id", "i", F.round("v", 6).alias("value"))


@R.add("""
WITH s AS (SELECT crop_id, list(token_id % 3 ORDER BY seq) AS t FROM v_token GROUP BY crop_id)
SELECT crop_id, coalesce(array_to_string(list_sort(list_distinct(list_transform(list_filter(range(1, len(t) - 1), lambda i: t[i] = t[len(t) - 1] AND t[i + 1] = t[len(t)]), lambda i: t[i + 2]))), ','), '') AS banned FROM s""")
def banned_ngrams(f):
    held = f.v_token.groupBy("crop_id").agg(F.array_sort(F.collect_list(F.struct("seq", (F.col("token_id") % 3).alias("t")))).alias("s"))
    tokens = held.select("crop_id", F.transform("s", lambda x: x["t"]).alias("t"))
    return tokens.select("crop_id", F.array_join(a.banned_ngrams(F.col("t")).cast("array<string>"), ",").alias("banned"))


_HEIGHT = 16
_SMOOTH = f"""
k AS (SELECT i AS ki, exp(-pow(i - {(2 * _HEIGHT - 1) / 2}::DOUBLE, 2) / {2 * (_HEIGHT / 8) ** 2}::DOUBLE) AS kw FROM (SELECT unnest(range(0, {2 * _HEIGHT})) AS i)),
d AS (SELECT vec_id, i, e + 0.6::DOUBLE AS v FROM ({_ROWS})),
c AS (SELECT vec_id, i + ki - {(2 * _HEIGHT - 1) // 2} AS pos, sum(v * kw) AS v FROM d CROSS JOIN k GROUP BY vec_id, pos),
sm AS (SELECT vec_id, pos, v / max(v) OVER (PARTITION BY vec_id) AS v FROM c WHERE pos BETWEEN 0 AND 63)"""


def _smooth(f: Fixtures) -> DataFrame:
    held = _scores(f, lambda e: e.cast("double") + 0.6)
    return held.select("vec_id", a.smoothed(F.col("s"), _HEIGHT).alias("s"))


@R.add(f"WITH {_SMOOTH} SELECT vec_id, CAST(pos AS INTEGER) AS i, round(v, 6) AS value FROM sm")
def smooth_density(f):
    return _smooth(f).select("vec_id", F.posexplode("s").alias("i", "v")).select("vec_id", "i", F.round("v", 6).alias("value"))


@R.add("""SELECT page_id, det_id, CASE WHEN w / h > 1.5::DOUBLE THEN CAST(ceil(w / h / 1.5::DOUBLE) AS INTEGER) ELSE 1 END AS n FROM v_det""")
def split_count(f):
    return f.v_det.select("page_id", "det_id", a.split_count(F.col("w"), F.col("h"), 1.5).alias("n"))


@R.add(f"""WITH {_SMOOTH}, l AS (SELECT vec_id, list(v ORDER BY pos) AS s FROM sm GROUP BY vec_id),
n AS (SELECT vec_id, s, k, CAST(trunc(64.0::DOUBLE * k / 3) AS BIGINT) AS a FROM l CROSS JOIN (SELECT unnest([1, 2]) AS k)),
p AS (SELECT vec_id, k, greatest(0, a - 16) AS lo, s[greatest(0, a - 16) + 1 : least(64, a + 16)] AS part FROM n)
SELECT vec_id, string_agg(CAST(lo + list_position(part, list_min(part)) - 1 AS VARCHAR), ',' ORDER BY k) AS cuts FROM p GROUP BY vec_id""")
def split_cuts(f):
    return _smooth(f).select("vec_id", F.array_join(a.split_cuts(F.col("s"), F.lit(3), _HEIGHT).cast("array<string>"), ",").alias("cuts"))


@R.add(None)
def beam_search(f):
    crops = f.embeddings.select(F.col("vec_id").alias("crop_id"), F.transform("embedding", lambda e: e * 8).alias("hidden"))
    return decode.decoded(crops, start=2, end=3).select("crop_id", F.array_join(F.col("tokens").cast("array<string>"), ",").alias("tokens"))


@R.add("SELECT vec_id, i, round((v / 255.0::DOUBLE - 0.5) / 0.5, 12) AS x FROM (SELECT vec_id, unnest(range(0, 192)) AS i, unnest(list_concat(list_concat(l, l), l)) AS v FROM (SELECT vec_id, [(vec_id * 31 + k * 7) % 256 for k in range(0, 64)] AS l FROM embeddings))")
def pixel_input(f):
    levels = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda k: (F.col("vec_id") * 31 + k * 7) % 256)
    return f.embeddings.select("vec_id", F.posexplode(a.pixel_input(levels)).alias("i", "x")).select("vec_id", F.col("i").cast("long").alias("i"), F.round("x", 12).alias("x"))


@R.add(f"SELECT label AS tensor, max(abs(e - round(e, 3))) AS max_abs, max(abs(e - round(e, 3))) <= 0.001 AS ok FROM (SELECT label, unnest(embedding)::DOUBLE AS e FROM embeddings) GROUP BY label")
def parity_maxabs(f):
    held = f.embeddings.select(F.col("label").alias("tensor"), "vec_id", F.posexplode("embedding").alias("i", "e"))
    left = held.select("tensor", F.struct("vec_id", "i").alias("idx"), F.col("e").cast("double").alias("value"))
    return evaluate.max_deviation(left, left.withColumn("value", F.round("value", 3)))


# masks: an embedding as 8 x 8 grid of (e + 0.6) / 1.2

_GRID = "SELECT vec_id, label, (e + 0.6::DOUBLE) / 1.2::DOUBLE AS p, i % 8 AS x, i // 8 AS y FROM (SELECT vec_id, label, unnest(embedding)::DOUBLE AS e, unnest(range(0, 64)) AS i FROM embeddings)"


def _grid(f: Fixtures) -> DataFrame:
    held = f.embeddings.select("vec_id", "label", F.posexplode("embedding").alias("i", "e"))
    p = (F.col("e").cast("double") + 0.6) / 1.2
    return held.select("vec_id", "label", p.alias("p"), (F.col("i") % 8).alias("x"), F.expr("i div 8").cast("int").alias("y"))


_LEVEL = "CAST(floor(p * 255) AS INTEGER)"


def _levels(f: Fixtures) -> DataFrame:
    return _grid(f).withColumn("value", F.floor(F.col("p") * 255).cast("int"))


@R.add(f"SELECT vec_id, CAST(sum(CASE WHEN p > 0.3 THEN 1 ELSE 0 END) AS BIGINT) AS on_cells, CAST(sum(CASE WHEN p > 0.3 THEN x + 8 * y ELSE 0 END) AS BIGINT) AS mark FROM ({_GRID}) GROUP BY vec_id")
def binarise(f):
    on = mask.binarised(F.col("p"))
    return _grid(f).groupBy("vec_id").agg(F.sum(on).cast("long").alias("on_cells"), F.sum(on * (F.col("x") + 8 * F.col("y"))).cast("long").alias("mark"))


@R.add(f"""SELECT b.vec_id, box_id, round(d, 6) AS density FROM (SELECT vec_id, k AS box_id, (vec_id + k) % 5 AS x1, vec_id % 6 AS y1, (vec_id + k) % 5 + k AS x2, vec_id % 6 + 2 AS y2 FROM embeddings CROSS JOIN (SELECT unnest([0, 1, 2]) AS k)) b
LEFT JOIN (SELECT c.vec_id, k, avg(v) / 255 AS d FROM (SELECT vec_id, x, y, CASE WHEN p > 0.6 THEN {_LEVEL} ELSE 0 END AS v FROM ({_GRID})) c JOIN (SELECT unnest([0, 1, 2]) AS k) ON x >= (vec_id + k) % 5 AND x < (vec_id + k) % 5 + k AND y >= vec_id % 6 AND y < vec_id % 6 + 2 GROUP BY c.vec_id, k) s
  ON b.vec_id = s.vec_id AND box_id = s.k WHERE d IS NULL OR d >= 0.1""")
def mask_density(f):
    boxes = f.embeddings.select("vec_id", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("box_id"))
    boxes = boxes.withColumns({"x1": (F.col("vec_id") + F.col("box_id")) % 5, "y1": F.col("vec_id") % 6}).withColumns({"x2": F.col("x1") + F.col("box_id"), "y2": F.col("y1") + 2})
    grid = _levels(f).withColumn("value", F.when(F.col("p") > 0.6, F.col("value")).otherwise(0)).select("vec_id", "x", "y", "value")
    return mask.dense_boxes(boxes, grid, "vec_id").select("vec_id", "box_id", F.round("density", 6).alias("density"))


@R.add(f"""SELECT label, CAST(CASE WHEN hi = lo THEN 127 ELSE least(254, floor((p - lo) / (hi - lo) * 255)) END AS INTEGER) AS bin, count(*) AS count
FROM (SELECT label, p, min(p) OVER (PARTITION BY label) AS lo, max(p) OVER (PARTITION BY label) AS hi FROM ({_GRID})) GROUP BY ALL""")
def histogram255(f):
    return mask.histogram(_grid(f), "label", "p")


@R.add(f"""SELECT label, arg_max(level, {{'b': b, 'l': -level}}) AS threshold FROM (
  SELECT label, level, CASE WHEN w * (n - w) = 0 THEN 0 ELSE (m * n - t * w) * (m * n - t * w) / (w * (n - w)) END AS b FROM (
    SELECT label, level, CAST(sum(c) OVER o AS DOUBLE) AS w, CAST(sum(c * level) OVER o AS DOUBLE) AS m, CAST(sum(c) OVER (PARTITION BY label) AS DOUBLE) AS n, CAST(sum(c * level) OVER (PARTITION BY label) AS DOUBLE) AS t
    FROM (SELECT label, {_LEVEL} AS level, count(*) AS c FROM ({_GRID}) GROUP BY ALL) WINDOW o AS (PARTITION BY label ORDER BY level ROWS UNBOUNDED PRECEDING))) GROUP BY label""")
def otsu(f):
    return mask.otsu(_levels(f), "label", "value")


@R.add(f"""
WITH RECURSIVE h AS (SELECT label, colour, c, row_number() OVER (PARTITION BY label ORDER BY c DESC, colour) AS n, sum(c) OVER (PARTITION BY label) * 0.001::DOUBLE AS least FROM (SELECT label, {_LEVEL} AS colour, count(*) AS c FROM ({_GRID}) GROUP BY ALL)),
s AS (SELECT label, n, [colour] AS chosen, false AS done FROM h WHERE n = 1
  UNION ALL
  SELECT label, n, chosen, done OR len(chosen) >= 3 OR c < least FROM (
    SELECT s.label, h.n, s.done, h.c, h.least, CASE WHEN s.done OR list_min(list_transform(s.chosen, lambda x: abs(x - h.colour))) <= 10 THEN s.chosen ELSE list_append(s.chosen, h.colour) END AS chosen
    FROM s JOIN h ON s.label = h.label AND h.n = s.n + 1))
SELECT label, array_to_string(arg_max(chosen, n), ',') AS colours FROM s GROUP BY label""")
def topk_color(f):
    counts = _levels(f).groupBy("label", F.col("value").alias("colour")).count()
    return mask.top_colours(counts, "label").select("label", F.array_join(F.col("colours").cast("array<string>"), ",").alias("colours"))


@R.add(f"""SELECT vec_id, CAST(least(own, other) AS BIGINT) AS cost, other < own AS negative FROM (
  SELECT vec_id, sum(xor(image, m)) AS own, sum(xor(255 - image, m)) AS other FROM (SELECT vec_id, CASE WHEN p > 0.5 THEN 255 ELSE 0 END AS image, {_LEVEL} AS m FROM ({_GRID})) GROUP BY vec_id)""")
def min_xor(f):
    held = _levels(f).withColumn("image", F.when(F.col("p") > 0.5, 255).otherwise(0))
    return mask.least_xor(held, "vec_id", "image", "value")


@R.add(f"""SELECT vec_id, CAST(sum(CASE WHEN v BETWEEN t - 60 AND t THEN 1 ELSE 0 END) AS BIGINT) AS inside FROM (SELECT vec_id, {_LEVEL} AS v, least(vec_id % 256 + 30, 255) AS t FROM ({_GRID})) GROUP BY vec_id""")
def colour_band(f):
    band = mask.colour_band(F.col("value"), (F.col("vec_id") % 256).cast("int"))
    return _levels(f).groupBy("vec_id").agg(F.sum(F.when(band == 255, 1).otherwise(0)).cast("long").alias("inside"))


@R.add(f"""WITH v AS (SELECT vec_id, x, y, {_LEVEL} AS v FROM ({_GRID}))
SELECT a.vec_id, CAST(a.x AS INTEGER) AS x, CAST(a.y AS INTEGER) AS y, max(b.v) AS dilated, min(b.v) AS eroded FROM v a JOIN v b ON a.vec_id = b.vec_id AND abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1 GROUP BY a.vec_id, a.x, a.y""")
def morphology(f):
    grid = _levels(f).select("vec_id", "x", "y", "value")
    grown = mask.morphology(grid, "vec_id", 8, 8, True).withColumnRenamed("value", "dilated")
    return grown.join(mask.morphology(grid, "vec_id", 8, 8, False).withColumnRenamed("value", "eroded"), ["vec_id", "x", "y"])


_PARTS = f"""
WITH RECURSIVE v AS (SELECT vec_id, x, y, x + 8 * y AS i FROM ({_GRID}) WHERE p > 0.55),
n AS (SELECT a.vec_id, a.i, b.i AS j FROM v a JOIN v b ON a.vec_id = b.vec_id AND abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1),
r AS (SELECT vec_id, i, j FROM n UNION SELECT r.vec_id, r.i, n.j FROM r JOIN n ON r.vec_id = n.vec_id AND r.j = n.i),
part AS (SELECT vec_id, i, min(j) AS root FROM r GROUP BY vec_id, i),
box AS (SELECT vec_id, root, CAST(min(i % 8) AS INTEGER) AS x, CAST(min(i // 8) AS INTEGER) AS y, CAST(max(i % 8) - min(i % 8) + 1 AS INTEGER) AS w, CAST(max(i // 8) - min(i // 8) + 1 AS INTEGER) AS h, CAST(count(*) AS INTEGER) AS area FROM part GROUP BY vec_id, root)"""


def _parts(f: Fixtures) -> DataFrame:
    held = f.embeddings.select("vec_id", F.transform("embedding", lambda e: F.when((e.cast("double") + 0.6) / 1.2 > 0.55, 255).otherwise(0)).alias("m"))
    return mask.components(held, "vec_id", "m", 8)


@R.add(f"{_PARTS} SELECT vec_id, CAST(row_number() OVER (PARTITION BY vec_id ORDER BY root) AS INTEGER) AS part, x, y, w, h, area FROM box")
def conn_comp(f):
    return _parts(f)


@R.add(f"""{_PARTS}
SELECT c.vec_id, part, x1, y1, x2, y2 FROM (SELECT vec_id, CAST(row_number() OVER (PARTITION BY vec_id ORDER BY root) AS INTEGER) AS part, area, x AS x1, y AS y1, x + w AS x2, y + h AS y2 FROM box) c
LEFT JOIN (SELECT vec_id, k, (vec_id + k) % 5 AS bx1, vec_id % 6 AS by1, (vec_id + k) % 5 + 4 AS bx2, vec_id % 6 + 4 AS by2 FROM embeddings CROSS JOIN (SELECT unnest([0, 1]) AS k) WHERE vec_id % 3 > 0) b ON c.vec_id = b.vec_id
WHERE area > 2 GROUP BY ALL HAVING coalesce(max(CASE WHEN bx1 IS NULL THEN -1 WHEN least(x2, bx2) < greatest(x1, bx1) OR least(y2, by2) < greatest(y1, by1) THEN -1 ELSE (least(x2, bx2) - greatest(x1, bx1)) * (least(y2, by2) - greatest(y1, by1)) END), -1) / (x2 - x1) / (y2 - y1) < 0.5""")
def undetected_components(f):
    parts = _parts(f).where("area > 2").select("vec_id", "part", F.col("x").alias("x1"), F.col("y").alias("y1"), (F.col("x") + F.col("w")).alias("x2"), (F.col("y") + F.col("h")).alias("y2"))
    blocks = f.embeddings.where("vec_id % 3 > 0").select("vec_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("k"))
    blocks = blocks.select("vec_id", ((F.col("vec_id") + F.col("k")) % 5).alias("x1"), (F.col("vec_id") % 6).alias("y1"), ((F.col("vec_id") + F.col("k")) % 5 + 4).alias("x2"), (F.col("vec_id") % 6 + 4).alias("y2"))
    return mask.undetected(parts, blocks, "vec_id")


@R.add(None)
def mask_merge(f):
    level = lambda e: F.floor((e.cast("double") + 0.6) / 1.2 * 255).cast("int")
    grids = f.embeddings.select("vec_id", F.transform("embedding", lambda e: F.when(level(e) > 128, 255).otherwise(0)).alias("image"), F.transform("embedding", level).alias("predicted"))
    return mask.merged_masks(grids, "vec_id", 8).select("vec_id", F.array_join(F.col("mask").cast("array<string>"), ",").alias("mask"))


@R.add(f"""SELECT vec_id, round(avg(p), 6) AS score FROM ({_GRID}) WHERE x >= 1 AND y >= 1 AND x <= 2 + vec_id % 5 AND y <= 2 + vec_id % 4 GROUP BY vec_id""")
def poly_score(f):
    right, low = F.lit(2) + F.col("vec_id") % 5, F.lit(2) + F.col("vec_id") % 4
    one = F.lit(1)
    boxes = f.embeddings.select("vec_id", one.alias("px1"), one.alias("py1"), right.alias("px2"), one.alias("py2"), right.alias("px3"), low.alias("py3"), one.alias("px4"), low.alias("py4"))
    return mask.polygon_score(boxes, _grid(f).select("vec_id", "x", "y", F.col("p").alias("value")), "vec_id").select("vec_id", F.round("score", 6).alias("score"))


@R.add(f"SELECT vec_id, x, CAST(sum(CASE WHEN p > 0.3 THEN 1 ELSE 0 END) AS BIGINT) AS density FROM ({_GRID}) GROUP BY vec_id, x")
def column_density(f):
    return mask.column_density(_grid(f).withColumn("value", mask.binarised(F.col("p"))), "vec_id").select("vec_id", F.col("x").cast("long").alias("x"), F.col("density").cast("long").alias("density"))


# catalogs and records


@R.add("SELECT lower(lib) AS lib, string_agg(DISTINCT file, ',' ORDER BY file) AS files, count(DISTINCT file) AS users FROM v_import GROUP BY lower(lib)")
def library_users(f):
    return catalog.library_users(f.v_import).select("lib", F.array_join("files", ",").alias("files"), "users")


@R.add("SELECT lang, source, count(*) AS files, CAST(coalesce(sum(strlen(text)), 0) AS BIGINT) AS bytes FROM documents GROUP BY lang, source")
def bytes_total(f):
    return catalog.total_bytes(f.documents.withColumn("bytes", F.octet_length("text")), "lang", "source")


@R.add("""WITH k AS (SELECT list(x ORDER BY i) AS tab FROM (SELECT i, list_reduce(range(0, 8), lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, i) AS x FROM (SELECT unnest(range(0, 256)) AS i)))
SELECT p_partkey, CAST(xor(list_reduce([ord(c) for c in string_split(p_name, '')], lambda a, b: xor(a >> 8, tab[(xor(a, b) & 255) + 1]), 4294967295), 4294967295) AS BIGINT) AS crc32 FROM part, k""")
def file_crc32(f):
    return catalog.checksums(f.part, "p_partkey", "p_name")


@R.add("SELECT p_partkey, name FROM (SELECT p_partkey, p_name AS name FROM part WHERE p_partkey % 3 = 0) WHERE replace(lower(name), '-', '_') NOT IN (SELECT replace(lower(p_name), '-', '_') FROM part WHERE p_partkey % 2 = 0)")
def package_guard(f):
    named = f.part.select("p_partkey", F.col("p_name").alias("name"))
    return catalog.missing_packages(named.where("p_partkey % 3 = 0"), named.where("p_partkey % 2 = 0").select("name"))


@R.add("""SELECT s_suppkey AS id, '{' || chr(10) || '  "id" : ' || s_suppkey || ',' || chr(10) || '  "name" : "' || s_name || '",' || chr(10) || '  "sha256" : "' || sha256(s_name) || '"' || CASE WHEN s_suppkey % 2 = 0 THEN ',' || chr(10) || '  "bytes" : ' || strlen(s_name) ELSE '' END || chr(10) || '}' AS entry FROM supplier""")
def catalog_entry(f):
    size = F.when(F.col("s_suppkey") % 2 == 0, F.octet_length("s_name"))
    return catalog.entry_json(f.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.sha2(F.col("s_name").cast("binary"), 256).alias("sha256"), size.alias("bytes")))


@R.add("""SELECT s, row_number() OVER (PARTITION BY s ORDER BY page_id) - 1 AS seq, CAST(page_id AS VARCHAR) || '.png' AS rel, '/in/' || CAST(page_id AS VARCHAR) || '.png' AS abs_path, width, height FROM (SELECT *, page_id % 8 AS s FROM v_page)""")
def manifest_pages(f):
    """Eight manifests, four of either root shape, written and parsed again."""
    page = F.struct("page_id", F.concat(F.col("page_id").cast("string"), F.lit(".png")).alias("rel"), F.concat(F.lit("/in/"), F.col("page_id").cast("string"), F.lit(".png")).alias("absPath"), "width", "height")
    held = f.v_page.groupBy((F.col("page_id") % 8).alias("s")).agg(F.array_sort(F.collect_list(page)).alias("pages"))
    text = held.select("s", F.when(F.col("s") % 2 == 0, F.to_json(F.struct("pages"))).otherwise(F.to_json("pages")).alias("value"))
    return files.manifest_pages(text, keep=("s",))


@R.add("""
WITH l AS (SELECT page_id, string_agg('{"text":"t' || line_id || '","confidence":1.0,"box":[' || CAST(least(px1, px4) AS VARCHAR) || '.0,' || CAST(least(py1, py2) AS VARCHAR) || '.0,' || CAST(greatest(px2, px3) AS VARCHAR) || '.0,' || CAST(greatest(py3, py4) AS VARCHAR) || '.0],"vertical":' || CASE WHEN line_id % 3 = 0 THEN 'true' ELSE 'false' END || '}', ',' ORDER BY line_id) AS l
           FROM v_line WHERE line_id % 4 <> 0 GROUP BY page_id)
SELECT p.page_id AS seq, CASE WHEN p.page_id % 10 = 0 THEN '{"kind":"page","file":"' || p.page_id || '.png","ok":false,"width":0,"height":0,"lines":[],"error":"unreadable"}'
  ELSE '{"kind":"page","file":"' || p.page_id || '.png","ok":true,"width":' || width || ',"height":' || height || ',"lines":[' || coalesce(l, '') || ']}' END AS record FROM v_page p LEFT JOIN l ON p.page_id = l.page_id""")
def ndjson_pages(f):
    pages = f.v_page.select(F.col("page_id").alias("seq"), "page_id", F.concat(F.col("page_id").cast("string"), F.lit(".png")).alias("file"), "width", "height", F.when(F.col("page_id") % 10 == 0, "unreadable").alias("error"))
    corner = lambda pick, *c: pick(*c).cast("double")
    box = F.array(corner(F.least, "px1", "px4"), corner(F.least, "py1", "py2"), corner(F.greatest, "px2", "px3"), corner(F.greatest, "py3", "py4"))
    text = F.when(F.col("line_id") % 4 == 0, "").otherwise(F.concat(F.lit("t"), F.col("line_id").cast("string")))
    lines = f.v_line.select("page_id", F.col("line_id").alias("line_no"), text.alias("text"), box.alias("box"), (F.col("line_id") % 3 == 0).alias("vertical"))
    return protocol.page_records(pages, lines)


@R.add("""SELECT CAST(doc_id AS VARCHAR) AS name, CASE doc_id % 5 WHEN 0 THEN 'missing' WHEN 1 THEN 'changed' ELSE 'ok' END AS status, CASE WHEN doc_id % 5 <> 0 THEN sha256(text) END AS actual FROM documents""")
def hash_verify(f):
    name = F.col("doc_id").cast("string").alias("name")
    own = F.sha2(F.col("text").cast("binary"), 256)
    manifest = f.documents.select(name, F.when(F.col("doc_id") % 5 == 1, F.lit("0" * 64)).otherwise(own).alias("sha256"))
    return catalog.verified(f.documents.where("doc_id % 5 <> 0").select(name, F.col("text").alias("content")), manifest).select("name", "status", "actual")


@R.add("""
WITH o AS (SELECT * FROM v_catalog_old WHERE id NOT IN (SELECT id FROM v_catalog_new))
SELECT id, name, version, row_number() OVER (ORDER BY id) - 1 AS place FROM o
UNION ALL SELECT id, name, version, row_number() OVER (ORDER BY id) - 1 + (SELECT count(*) FROM o) FROM v_catalog_new""")
def catalog_upsert(f):
    return catalog.upsert(f.v_catalog_old, f.v_catalog_new, order="id")


#: Package names for the deny-list query.
_PACKAGES = ("torch", "Torch-sub", "torchx", "numpy", "onnxruntime_gpu", "transformers.extra", "tokenizers2", "fugashi", "cv2")
_PICK = "[" + ", ".join(f"'{p}'" for p in _PACKAGES) + "]"


@R.add(f"""SELECT p_partkey, name FROM (SELECT p_partkey, ({_PICK})[1 + p_partkey % 9] || CASE WHEN p_partkey % 2 = 0 THEN '' ELSE '-1.0' END AS name FROM part)
WHERE NOT regexp_matches(name, '{catalog.SKIPPED_PACKAGES}')""")
def pkg_filter(f):
    names = F.array(*[F.lit(p) for p in _PACKAGES])
    name = F.concat(F.get(names, (F.col("p_partkey") % 9).cast("int")), F.when(F.col("p_partkey") % 2 == 0, "").otherwise("-1.0"))
    return catalog.kept_packages(f.part.select("p_partkey", name.alias("name")))


_LIBS = ("kernel32.dll", "MSVCP140.dll", "api-ms-win-core.dll", "mf.dll", "f12.dll", "extra.dll", "ext-ms-win-x.dll")


@R.add(f"""
WITH i AS (SELECT file, CASE WHEN k < 7 THEN lower(([{', '.join(f"'{x}'" for x in _LIBS)}])[k + 1]) ELSE lib END AS lib FROM (SELECT *, row_number() OVER (ORDER BY file, lib) % 9 AS k FROM v_import))
SELECT lib, CASE WHEN lib IN ({', '.join(f"'{x}'" for x in catalog.CONDITIONAL_LIBRARIES)}) THEN 'conditional' ELSE 'hard' END AS kind, count(DISTINCT file) AS users FROM i
WHERE lib NOT IN (SELECT lower(file) FROM v_import) AND NOT starts_with(lib, 'api-ms-win') AND NOT starts_with(lib, 'ext-ms-win')
  AND (lib IN ({', '.join(f"'{x}'" for x in catalog.CONDITIONAL_LIBRARIES)}) OR lib NOT IN ({', '.join(f"'{x}'" for x in catalog.BASE_LIBRARIES)})) GROUP BY lib""")
def dep_audit(f):
    k = F.row_number().over(Window.orderBy("file", "lib")) % 9
    lib = F.when(F.col("k") < 7, F.get(F.array(*[F.lit(x) for x in _LIBS]), F.col("k"))).otherwise(F.col("lib"))
    imports = f.v_import.withColumn("k", k).select("file", lib.alias("lib"))
    return catalog.missing_libraries(imports, f.v_import.select(F.col("file").alias("lib")).distinct())
