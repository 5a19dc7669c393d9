"""SQL functions of a session; their bodies are expressions, so they stay within generated code."""

from __future__ import annotations

from pyspark.sql import SparkSession

_BOXES = "ax1 DOUBLE, ay1 DOUBLE, ax2 DOUBLE, ay2 DOUBLE, bx1 DOUBLE, by1 DOUBLE, bx2 DOUBLE, by2 DOUBLE"
_W, _H = "least(ax2, bx2) - greatest(ax1, bx1)", "least(ay2, by2) - greatest(ay1, by1)"
_COMMON = f"CASE WHEN {_W} < 0 OR {_H} < 0 THEN -1D ELSE ({_W}) * ({_H}) END"
_SIZES = "(ax2 - ax1) * (ay2 - ay1) + (bx2 - bx1) * (by2 - by1)"

FUNCTIONS = {
    "page_box_common": (_BOXES, "DOUBLE", _COMMON),
    "page_box_iou": (_BOXES, "DOUBLE", f"try_divide(greatest({_COMMON}, 0D), {_SIZES} - greatest({_COMMON}, 0D))"),
    "page_strip_white": ("t STRING", "STRING", r"regexp_replace(t, '(?U)[\\s\\x1c-\\x1f]+', '')"),
    "page_block_text": ("lines ARRAY<STRING>", "STRING", "trim(array_join(lines, ' '))"),
}


def register(spark: SparkSession) -> list[str]:
    """Make the functions known to ``spark.sql`` in this session; gives their names."""
    for name, (arguments, result, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {result} RETURN {body}")
    return list(FUNCTIONS)
