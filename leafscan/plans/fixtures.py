"""Detections, lines, predictions and tokens derived from the star-schema tables, in SQL that Spark and DuckDB both run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "conversations")

#: name -> (tables and views that it reads, statement)
VIEWS: dict[str, str] = {
    "v_params": "SELECT CAST(count(*) / 30 AS bigint) AS n_pages FROM orders",
    "v_page": """
        SELECT DISTINCT l_orderkey % n_pages AS page_id, CASE WHEN (l_orderkey % n_pages) % 4 = 0 THEN 1600 ELSE 900 END AS width, 1300 AS height
        FROM lineitem CROSS JOIN v_params""",
    "v_det": """
        SELECT page_id, det_id, cx, cy, w, h,
               CAST(40 + (l_partkey * 7 + l_linenumber * 13) % 60 AS double) / 100 - 0.05 AS obj,
               CAST((l_partkey * 3) % 97 AS double) / 97 AS cls0,
               CAST((l_suppkey * 5 + l_orderkey) % 97 AS double) / 97 AS cls1,
               cx - w / 2 AS x1, cy - h / 2 AS y1, cx + w / 2 AS x2, cy + h / 2 AS y2
        FROM (SELECT l_orderkey % n_pages AS page_id,
                     row_number() OVER (PARTITION BY l_orderkey % n_pages
                       ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice, l_quantity) AS det_id,
                     l_orderkey, l_linenumber, l_partkey, l_suppkey,
                     CAST(100 + (l_partkey * 37 + l_linenumber * 11) % 700 AS double) AS cx,
                     CAST(150 + (l_suppkey * 53 + l_orderkey * 7) % 1000 AS double) AS cy,
                     CAST(40 + l_quantity * 4 AS double) AS w,
                     CAST(40 + (l_partkey % 50) * 4 AS double) AS h
              FROM lineitem CROSS JOIN v_params) t""",
    "v_line": """
        SELECT page_id, det_id AS line_id,
               CAST(cx - w / 4 AS int) AS px1, CAST(cy - h / 4 AS int) AS py1,
               CAST(cx + w / 4 AS int) AS px2, CAST(cy - h / 4 + det_id % 3 AS int) AS py2,
               CAST(cx + w / 4 AS int) AS px3, CAST(cy + h / 4 + det_id % 3 AS int) AS py3,
               CAST(cx - w / 4 AS int) AS px4, CAST(cy + h / 4 AS int) AS py4, obj AS score
        FROM v_det WHERE det_id % 2 = 0""",
    "v_pred": """
        SELECT page_id, det_id AS pred_id, x1 + det_id % 7 AS x1, y1 + det_id % 5 AS y1, x2 + det_id % 7 AS x2, y2 + det_id % 5 AS y2,
               CASE WHEN det_id % 11 = 0 THEN 'x' ELSE CAST(det_id % 9 AS varchar(4)) END AS pred_text
        FROM v_det WHERE det_id % 13 <> 0""",
    "v_text": """
        SELECT doc_id, replace(replace(replace(text, ', ', '・.'), '. ', '…'), ' la ', concat(' ', '　', '・')) AS raw_text FROM documents""",
    "v_token": "SELECT conv_id AS crop_id, turn AS seq, length(text) % 64 AS token_id FROM conversations",
    "v_catalog_old": "SELECT s_suppkey AS id, s_name AS name, 1 AS version FROM supplier",
    "v_catalog_new": "SELECT s_suppkey * 3 AS id, concat(s_name, '-b') AS name, 2 AS version FROM supplier",
    "v_import": "SELECT concat('f', CAST(p_partkey % 200 AS varchar(9)), '.dll') AS file, lower(replace(p_brand, '#', '_')) AS lib FROM part",
}


def with_views(select: str) -> str:
    """``select`` with the views that it names, directly or through others, as common table expressions."""
    needed: list[str] = []

    def need(sql: str) -> None:
        for name, body in VIEWS.items():
            if name in sql and name not in needed:
                need(body)
                needed.append(name)

    need(select)
    body = select.lstrip()
    ctes = ", ".join(f"{n} AS ({VIEWS[n]})" for n in needed)
    if not ctes:
        return body
    for opening in ("WITH RECURSIVE ", "WITH "):
        if body.startswith(opening):
            return f"{opening}{ctes}, {body[len(opening):]}"
    return f"WITH {ctes} {body}"


class Fixtures:
    """The tables and views of one folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def __getattr__(self, name: str) -> DataFrame:
        """``f.v_det``: a view; ``f.orders``: a table."""
        if name in TABLES:
            return self.table(name)
        if name not in VIEWS:
            raise AttributeError(name)
        sql = with_views(f"SELECT * FROM {name}")
        for table in TABLES:
            if f"FROM {table}" in sql:
                self.table(table).createOrReplaceTempView(table)
        return self.spark.sql(sql)
