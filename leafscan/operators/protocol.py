"""Result records: page lines to NDJSON, in the order of the manifest."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LINE = "array<struct<text:string,confidence:double,box:array<double>,vertical:boolean>>"


def page_records(pages: DataFrame, lines: DataFrame) -> DataFrame:
    """(seq, record) of pages (seq, page_id, file, width, height, error); lines: page_id, line_no, text, box, vertical.

    Lines without text are left out; a page with an error has no size and no lines.
    """
    line = F.struct("line_no", "text", F.lit(1.0).alias("confidence"), "box", "vertical")
    held = lines.where(F.col("text") != "").groupBy("page_id").agg(F.array_sort(F.collect_list(line)).alias("l"))
    bare = F.transform("l", lambda x: F.struct(x["text"].alias("text"), x["confidence"].alias("confidence"), x["box"].alias("box"), x["vertical"].alias("vertical")))
    out = pages.join(held, "page_id", "left")
    ok = F.col("error").isNull()
    none = F.array().cast(LINE)
    record = F.struct(
        F.lit("page").alias("kind"), "file", ok.alias("ok"),
        F.when(ok, F.col("width")).otherwise(0).alias("width"), F.when(ok, F.col("height")).otherwise(0).alias("height"),
        F.when(ok, F.coalesce(bare, none)).otherwise(none).alias("lines"), "error",
    )
    return out.select("seq", F.to_json(record).alias("record"))


def meta_record(spark, engine: str, languages: list[str], requested: list[str]) -> DataFrame:
    held = spark.createDataFrame([(-1, "meta", engine, languages, requested)], "seq long, kind string, engine string, languages array<string>, requested array<string>")
    return held.select("seq", F.to_json(F.struct("kind", "engine", "languages", "requested")).alias("record"))


def fatal_record(spark, error: str) -> DataFrame:
    held = spark.createDataFrame([(0, "fatal", error)], "seq long, kind string, error string")
    return held.select("seq", F.to_json(F.struct("kind", "error")).alias("record"))


def write_ordered(records: DataFrame, path: str) -> None:
    """One record a line, in the order of seq: range partitions are written as ordered files."""
    records.repartitionByRange("seq").sortWithinPartitions("seq").select(F.col("record").alias("value")).write.mode("errorifexists").text(path)
