"""Page records as a stream: stateless, since the page is the unit of every step."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..functions import text as t
from ..operators import protocol

#: One row per recognised line; files arrive in a folder.
LINES = "seq long, page_id long, file string, width int, height int, error string, line_no int, text string, box array<double>, vertical boolean"


def records(lines: DataFrame) -> DataFrame:
    """(seq, record) of whole pages: lines of one page arrive in one file."""
    pages = lines.select("seq", "page_id", "file", "width", "height", "error").distinct()
    clean = lines.where("text is not null").withColumn("text", t.normalised(lines["text"]))
    return protocol.page_records(pages, clean)


def start(spark: SparkSession, source: str, sink: str, checkpoint: str, files_per_batch: int = 100, each: Callable[[DataFrame], DataFrame] = records) -> StreamingQuery:
    """Read JSON-lines files as they come and write each batch's records under ``sink/batch=N``.

    A batch that is run again after a failure overwrites its own folder, so records come once.
    """
    stream = spark.readStream.schema(LINES).option("maxFilesPerTrigger", files_per_batch).json(source)

    def write(batch: DataFrame, number: int) -> None:
        out = each(batch).repartitionByRange("seq").sortWithinPartitions("seq")
        out.selectExpr("record as value").write.mode("overwrite").text(f"{sink}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
