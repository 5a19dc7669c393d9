"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; a temporary one only where that is unset (local tests)."""
    found = spark.conf.get(CHECKPOINT_DIR, None)
    if found:
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set {CHECKPOINT_DIR} to a folder that the driver and all executors share")
    if spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError(f"set {CHECKPOINT_DIR} on a local-cluster master")
    found = spark.conf.get("spark.leafscan.localScratch", None)
    if not found:
        found = "file://" + tempfile.mkdtemp(prefix="leafscan-")
        spark.conf.set("spark.leafscan.localScratch", found)
    return found


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again.

    This cuts the lineage: losing any executor later costs a reread of files and no recomputation.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._leafscan_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete the files behind a table made by :func:`saved`."""
    path = getattr(df, "_leafscan_path", None)
    if path:
        jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(conf).delete(where, True)


def bounded_batches(spark: SparkSession, rows: int = 2000, size: str = "8m") -> None:
    """Keep Arrow batches small, so that a worker's memory does not depend on the length of the texts."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)
