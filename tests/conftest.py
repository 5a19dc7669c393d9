import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = os.pathsep.join([str(ROOT), os.environ.get("PYTHONPATH", "")])

TESTDATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return TESTDATA


def plain(value):
    """A value for comparing: rows and arrays as lists, doubles rounded."""
    if value is None:
        return None
    if isinstance(value, float):
        return "nan" if value != value else round(value, 8) + 0.0
    if isinstance(value, (list, tuple)):
        return [plain(v) for v in value]
    if isinstance(value, dict):
        return {k: plain(v) for k, v in value.items()}
    return value


def frame_rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted((repr([plain(r[k]) for k in order]) for r in rows))


@pytest.fixture(scope="session")
def compare(spark, sf_dir):
    """compare(query, sql): same columns and rows from Spark and DuckDB."""
    import duckdb

    connection = duckdb.connect()
    for path in Path(sf_dir).glob("*.parquet"):
        connection.sql(f"create view {path.stem} as select * from '{path}'")

    def run(query, sql):
        df = query(spark, sf_dir)
        got = df.collect()
        cursor = connection.execute(sql)
        columns = [d[0] for d in cursor.description]
        assert sorted(df.columns) == sorted(columns)
        want = cursor.fetchall()
        assert len(got) == len(want)
        assert frame_rows(df.columns, [tuple(r) for r in got]) == frame_rows(columns, want)

    return run
