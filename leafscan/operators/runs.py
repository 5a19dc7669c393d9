"""Whole pages from Arrow batches: a page's rows of all sides lie together, many pages in one table."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def whole(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables of whole runs of equal non-null integer ``key``, from batches sorted by it; a run may span batches."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        values = batch.column(batch.schema.get_field_index(key)).to_numpy(zero_copy_only=False)
        if held and values[0] != held[-1].column(held[-1].schema.get_field_index(key))[-1].as_py():
            yield pa.Table.from_batches(held)
            held = []
        change = np.flatnonzero(values[1:] != values[:-1])
        if len(change):
            at = int(change[-1]) + 1
            yield pa.Table.from_batches([*held, batch.slice(0, at)])
            held = [batch.slice(at)]
        else:
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


def edges(*keys: np.ndarray) -> list[int]:
    """Where runs of equal keys begin, and the end of the last."""
    if not len(keys[0]):
        return [0]
    change = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return [0, *(np.flatnonzero(change) + 1).tolist(), len(keys[0])]


def by_page(sides: list[DataFrame], order: list[str], kernel: Callable[[pa.Table], list[tuple]], schema: str) -> DataFrame:
    """``kernel``'s rows over tables of whole pages: all sides, told apart by ``side``, in one shuffle by page_id, each in ``order``.

    The kernel gives tuples in the schema's order.  Rows without a page_id belong to no page.
    """
    both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [df.withColumn("side", F.lit(k)) for k, df in enumerate(sides)])
    held = both.where("page_id is not null").withColumn("page_id", F.col("page_id").cast("long"))
    held = held.repartition("page_id").sortWithinPartitions("page_id", "side", *order)
    kinds = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole(batches, "page_id"):
            rows = kernel(table)
            if rows:
                columns = [pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, schema=kinds)

    return held.mapInArrow(run, schema)
