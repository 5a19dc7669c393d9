"""Long lists dealt out as pairs of blocks, so that no task holds one list of unbounded length."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import saved

BLOCK = 4096


def dealt(lists: DataFrame, key: str, member: str, block: int = BLOCK) -> DataFrame:
    """``lists`` with ``cell`` and ``side``: lists up to ``block`` rows are cell -1; longer ones are cut into
    blocks by a hash of ``member``, and each pair of blocks is a cell, so all pairs still meet.

    In a cell of two different blocks rows of side 0 are to be compared with rows of side 1 alone.
    """
    lengths = saved(lists.groupBy(key).count().where(F.col("count") > block).select(key, F.ceil(F.col("count") / block).alias("blocks")), "long-lists")
    plain = lists.withColumns({"cell": F.lit(-1).cast("long"), "side": F.lit(0).cast("long")})
    if lengths.isEmpty():
        return plain
    cut = lists.join(lengths, key).withColumn("mine", F.pmod(F.xxhash64(member), F.col("blocks")))
    cut = cut.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    cell = F.shiftleft(F.least("mine", "other"), 32).bitwiseOR(F.greatest("mine", "other"))
    cut = cut.withColumns({"cell": cell, "side": (F.col("mine") > F.col("other")).cast("long")}).drop("mine", "other", "blocks")
    return plain.join(lengths, key, "left_anti").unionByName(cut)


def one_block(cell: int) -> bool:
    """Whether all rows of the cell are to be compared with each other."""
    return cell < 0 or cell >> 32 == cell & 0xFFFFFFFF


def runs(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...], most: int = 0, overlap: int = 0) -> Iterator[pa.Table]:
    """Tables of whole runs of rows with equal non-null integer ``keys``, from batches sorted by them; a run may span batches.

    With ``most``, runs over so many rows come in parts, each of which begins with the last ``overlap`` rows of the one before.
    """
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        key = [batch.column(batch.schema.get_field_index(k)).to_numpy(zero_copy_only=False) for k in keys]
        change = np.flatnonzero(np.logical_or.reduce([k[1:] != k[:-1] for k in key])) + 1
        first = tuple(k[0] for k in key)
        if held and first != last:
            yield pa.Table.from_batches(held)
            held = []
        if len(change):
            held.append(batch.slice(0, int(change[-1])))
            yield pa.Table.from_batches(held)
            held = [batch.slice(int(change[-1]))]
        else:
            held.append(batch)
            if most and sum(b.num_rows for b in held) > most:
                part = pa.Table.from_batches(held)
                yield part
                held = part.slice(part.num_rows - overlap).combine_chunks().to_batches()
        last = tuple(k[-1] for k in key)
    if held:
        yield pa.Table.from_batches(held)


def bounds(table: pa.Table, keys: tuple[str, ...]) -> tuple[np.ndarray, np.ndarray]:
    """First row and length of each run."""
    key = [table.column(k).to_numpy() for k in keys]
    edge = np.flatnonzero(np.concatenate([[True], np.logical_or.reduce([k[1:] != k[:-1] for k in key])])) if table.num_rows else np.empty(0, np.int64)
    return edge, np.diff(np.append(edge, table.num_rows))
