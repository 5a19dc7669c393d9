"""Connected components over a table of links, by alternating star contraction.

Each round turns links into links to the smallest neighbour, first for the larger ends (large star),
then for the smaller ends (small star); the number of rounds grows with the logarithm of the longest
path.  All work is joins and aggregates with map-side combining.  A hub that holds a third of the
links is one key of a sort-merge join.  Both sides of each join are shuffled for it alone (the least
neighbours under a new name), so adaptive execution can split the hub's partition and repeat the one
row that meets it.  Sets of up to ``HELD_LINKS`` links, 16 MB, are joined by union-find in one task
instead, with the same result and without the rounds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import discard, saved

MAX_ROUNDS = 100
HELD_LINKS = 1 << 20


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, component) of all links, each u > v."""
    held = [np.stack([b.column(0).to_numpy(), b.column(1).to_numpy()]) for b in batches if b.num_rows]
    if not held:
        return
    nodes, ends = np.unique(np.concatenate(held, axis=1), return_inverse=True)
    u, v = ends.reshape(2, -1)
    up = np.arange(len(nodes))
    while True:  # the larger root of each link hangs on the least root it meets, then all paths are cut to one step
        a, b = up[u], up[v]
        apart = a != b
        if not apart.any():
            break
        u, v = u[apart], v[apart]
        np.minimum.at(up, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
        while (up[up] != up).any():
            up = up[up]
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[up])], ["node", "component"])


def components(links: DataFrame, a: str = "a", b: str = "b", held_links: int = HELD_LINKS) -> DataFrame:
    """``(node, component)`` for every node of a link; component is the smallest node reachable.

    Nulls, self-links and repeated links have no effect; no link gives no row.
    """
    edges = saved(
        links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("u") != F.col("v"))).distinct(),
        "links",
    )
    mark = _mark(edges)
    if mark[0] <= held_links:
        out = saved(edges.coalesce(1).mapInArrow(_united, "node long, component long"), "components")
        discard(edges)
        return out
    for _ in range(MAX_ROUNDS):
        if mark[0] == 0:
            break
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(_apart("u").alias("w"), F.least("u", "m").alias("m"))
        larger = both.where("v > u")
        large = larger.join(least, larger["u"] == least["w"]).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        apart = least.select(_apart("u").alias("w"), "m")
        held = large.select(_apart("u").alias("u"), "v")
        small = held.join(apart, held["u"] == apart["w"])
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        after = saved(small, "links")
        was, mark = mark, _mark(after)
        discard(edges)
        edges = after
        if was == mark:
            break
    else:
        raise RuntimeError(f"links did not settle in {MAX_ROUNDS} rounds")
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def _apart(c: str):
    """The same value as an expression of its own, which no partitioning by ``c`` serves."""
    return F.col(c).bitwiseXOR(F.lit(0).cast("long"))


def _mark(edges: DataFrame) -> tuple:
    """Count and two sums that stay the same only when the links do."""
    h = F.xxhash64("u", "v")
    row = edges.agg(F.count("*"), F.sum(h.bitwiseAND(F.lit(0xFFFFFFFF))), F.sum(F.shiftrightunsigned(h, 32))).first()
    return tuple(row)
