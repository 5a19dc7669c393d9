"""Sharding by a hierarchical weighted hash tree.

A tree names regions, racks and shards; shards carry weights, and a rack or region has the sum of
those below it.  A row's key descends from the root: each child of the node it stands at draws a
waiting time ``-ln(u) / weight`` with ``u`` from MD5 of the key and the child's path, and the least
draw is entered.  Only children of chosen nodes draw.

A node's draw depends on its own path and weight alone.  So a change of weights moves rows only into
or out of the subtrees that hold it, and a new shard in a region of its own takes rows only into itself.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: MD5's first hexadecimal digits that make a draw; 13 digits fit a double's 53 bits.
DRAW_DIGITS = 13


@dataclass(frozen=True)
class Leaf:
    """A shard with its place in the tree."""

    shard: int
    region: str
    rack: str
    weight: float = 1.0


def even_tree(shards: int, regions: int = 2, racks: int = 2) -> list[Leaf]:
    """``shards`` leaves of weight 1: sixteen in blocks over ``regions`` x ``racks``, each further one in a region of its own, so that it takes rows only into itself."""
    per = max(1, 16 // (regions * racks))
    full = per * regions * racks
    out = []
    for s in range(shards):
        block = s // per
        out.append(Leaf(s, f"region{block // racks}", f"rack{block % racks}") if s < full else Leaf(s, f"region{regions + s - full}", "rack0"))
    return out


def _draw(key: Column, path: str, weight: float) -> Column:
    digits = F.substring(F.md5(F.concat(key, F.lit(f":{path}")).cast("binary")), 1, DRAW_DIGITS)
    u = (F.conv(digits, 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(16**DRAW_DIGITS))
    return -F.log(u) / F.lit(float(weight))


def _entered(key: Column, nodes: list[tuple[str, float]]) -> Column:
    """The place of the (path, weight) with the least draw; of equal draws the first."""
    if len(nodes) == 1:
        return F.lit(0)
    return F.array_min(F.array(*[F.struct(_draw(key, path, weight).alias("d"), F.lit(k).alias("k")) for k, (path, weight) in enumerate(nodes)]))["k"]


def _by_case(of: Column, below: list[Column]) -> Column:
    """``below[of]``; only that one is computed."""
    out = below[-1]
    for k in range(len(below) - 2, -1, -1):
        out = F.when(of == k, below[k]).otherwise(out)
    return out


def descend(docs: DataFrame, tree: list[Leaf], key: str, name: str) -> DataFrame:
    """``docs`` with the shard reached from the root as ``name``."""
    regions: dict[str, dict[str, list[Leaf]]] = {}
    for leaf in tree:
        if leaf.weight > 0:
            regions.setdefault(leaf.region, {}).setdefault(leaf.rack, []).append(leaf)
    if not regions:
        raise ValueError("no shard has a positive weight")
    text = F.coalesce(F.col(key).cast("string"), F.lit("null"))
    total = lambda leaves: sum(x.weight for x in leaves)
    top = [(r, total(x for rack in racks.values() for x in rack)) for r, racks in regions.items()]
    middle = [[(f"{r}/{k}", total(leaves)) for k, leaves in racks.items()] for r, racks in regions.items()]
    low = [[[(f"{r}/{k}/{x.shard}", x.weight) for x in leaves] for k, leaves in racks.items()] for r, racks in regions.items()]
    out = docs.withColumn("__region", _entered(text, top))
    out = out.withColumn("__rack", _by_case(F.col("__region"), [_entered(text, nodes) for nodes in middle]))
    under = lambda found: _by_case(F.col("__region"), [_by_case(F.col("__rack"), list(map(found, range(len(racks)), [k] * len(racks)))) for k, racks in enumerate(low)])
    out = out.withColumn("__leaf", under(lambda j, k: _entered(text, low[k][j])))
    shards = [[[x.shard for x in leaves] for leaves in racks.values()] for racks in regions.values()]
    reached = under(lambda j, k: _by_case(F.col("__leaf"), [F.lit(s) for s in shards[k][j]]))
    return out.withColumn(name, reached.cast("int")).drop("__region", "__rack", "__leaf")


def place(docs: DataFrame, tree: list[Leaf], key: str = "doc_id", grown: list[Leaf] | None = None) -> DataFrame:
    """``docs`` with ``shard`` (and ``grown_shard`` under the grown tree), without a shuffle.

    A null key is a key of its own.  Rows with equal keys share a shard.  Columns of ``docs`` with
    these names are replaced.
    """
    out = descend(docs, tree, key, "shard")
    return descend(out, grown, key, "grown_shard") if grown else out


def numbered(placed: DataFrame, keys: DataFrame, key: str = "doc_id", buckets: int = 256) -> DataFrame:
    """``placed`` with ``slot``, gapless from 0 in each shard, ordered by (bucket of the key, key).

    ``keys`` holds ``shard`` and the key of the same rows and may come from a scan of the key alone.
    A shard's rows are numbered bucket by bucket, so no task holds a whole shard; the offsets number
    shards x buckets and are broadcast.  Rows with equal keys get consecutive slots in any order.
    """
    bucket = F.conv(F.substring(F.md5(F.coalesce(F.col(key).cast("string"), F.lit("null")).cast("binary")), 31, 2), 16, 10).cast("int") % buckets
    counts = keys.groupBy("shard", bucket.alias("__bucket")).count()
    before = Window.partitionBy("shard").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "__bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__offset"))
    local = Window.partitionBy("shard", "__bucket").orderBy(F.col(key).asc_nulls_first())
    rows = placed.withColumn("__bucket", bucket).withColumn("__local", F.row_number().over(local))
    return rows.join(F.broadcast(offsets), ["shard", "__bucket"]).withColumn("slot", F.col("__offset") + F.col("__local") - 1).drop("__bucket", "__local", "__offset")


def shard(docs: DataFrame, tree: list[Leaf], grown: list[Leaf] | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, ``size`` (UTF-8 bytes + 1; null text: 1), ``text_crc32`` (null: 0), ``law`` 'key', ``shard``, ``slot``, ``grown_shard``.

    An empty table gives no rows; other columns are not returned.
    """
    narrow = docs.select(
        F.col(key),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
    )
    out = numbered(place(narrow, tree, key, grown), place(docs.select(key), tree, key), key)
    return out.select(key, "size", "text_crc32", "law", "shard", F.col("slot").cast("long"), F.col("grown_shard") if grown else F.lit(None).cast("int").alias("grown_shard"))


def write_shards(docs: DataFrame, tree: list[Leaf], path: str, key: str = "doc_id") -> None:
    """Whole rows as Parquet under ``path/shard=N``; each task writes to every shard it meets, so a hot shard is written by many tasks."""
    place(docs, tree, key).write.partitionBy("shard").mode("errorifexists").parquet(path)
