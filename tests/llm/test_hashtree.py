import math
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from leafscan.llm import hashtree as h

from .helpers import no_docs, odd_docs, odd_rows


def ids(spark, n=4000):
    return spark.range(n).withColumnRenamed("id", "doc_id")


def placed(spark, tree, n=4000):
    return {r["doc_id"]: r["shard"] for r in h.place(ids(spark, n), tree).collect()}


def test_new_shard_takes_rows_only_into_itself(spark):
    rows = h.place(ids(spark), h.even_tree(16), grown=h.even_tree(17)).collect()
    moved = [r for r in rows if r["shard"] != r["grown_shard"]]
    assert moved and {r["grown_shard"] for r in moved} == {16} and {r["shard"] for r in rows} == set(range(16))
    assert abs(len(moved) - 4000 / 17) < 5 * math.sqrt(4000 / 17)


def test_weights_are_met_and_confined(spark):
    tree = [h.Leaf(0, "a", "r", 1.0), h.Leaf(1, "a", "r", 3.0), h.Leaf(2, "b", "r", 2.0), h.Leaf(3, "b", "q", 2.0), h.Leaf(4, "b", "q", 0.0)]
    before = placed(spark, tree)
    share = Counter(before.values())
    assert 4 not in share and all(abs(share[x.shard] / 4000 - x.weight / 8) < 0.04 for x in tree)
    in_b = lambda s: s in (2, 3)
    after = placed(spark, [*tree[:3], h.Leaf(3, "b", "q", 5.0), tree[4]])
    moved = {k for k in before if after[k] != before[k]}
    assert moved and all(in_b(after[k]) for k in moved)  # into the region that gained, within it into the rack that gained
    assert all(after[k] == 3 for k in moved if in_b(before[k]))
    gone = placed(spark, [x for x in tree if x.shard != 2])
    assert all(gone[k] == s for k, s in before.items() if not in_b(s))
    rack = placed(spark, [h.Leaf(0, "a", "r", 2.0), h.Leaf(1, "a", "r", 2.0), *tree[2:]])  # weights within a rack
    assert all({before[k], rack[k]} == {0, 1} for k in before if rack[k] != before[k]) and rack != before


def test_descent_equals_a_walk_down_the_tree(spark):
    import hashlib

    def draw(i, path, w):
        return -math.log((int(hashlib.md5(f"{i}:{path}".encode()).hexdigest()[:13], 16) + 0.5) / 16**13) / w

    tree = [h.Leaf(0, "a", "r", 1.0), h.Leaf(1, "a", "r", 3.0), h.Leaf(2, "b", "r", 2.0), h.Leaf(3, "b", "q", 2.5), h.Leaf(4, "b", "q", 0.5), h.Leaf(5, "c", "q", 1.0)]

    def walk(i):
        region = min("abc", key=lambda r: draw(i, r, sum(x.weight for x in tree if x.region == r)))
        racks = {x.rack for x in tree if x.region == region}
        rack = min(racks, key=lambda k: draw(i, f"{region}/{k}", sum(x.weight for x in tree if (x.region, x.rack) == (region, k))))
        return min((x for x in tree if (x.region, x.rack) == (region, rack)), key=lambda x: draw(i, f"{region}/{rack}/{x.shard}", x.weight)).shard

    assert placed(spark, tree, 500) == {i: walk(i) for i in range(500)}


def test_slots_are_gapless(spark):
    rows = h.shard(odd_docs(spark), h.even_tree(3), h.even_tree(4)).collect()
    assert len(rows) == len(odd_rows())
    for s in range(3):
        mine = sorted(r["slot"] for r in rows if r["shard"] == s)
        assert mine == list(range(len(mine)))
    want = sorted((str(i), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in odd_rows())
    assert sorted((str(r["doc_id"]), r["size"], r["text_crc32"]) for r in rows) == want
    assert h.shard(no_docs(spark), h.even_tree(3)).count() == 0


def test_trees_are_checked(spark):
    with pytest.raises(ValueError):
        h.place(ids(spark, 3), [h.Leaf(0, "a", "r", 0.0)])


def test_written_shards_read_back(spark, tmp_path):
    docs = odd_docs(spark)
    h.write_shards(docs.drop("shard"), h.even_tree(4), str(tmp_path / "s"))
    back = spark.read.parquet(str(tmp_path / "s"))
    assert back.count() == docs.count()
    assert back.select("doc_id", F.col("shard").cast("int")).exceptAll(h.place(docs.select("doc_id"), h.even_tree(4)).select("doc_id", "shard")).count() == 0
