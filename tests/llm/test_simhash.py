import random

import numpy as np
import xxhash

from leafscan.llm import simhash

from .helpers import Groups, docs_of, no_docs, odd_docs, odd_rows, words


def fingerprint(text):
    each = (text or "").encode().lower().split()
    grams = [b" ".join(each[i : i + 3]) for i in range(len(each) - 2)] or ([b" ".join(each)] if each else [])
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def expected(rows):
    groups, prints = Groups(), [(i, fingerprint(t)) for i, t in rows]
    for i, a in prints:
        for j, b in prints:
            if i is not None and j is not None and (a ^ b).bit_count() <= 3:
                groups.join(i, j)
    least = {}
    for i, a in prints:
        if i is not None:
            least[a] = min(least.get(a, i), i)
    return sorted((i, f"{a:016x}", groups.find(least[a]) if a in least else None) for i, a in prints if i is not None)


def got(df):
    return sorted(tuple(r) for r in df.where("doc_id is not null").collect())


def test_equals_brute_force(spark, sf_dir):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert got(simhash.near_duplicates(docs_of(spark, rows))) == expected(rows)


def test_odd_rows(spark):
    out = simhash.near_duplicates(odd_docs(spark))
    assert got(out) == expected([(i, t) for i, t, *_ in odd_rows()]) and out.count() == len(odd_rows())
    assert simhash.near_duplicates(no_docs(spark)).count() == 0


def test_planes_hold_in_any_five_positions():
    from itertools import combinations

    assert len(simhash.PLANES) == 14
    assert all(any(set(p) <= set(five) for p in simhash.PLANES) for five in combinations(range(8), 5))


def prints_frame(spark, prints):
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    return spark.createDataFrame([(signed(v), k) for k, v in enumerate(prints)], "fp long, node long")


def chained(spark, prints):
    groups = Groups()
    for r in simhash.links(prints_frame(spark, prints)).collect():
        groups.join(r["a"], r["b"])
    return [groups.find(k) for k in range(len(prints))]


def brute(prints):
    groups = Groups()
    for i, a in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j]).bit_count() <= 3:
                groups.join(i, j)
    return [groups.find(k) for k in range(len(prints))]


def test_links_of_chains_and_dense_groups(spark, monkeypatch):
    rng = random.Random(4)
    prints = {rng.getrandbits(64) for _ in range(60)}
    base = rng.getrandbits(64)
    for _ in range(80):  # one dense group, and chains that leave it
        prints.add(base ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)))
    step = base
    for _ in range(12):
        step ^= sum(1 << b for b in rng.sample(range(64), 3))
        prints.add(step)
    prints = sorted(prints)
    assert chained(spark, prints) == brute(prints)
    monkeypatch.setattr(simhash, "BLOCK", 10)  # long lists are dealt out as pairs of blocks
    assert chained(spark, prints) == brute(prints)


def test_case_folds_and_order_counts(spark):
    base = words(300, 5)
    rows = [(1, " ".join(base)), (2, " ".join(base).upper()), (3, " ".join(reversed(base)))]
    out = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(docs_of(spark, rows)).collect()}
    assert out == {1: 1, 2: 1, 3: 3}


def test_the_tally_rejects_before_bits_are_compared():
    rng = np.random.default_rng(2)
    a = rng.integers(0, 2**64, 20000, np.uint64)
    keep = rng.integers(0, 2**64, 20000, np.uint64)
    shared = ((a & keep).view(np.uint8).reshape(-1, 8) == 0).sum(1)
    assert simhash.shared_bytes(a & keep).tolist() == shared.tolist()
    one = np.array([0x0101010100000000, 0x0101010000000000, 0x0700000000000000, 0], np.uint64)  # 4 bytes apart by a bit each; 3; one byte by 3
    assert (simhash.shared_bytes(one) >= simhash.LEAST_BYTES).tolist() == [False, True, True, True]
    assert simhash.linked(one).tolist() == [False, True, True, True]
    wide = np.array([0xFF00000000000000, 0x0F00000000000000], np.uint64)  # passes the tally, not the bits
    assert (simhash.shared_bytes(wide) >= simhash.LEAST_BYTES).all() and not simhash.linked(wide).any()
