"""SimHash near-duplicates by a byte-position inverted index with count filtering.

Two 64-bit fingerprints with at most 3 differing bits agree in at least 5 of their 8 bytes.  Posting
lists of single (position, byte) pairs would each hold 1/256 of all fingerprints, so the index keeps
lists of four positional bytes at once: the 14 planes of the affine space on the 8 positions.  Any 5
positions contain one of these planes, so each link meets in a list.  There the shared positional
bytes of a pair are tallied, pairs with the guaranteed minimum of 5 kept, and their bits compared.

Equal fingerprints collapse first.  A list over ``BLOCK`` long is dealt out as pairs of blocks, and
a list reports links that connect what it has not connected yet: the output is linear in the list
and the components are those of all links.  Components come from distributed star contraction.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words
from .components import components
from .storage import bounded_batches, saved

SEED = 42
MAX_BITS = 3
#: With at most MAX_BITS bits apart, at least this many of 8 positional bytes agree.
LEAST_BYTES = 8 - MAX_BITS
#: Sets of four byte positions whose XOR is 0.
PLANES = [c for c in combinations(range(8), 4) if c[0] ^ c[1] ^ c[2] ^ c[3] == 0]
BLOCK = 4096
SMALL = 8


def fingerprints_of(texts: list[str | None], width: int = 3) -> np.ndarray:
    """uint64 fingerprints of whole texts; no word: 0."""
    out = np.zeros(len(texts), np.uint64)
    digest = xxhash.xxh64_intdigest
    for begin, raw in words.slices(texts, lower=True, size=1 << 20):
        hashes, counts = [], np.zeros(len(raw), np.int64)
        for k, text in enumerate(raw):
            each = text.split()
            if not each:
                continue
            joined = b" ".join(each)
            lengths = np.fromiter(map(len, each), np.int64, len(each)) + 1
            if len(each) < width:
                found = [digest(joined, SEED)]
            else:
                opens = np.cumsum(lengths) - lengths
                closes = (opens + lengths - 1)[width - 1 :].tolist()
                found = [digest(joined[a:b], SEED) for a, b in zip(opens.tolist(), closes, strict=False)]
            hashes += found
            counts[k] = len(found)
        if hashes:
            bits = np.unpackbits(np.array(hashes, np.uint64).astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            filled = np.flatnonzero(counts)
            opens = np.cumsum(counts[filled]) - counts[filled]
            ones = np.add.reduceat(bits, opens, axis=0, dtype=np.int64)
            out[begin + filled] = np.packbits(ones * 2 > counts[filled][:, None], axis=1, bitorder="little").view("<u8").ravel()
    return out


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """(doc_id, fp): a signed long holding the fingerprint's bits."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = fingerprints_of(batch.column(1).to_pylist(), width)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    bounded_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text")).mapInArrow(kernel, "doc_id long, fp long")


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fp, node = batch.column(0), batch.column(1)
        raw = np.ascontiguousarray(fp.to_numpy(zero_copy_only=False)).astype("<i8").view(np.uint8).reshape(-1, 8).astype(np.int64)
        for k, plane in enumerate(PLANES):
            key = np.full(len(raw), k, np.int64)
            for position in plane:
                key = key << 8 | raw[:, position]
            yield pa.RecordBatch.from_arrays([pa.array(key), fp, node], ["key", "fp", "node"])


def shared_bytes(x: np.ndarray) -> np.ndarray:
    """Zero bytes of each 64-bit value, which are the positional bytes that the two sides of an XOR share."""
    low = np.uint64(0x7F7F7F7F7F7F7F7F)
    return 8 - np.bitwise_count(((x & low) + low | x) & ~low)


def linked(x: np.ndarray) -> np.ndarray:
    """Whether XORs are of pairs that share LEAST_BYTES positional bytes and, of these, differ in MAX_BITS bits at most."""
    out = shared_bytes(x) >= LEAST_BYTES
    out[out] = np.bitwise_count(x[out]) <= MAX_BITS
    return out


def _spanning(fp: np.ndarray, node: np.ndarray, side: np.ndarray, both: bool) -> list[tuple[int, int]]:
    """Links that connect one list as all its links do.  both: compare each with each, else only rows of side 0 with those of side 1."""
    label, out = np.arange(len(fp)), []
    for i in range(len(fp) - 1):
        other = np.flatnonzero(label[i + 1 :] != label[i]) + i + 1
        if not both:
            other = other[side[other] != side[i]]
        near = other[linked(fp[other] ^ fp[i])]
        for root in np.unique(label[near]):
            j = near[label[near] == root][0]
            out.append((int(node[i]), int(node[j])))
            label[label == root] = label[i]
    return out


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by (key, cell); a list may span batches."""
    held: list[np.ndarray] = [np.empty(0, np.int64) for _ in range(5)]

    def within(key, cell, side, fp, node) -> pa.RecordBatch:
        fp = fp.view(np.uint64)
        edge = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (cell[1:] != cell[:-1])]))
        size = np.diff(np.append(edge, len(key)))
        a, b = [], []
        small = np.repeat(size <= SMALL, size)
        group = np.repeat(np.arange(len(size)), size)
        for d in range(1, SMALL):
            i = np.flatnonzero((group[:-d] == group[d:]) & small[:-d]) if len(group) > d else np.empty(0, np.int64)
            if not len(i):
                break
            i = i[(cell[i] < 0) | (cell[i] >> 32 == cell[i] & 0xFFFFFFFF) | (side[i] != side[i + d])]
            i = i[linked(fp[i] ^ fp[i + d])]
            a.append(node[i])
            b.append(node[i + d])
        for k in np.flatnonzero(size > SMALL):
            s = slice(edge[k], edge[k] + size[k])
            c = int(cell[edge[k]])
            found = _spanning(fp[s], node[s], side[s], c < 0 or c >> 32 == c & 0xFFFFFFFF)
            a.append(np.array([x for x, _ in found], np.int64))
            b.append(np.array([y for _, y in found], np.int64))
        cat = lambda x: pa.array(np.concatenate(x) if x else np.empty(0, np.int64), pa.int64())
        return pa.RecordBatch.from_arrays([cat(a), cat(b)], ["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        held = [np.concatenate([h, batch.column(k).to_numpy(zero_copy_only=False)]) for k, h in enumerate(held)]
        change = np.flatnonzero((held[0][1:] != held[0][:-1]) | (held[1][1:] != held[1][:-1]))
        if len(change):
            cut = change[-1] + 1
            yield within(*[h[:cut] for h in held])
            held = [h[cut:] for h in held]
    if len(held[0]):
        yield within(*held)


def links(classes: DataFrame) -> DataFrame:
    """Links (a, b) of ``classes`` (fp, node), one row per distinct fingerprint; enough to connect all that are linked."""
    postings = classes.select("fp", "node").mapInArrow(_postings, "key long, fp long, node long")
    long_lists = saved(postings.groupBy("key").count().where(F.col("count") > BLOCK).select("key", F.ceil(F.col("count") / BLOCK).alias("blocks")), "long-lists")
    plain = postings.select("key", F.lit(-1).cast("long").alias("cell"), F.lit(0).cast("long").alias("side"), "fp", "node")
    if not long_lists.isEmpty():
        mine = F.pmod(F.xxhash64("fp"), F.col("blocks"))
        dealt = postings.join(long_lists, "key").withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        cell = F.shiftleft(F.least("mine", "other"), 32).bitwiseOR(F.greatest("mine", "other"))
        dealt = dealt.select("key", cell.alias("cell"), (F.col("mine") > F.col("other")).cast("long").alias("side"), "fp", "node")
        plain = plain.join(long_lists, "key", "left_anti").unionByName(dealt)
    ordered = plain.repartition("key", "cell").sortWithinPartitions("key", "cell").select("key", "cell", "side", "fp", "node")
    return ordered.mapInArrow(_links, "a long, b long")


def near_duplicates(docs: DataFrame, width: int = 3) -> DataFrame:
    """(doc_id, fingerprint, component_id) for each row.

    Null and empty texts have fingerprint zero and link as any other.  Equal doc_ids are separate
    rows of the result.  An empty table gives none.  Columns besides doc_id and text are not read.
    """
    prints = saved(fingerprints(docs, width), "fingerprints")
    classes = saved(prints.groupBy("fp").agg(F.min("doc_id").alias("node")).where("node is not null"), "classes")
    found = components(links(classes))
    named = classes.join(found, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    return prints.join(named, "fp", "left").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
