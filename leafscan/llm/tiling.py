"""Benchmark decontamination by greedy string tiling.

Words (``[^\\x20\\x09-\\x0D]+``, A-Z lower-cased) of documents and test items are hashed.  Documents and
items that share a seed of five words meet in a join; each pair is then tiled: the longest matches
that overlap no marked word are found by running Karp-Rabin over falling lengths and marked, down to
tiles of five words.  The share of an item's words that are marked is its coverage.  Order plays no
part, so reordered passages are caught.  An item covered to ``coverage`` or more has leaked.

Benchmark items under five words have no seed and never match.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words
from .storage import bounded_batches

SEED_WORDS = 5
COVERAGE = 0.6
#: Test sets up to this many bytes are held by every task; larger ones are joined by shuffle.
HELD_BYTES = 32 << 20
FIRST_LENGTH = 32

PAIRS = "doc_id long, item_id long, item_words long, tiled_words long, n_tiles int, longest_tile int, coverage double"


def _windows(tokens: list[int], free: list[bool], length: int) -> Iterator[tuple[int, int]]:
    """(Karp-Rabin hash, position) of each window of free tokens."""
    base, modulus = 1_000_003, (1 << 61) - 1
    top = pow(base, length - 1, modulus)
    run = value = 0
    for i, token in enumerate(tokens):
        if not free[i]:
            run = value = 0
            continue
        if run >= length:
            value = (value - tokens[i - length] * top) % modulus
        value = (value * base + token) % modulus
        run += 1
        if run >= length:
            yield value, i - length + 1


def tiles(item: list[int], text: list[int], least: int = SEED_WORDS) -> list[tuple[int, int, int]]:
    """Non-overlapping (position in item, position in text, length), longest first, then leftmost in the item, then in the text."""
    free_item, free_text, out = [True] * len(item), [True] * len(text), []
    length = max(least, min(FIRST_LENGTH, len(item), len(text)))
    while True:
        index: dict[int, list[int]] = defaultdict(list)
        for value, i in _windows(item, free_item, length):
            index[value].append(i)
        found: list[tuple[int, int, int]] = []
        longest = 0
        if index:
            for value, j in _windows(text, free_text, length):
                for i in index.get(value, ()):
                    if i and j and free_item[i - 1] and free_text[j - 1] and item[i - 1] == text[j - 1]:
                        continue  # part of the match that begins before it
                    n = 0
                    while i + n < len(item) and j + n < len(text) and free_item[i + n] and free_text[j + n] and item[i + n] == text[j + n]:
                        n += 1
                    if n >= length:
                        found.append((i, j, n))
                        longest = max(longest, n)
        if longest > 2 * length:
            length = longest
            continue
        again = False
        for i, j, n in sorted(found, key=lambda m: (-m[2], m[0], m[1])):
            if all(free_item[i : i + n]) and all(free_text[j : j + n]):
                free_item[i : i + n] = free_text[j : j + n] = [False] * n
                out.append((i, j, n))
            else:
                again = True  # what is left of it may still hold a match of this length
        if again:
            continue
        if length <= least:
            return out
        length = max(least, length // 2)


def _tokens(texts: list[str | None]) -> tuple[words.Words, np.ndarray, np.ndarray]:
    w = words.split([words.as_bytes(t, True) for t in texts])
    seeds, whole = w.shingles(SEED_WORDS)
    return w, seeds, whole


class Items:
    """Test items in memory: token hashes, and the seeds' items."""

    def __init__(self, ids: list[int], texts: list[str | None]):
        w, seeds, whole = _tokens(texts)
        self.ids = ids
        self.tokens = [w.hash[a:b].tolist() for a, b in zip(w.first[:-1], w.first[1:], strict=True)]
        at = np.flatnonzero(whole)
        doc = w.document()[at]
        order = np.argsort(seeds[at], kind="stable")
        self.seeds, first = np.unique(seeds[at][order], return_index=True)
        self.of = np.split(doc[order], first[1:]) if len(first) else []
        self.mask = np.uint64((1 << max(10, min(20, 4 + len(self.seeds).bit_length()))) - 1)
        self.maybe = np.zeros(int(self.mask) + 1, bool)
        self.maybe[self.seeds & self.mask] = True

    def hits(self, seeds: np.ndarray, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions whose seed is in the index, and the seed's number there."""
        at = np.flatnonzero(self.maybe[seeds & self.mask] & whole)
        if not len(at) or not len(self.seeds):
            return at[:0], at[:0]
        k = np.minimum(np.searchsorted(self.seeds, seeds[at]), len(self.seeds) - 1)
        right = self.seeds[k] == seeds[at]
        return at[right], k[right]


def _cover(item: list[int], text: list[int]) -> tuple[int, int, int, int, float]:
    found = tiles(item, text)
    tiled = sum(n for _, _, n in found)
    return len(item), tiled, len(found), max((n for _, _, n in found), default=0), tiled / len(item)


def _shared(tokens: np.ndarray, positions: list[int]) -> list[int]:
    """The words of a text that its seeds at ``positions`` cover, with a break (no word's hash) between runs."""
    out: list[int] = []
    last = -1
    for p in positions:
        if last >= 0 and p > last:
            out.append(-1 - p)
        out += tokens[max(p, last) : p + SEED_WORDS].tolist()
        last = p + SEED_WORDS
    return out


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    names = [c.split()[0] for c in PAIRS.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.float64()]
    columns = list(zip(*rows, strict=True)) if rows else [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


def _against(items: Items, doc_ids: list[int], texts: list[str | None], coverage: float) -> list[tuple]:
    out = []
    for begin, raw in words.slices(texts, lower=True):
        w = words.split(raw)
        at, k = items.hits(*w.shingles(SEED_WORDS))
        if not len(at):
            continue
        doc = np.searchsorted(w.first, at, "right") - 1
        cuts = np.flatnonzero(np.diff(doc)) + 1
        for each, seeds in zip(np.split(at, cuts), np.split(k, cuts), strict=True):
            d = int(np.searchsorted(w.first, each[0], "right") - 1)
            by_item: dict[int, list[int]] = defaultdict(list)
            for p, s in zip(each.tolist(), seeds.tolist(), strict=True):
                for i in items.of[s].tolist():
                    if not by_item[i] or by_item[i][-1] != p:
                        by_item[i].append(p)
            for i, positions in sorted(by_item.items()):
                if len(set(range(SEED_WORDS)).union(*(range(p, p + SEED_WORDS) for p in positions))) < coverage * len(items.tokens[i]):
                    continue  # fewer shared words than coverage needs
                found = _cover(items.tokens[i], _shared(w.hash, positions))
                if found[-1] >= coverage:
                    out.append((doc_ids[begin + d], items.ids[i], *found))
    return out


def leaks(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, held_bytes: int = HELD_BYTES) -> DataFrame:
    """One row per document and test item with the item's coverage at ``coverage`` or more.

    Null and empty texts match nothing; repeated rows of either table give repeated rows; empty
    tables give none.  Other columns are not read.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    size = benchmark.agg(F.sum(F.octet_length("text")), F.count("*")).first()
    if (size[0] or 0) + 64 * size[1] > held_bytes:
        return _joined(docs, benchmark, coverage)
    rows = benchmark.select("item_id", "text").collect()
    sent = spark.sparkContext.broadcast(([r[0] for r in rows], [r[1] for r in rows]))

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = Items(*sent.value)
        for batch in batches:
            yield _rows(_against(items, batch.column(0).to_pylist(), batch.column(1).to_pylist(), coverage))

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(kernel, PAIRS)


def _seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, seed), each seed once per text."""
    for batch in batches:
        for begin, raw in words.slices(batch.column(1).to_pylist(), lower=True):
            w = words.split(raw)
            seeds, whole = w.shingles(SEED_WORDS)
            at = np.flatnonzero(whole)
            ids = batch.column(0).slice(begin, len(raw))
            pairs = np.unique(np.stack([w.document()[at].astype(np.uint64), seeds[at]]), axis=1) if len(at) else np.empty((2, 0), np.uint64)
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(pairs[0].astype(np.int64))), pa.array(pairs[1].view(np.int64))], ["id", "seed"])


def _joined(docs: DataFrame, benchmark: DataFrame, coverage: float) -> DataFrame:
    """The same by joins, for a test set of any size.

    A row is named by a hash of its id and text, so nulls and repeated rows fare as in the other path.
    Each text is met once with all items it shares a seed with (in parts of about a thousand).
    """
    left = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    left = left.withColumn("row", F.xxhash64("doc_id", "text"))
    right = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("item"))
    right = right.withColumn("item_row", F.xxhash64("item_id", "item"))
    mine = left.select("row", "text").mapInArrow(_seeds, "id long, seed long").withColumnRenamed("id", "row")
    theirs = right.select("item_row", "item").mapInArrow(_seeds, "id long, seed long").withColumnRenamed("id", "item_row").distinct()
    pairs = mine.join(theirs, "seed").select("row", "item_row").distinct()
    many = pairs.groupBy("row").count().select("row", F.ceil(F.col("count") / 1000).alias("parts"))
    dealt = pairs.join(many, "row").withColumn("part", F.pmod("item_row", "parts")).join(right, "item_row")
    items = dealt.groupBy("row", "part").agg(F.collect_list(F.struct("item_id", "item")).alias("items"))
    whole = left.join(items, "row").select("doc_id", "text", "items")

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc_id, text, some in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                out += _against(Items([x["item_id"] for x in some], [x["item"] for x in some]), [doc_id], [text], coverage)
            yield _rows(out)

    return whole.mapInArrow(kernel, PAIRS)
