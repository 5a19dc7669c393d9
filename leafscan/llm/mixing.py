"""Mixing sources to target weights by iterative proportional fitting.

Documents fall into cells of (source, language, topic); the table of token sums by cell is raked:
cell weights are scaled to the target shares of sources, then of languages, then of topics, again and
again until all three hold.  A cell's fitted tokens over its own tokens are its documents' weight.
Divided by the largest weight it is the probability with which each document is kept, so that the
kept tokens have the target shares in expectation.  The draw is a hash of the document's id.

The topic of a text, where no column names one, is learned from all texts: spherical k-means over
hashed word counts, which are stored once.  Word rarities and each pass's centres are sums over every
text, in whole numbers, so they are the same for the same rows in any order.  Only where the centres
begin is drawn: in ``DRAWS`` rounds texts are drawn among all, those far from the earlier ones more
often, and of these the ones that all texts are nearest to are taken (k-means||).  Every text is then
assigned to the centre it is nearest to (ties: the lesser number; texts without words: topic 0).
"""

from __future__ import annotations

import math
import warnings
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words
from .storage import bounded_batches, discard, saved

DIMENSIONS = ("source", "lang", "topic")
NONE = "(none)"
#: Cell tables up to this many rows are raked on the driver, larger ones as a table.
HELD_CELLS = 100_000
#: Words are hashed to FEATURES; passes over all texts at most, fewer if the centres stay.
FEATURES, PASSES = 4096, 12
#: Rounds that texts to begin with are drawn in; the whole number that stands for 1 in sums over texts.
DRAWS, UNIT = 3, 1 << 30


@dataclass(frozen=True)
class Targets:
    """Shares by dimension.  Where a dimension has none, its shares in the data are tempered: ``share ** power``, scaled to 1.

    Learned topics without shares get those that the languages' targets imply: texts of one topic are
    often of one language, and tempering both apart would ask for what no weights can give.
    Given shares need not sum to 1; values that have no tokens are passed over, values without a share get 0.
    """

    shares: dict[str, dict[str, float]] = field(default_factory=dict)
    power: float = 0.7
    tolerance: float = 1e-9
    rounds: int = 500


def _counts(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, hashed word, count) of all texts, by text, and the number of words of each."""
    w = words.split(raw)
    code = np.sort(w.document() * FEATURES + (w.hash % np.uint64(FEATURES)).astype(np.int64))
    first = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]])) if len(code) else np.empty(0, np.int64)
    return code[first] // FEATURES, code[first] % FEATURES, np.diff(np.append(first, len(code))), np.diff(w.first)


_COUNTED = "doc_id long, source string, lang string, n_tokens long, word binary, n binary"


def _pieces(flat: np.ndarray, first: np.ndarray) -> pa.Array:
    """``flat[first[k]:first[k + 1]]`` as bytes for each k."""
    return pa.Array.from_buffers(pa.binary(), len(first) - 1, [None, pa.py_buffer((first * flat.itemsize).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(flat))])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows with the number of words, and the hashed words of the whole text (2 bytes each) with their counts (4 bytes each)."""
    for batch in batches:
        for begin, raw in words.slices(batch.column(3).to_pylist(), lower=True):
            owner, word, n, total = _counts(raw)
            first = np.searchsorted(owner, np.arange(len(raw) + 1))
            own = [c.slice(begin, len(raw)) for c in batch.columns[:3]]
            yield pa.RecordBatch.from_arrays([*own, pa.array(total, pa.int64()), _pieces(word.astype("<u2"), first), _pieces(n.astype("<u4"), first)], [x.split()[0] for x in _COUNTED.split(", ")])


def _vectors(word: list[bytes], n: list[bytes], rarity: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, hashed word, value) of all texts; the values of a text have norm 1, or are 0."""
    owner = np.repeat(np.arange(len(word)), np.fromiter(map(len, word), np.int64, len(word)) // 2)
    at = np.frombuffer(b"".join(word), "<u2").astype(np.int64)
    x = np.log1p(np.frombuffer(b"".join(n), "<u4").astype(np.float64)) * rarity[at]
    norm = np.sqrt(np.bincount(owner, x * x, len(word)))
    return owner, at, x / np.maximum(norm, 1e-9)[owner]


def _near(owner: np.ndarray, at: np.ndarray, x: np.ndarray, texts: int, centre: np.ndarray) -> np.ndarray:
    """Cosine of each text with each row of ``centre``; the same wherever the text lies."""
    out = np.empty((texts, len(centre)))
    for k, c in enumerate(centre):
        out[:, k] = np.bincount(owner, x * c[at], texts)
    return np.round(out, 9)


def _summed(counted: DataFrame, each, shape: tuple[int, int]) -> np.ndarray:
    """The sum over all texts of the whole numbers that ``each(word, n)`` gives for those of a batch; a task sends one table of ``shape``."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape[0] * shape[1], np.int64)
        for batch in batches:
            total += each(batch.column(0).to_pylist(), batch.column(1).to_pylist())
        on = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(on.astype(np.int32)), pa.array(total[on])], ["cell", "total"])

    out = np.zeros(shape[0] * shape[1], np.int64)
    for r in counted.select("word", "n").mapInArrow(kernel, "cell int, total long").groupBy("cell").agg(F.sum("total").alias("total")).collect():
        out[r["cell"]] = r["total"]
    return out.reshape(shape)


def _drawn(counted: DataFrame, rarity: np.ndarray, centre: np.ndarray, count: int, turn: int) -> list[tuple[bytes, bytes]]:
    """``count`` texts, each with a chance in proportion to its distance from the nearest row of ``centre``."""
    sent = counted.sparkSession.sparkContext.broadcast((rarity, centre))
    draw = (F.shiftrightunsigned(F.xxhash64(F.lit(17 + turn), "doc_id", "word", "n"), 11) + F.lit(0.5)) / F.lit(float(2**53))

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rarity, centre = sent.value
        held: list[tuple[float, bytes, bytes]] = []
        for batch in batches:
            word, n = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            owner, at, x = _vectors(word, n, rarity)
            far = 1 - _near(owner, at, x, len(word), centre).max(axis=1, initial=0)
            far[np.bincount(owner, x, len(word)) == 0] = 0
            wait = np.divide(-np.log(batch.column(0).to_numpy()), far, out=np.full(len(word), np.inf), where=far > 1e-9)
            first = np.argsort(wait, kind="stable")[:count]
            held = sorted(held + [(float(wait[k]), word[k], n[k]) for k in first[np.isfinite(wait[first])].tolist()])[:count]
        kinds = [pa.float64(), pa.binary(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in held], kind) for k, kind in enumerate(kinds)], ["wait", "word", "n"])

    rows = counted.select(draw.alias("draw"), "word", "n").mapInArrow(kernel, "wait double, word binary, n binary").orderBy("wait", "word", "n").limit(count).collect()
    return [(bytes(r["word"]), bytes(r["n"])) for r in rows]


def _begun(counted: DataFrame, rarity: np.ndarray, topics: int) -> np.ndarray:
    """topics x FEATURES: texts that the others are near to; rows of 0 where there are fewer texts."""
    texts: dict[tuple[bytes, bytes], None] = {}
    tried = np.zeros((0, FEATURES))
    for turn in range(DRAWS):
        texts |= dict.fromkeys(_drawn(counted, rarity, tried, 2 * topics, turn))
        tried = np.zeros((len(texts), FEATURES))
        owner, at, x = _vectors([w for w, _ in texts], [n for _, n in texts], rarity)
        tried[owner, at] = x
    out = np.zeros((topics, FEATURES))
    if not len(tried):
        return out
    sent = counted.sparkSession.sparkContext.broadcast((rarity, tried))

    def nearest(word: list[bytes], n: list[bytes]) -> np.ndarray:
        rarity, tried = sent.value
        owner, at, x = _vectors(word, n, rarity)
        return np.bincount(np.argmax(_near(owner, at, x, len(word), tried), axis=1), minlength=len(tried))

    weight = _summed(counted, nearest, (1, len(tried)))[0]
    like, near = np.round(tried @ tried.T, 9), np.zeros(len(tried))
    for k in range(min(topics, len(tried))):  # each next one is that which brings all texts nearest
        gain = np.maximum(like, near) @ weight
        best = int(np.argmax(gain))
        out[k], near = tried[best], np.maximum(near, like[best])
        like[best] = 0
    return out


def learned(counted: DataFrame, topics: int) -> tuple[np.ndarray, np.ndarray]:
    """(rarity of each hashed word, topics x FEATURES centres) of all texts; the same for the same rows in any order."""

    def having(word: list[bytes], n: list[bytes]) -> np.ndarray:
        return np.append(np.bincount(np.frombuffer(b"".join(word), "<u2"), minlength=FEATURES), sum(map(bool, word)))

    *texts, total = _summed(counted, having, (1, FEATURES + 1))[0].tolist()
    rarity = np.log((1 + total) / (1 + np.array(texts)))
    if topics < 2 or not total:
        return rarity, np.zeros((topics, FEATURES))
    centre = _begun(counted, rarity, topics)
    for _ in range(PASSES):
        sent = counted.sparkSession.sparkContext.broadcast((rarity, centre))

        def members(word: list[bytes], n: list[bytes], sent=sent) -> np.ndarray:
            rarity, centre = sent.value
            owner, at, x = _vectors(word, n, rarity)
            of = np.argmax(_near(owner, at, x, len(word), centre), axis=1)
            return np.bincount(of[owner] * FEATURES + at, np.rint(x * UNIT), centre.size).astype(np.int64)

        mean = _summed(counted, members, centre.shape).astype(np.float64)
        norm = np.linalg.norm(mean, axis=1, keepdims=True)
        after = np.where(norm > 0, mean / np.maximum(norm, 1), centre)
        sent.unpersist()
        if (after == centre).all():
            break
        centre = after
    return rarity, centre


def facts(docs: DataFrame, topics: int = 8, topic: str | None = None) -> DataFrame:
    """(doc_id, source, lang, topic, n_tokens), stored: words of the whole text; null names become ``(none)``."""
    bounded_batches(docs.sparkSession)
    schema = "doc_id long, source string, lang string, topic string, n_tokens long"
    names = [x.split()[0] for x in schema.split(", ")]
    named = [F.coalesce(F.col(c).cast("string"), F.lit(NONE)).alias(c) for c in ("source", "lang")]
    held = docs.select(F.col("doc_id").cast("long"), *named, F.col("text").cast("string"), *([F.col(topic).cast("string").alias("topic")] if topic else []))
    if topic:

        def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for begin, raw in words.slices(batch.column(3).to_pylist()):
                    own = [c.slice(begin, len(raw)) for c in batch.columns]
                    yield pa.RecordBatch.from_arrays([*own[:3], own[4].fill_null(NONE), pa.array(np.diff(words.split(raw, False).first), pa.int64())], names)

        return saved(held.mapInArrow(told, schema), "facts")
    counted = saved(held.mapInArrow(_counted, _COUNTED), "counted")
    sent = docs.sparkSession.sparkContext.broadcast(learned(counted, topics))

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rarity, centre = sent.value
        for batch in batches:
            owner, at, x = _vectors(batch.column(4).to_pylist(), batch.column(5).to_pylist(), rarity)
            of = np.argmax(_near(owner, at, x, batch.num_rows, centre), axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(map(str, of.tolist()), pa.string()), batch.column(3)], names)

    out = saved(counted.mapInArrow(found, schema), "facts")
    discard(counted)
    return out


def target_shares(totals: dict[str, float], given: dict[str, float] | None, power: float) -> dict[str, float]:
    """Shares of the values that have tokens, summing to 1."""
    total = sum(totals.values())
    raw = {v: (given.get(v, 0.0) if given is not None else (n / total) ** power) for v, n in totals.items() if n > 0}
    whole = sum(raw.values())
    if whole <= 0:
        raise ValueError("no value with tokens has a target share")
    return {v: s / whole for v, s in raw.items()}


def rake(cells: list[tuple], targets: Targets) -> tuple[np.ndarray, float]:
    """Factor of each (source, lang, topic, tokens) cell, and the largest miss of a share at the end."""
    tokens = np.array([c[3] for c in cells], float)
    codes, shares = [], []
    for k, name in enumerate(DIMENSIONS):
        values = sorted({c[k] for c in cells})
        number = {v: i for i, v in enumerate(values)}
        codes.append(np.array([number[c[k]] for c in cells]))
        sums = np.bincount(codes[k], tokens, len(values))
        wanted = target_shares(dict(zip(values, sums.tolist(), strict=True)), targets.shares.get(name), targets.power)
        shares.append(np.array([wanted.get(v, 0.0) for v in values]))
    factor, miss = np.full(len(cells), 1 / max(tokens.sum(), 1)), math.inf
    for _ in range(targets.rounds):
        miss = 0.0
        for code, share in zip(codes, shares, strict=True):
            now = np.bincount(code, tokens * factor, len(share))
            miss = max(miss, float(np.abs(now - share).max()))
            factor = factor * np.divide(share, now, out=np.zeros_like(share), where=now > 0)[code]
        if miss < targets.tolerance:
            break
    return factor, miss


def _implied(cells: DataFrame, targets: Targets) -> dict[str, float]:
    """Shares of the topics when each language has its target and its own topics keep their shares in it."""
    total = cells.agg(F.sum("tokens")).first()[0]
    sums = cells.groupBy("lang").agg(F.sum("tokens").alias("m")).where("m > 0")
    if "lang" in targets.shares:
        given = cells.sparkSession.createDataFrame(list(targets.shares["lang"].items()), "lang string, raw double")
        sums = sums.join(given, "lang").select("lang", "m", "raw")
    else:
        sums = sums.withColumn("raw", F.pow(F.col("m") / F.lit(total), F.lit(targets.power)))
    each = cells.groupBy("lang", "topic").agg(F.sum("tokens").alias("n")).join(sums, "lang")
    rows = each.groupBy("topic").agg(F.sum(F.col("raw") * F.col("n") / F.col("m")).alias("share")).collect()
    return {r["topic"]: r["share"] for r in rows}


def _rake_table(cells: DataFrame, targets: Targets) -> tuple[DataFrame, float]:
    """The same on a table of any size: each step is an aggregate and a join on one dimension."""
    shares = {}
    for name in DIMENSIONS:
        sums = cells.groupBy(name).agg(F.sum("tokens").alias("n")).where("n > 0")
        if name in targets.shares:
            given = cells.sparkSession.createDataFrame(list(targets.shares[name].items()), f"{name} string, raw double")
            raw = sums.join(given, name, "left").select(name, F.coalesce("raw", F.lit(0.0)).alias("raw"))
        else:
            total = sums.agg(F.sum("n")).first()[0]
            raw = sums.select(name, F.pow(F.col("n") / F.lit(total), F.lit(targets.power)).alias("raw"))
        whole = raw.agg(F.sum("raw")).first()[0]
        shares[name] = saved(raw.select(name, (F.col("raw") / F.lit(whole)).alias("share")), "shares")
    held = saved(cells.withColumn("factor", F.lit(1.0) / F.lit(max(1, cells.agg(F.sum("tokens")).first()[0]))), "rake")
    for _ in range(targets.rounds):
        step, miss = held, []
        for name in DIMENSIONS:
            now = step.groupBy(name).agg(F.sum(F.col("tokens") * F.col("factor")).alias("now")).join(shares[name], name)
            miss.append(now.agg(F.max(F.abs(F.col("now") - F.col("share")))).first()[0] or 0.0)
            scaled = F.when(F.col("now") > 0, F.col("factor") * F.col("share") / F.col("now")).otherwise(F.lit(0.0))
            step = step.join(now, name, "left").select(*DIMENSIONS, "tokens", F.coalesce(scaled, F.lit(0.0)).alias("factor"))
            after = saved(step, "rake")
            discard(held)
            step = held = after
        if max(miss) < targets.tolerance:
            break
    return held, max(miss)


def mix(docs: DataFrame, targets: Targets = Targets(), topics: int = 8, topic: str | None = None, seed: int = 5, held_cells: int = HELD_CELLS) -> DataFrame:
    """One row per document: its cell, tokens, weight, probability, whether it is kept, and ``miss``.

    ``miss`` is the largest deviation of a share from its target when raking ended; if that is over the
    tolerance (targets that contradict each other, too few rounds) a warning tells it as well.  A text
    without words has no tokens and takes its cell's probability (0 in a cell without tokens).  Rows
    with equal ids share a draw.  Long texts are read whole.  An empty table gives none.  Columns
    besides doc_id, source, lang, text and the topic's are not read, whatever their names.
    """
    spark = docs.sparkSession
    held = facts(docs, topics, topic)
    cells = saved(held.groupBy(*DIMENSIONS).agg(F.sum("n_tokens").alias("tokens")), "cells")
    miss = 0.0
    some = cells.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0] > 0
    if some and topic is None and "topic" not in targets.shares:
        targets = replace(targets, shares=targets.shares | {"topic": _implied(cells, targets)})
    if not some:
        rated = cells.withColumn("factor", F.lit(0.0))
    elif cells.count() <= held_cells:
        rows = [tuple(r) for r in cells.orderBy(*DIMENSIONS).collect()]
        factor, miss = rake(rows, targets)
        rated = spark.createDataFrame([(*r, float(f)) for r, f in zip(rows, factor, strict=True)], "source string, lang string, topic string, tokens long, factor double")
    else:
        rated, miss = _rake_table(cells, targets)
    if miss >= targets.tolerance:
        warnings.warn(f"raking ended {miss:.2e} off its targets", stacklevel=2)
    most = rated.where("tokens > 0").agg(F.max("factor")).first()[0] or 1.0
    rated = rated.select(*DIMENSIONS, "factor", F.when(F.col("tokens") > 0, F.col("factor") / F.lit(most)).otherwise(F.lit(0.0)).alias("probability"))
    draw = F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id"), 11) / F.lit(float(2**53))
    total = F.lit(float(max(1, cells.agg(F.sum("tokens")).first()[0] or 1)))
    out = held.join(rated, list(DIMENSIONS), "left")
    return out.select("doc_id", *DIMENSIONS, "n_tokens", (F.col("factor") * total).alias("weight"), "probability", (draw < F.col("probability")).alias("kept"), F.lit(float(miss)).alias("miss"))
