"""Language-model scores as marginal likelihoods of a subword lattice.

A word's lattice has every piece of an existing vocabulary that matches somewhere in it, single bytes,
and, if the training text has the word, one arc for the word as a whole.  The forward recursion in log
space sums all segmentations:

    P(word) = max(c - d, 0) / N + (d * V / N) * sum over segmentations of the product of piece weights

c is the word's count in training tokens, N all of these, V the distinct ones, d the absolute discount
n1 / (n1 + 2 n2).  Piece weights start from the vocabulary file's own scores and are fitted to the
distinct training words by expected counts (forward-backward); vocabulary and segmentation rules are
never trained.  A text's probability is the product over its words and one end.

Words (``[^\\x20\\x09-\\x0D]+``, A-Z lower-cased) whose training count reaches a threshold are scored
from a table in memory that holds at most ``HELD_WORDS``; all others meet their counts in a shuffle by
word, where each distinct word's lattice is run once.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import words
from .storage import bounded_batches, saved

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
HELD_WORDS = 1 << 18
#: Words of more bytes than this are recursed on one by one, piece matches being looked up for so many bytes at a time.
LONG, CHUNK = 256, 1 << 16
FLUSH = 100_000
PRIOR = 0.5
LN10 = math.log(10)


def load_pieces(path: str = VOCABULARY) -> tuple[list[bytes], np.ndarray]:
    """Pieces as bytes (a leading space opens a word) and log weights that sum to 1.

    A file of ranks (scores 0, -1, -2, ...) gives the weight 1 / (rank + 10), others exp(score).
    Single bytes are pieces, with the weights of the file's byte pieces or the least weight.  Pieces that cannot occur in lower-cased words are left out.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    found: dict[bytes, float] = {}
    n = model.get_piece_size()
    scores = [model.get_score(i) for i in range(n)]
    ranks = all(s == int(s) for s in scores)
    rate = (lambda s: 1 / (10 - s)) if ranks else math.exp
    least = min(rate(s) for s in scores)
    for i in range(n):
        if model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i):
            continue
        raw = model.id_to_piece(i).replace("▁", " ").encode()
        if not raw.strip() and raw != b" " or raw != raw.lower() or b" " in raw[1:]:
            continue
        found[raw] = max(found.get(raw, 0), rate(scores[i]))
    for b in range(256):
        found.setdefault(bytes([b]), least)
    pieces = sorted(found)
    weight = np.array([found[p] for p in pieces])
    return pieces, np.log(weight / weight.sum())


@dataclass
class Arcs:
    """Matches of pieces in a batch of words, in order of (offset, length)."""

    base: np.ndarray
    size: np.ndarray
    start: np.ndarray
    piece: np.ndarray
    length: np.ndarray
    cuts: np.ndarray


class Lattice:
    def __init__(self, pieces: list[bytes], weight: np.ndarray):
        self.weight = weight
        value = np.empty(len(pieces), np.uint64)
        for k, p in enumerate(pieces):
            value[k] = _span_hash(p, np.array([0]), np.array([len(p)]))[0]
        self.order = np.argsort(value)
        self.value = value[self.order]
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[self.value & np.uint64((1 << 20) - 1)] = True
        self.longest = max(map(len, pieces))

    def _arcs(self, batch: list[bytes]) -> Arcs:
        """batch: words with their leading space."""
        size = np.fromiter(map(len, batch), np.int64, len(batch))
        buffer = b"".join(batch)
        base = np.cumsum(size) - size
        word = np.repeat(np.arange(len(batch)), size)
        offset = np.arange(len(buffer)) - base[word]
        left = size[word] - offset
        every, piece, length = [], [], []
        total, inverse = _prefix(buffer)
        for m in range(1, self.longest + 1):
            start = np.flatnonzero(left >= m)
            if not len(start):
                break
            h = words.mixed((total[start + m] - total[start]) * inverse[start])
            on = self.maybe[h & np.uint64((1 << 20) - 1)]
            start, h = start[on], h[on]
            k = np.minimum(np.searchsorted(self.value, h), len(self.value) - 1)
            on = self.value[k] == h
            every.append(start[on])
            piece.append(self.order[k[on]])
            length.append(np.full(int(on.sum()), m))
        start, piece, length = np.concatenate(every), np.concatenate(piece), np.concatenate(length)
        rank = offset[start] * (self.longest + 1) + length
        order = np.argsort(rank, kind="stable")
        cuts = np.flatnonzero(np.diff(rank[order])) + 1
        # states: one more than bytes in each word
        return Arcs(base + np.arange(len(batch)), size, (start + word[start])[order], piece[order], length[order], cuts)

    def _forward(self, a: Arcs, states: int) -> np.ndarray:
        alpha = np.full(states, -np.inf)
        alpha[a.base] = 0.0
        for start, piece, length in zip(np.split(a.start, a.cuts), np.split(a.piece, a.cuts), np.split(a.length, a.cuts), strict=True):
            if len(start):
                end = start + length[0]
                alpha[end] = np.logaddexp(alpha[end], alpha[start] + self.weight[piece])
        return alpha

    def log_marginals(self, batch: list[bytes]) -> np.ndarray:
        """Natural logarithm of each word's summed segmentations; words come without the space."""
        out = np.zeros(len(batch))
        for at, some in _groups(batch):
            a = self._arcs(some)
            out[at] = self._forward(a, int(a.size.sum()) + len(some))[a.base + a.size]
        for k in _long(batch):
            out[k] = self._walk(*self._all_arcs(b" " + batch[k]), len(batch[k]) + 1)[-1]
        return out

    def _all_arcs(self, word: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, piece) of all matches in a word of any length, by start."""
        found = []
        for begin in range(0, len(word), CHUNK):
            a = self._arcs([word[begin : begin + CHUNK + self.longest - 1]])
            on = a.start < CHUNK
            found.append((a.start[on] + begin, a.start[on] + a.length[on] + begin, a.piece[on]))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def _walk(self, start: np.ndarray, end: np.ndarray, piece: np.ndarray, size: int) -> np.ndarray:
        """Forward sums of one word's states from arcs by start."""
        alpha = [-math.inf] * (size + 1)
        alpha[0] = 0.0
        for s, e, w in zip(start.tolist(), end.tolist(), self.weight[piece].tolist(), strict=True):
            x, y = alpha[e], alpha[s] + w
            alpha[e] = max(x, y) + math.log1p(math.exp(-abs(x - y))) if x > -math.inf else y
        return np.array(alpha)

    def expected(self, batch: list[bytes]) -> np.ndarray:
        """Expected count of each piece over all segmentations of the words."""
        out = np.zeros(len(self.weight))
        for _, some in _groups(batch):
            a = self._arcs(some)
            states = int(a.size.sum()) + len(some)
            alpha = self._forward(a, states)
            beta = np.full(states, -np.inf)
            beta[a.base + a.size] = 0.0
            groups = list(zip(np.split(a.start, a.cuts), np.split(a.piece, a.cuts), np.split(a.length, a.cuts), strict=True))
            for start, piece, length in reversed(groups):
                if len(start):
                    beta[start] = np.logaddexp(beta[start], beta[start + length[0]] + self.weight[piece])
            whole = np.repeat(alpha[a.base + a.size], a.size + 1)
            share = np.exp(alpha[a.start] + self.weight[a.piece] + beta[a.start + a.length] - whole[a.start])
            out += np.bincount(a.piece, share, len(out))
        for k in _long(batch):
            size = len(batch[k]) + 1
            start, end, piece = self._all_arcs(b" " + batch[k])
            alpha = self._walk(start, end, piece, size)
            back = np.argsort(-end, kind="stable")
            beta = self._walk(size - end[back], size - start[back], piece[back], size)[::-1]
            out += np.bincount(piece, np.exp(alpha[start] + self.weight[piece] + beta[end] - alpha[-1]), len(out))
        return out


def _groups(batch: list[bytes]) -> Iterator[tuple[list[int], list[bytes]]]:
    """(places, words with their leading space) of words up to LONG bytes, FLUSH at a time."""
    at = [k for k, w in enumerate(batch) if len(w) < LONG]
    for begin in range(0, len(at), FLUSH):
        some = at[begin : begin + FLUSH]
        yield some, [b" " + batch[k] for k in some]


def _long(batch: list[bytes]) -> list[int]:
    return [k for k, w in enumerate(batch) if len(w) >= LONG]


def _prefix(buffer: bytes) -> tuple[np.ndarray, np.ndarray]:
    power, inverse = words._powers(len(buffer) + 1)
    total = np.zeros(len(buffer) + 1, np.uint64)
    np.cumsum(words._MIX[np.frombuffer(buffer, np.uint8)] * power[: len(buffer)], out=total[1:])
    return total, inverse


def _span_hash(buffer: bytes, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    total, inverse = _prefix(buffer)
    return words.mixed((total[end] - total[start]) * inverse[start])


@dataclass(frozen=True)
class Model:
    """What the corpus gave: N, V, training documents, discount, held words' threshold, the count table and fitted piece weights."""

    tokens: int
    distinct: int
    ends: int
    discount: float
    held_from: int
    counts: DataFrame
    pieces: list[bytes]
    weight: np.ndarray


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: Counter = Counter()

    def flush() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.binary()), pa.array(held.values(), pa.int64())], ["word", "c"])
        held.clear()
        return out

    for batch in batches:
        for text in batch.column(0).to_pylist():
            held.update(words.as_bytes(text, True).split())
            if len(held) > 300_000:
                yield flush()
    yield flush()


def fit(docs: DataFrame, training: Column, vocabulary: str = VOCABULARY, held_words: int = HELD_WORDS, rounds: int = 2) -> Model:
    """Count the words of all training rows and fit piece weights to all distinct ones."""
    spark = docs.sparkSession
    bounded_batches(spark)
    chosen = docs.where(training).select(F.col("text").cast("string"))
    counts = saved(chosen.mapInArrow(_count_words, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c")), "word-counts")
    ends = docs.where(training).count()
    # words by count: a table of as many rows as there are different counts, at most about sqrt(2 N)
    by_count = sorted(((r["c"], r["n"]) for r in counts.groupBy("c").agg(F.count("*").alias("n")).collect()), reverse=True)
    tokens, distinct = sum(c * n for c, n in by_count) + ends, sum(n for _, n in by_count) + (ends > 0)
    n1, n2 = (dict(by_count).get(k, 0) + (ends == k) for k in (1, 2))
    discount = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
    held_from, held = (by_count[0][0] + 1 if by_count else 1), 0
    for c, n in by_count:
        if held + n > held_words:
            break
        held_from, held = c, held + n
    pieces, weight = load_pieces(vocabulary)
    for _ in range(rounds if distinct > 1 else 0):
        sent = spark.sparkContext.broadcast((pieces, weight))

        def kernel(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            lattice, waiting = Lattice(*sent.value), []
            total = np.zeros(len(lattice.weight))
            for batch in batches:
                waiting += batch.column(0).to_pylist()
                if len(waiting) >= FLUSH:
                    total += lattice.expected(waiting)
                    waiting = []
            if waiting:
                total += lattice.expected(waiting)
            on = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(on, pa.int64()), pa.array(total[on])], ["piece", "n"])

        found = counts.select("word").mapInArrow(kernel, "piece long, n double").groupBy("piece").agg(F.sum("n").alias("n")).collect()
        prior = np.exp(weight)
        fitted = PRIOR * len(pieces) * prior
        for k, n in found:
            fitted[k] += n
        weight = np.log(fitted / fitted.sum())
    return Model(tokens, distinct, ends, discount, held_from, counts, pieces, weight)


def log10_probability(c: np.ndarray, marginal: np.ndarray, tokens: int, distinct: int, discount: float) -> np.ndarray:
    """log10 P(word) from training counts and the lattices' natural log marginals."""
    with np.errstate(divide="ignore"):
        known = np.log(np.maximum(c - discount, 0) / max(tokens, 1))
        rest = math.log(discount * distinct / tokens) if tokens else 0.0
    return np.logaddexp(known, rest + marginal) / LN10


def base_log10(c: np.ndarray, tokens: int, distinct: int) -> np.ndarray:
    return np.log10((c + 0.5) / (tokens + 0.5 * (distinct + 1)))


_PARTIAL = "word binary, doc_id long, mark long, kind int, n_tokens long, n_known long, base double, score double"
_KINDS = [pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
_NAMES = [c.split()[0] for c in _PARTIAL.split(", ")]


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, n_tokens, n_known, base_score, score) for each row.

    Null and empty texts are one end.  Rows equal in doc_id and text give equal results, each its own
    row.  An empty training set gives the lattice alone; an empty table no rows.
    """
    spark = docs.sparkSession
    n, v, d = model.tokens, model.distinct, model.discount
    held = [(bytes(r["word"]), r["c"]) for r in model.counts.where(F.col("c") >= model.held_from).collect()]
    sent = spark.sparkContext.broadcast((held, model.pieces, model.weight))
    ends = model.ends
    end_score = float(np.log10(max(ends - d, 0) / n)) if n and ends > d else (float(np.log10(max(n, 1) ** -1 * 0.5)))
    end_base = float(base_log10(np.array([ends]), n, v)[0])

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, base, good = _held_table(sent, n, v, d)
        get = number.get
        for batch in batches:
            ids, marks = batch.column(0), batch.column(1)
            for begin, raw in words.slices(batch.column(2).to_pylist(), lower=True):
                each = [t.split() for t in raw]
                sizes = np.fromiter(map(len, each), np.int64, len(each))
                at = np.fromiter((get(w, -1) for t in each for w in t), np.int64, int(sizes.sum()))
                doc = np.repeat(np.arange(len(each)), sizes)
                on = at >= 0
                sums = [np.bincount(doc[on], x, len(each)) for x in (base[at[on]], good[at[on]])]
                known = np.bincount(doc[on], minlength=len(each))
                mine, mark = ids.slice(begin, len(raw)), marks.slice(begin, len(raw))
                # a key that no word has, spread over all partitions
                keys = pa.array([b" %d" % (x or 0) for x in mark.to_pylist()], pa.binary())
                yield _partial([keys, mine, mark, np.zeros(len(each), np.int32), sizes + 1, known + (ends > 0), sums[0] + end_base, sums[1] + end_score])
                off = np.flatnonzero(~on)
                if len(off):
                    flat = [w for t in each for w in t]
                    rest = Counter(zip(doc[off].tolist(), (flat[i] for i in off.tolist()), strict=True))
                    take = pa.array([k for k, _ in rest], pa.int64())
                    m = len(rest)
                    yield _partial([[w for _, w in rest], mine.take(take), mark.take(take), np.full(m, 2, np.int32), np.fromiter(rest.values(), np.int64, m), np.zeros(m, np.int64), np.zeros(m), np.zeros(m)])

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(model_pieces := sent.value[1], sent.value[2])
        del model_pieces
        waiting: list[pa.RecordBatch] = []
        rows, carry = 0, (None, 0)
        for batch in batches:
            waiting.append(batch)
            rows += batch.num_rows
            if rows >= FLUSH:
                out, carry = _rated(waiting, lattice, carry, n, v, d)
                yield out
                waiting, rows = [], 0
        if waiting:
            yield _rated(waiting, lattice, carry, n, v, d)[0]

    bounded_batches(spark)
    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64("doc_id", "text").alias("mark"), F.col("text").cast("string"))
    partial = rows.mapInArrow(first, _PARTIAL)
    rare = model.counts.where(F.col("c") < model.held_from).select("word", F.lit(None).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("mark"), F.lit(1).alias("kind"), F.lit(0).cast("long").alias("n_tokens"), F.col("c").alias("n_known"), F.lit(0.0).alias("base"), F.lit(0.0).alias("score"))
    met = partial.unionByName(rare).repartition("word").sortWithinPartitions("word", "kind")
    sums = met.mapInArrow(second, "doc_id long, mark long, copies long, n_tokens long, n_known long, base double, score double")
    out = sums.groupBy("doc_id", "mark").agg(*[F.sum(c).alias(c) for c in ("copies", "n_tokens", "n_known", "base", "score")])
    out = out.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    each = lambda c: (F.col(c) / F.col("copies"))
    return out.select("doc_id", each("n_tokens").cast("long").alias("n_tokens"), each("n_known").cast("long").alias("n_known"), each("base").alias("base_score"), each("score").alias("score"))


_HELD: dict = {}


def _held_table(sent, n: int, v: int, d: float) -> tuple[dict[bytes, int], np.ndarray, np.ndarray]:
    """Numbers of the held words, their base and model scores; built once for a worker."""
    key = (sent._jbroadcast.id() if getattr(sent, "_jbroadcast", None) else getattr(sent, "_path", id(sent)), n, v)
    if _HELD.get("key") != key:
        held, pieces, weight = sent.value
        c = np.array([x for _, x in held], float)
        marginal = Lattice(pieces, weight).log_marginals([w for w, _ in held]) if held else np.zeros(0)
        _HELD.clear()
        _HELD.update(key=key, table=({w: i for i, (w, _) in enumerate(held)}, base_log10(c, n, v), log10_probability(c, marginal, n, v, d)))
    return _HELD["table"]


def _partial(columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, k) for c, k in zip(columns, _KINDS, strict=True)], _NAMES)


def _rated(waiting: list[pa.RecordBatch], lattice: Lattice, carry: tuple, n: int, v: int, d: float) -> tuple[pa.RecordBatch, tuple]:
    """Sums for rows sorted by (word, kind): kind 0 is a text's sums so far, 1 a training count, 2 a text's word.  carry: the last word and its count."""
    t = pa.Table.from_batches(waiting)
    kind = t.column("kind").to_numpy()
    own = np.flatnonzero(kind == 0)
    rest = np.flatnonzero(kind != 0)
    word = t.column("word").take(pa.array(rest)).to_pylist()
    change = np.ones(len(rest), bool)
    if len(rest):
        change[1:] = [a != b for a, b in zip(word, word[1:], strict=False)]
    group = np.cumsum(change) - 1
    distinct = [word[i] for i in np.flatnonzero(change).tolist()]
    c = np.zeros(len(distinct))
    if distinct and carry[0] == distinct[0]:
        c[0] = carry[1]
    counted = kind[rest] == 1
    np.add.at(c, group[counted], t.column("n_known").to_numpy()[rest[counted]])
    used = np.flatnonzero(kind[rest] == 2)
    need = np.unique(group[used])
    marginal = np.zeros(len(distinct))
    if len(need):
        marginal[need] = lattice.log_marginals([distinct[k] for k in need.tolist()])
    good, base = log10_probability(c, marginal, n, v, d), base_log10(c, n, v)
    after = (distinct[-1], c[-1]) if distinct else carry
    rows, g = rest[used], group[used]
    times = t.column("n_tokens").to_numpy()[rows]
    at = pa.array(np.concatenate([own, rows]))
    col = lambda name: t.column(name).to_numpy()[own]
    both = lambda a, b, kind: pa.array(np.concatenate([a, b]), kind)
    ids = t.column("doc_id").take(at).combine_chunks()
    marks = t.column("mark").take(at).combine_chunks()
    zero = np.zeros(len(rows), np.int64)
    out = pa.RecordBatch.from_arrays([
        ids, marks, both(np.ones(len(own), np.int64), zero, pa.int64()), both(col("n_tokens"), zero, pa.int64()),
        both(col("n_known"), np.where(c[g] > 0, times, 0), pa.int64()), both(col("base"), base[g] * times, pa.float64()), both(col("score"), good[g] * times, pa.float64()),
    ], ["doc_id", "mark", "copies", "n_tokens", "n_known", "base", "score"])
    return out, after


def held_out(remainder: int) -> Column:
    """crc32 of doc_id as text, mod 5, equals ``remainder``; a null id counts as the text ''."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == remainder


def documents_scored(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """The digest: fit on rows whose remainder is not 1, score all rows."""
    model = fit(docs, ~held_out(1), vocabulary)
    return score(docs, model).select("doc_id", held_out(1).alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")
