"""Fuzzy line deduplication by MinHash.

A line is a part of a text between ``\\n`` that has a word, without the white space around it.  Equal
lines (by 64-bit XXH3) are one class.  Each class has 70 minimal hashes of its sets of 5 characters
(a shorter line is one set) in 14 bands of 5: a pair of similarity 0.8 shares a band with probability
0.996.  Lines that share a band are compared by exact Jaccard similarity, on
sorted 45-bit hashes of the sets; longer lists report links that connect what they have not connected yet.  Distributed union-find joins the links, and of each component the line
with the least (doc_id, line_no) is kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import BLOCK, bounds, dealt, runs
from .components import components
from .storage import bounded_batches, discard, saved
from .words import SPACES, mixed

WIDTH = 5
BANDS, ROWS = 14, 5
SIMILARITY = 0.8
#: Rows of a band that a task holds to name its list.
LONGEST = 1 << 20
_SLICE = 1 << 18
#: Bits of a set's hash; the bits above number the lines or pairs of a slice.
_BITS = np.uint64(45)
#: Lines that a task keeps in mind in order not to send them twice.
REMEMBERED = 1 << 18
#: Lists up to this long are compared pair by pair, all of a batch at once.
SMALL = 64
#: Bits of a line that tell in advance which pairs are not similar.
MARKS = 2048
#: Bits of a list's number that tell lists with the same least line apart.
LOW = 24
_OWN = np.uint64((1 << LOW) - 1)
_random = np.random.Generator(np.random.PCG64(31))
_FACTOR = _random.integers(0, 2**31, BANDS * ROWS, np.uint32) * np.uint32(2) + np.uint32(1)
_POINT = _random.integers(0, 2**63, 1 << 16, np.uint64)
_BLANK = SPACES.decode()


def lines_of(text: str | None) -> list[tuple[int, str]]:
    """(number of the line in the text from 0, line) of each line that has a word."""
    return [(i, s) for i, line in enumerate((text or "").split("\n")) if (s := line.strip(_BLANK))]


def _name(line: str) -> int:
    """A line's class: its XXH3 as a signed long."""
    h = xxhash.xxh3_64_intdigest(line.encode("utf-8", "surrogatepass"))
    return h - (1 << 64) if h >> 63 else h


def shingles(line: str, width: int = WIDTH) -> set[str]:
    return {line[i : i + width] for i in range(max(1, len(line) - width + 1))}


def similarity(a: set[str], b: set[str]) -> float:
    common = len(a & b)
    return common / (len(a) + len(b) - common)


def _slices(lines: list[str]) -> Iterator[tuple[int, list[str]]]:
    """(place of the first, lines) in slices of about _SLICE characters."""
    begin = 0
    while begin < len(lines):
        end, total = begin, 0
        while end < len(lines) and (end == begin or total + len(lines[end]) < _SLICE):
            total += len(lines[end]) + WIDTH
            end += 1
        yield begin, lines[begin:end]
        begin = end


def _hashes(some: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of every set of WIDTH characters, first of each line, number of each line)."""
    size = np.fromiter(map(len, some), np.int64, len(some))
    points = np.frombuffer("".join(s + "\0" * WIDTH for s in some).encode("utf-32-le", "surrogatepass"), np.uint32)
    base = np.cumsum(size + WIDTH) - size - WIDTH
    h = np.zeros(len(points), np.uint64)
    spread = _POINT[points & 0xFFFF]
    far = np.flatnonzero(points >> 16)
    spread[far] = mixed(points[far].astype(np.uint64))
    for j in range(WIDTH):
        h[: len(h) - j] *= np.uint64(0xD6E8FEB86659FD93)
        h[: len(h) - j] += spread[j:]
    number = np.maximum(1, size - WIDTH + 1)
    first = np.cumsum(number) - number
    at = np.arange(int(number.sum())) + np.repeat(base - first, number)
    return h[at], first, number


def bands_of(lines: list[str]) -> np.ndarray:
    """int64 band keys, BANDS for each line."""
    out = np.empty((len(lines), BANDS), np.int64)
    for begin, some in _slices(lines):
        h, first, _ = _hashes(some)
        value = ((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.uint32)
        least = np.empty((len(some), BANDS * ROWS), np.uint64)
        for k in range(BANDS * ROWS):
            least[:, k] = np.minimum.reduceat(value * _FACTOR[k], first)
        for b in range(BANDS):
            key = np.full(len(some), b + 1, np.uint64)
            for r in range(ROWS):
                key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + least[:, b * ROWS + r])
            out[begin : begin + len(some), b] = key.view(np.int64)
    return out


def _places(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(_BITS-bit hash of the set member at every place of the lines, repeats included; ends of each line's, from 0)."""
    held, amount = [np.empty(0, np.uint64)], [np.zeros(1, np.int64)]
    for _, some in _slices(lines):
        h, _, number = _hashes(some)
        held.append(mixed(h) >> np.uint64(64 - int(_BITS)))
        amount.append(number)
    return np.concatenate(held), np.cumsum(np.concatenate(amount))


def _taken(ends: np.ndarray, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places of the lines ``some``, line by line; ends of each one's, from 0)."""
    n = np.diff(ends)[some]
    last = np.cumsum(n)
    return np.arange(int(n.sum())) + np.repeat(ends[some] - (last - n), n), np.concatenate([[0], last])


def _distinct(h: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct hashes, sorted in each line; ends of each line's, from 0)."""
    held, amount = [np.empty(0, np.uint64)], [np.zeros(1, np.int64)]
    begin = 0
    while begin < len(ends) - 1:
        end = max(begin + 1, int(np.searchsorted(ends, ends[begin] + _SLICE, "right")) - 1)
        owner = np.repeat(np.arange(end - begin, dtype=np.uint64), np.diff(ends[begin : end + 1]))
        both = np.sort(owner << _BITS | h[ends[begin] : ends[end]])
        both = both[np.concatenate([[True], both[1:] != both[:-1]])]
        held.append(both & ((np.uint64(1) << _BITS) - np.uint64(1)))
        amount.append(np.bincount((both >> _BITS).astype(np.int64), minlength=end - begin))
        begin = end
    return np.concatenate(held), np.cumsum(np.concatenate(amount))


def sets_of(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(distinct hashes of the lines' sets of characters, sorted in each line; ends of each line's, from 0)."""
    return _distinct(*_places(lines))


def _marks(h: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """MARKS bits of each line: those that the hashes of its set fall on."""
    out = np.empty((len(ends) - 1, MARKS // 64), np.uint64)
    for begin in range(0, len(out), 1024):
        end = min(begin + 1024, len(out))
        on = np.zeros((end - begin) * MARKS, bool)
        owner = np.repeat(np.arange(end - begin) * MARKS, np.diff(ends[begin : end + 1]))
        on[owner + (h[ends[begin] : ends[end]] % np.uint64(MARKS)).astype(np.int64)] = True
        out[begin:end] = np.packbits(on.reshape(-1, MARKS), axis=1).view(np.uint64)
    return out


def _possible(marks: np.ndarray, number: np.ndarray, i: np.ndarray, j: np.ndarray, limit: float) -> np.ndarray:
    """False only for pairs whose similarity is below ``limit`` by their marks.

    A mark of one line alone is a member of its set that the other has not: so many at least are not
    common, and of a line's ``number`` of places so many fewer can be.
    """
    total = np.bitwise_count(marks).sum(axis=1, dtype=np.int64)
    out = np.empty(len(i), bool)
    for begin in range(0, len(i), 1 << 12):
        a, b = i[begin : begin + (1 << 12)], j[begin : begin + (1 << 12)]
        both = np.bitwise_count(marks[a] & marks[b]).sum(axis=1, dtype=np.int64)
        alone = total[a] - both, total[b] - both
        most = np.minimum(number[a] - alone[0], number[b] - alone[1])
        out[begin : begin + (1 << 12)] = most >= limit * (most + alone[0] + alone[1])
    return out


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The place of every line."""
    for batch in batches:
        found = [(_name(line), doc_id, number) for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for number, line in lines_of(text)]
        columns = list(zip(*found, strict=True)) if found else [[]] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.int32()), strict=True)], ["line", "doc_id", "line_no"])


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(band, line); a line that a task meets again within REMEMBERED others is passed over."""
    seen: set[int] = set()
    for batch in batches:
        fresh: dict[int, str] = {}
        for text in batch.column(0).to_pylist():
            for _, line in lines_of(text):
                name = _name(line)
                if name not in seen:
                    seen.add(name)
                    fresh[name] = line
        keys = bands_of(list(fresh.values()))
        yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.repeat(np.fromiter(fresh, np.int64, len(fresh)), BANDS))], ["band", "line"])
        if len(seen) > REMEMBERED:
            seen.clear()


def _listed(band: np.ndarray, line: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """(list, line) of the whole bands in rows sorted by (band, line)."""
    fresh = np.concatenate([[True], (band[1:] != band[:-1]) | (line[1:] != line[:-1])])[: len(band)]
    band, line = band[fresh], line[fresh]
    edge = np.flatnonzero(np.concatenate([[True], band[1:] != band[:-1]])[: len(band)])
    size = np.diff(np.append(edge, len(band)))
    many = size > 1
    line, edge, size = line[np.repeat(many, size)], edge[many], size[many]
    if not len(size):
        return line, line
    first = np.cumsum(size) - size
    of = mixed(line.view(np.uint64))
    number = mixed(np.add.reduceat(of, first) + size.astype(np.uint64))
    number = np.where(size > SMALL, number, number & _OWN | of[first] & ~_OWN).view(np.int64)
    return np.repeat(np.where(size > longest, band[edge], number), size), line


def _shared(longest: int):
    """(list, line) of bands with two different lines or more; rows sorted by (band, line).

    A list's number is a hash of its lines, so lists that several bands give alike become one.  For lists
    up to ``SMALL`` all but the last ``LOW`` bits are of the least line alone: those that share it, at most
    one of each band, lie together.  (Two lists that came to one number would be compared as one, which
    loses no link.)  A band over ``longest`` rows is not held: its rows pass on under the band's own number.
    """

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        last, passing = None, False

        def closed() -> tuple[np.ndarray, np.ndarray]:
            line = np.concatenate([np.empty(0, np.int64), *([] if passing else held)])
            return _listed(np.full(len(line), last), line, longest)

        for batch in batches:
            if not batch.num_rows:
                continue
            band, line = (batch.column(k).to_numpy() for k in (0, 1))
            edge = np.flatnonzero(np.concatenate([[True], band[1:] != band[:-1]]))
            begin, end = (edge[1], edge[-1]) if len(edge) > 1 else (len(band), len(band))
            out = [_listed(band[begin:end], line[begin:end], longest)]
            # the first band of a batch may have begun before it, the last may go on after it
            for of, part in ((band[0], line[:begin]), (band[-1], line[end:])):
                if not len(part):
                    continue
                if of != last:
                    if held:
                        out.append(closed())
                    held, passing, last = [], False, of
                held.append(part)
                if passing or sum(map(len, held)) > longest:
                    passing = True
                    part = np.unique(np.concatenate(held))
                    out.append((np.full(len(part), last), part))
                    held = [line[:0]]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], ["list", "line"])
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in closed()], ["list", "line"])

    return kernel


def _fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(line, text) of the wanted lines of each text."""
    for batch in batches:
        found = {}
        for text, wanted in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            numbers = {w["line_no"] for w in wanted}
            names = {w["line"] for w in wanted}
            for number, line in lines_of(text):
                if number in numbers and (d := _name(line)) in names:
                    found[d] = line
        yield pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.int64()), pa.array(found.values(), pa.string())], ["line", "text"])


def _similar(h: np.ndarray, ends: np.ndarray, i: np.ndarray, j: np.ndarray, limit: float) -> np.ndarray:
    """Whether sets i[k] and j[k] have Jaccard similarity ``limit`` or more."""
    amount = np.diff(ends)
    out = np.minimum(amount[i], amount[j]) >= limit * np.maximum(amount[i], amount[j])
    at = np.flatnonzero(out)
    both = amount[i[at]] + amount[j[at]]
    cuts = np.searchsorted(np.cumsum(both), np.arange(_SLICE, int(both.sum()) + _SLICE, _SLICE)) if len(at) else []
    for some in np.split(at, np.unique(cuts)):
        if not len(some):
            continue
        side = np.stack([i[some], j[some]], axis=1).ravel()
        n = amount[side]
        take = np.arange(int(n.sum())) + np.repeat(ends[side] - (np.cumsum(n) - n), n)
        pair = np.repeat(np.arange(len(side), dtype=np.uint64) // np.uint64(2), n)
        value = np.sort(pair << _BITS | h[take])
        twice = value[1:][value[1:] == value[:-1]]
        common = np.bincount((twice >> _BITS).astype(np.int64), minlength=len(some))
        out[some] = common >= limit * (amount[i[some]] + amount[j[some]] - common)
    return out


#: Lists of so many rows times distinct sets are counted as one matrix.
_DENSE = 1 << 21


def _joined(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``label``, the least place of what each place is linked with, when a[k] and b[k] are linked as well."""
    up = label.copy()
    while True:
        x, y = up[a], up[b]
        apart = x != y
        if not apart.any():
            return up
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(up, np.maximum(x, y), np.minimum(x, y))
        while (up[up] != up).any():
            up = up[up]


def _spanning(h: np.ndarray, ends: np.ndarray, side: np.ndarray | None, label: np.ndarray, limit: float) -> list[tuple[int, int]]:
    """Links of one list that connect it as all its links do; with ``side`` only rows of different sides are compared.

    Rows with the same ``label`` are connected already.
    """
    amount = np.diff(ends)
    n = len(amount)
    owner = np.repeat(np.arange(n), amount)
    _, token = np.unique(h, return_inverse=True)
    kinds = int(token.max()) + 1
    order = np.argsort(token, kind="stable")
    held, first = owner[order], np.searchsorted(token[order], np.arange(kinds + 1))
    table = None
    if n * kinds <= _DENSE:
        has = np.zeros((n, kinds), np.float32)
        has[owner, token] = 1
        table = np.rint(has @ has.T).astype(np.int64)
    label, out = label.copy(), []
    for i in range(n - 1):
        near = (label != label[i]) & (np.arange(n) > i) & (np.minimum(amount, amount[i]) >= limit * np.maximum(amount, amount[i]))
        if side is not None:
            near &= side != side[i]
        if not near.any():
            continue
        common = table[i] if table is not None else np.bincount(np.concatenate([held[first[t] : first[t + 1]] for t in token[ends[i] : ends[i + 1]].tolist()]), minlength=n)
        near &= common >= limit * (amount + amount[i] - common)
        for j in np.flatnonzero(near).tolist():
            if label[j] != label[i]:
                out.append((i, j))
                label[label == label[j]] = label[i]
    return out


def _verified(limit: float):
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs(batches, ("list", "cell")):
            name, back, mine = np.unique(table.column("line").to_numpy(), return_index=True, return_inverse=True)
            h, ends = _places(table.column("text").take(pa.array(back)).to_pylist())
            number, marks = np.diff(ends), _marks(h, ends)
            edge, size = bounds(table, ("list", "cell"))
            group = np.repeat(np.arange(len(size)), size)
            order = np.lexsort((number[mine], group))  # lines of like length lie together in their list
            mine, cell, side = mine[order], table.column("cell").to_numpy(), table.column("side").to_numpy()[order]
            whole, few = (cell < 0) | (cell >> 32 == cell & 0xFFFFFFFF), np.repeat(size <= SMALL, size)
            label, links, tried = np.arange(len(name)), [], np.empty(0, np.int64)
            for step in range((SMALL - 1).bit_length()):  # what nearer rows have linked is not compared again
                pairs = [np.empty(0, np.int64)]
                for d in range(1 << step, min(2 << step, SMALL, int(size.max()))):
                    i = np.flatnonzero((group[:-d] == group[d:]) & (few[d:] | (step == 0)))
                    i = i[(whole[i] | (side[i] != side[i + d])) & (label[mine[i]] != label[mine[i + d]])]
                    pairs.append(np.minimum(mine[i], mine[i + d]) * len(name) + np.maximum(mine[i], mine[i + d]))
                fresh = np.setdiff1d(np.concatenate(pairs), tried)  # a pair of several lists counts once
                tried = np.concatenate([tried, fresh])
                i, j = fresh // len(name), fresh % len(name)
                left = _possible(marks, number, i, j, limit)
                some, ij = np.unique(np.stack([i[left], j[left]]), return_inverse=True)
                take, last = _taken(ends, some)
                found = _similar(*_distinct(h[take], last), *ij.reshape(2, -1), limit)
                links.append((i[left][found], j[left][found]))
                label = _joined(label, *links[-1])
            for k in np.flatnonzero(size > SMALL):
                rows = mine[edge[k] : edge[k] + size[k]]
                if (label[rows] == label[rows[0]]).all():
                    continue
                take, last = _taken(ends, rows)
                some = _spanning(*_distinct(h[take], last), None if whole[edge[k]] else side[edge[k] : edge[k] + size[k]], label[rows], limit)
                if some:
                    links.append(tuple(rows[np.array(x)] for x in zip(*some, strict=True)))
                    label = _joined(label, *links[-1])
            yield pa.RecordBatch.from_arrays([pa.array(name[np.concatenate(x)]) for x in zip(*links, strict=True)], ["a", "b"])

    return kernel


def deduplicated(docs: DataFrame, limit: float = SIMILARITY, block: int = BLOCK) -> DataFrame:
    """(doc_id, line_no, keeper_doc_id, keeper_line_no, kept) for every line that has a word.

    Null and empty texts have no line.  Rows with equal doc_id count as one text: equal places are
    kept or dropped together.  A null doc_id comes before all others.  Very long texts and lines are
    read whole; an empty table gives no rows; other columns are not read, whatever their names.
    """
    bounded_batches(docs.sparkSession)
    held = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    lines = saved(held.mapInArrow(_lines, "line long, doc_id long, line_no int"), "lines")
    classes = saved(lines.groupBy("line").agg(F.min(F.struct("doc_id", "line_no")).alias("place")), "classes")
    postings = held.select("text").mapInArrow(_postings, "band long, line long")
    found = postings.repartition("band").sortWithinPartitions("band", "line").mapInArrow(_shared(LONGEST), "list long, line long")
    lists = saved(found.distinct(), "lists")
    places = lists.select("line").distinct().join(classes, "line").select(F.col("place.doc_id").alias("doc_id"), F.struct(F.col("place.line_no").alias("line_no"), "line").alias("w"))
    wanted = places.groupBy("doc_id").agg(F.collect_list("w").alias("wanted"))
    fetched = held.join(wanted, held["doc_id"].eqNullSafe(wanted["doc_id"])).select("text", "wanted").mapInArrow(_fetch, "line long, text string")
    listed = dealt(lists, "list", "line", block).join(fetched, "line")
    ordered = listed.repartition(F.shiftright("list", LOW), "cell").sortWithinPartitions("list", "cell").select("list", "cell", "side", "line", "text")
    found = components(ordered.mapInArrow(_verified(limit), "a long, b long")).withColumnRenamed("node", "line")
    discard(lists)
    rooted = saved(classes.join(found, "line", "left").select("line", F.coalesce("component", "line").alias("root"), "place"), "rooted")
    discard(classes)
    keepers = rooted.groupBy("root").agg(F.min("place").alias("keeper"))
    named = rooted.join(keepers, "root").select("line", "keeper")
    out = lines.select("line", "doc_id", "line_no").join(named, "line")
    kept = F.col("doc_id").eqNullSafe(F.col("keeper.doc_id")) & (F.col("line_no") == F.col("keeper.line_no"))
    return out.select("doc_id", "line_no", F.col("keeper.doc_id").alias("keeper_doc_id"), F.col("keeper.line_no").alias("keeper_line_no"), kept.alias("kept"))


def without_repeats(docs: DataFrame, limit: float = SIMILARITY) -> DataFrame:
    """``docs`` with dropped lines cut out of ``text``; lines without a word stay."""
    dropped = deduplicated(docs, limit).where(~F.col("kept")).groupBy("doc_id").agg(F.collect_set("line_no").alias("__dropped"))
    joined = docs.join(dropped, "doc_id", "left")
    parts = F.transform(F.split("text", "\n"), lambda s, i: F.struct(s.alias("s"), i.alias("i")))
    kept = F.transform(F.filter(parts, lambda x: ~F.array_contains(F.col("__dropped"), x["i"])), lambda x: x["s"])
    return joined.withColumn("text", F.when(F.col("__dropped").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))).select(*docs.columns)
