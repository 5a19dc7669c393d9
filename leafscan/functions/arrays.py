"""Score arrays as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """``body`` of ``value``, which is computed once."""
    return F.transform(F.array(value), body)[0]


def top_k(scores: Column, k: int) -> Column:
    """Indices of the k largest scores, largest first; of equal scores the higher index first."""
    keyed = F.transform(scores, lambda s, i: F.struct(s.alias("s"), i.alias("i")))
    return F.transform(F.slice(F.reverse(F.array_sort(keyed)), 1, k), lambda x: x["i"])


def log_softmax(scores: Column) -> Column:
    def shifted(xs: Column) -> Column:
        total = F.log(F.aggregate(xs, F.lit(0.0), lambda a, x: a + F.exp(x)))
        return F.transform(xs, lambda x: x - total)

    most = F.array_max(scores)
    return let(F.transform(scores, lambda x: x - most), shifted)


def banned_ngrams(tokens: Column, n: int = 3) -> Column:
    """Tokens, sorted and distinct, that would repeat an n-gram after the last n - 1 tokens."""
    size = F.size(tokens)
    same = lambda i: F.slice(tokens, i, n - 1) == F.slice(tokens, size - n + 2, n - 1)
    places = F.filter(F.sequence(F.lit(1), size - n + 1), same)
    return F.when(size >= n, F.array_sort(F.array_distinct(F.transform(places, lambda i: F.element_at(tokens, i + n - 1))))).otherwise(F.slice(tokens, 1, 0))


def gaussian(points: int, deviation: float) -> list[float]:
    return [math.exp(-((i - (points - 1) / 2) ** 2) / (2 * deviation * deviation)) for i in range(points)]


def smoothed(density: Column, height: int = 64) -> Column:
    """Convolved with a Gaussian of 2 x height points and deviation height / 8, in the middle, as long as the density (which must be as long as the kernel at least), and over its maximum where that is positive."""
    kernel = gaussian(2 * height, height / 8)
    m = len(kernel)
    weights = F.array(*[F.lit(v) for v in kernel])
    start = (m - 1) // 2

    def convolved(d: Column) -> Column:
        n = F.size(d)

        def at(k: Column) -> Column:
            low, high = F.greatest(F.lit(0), k + (start - m + 1)), F.least(n - 1, k + start)
            return F.aggregate(F.sequence(low, high), F.lit(0.0), lambda a, i: a + F.get(d, i) * F.get(weights, k + start - i))

        return F.transform(F.sequence(F.lit(0), n - 1), at)

    def scaled(xs: Column) -> Column:
        return let(F.array_max(xs), lambda m: F.when(m > 0, F.transform(xs, lambda x: x / m)).otherwise(xs))

    return let(let(density, convolved), scaled)


def split_count(width: Column, height: Column, most: int) -> Column:
    """Pieces that a line of this size is cut into; 1 up to the ratio ``most``."""
    ratio = width / height
    return F.when(ratio > most, F.ceil(ratio / most)).otherwise(F.lit(1)).cast("int")


def split_cuts(density: Column, count: Column, height: int = 64, window: int = 2) -> Column:
    """Cut columns: by each inner anchor the first least density within ``window`` half heights."""
    n = F.size(density)
    reach = window * height // 2

    def cut(k: Column) -> Column:
        anchor = (n * k / count).cast("int")
        low, high = F.greatest(F.lit(0), anchor - reach), F.least(n, anchor + reach)
        return let(F.slice(density, low + 1, high - low), lambda part: low + F.array_position(part, F.array_min(part)).cast("int") - 1)

    return F.when(count > 1, F.transform(F.sequence(F.lit(1), count - 1), cut)).otherwise(F.array().cast("array<int>"))


def pixel_input(levels: Column, channels: int = 3) -> Column:
    """Grey levels 0 to 255 as (v / 255 - 0.5) / 0.5, the same plane for each channel, channels first."""
    plane = F.transform(levels, lambda v: (v / 255.0 - 0.5) / 0.5)
    return F.flatten(F.array_repeat(plane, channels))
