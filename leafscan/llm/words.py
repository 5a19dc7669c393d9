"""Words of whole texts as flat numpy arrays.

Words are the maximal runs of bytes other than ``\\x20 \\x09-\\x0D`` in the UTF-8 text, so they equal
``[^\\x20\\x09-\\x0D]+`` on code points.  Work is done on slices of a few megabytes: memory does not
depend on how many rows or how long texts an Arrow batch has, except for a single text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

SPACES = b" \t\n\x0b\x0c\r"
SLICE_BYTES = 2 << 20
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(SPACES)] = True
_MIX = np.random.Generator(np.random.PCG64(20240229)).integers(1, 2**63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 & ~7 | 5
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, SLICE_BYTES + (1 << 18))
        _POWERS[:] = [_geometric(_BASE, size), _geometric(_BASE_INVERSE, size)]
    return _POWERS[0], _POWERS[1]


def _geometric(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


@dataclass
class Words:
    """``first[d]:first[d + 1]`` are the words of text d; word w is ``buffer[start[w]:end[w]]``."""

    buffer: bytes
    first: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray | None

    def document(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def shingles(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of the ``width`` words from each word on, and whether they lie in one text."""
        n = len(self.hash)
        whole = np.zeros(n, bool)
        out = np.zeros(n, np.uint64)
        if n >= width:
            last = n - width + 1
            doc = self.document()
            whole[:last] = doc[:last] == doc[width - 1 :]
            total = self.hash[:last].copy()
            for j in range(1, width):
                total = total * np.uint64(0xD6E8FEB86659FD93) + self.hash[j : j + last]
            out[:last] = mixed(total)
        return out, whole


def as_bytes(text: str | None, lower: bool) -> bytes:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw.lower() if lower else raw  # bytes.lower() changes A-Z alone


def slices(texts: list[str | None], lower: bool = False, size: int = SLICE_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """(position of the first, UTF-8 texts) in slices of about ``size`` bytes; each text is whole."""
    begin, held, total = 0, [], 0
    for i, text in enumerate(texts):
        held.append(as_bytes(text, lower))
        total += len(held[-1]) + 1
        if total >= size:
            yield begin, held
            begin, held, total = i + 1, [], 0
    if held:
        yield begin, held


def split(texts: list[bytes], hashes: bool = True) -> Words:
    buffer = b"\n".join(texts) + b"\n"
    raw = np.frombuffer(buffer, np.uint8)
    space = _IS_SPACE[raw]
    before = np.empty_like(space)
    before[0] = True
    before[1:] = space[:-1]
    start = np.flatnonzero(before & ~space)
    end = np.flatnonzero(space & ~before)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    opens = np.concatenate([[0], np.cumsum(lengths)])
    first = np.searchsorted(start, opens)
    value = None
    if hashes:
        power, inverse = _powers(len(raw))
        total = np.empty(len(raw) + 1, np.uint64)
        total[0] = 0
        np.cumsum(_MIX[raw] * power[: len(raw)], out=total[1:])
        value = mixed((total[end] - total[start]) * inverse[start])
    return Words(buffer, first, start, end, value)
