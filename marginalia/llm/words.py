"""Numpy view of a batch of texts: code points, pieces between boundaries, their hashes and classes.

Everything here works on one bounded batch inside a task. A batch is cut into segments, equal
segments get one class number, and only one segment of a class is ever looked at by the operators.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cache

import numpy as np
import pandas as pd

_ODD = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0xD1342543DE82EF95
_INVERSE = pow(_BASE, -1, 2**64)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    x = x.astype(np.uint64) * _ODD
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


_powers: dict[int, np.ndarray] = {}


def _power_table(base: int, n: int) -> np.ndarray:
    table = _powers.get(base)
    if table is None or len(table) < n:
        step = np.full(max(n, 1 << 20), base, dtype=np.uint64)
        step[0] = 1
        table = _powers[base] = np.cumprod(step, dtype=np.uint64)
    return table[:n]


def codepoints(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All code points one after another, and where each text starts (one entry more at the end)."""
    starts = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum([len(t) for t in texts], out=starts[1:])
    raw = "".join(texts).encode("utf-32-le", "surrogatepass")
    return np.frombuffer(raw, dtype=np.uint32), starts


@cache
def char_table(kind: str) -> np.ndarray:
    """For every code point whether ``str.<kind>()`` holds."""
    test = getattr(str, kind)
    out = np.fromiter((test(chr(i)) for i in range(0x30000)), dtype=bool, count=0x30000)
    return np.concatenate([out, np.zeros(0x110000 - 0x30000, dtype=bool)])


class Segments:
    """The segments of a batch that begin at the given positions; a text never shares a segment."""

    def __init__(self, cp: np.ndarray, text_starts: np.ndarray, begins: np.ndarray, keep: Callable | None = None):
        begins = begins.copy()
        begins[text_starts[:-1][text_starts[:-1] < len(cp)]] = True
        start = np.flatnonzero(begins)
        end = np.append(start[1:], len(cp))
        if keep is not None:
            kept = keep(start)
            start, end = start[kept], end[kept]
        self.cp, self.start, self.length = cp, start, end - start
        self.text = np.searchsorted(text_starts, start, side="right") - 1
        self.hash = self._hashes(start, end)

    def _hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        n = len(self.cp)
        total = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(mix(self.cp + np.uint32(1)) * _power_table(_BASE, n), dtype=np.uint64, out=total[1:])
        h = (total[end] - total[start]) * _power_table(_INVERSE, n + 1)[start]
        return mix(h ^ (end - start).astype(np.uint64))

    def classes(self) -> tuple[np.ndarray, np.ndarray]:
        """Class number of every segment, and one segment of every class."""
        codes, _ = pd.factorize(self.hash)
        first = np.zeros(codes.max(initial=-1) + 1, dtype=np.int64)
        first[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
        return codes, first

    def string(self, i: int) -> str:
        a = self.start[i]
        return self.cp[a:a + self.length[i]].tobytes().decode("utf-32-le", "surrogatepass")

    def matrix(self, rows: np.ndarray, length: int) -> np.ndarray:
        """Code points of equally long segments, a row for each."""
        return self.cp[self.start[rows][:, None] + np.arange(length)]


def ragged(offsets: np.ndarray, data: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lists ``data[offsets[r]:offsets[r + 1]]`` of the rows one after another, and their lengths."""
    lengths = offsets[rows + 1] - offsets[rows]
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    at = np.arange(total, dtype=np.int64) + np.repeat(offsets[rows] - (ends - lengths), lengths)
    return data[at], lengths


class ListCache:
    """What was worked out for a segment class, by hash, across the batches of one task.

    Bounded: it starts anew after ``limit`` classes, which costs time but changes no result.
    """

    def __init__(self, limit: int = 300_000):
        self.limit = limit
        self._clear()

    def _clear(self) -> None:
        self.at: dict[int, int] = {}
        self.offsets = np.zeros(1, dtype=np.int64)
        self.data: np.ndarray | None = None

    def rows(self, hashes: np.ndarray, work: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Cache rows of the hashes. ``work`` takes the positions not known yet and returns the
        concatenated values of their lists and the lengths."""
        if len(self.at) + len(hashes) > self.limit:
            self._clear()
        keys = hashes.tolist()
        known = self.at
        new = [i for i, h in enumerate(keys) if h not in known]
        if new:
            values, lengths = work(np.array(new, dtype=np.int64))
            base = len(self.offsets) - 1
            for k, i in enumerate(new):
                known[keys[i]] = base + k
            self.offsets = np.concatenate([self.offsets, self.offsets[-1] + np.cumsum(lengths)])
            self.data = values if self.data is None else np.concatenate([self.data, values])
        return np.fromiter((known[h] for h in keys), dtype=np.int64, count=len(keys))
