"""Words of Arrow text columns, cut and hashed by numpy on the UTF-8 bytes, without a Python string for any word."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text looked at together; only a single longer text makes a larger piece.
PIECE = 2 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
SPACES = np.zeros(256, bool)
SPACES[[9, 10, 11, 12, 13, 32]] = True
#: All ASCII but letters and digits.
MARKS = np.zeros(256, bool)
MARKS[:128] = True
MARKS[48:58] = MARKS[65:91] = MARKS[97:123] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_powers: dict[str, np.ndarray] = {}
#: What operators keep in a worker from task to task; a worker that goes on to other work drops it.
KEPT: list[dict] = []


def drop_kept() -> None:
    for k in KEPT:
        k.clear()


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers["up"]) < n:
        size = max(n, PIECE + 64)
        for name, by in (("up", _BASE), ("down", _INVERSE)):
            p = np.full(size, by, np.uint64)
            p[0] = 1
            _powers[name] = np.cumprod(p, dtype=np.uint64)
    return _powers["up"], _powers["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def run_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k values from each place on, for all places with k values."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    up, down = powers(len(h) + 1)
    sums = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * up[: len(h)], dtype=np.uint64, out=sums[1:])
    return mix((sums[k:] - sums[:n]) * down[:n])


def column(values) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a text column; null is empty."""
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    values = values.cast(pa.large_string()).fill_null("")
    off = np.frombuffer(values.buffers()[1], np.int64)[values.offset : values.offset + len(values) + 1]
    data = values.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[off[0] : off[-1]] if len(off) else raw[:0], off - off[0] if len(off) else np.zeros(1, np.int64)


def pieces(values, size: int = PIECE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows of about ``size`` bytes."""
    raw, off = column(values)
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + size, "right")) - 1)
        j = min(j, n)
        yield i, j, raw[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j


class Words:
    """Words of a piece: byte places ``starts`` and ``ends``, ``hash``, and ``first``, the first word of each row."""

    def __init__(self, raw: np.ndarray, off: np.ndarray, between: np.ndarray = SPACES, lower: bool = False):
        raw = LOWER[raw] if lower else raw
        inside = ~between[raw]
        head = np.zeros(len(raw) + 1, bool)
        head[off] = True
        before = np.zeros(len(raw), bool)
        before[1:] = inside[:-1]
        self.starts = np.flatnonzero(inside & (~before | head[:-1]))
        after = np.zeros(len(raw), bool)
        after[:-1] = inside[1:]
        self.ends = np.flatnonzero(inside & (~after | head[1:])) + 1
        up, down = powers(len(raw) + 1)
        sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)], dtype=np.uint64, out=sums[1:])
        self.hash = mix((sums[self.ends] - sums[self.starts]) * down[self.starts])
        self.first = np.searchsorted(self.starts, off)
        self.counts = np.diff(self.first)

    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.counts)), self.counts)


def shingles(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first hash of each row) of runs of k words within a row; a shorter row that has words gives one of all."""
    runs = run_hashes(w.hash, k)
    n = np.where(w.counts >= k, w.counts - k + 1, (w.counts > 0).astype(np.int64))
    first = np.concatenate([[0], np.cumsum(n)])
    place = np.repeat(w.first[:-1] - first[:-1], n) + np.arange(first[-1])
    out = np.empty(first[-1], np.uint64)
    whole = np.repeat(w.counts >= k, n)
    out[whole] = runs[place[whole]]
    for r in np.flatnonzero((w.counts > 0) & (w.counts < k)):
        h = w.hash[w.first[r] : w.first[r + 1]]
        out[first[r]] = mix(run_hashes(h, len(h)) + np.uint64(len(h)))[0]
    return out, first


def distinct(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of each row, ascending within the row."""
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    order = np.lexsort((h, row)) if len(first) > 2 else np.argsort(h)
    h, row = h[order], row[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return h[keep], np.searchsorted(row[keep], np.arange(len(first)))


def give_back() -> None:
    """Returns freed memory of this process to the system; Arrow's pool and the C allocator keep it otherwise."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)
