"""Words of whole texts as 64-bit hashes, many texts at a time, in numpy.

A word is a run of bytes other than white space (space, tab to carriage return), with A-Z in
lower case. Its hash is a polynomial over a table of random bytes' values, mixed with its
length; equal words have equal hashes, and two unlike words share one with chance 2**-64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
BLOCK = 4 << 20
_STEP = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_VALUES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.int64).astype(U)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
#: White space and ASCII punctuation.
LOOSE = _SPACE.copy()
LOOSE[[b for b in range(33, 127) if not chr(b).isalnum()]] = True
_powers: dict[int, np.ndarray] = {}


def give_back() -> None:
    """Hands freed memory back to the machine, as workers live on for tasks of other operators."""
    import ctypes

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def trimmed(run):
    """A function of a task's batches that gives memory back when the task ends."""

    def whole(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return whole


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> U(33))
    x = x * U(0xFF51AFD7ED558CCD)
    x ^= x >> U(33)
    x *= U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U(33))


def powers(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, _STEP + 1), base, U)
        steps[0] = 1
        have = _powers[base] = np.multiply.accumulate(steps)
    return have[:n]


def raw(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column one after another, and where each row's start; null: empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_string()).cast(pa.large_binary())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, at, data = column.buffers()
    off = np.frombuffer(at, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    return data, off - off[0]


def blocks(off: np.ndarray, limit: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Ranges of whole rows of about ``limit`` bytes."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
        yield i, j
        i = j


def spans(data: np.ndarray, off: np.ndarray, gaps: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and its row."""
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, z
    word = ~gaps[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[off] = True
    first = word.copy()
    first[1:] &= ~word[:-1] | edge[1:-1]
    last = word
    last[:-1] &= ~word[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(off, starts, "right") - 1


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    out = np.empty(len(starts), U)
    inverse = pow(_BASE, -1, 1 << 64)
    i, n = 0, len(starts)
    while i < n:
        lo = int(starts[i])
        j = max(i + 1, int(np.searchsorted(ends, lo + _STEP, "right")))
        size = int(ends[j - 1]) - lo
        total = np.zeros(size + 1, U)
        np.cumsum(_VALUES[_LOWER[data[lo : lo + size]]] * powers(_BASE, size), out=total[1:])
        s, e = starts[i:j] - lo, ends[i:j] - lo
        out[i:j] = (total[e] - total[s]) * powers(inverse, size + 1)[s]
        i = j
    return mix(out ^ ((ends - starts).astype(U) * U(0xD6E8FEB86659FD93)))


def tokens(data: np.ndarray, off: np.ndarray, gaps: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every word."""
    starts, ends, row = spans(data, off, gaps)
    return hashes(data, starts, ends), row


def shingles(h: np.ndarray, row: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of k words of each row, and their rows; of the whole sequence where there are fewer words."""
    n = len(h)
    if not n:
        return h, row
    start = np.r_[True, row[1:] != row[:-1]]
    at = np.flatnonzero(start)
    length = np.diff(np.r_[at, n])
    whole = np.zeros(n, U)
    if n >= k:
        m = n - k + 1
        acc = np.zeros(m, U)
        for j in range(k):
            acc = mix(acc ^ (h[j : j + m] + U(0xA0761D6478BD642F * (j + 1) % (1 << 64))))
        whole[:m] = acc
    left = np.repeat(at + length, length) - np.arange(n)
    keep = left >= k
    short = np.flatnonzero(length < k)
    if len(short):
        acc = np.full(len(short), 0x51ED270B7F4A7C15, U)
        for j in range(k - 1):
            has = length[short] > j
            acc[has] = mix(acc[has] ^ (h[at[short][has] + j] + U(j + 1)))
        whole[at[short]] = acc
        keep[at[short]] = True
    return whole[keep], row[keep]


def row_keys(ids: pa.Array, data: np.ndarray, off: np.ndarray, lo: int, hi: int) -> np.ndarray:
    """64 bits for each row of a range, from its id and whole text."""
    import xxhash

    view = memoryview(np.ascontiguousarray(data))
    return np.fromiter((xxhash.xxh3_64_intdigest(view[off[k] : off[k + 1]], seed=(ids[k].as_py() or 0) & 0x7FFFFFFFFFFFFFFF) for k in range(lo, hi)), U, hi - lo).view(np.int64)
