"""Long repeated byte strings: a Burrows-Wheeler transform per group of pieces, expanded to a bounded length.

Every window of ``least`` bytes is held by the smallest hash of the ``ANCHOR``-byte strings in it
(its anchor); runs of windows with one anchor are pieces. Equal windows have equal anchors, so

1. anchors whose string starts once in all texts are dropped (their windows can't repeat),
2. pieces of equal bytes count as one with a number; with two or more, all their windows repeat,
3. the distinct pieces of an anchor meet in one block, and blocks of whole groups of about
   ``BLOCK`` bytes get a suffix array and its transform. Intervals of suffixes with a common
   prefix are extended backward, breadth first, which gives common prefixes by rising length;
   this stops at ``least``, and neighbours then still unparted share a window.

A group above ``LARGEST`` pieces or bytes is never gathered: its windows become their own anchors
(a piece of one window), which counting decides, in any number of tasks.

Defined results: null text is empty; texts under ``least`` bytes lose nothing; repeated rows are
copies of each other and both lose all windows; matches never cross rows; tables without rows
give none; other columns are not read. Anchors, pieces and texts are told apart by 64 bits
(pieces within their anchor, texts within their doc_id).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.session import cut

LEAST = 400
ANCHOR = 128
SLICE = 1 << 20
BLOCK = 1 << 17
LARGEST = (2000, 4 << 20)
_BASE = 0x9E3779B97F4A7C15
_TABLE = np.random.default_rng(11).integers(0, 1 << 64, 256, dtype=np.uint64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, np.uint64(base))
    out[0] = 1
    return np.multiply.accumulate(out)


_UP, _DOWN = _powers(_BASE, SLICE + 4096), _powers(pow(_BASE, -1, 1 << 64), SLICE + 4096)


def anchor_hashes(data: np.ndarray, anchor: int) -> np.ndarray:
    """The hash of every string of ``anchor`` bytes in ``data`` (at most SLICE windows)."""
    n = len(data)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_TABLE[data] * _UP[:n], out=sums[1:])
    h = (sums[anchor:] - sums[: n + 1 - anchor]) * _DOWN[: n + 1 - anchor]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


def least_of(h: np.ndarray, width: int) -> np.ndarray:
    """The smallest of every ``width`` neighbours."""
    span = 1
    while 2 * span <= width:
        h = np.minimum(h[:-span], h[span:])
        span *= 2
    return np.minimum(h[: len(h) - (width - span)], h[width - span :]) if width > span else h


def slices(text: bytes, least: int, anchor: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Slice by slice: its place, its hashes, the anchor of every window and where pieces begin."""
    for at in range(0, len(text) - least + 1, SLICE):
        h = anchor_hashes(np.frombuffer(text, np.uint8, min(SLICE + least - 1, len(text) - at), at), anchor)
        m = least_of(h, least - anchor + 1)
        yield at, h, m, np.flatnonzero(np.r_[True, m[1:] != m[:-1]])


def pieces(text: bytes, least: int, anchor: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Starts, numbers of windows and anchors (int64), slice by slice."""
    for at, _, m, first in slices(text, least, anchor):
        yield at + first, np.diff(np.r_[first, len(m)]), m[first].view(np.int64)


def occurrences(text: bytes, least: int, anchor: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For every piece its anchor (int64) and how often the anchor's string starts in it, slice by slice."""
    width = least - anchor + 1
    span = 1 << ((width + 1) // 2).bit_length() - 1
    for _, h, m, first in slices(text, least, anchor):
        # Every window around a place reaches span places to its left or its right, so an anchor is the least of one of these.
        near = least_of(h, span)
        may = np.zeros(len(h), bool)
        may[: len(near)] = h[: len(near)] == near
        may[span - 1 :] |= h[span - 1 :] == near
        may = np.flatnonzero(may)
        lo, hi = np.searchsorted(may, first), np.searchsorted(may, np.r_[first[1:], len(m)] + width - 1)
        ends = np.cumsum(hi - lo)
        at = np.arange(ends[-1]) + np.repeat(lo - np.r_[0, ends[:-1]], hi - lo)
        same = h[may[at]] == np.repeat(m[first], hi - lo)
        yield m[first].view(np.int64), np.add.reduceat(same, ends - (hi - lo), dtype=np.int64)


def order(sym: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Suffix array of ``sym`` (bytes + 1; each end mark, 0, is its own symbol, smaller the earlier it stands)."""
    n = len(sym)
    packed = np.zeros(n, np.int64)
    wide = np.r_[sym, np.zeros(7, np.int64)]
    upto = ends[np.searchsorted(ends, np.arange(n))] - np.arange(n)  # distance to the end mark
    for k in range(7):
        packed = (packed << 9) | np.where(upto >= k, wide[k : k + n], 0)
    # Strings up to an end mark stand in the order of the marks, which a stable sort keeps.
    sa = np.argsort(packed, kind="stable")
    p, closed = packed[sa], (upto < 7)[sa]
    new = np.r_[True, (p[1:] != p[:-1]) | closed[1:]]
    rank, todo, step = np.empty(n, np.int64), np.arange(n), 7
    while True:
        # Only suffixes that still tie are ranked and sorted again; a rank is the place of its group's first.
        first = np.flatnonzero(new[todo])
        rank[sa[todo]] = np.repeat(todo[first], np.diff(np.r_[first, len(todo)]))
        tied = ~new[todo]
        tied[:-1] |= tied[1:]
        todo = todo[tied]
        if not len(todo):
            return sa
        s = sa[todo]
        r1, r2 = rank[s], rank[s + step]
        o = np.argsort(r1 * n + r2, kind="stable")
        sa[todo] = s[o]
        r1, r2 = r1[o], r2[o]
        new[todo[1:]] |= (r1[1:] == r1[:-1]) & (r2[1:] != r2[:-1])
        step *= 2


def unparted(sym: np.ndarray, sa: np.ndarray, least: int) -> np.ndarray:
    """For each place of ``sa`` but the first, whether its suffix shares ``least`` symbols with the one before.

    Interval expansion on the transform: an interval of suffixes that begin with one string, extended
    backward by a symbol, is the interval of the longer string; where its right end is new, the common
    prefix there is as long as the string, and only then it is expanded further.
    """
    n = len(sym)
    bwt = sym[sa - 1]  # sa 0 wraps to the last end mark
    marks = bwt == 0
    by = np.argsort(bwt.astype(np.int16), kind="stable")
    lf = np.empty(n, np.int64)
    lf[by] = np.arange(n)
    # End marks are symbols of their own: each is alone, and extends nothing.
    same = bwt[by[1:]] == bwt[by[:-1]]
    after, before = np.full(n, n), np.full(n, -1)
    after[by[:-1][same]] = by[1:][same]
    before[by[1:][same]] = by[:-1][same]
    # Begin with the intervals of strings of one symbol.
    first = sym[sa]
    parted = np.r_[True, (first[1:] != first[:-1]) | (first[1:] == 0), True]
    heads = np.flatnonzero(parted)
    lo, hi = heads[:-1], heads[1:] - 1
    for _ in range(1, least):
        width = hi - lo + 1
        base = np.repeat(lo - np.r_[0, np.cumsum(width)[:-1]], width)
        at = np.arange(len(base)) + base
        left, right = np.repeat(lo, width), np.repeat(hi, width)
        ok = ~marks[at]
        starts, ends = at[ok & (before[at] < left)], at[ok & (after[at] > right)]
        # First and last of each symbol in each interval; sorted by their images both align.
        a, b = np.sort(lf[starts]), np.sort(lf[ends])
        fresh = ~parted[b + 1]
        lo, hi = a[fresh], b[fresh]
        if not len(lo):
            break
        parted[hi + 1] = True
    return ~parted[1:n]


def repeated(parts: list[bytes], least: int) -> list[np.ndarray]:
    """For every part, which of its windows occur twice or more in all of them."""
    raw = np.frombuffer(b"\0".join(parts) + b"\0", np.uint8)
    ends = np.cumsum([len(p) + 1 for p in parts]) - 1
    sym = raw.astype(np.int64) + 1
    sym[ends] = 0
    sa = order(sym, ends)
    tied = unparted(sym, sa, least)
    found = np.zeros(len(sym), bool)
    found[sa[1:][tied]] = True
    found[sa[:-1][tied]] = True
    return [found[e - len(p) : e - least + 1] for p, e in zip(parts, ends, strict=True)]


def runs(found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.flatnonzero(np.diff(np.r_[False, found, False].astype(np.int8)))
    return edge[::2], edge[1::2] - edge[::2]


KEY = "doc_id long, h long"


def _keyed(b: pa.RecordBatch) -> Iterator[tuple[int, int, bytes]]:
    for i, x in zip(b.column(0), b.column(1), strict=True):
        text = x.as_py() or b""
        i = i.as_py()
        yield i or 0, xxhash.xxh3_64_intdigest(text, seed=i is None) - (1 << 63), text


def _batch(schema: str, rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string()}
    names = [c.split() for c in schema.split(", ")]
    cols = list(zip(*rows, strict=True)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, kinds[t]) for c, (_, t) in zip(cols, names, strict=True)], [n for n, _ in names])


def _columns(schema: str, parts: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
    names = [c.split()[0] for c in schema.split(", ")]
    cols = [np.concatenate(c) for c in zip(*parts, strict=True)] if parts else [np.zeros(0, np.int64)] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in cols], names)


def _packed(docs: DataFrame) -> DataFrame:
    """Keys and compressed texts, as texts travel."""
    schema = f"id long, {KEY}, size long, z binary"

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd")
        for b in batches:
            ids = b.column(0).to_pylist()
            yield _batch(schema, [(i, d, h, len(t), codec.compress(t, asbytes=True) if t else b"") for i, (d, h, t) in zip(ids, _keyed(b), strict=True)])

    return docs.mapInArrow(pack, schema)


def _unpacked(size: int, z: bytes) -> bytes:
    return pa.Codec("zstd").decompress(z, size, asbytes=True) if size else b""


def spans(docs: DataFrame, least: int = LEAST, anchor: int = ANCHOR, largest: tuple[int, int] = LARGEST) -> DataFrame:
    """doc_id, h, start, n: runs of starts of repeated windows; ``docs`` has doc_id long, text binary."""

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, out, held = "m long, n long", [], 0
        for b in batches:
            for x in b.column(1):
                for m, n in occurrences(x.as_py() or b"", least, anchor):
                    out.append((m, n))
                    held += len(m)
                    if held > 50_000:
                        yield _columns(schema, out)
                        out, held = [], 0
        yield _columns(schema, out)

    def cuts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, held = [], 0
        for b in batches:
            for d, h, text in _keyed(b):
                for at, n, m in pieces(text, least, anchor):
                    c = np.array([xxhash.xxh3_64_intdigest(text[s : s + k + least - 1]) for s, k in zip(at.tolist(), n.tolist(), strict=True)], np.uint64).view(np.int64)
                    out.append((np.full(len(m), d), np.full(len(m), h), at, n, m, c))
                    held += len(m)
                    if held > 50_000:
                        yield _columns(CUT, out)
                        out, held = [], 0
        yield _columns(CUT, out)

    CUT = f"{KEY}, start long, n long, m long, c long"
    often = docs.mapInArrow(anchors, "m long, n long").groupBy("m").agg(F.sum("n").alias("n")).where("n > 1").select("m")
    held = cut(docs.mapInArrow(cuts, CUT).join(often, "m", "left_semi"))
    kinds = held.groupBy("m", "c").agg(F.count("*").alias("copies"), F.min(F.struct("doc_id", "h", "start", "n")).alias("rep"))
    kinds = cut(kinds.select("m", "c", "copies", "rep.*"))
    groups = kinds.groupBy("m").agg(F.count("*").alias("k"), F.sum(F.col("n") + (least - 1)).alias("size"), F.min("copies").alias("fewest"))
    # Pieces with copies are settled; only those that stand once ask something.
    groups = groups.where(F.col("fewest") == 1).select("m", ((F.col("k") > 1) & ((F.col("k") > largest[0]) | (F.col("size") > largest[1]))).cast("long").alias("large"))
    asked = kinds.join(groups, "m").groupBy("doc_id", "h").agg(F.collect_list(F.struct("start", "n", "m", "copies", "large")).alias("asked"))
    BYTES = f"m long, large long, copies long, {KEY}, start long, n long, piece binary"

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, held = [], 0
            for d, h, size, z, wanted in zip(*(b.column(k) for k in range(5)), strict=True):
                d, h, text = d.as_py(), h.as_py(), _unpacked(size.as_py(), z.as_py())
                for w in wanted.as_py():
                    p = text[w["start"] : w["start"] + w["n"] + least - 1]
                    out.append((w["m"], w["large"], w["copies"], d, h, w["start"], w["n"], p))
                    held += len(p)
                    if held > 4 << 20:
                        yield _batch(BYTES, out)
                        out, held = [], 0
            yield _batch(BYTES, out)

    fetched = _packed(docs).drop("id").join(asked, ["doc_id", "h"]).mapInArrow(fetch, BYTES)
    fetched = cut(fetched)
    SPAN = f"{KEY}, start long, n long"

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by anchor; blocks end only between anchors."""
        rows, held, last = [], 0, None
        for b in batches:
            for m, copies, d, h, s, p in zip(*(b[c].to_pylist() for c in ("m", "copies", "doc_id", "h", "start", "piece")), strict=True):
                if m != last and held > BLOCK:
                    yield _batch(SPAN, settled(rows))
                    rows, held = [], 0
                rows.append((copies, d, h, s, p))
                held, last = held + len(p), m
        if rows:
            yield _batch(SPAN, settled(rows))

    def settled(rows: list[tuple]) -> list[tuple]:
        out = []
        for (copies, d, h, s, _), found in zip(rows, repeated([r[-1] for r in rows], least), strict=True):
            if copies == 1:
                out += [(d, h, s + a, k) for a, k in zip(*(x.tolist() for x in runs(found)), strict=True)]
        return out

    blocks = fetched.where(F.col("large") == 0).repartition("m").sortWithinPartitions("m").mapInArrow(expand, SPAN)
    WINDOW = f"m long, w long, copies long, {KEY}, start long"

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                p, n = row["piece"], row["n"]
                for at in range(0, n, 1 << 16):
                    k = min(1 << 16, n - at)
                    w = np.array([xxhash.xxh3_64_intdigest(p[j : j + least]) for j in range(at, at + k)], np.uint64).view(np.int64)
                    yield _columns(WINDOW, [(np.full(k, row["m"]), w, np.full(k, row["copies"]), np.full(k, row["doc_id"]), np.full(k, row["h"]), row["start"] + at + np.arange(k))])

    single = fetched.where(F.col("large") == 1).mapInArrow(windows, WINDOW)
    twice = single.groupBy("m", "w").agg(F.count("*").alias("k")).where("k > 1").select("m", "w")
    counted = single.where("copies = 1").join(twice, ["m", "w"], "left_semi").select("doc_id", "h", "start", F.lit(1).cast("long").alias("n"))
    copied = held.join(kinds.where("copies > 1").select("m", "c"), ["m", "c"], "left_semi").select("doc_id", "h", "start", "n")
    return copied.unionByName(blocks).unionByName(counted)


def without_repeats(docs: DataFrame, least: int = LEAST, anchor: int = ANCHOR, largest: tuple[int, int] = LARGEST, keep_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row of ``docs`` (doc_id, text), and what is kept of the text (binary)."""
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text"))
    out = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * keep_text

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for i, size, z, found in zip(*(b.column(k) for k in range(4)), strict=True):
                text, at, gone, n = _unpacked(size.as_py(), z.as_py()), 0, 0, 0
                kept, end = [], -1
                for s in sorted((x["start"], x["start"] + x["n"] + least - 1) for x in found.as_py() or ()):
                    if s[0] > end:
                        n += 1
                        if end > 0:
                            gone += end - at
                        kept.append(text[max(end, 0) : s[0]])
                        at, end = s
                    else:
                        end = max(end, s[1])
                if n:
                    gone += end - at
                kept.append(text[max(end, 0) :])
                left = b"".join(kept)
                rows.append((i.as_py(), len(text), gone, n, hashlib.sha256(left).hexdigest(), *[left] * keep_text))
            yield _batch(out, rows)

    found = spans(docs, least, anchor, largest).groupBy("doc_id", "h").agg(F.collect_list(F.struct("start", "n")).alias("found"))
    return _packed(docs).join(found, ["doc_id", "h"], "left").select("id", "size", "z", "found").mapInArrow(finish, out)


def op8(spark, sf_dir: str) -> DataFrame:
    return without_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
