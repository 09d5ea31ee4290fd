"""Audio fingerprints: packed integers from filters over pitch classes, aligned by offset histograms.

A recording's frames (``FRAME`` samples, every ``HOP``) are folded into twelve pitch classes. Filters,
differences of rectangle sums read from an integral image over time and pitch class, are each cut
into four levels (Gray code, two bits); ``FILTERS`` of them pack into one 32-bit integer per place.

Recordings of equal fingerprints are one class. A class's integers are its seeds. A query asks with the integers of its
recording begun at each of ``SHIFTS`` parts of a hop, since a cut seldom falls on a hop, each with all combinations of its
``FLIPS`` least certain filters read one level over. Hits are counted per pair and offset; where ``VOTES`` unlike stretches of
``SLOT`` places hit, the pair is verified at that offset by the share of unlike bits over the whole overlap.

Queries are a stated set: they are broadcast in blocks of at most ``PROBES`` probes (or one recording), each held against
all classes where they lie, so chance hits are counted within a task and nothing but aligned pairs leaves it.

Defined results: null, too short or undecodable media (those on which the decoder raises) have no integers, are a class of their own
each, and match nothing; repeated rows are one class; null ids are dropped from queries, not from
membership; empty tables give no rows; media of any length are whole; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwork.session import cut

RATE = 5512
FRAME, HOP = 2048, 689
LOW_HZ, HIGH_HZ = 60.0, 2400.0
WIDTH = 8
#: Stretches of SLOT places, this many of which must hit at one offset; neighbours hit together by chance.
VOTES, SLOT = 3, 4
#: Probes and queries of a block, and hits counted at once.
PROBES, QUERIES, HITS = 1 << 21, 1 << 10, 1 << 22
#: Starts within a hop that a query asks from, and filters of which it asks both levels.
SHIFTS, FLIPS = 2, 4
#: Largest share of unlike bits, and least places of overlap.
UNLIKE, OVERLAP = 0.2, 24
CUTS = (-0.25, 0.0, 0.25)


def _filters() -> list[tuple[str, int, int, int]]:
    """Sixteen filters by rule: kind, first pitch class, classes, places."""
    kinds = ("pitch", "time", "cross", "middle")
    return [(kinds[k % 4], (5 * k) % 9, 2 + 2 * (k // 8) + (k // 4) % 2, 4 + 4 * (k // 4 % 2)) for k in range(16)]


FILTERS = _filters()


def pcm16(media: bytes) -> np.ndarray:
    """Samples of 16-bit little-endian mono at RATE."""
    return np.frombuffer(media, "<i2", len(media) // 2).astype(np.float32) / 32768


def tones(vector: list[float], note: int = 2 * HOP) -> np.ndarray:
    """A recording with one tone for each component of ``vector``, by its value; for tables that hold no media."""
    v = np.nan_to_num(np.asarray([np.nan if x is None else x for x in vector], np.float64), posinf=0, neginf=0)
    hz = 110 * 2 ** (np.floor(np.clip(v / (np.abs(v).mean() + 1e-12), -4, 4) * 6 + 24) / 12)
    return np.sin(np.cumsum(np.repeat(hz, note)) * (2 * np.pi / RATE)).astype(np.float32)


_HZ = np.fft.rfftfreq(FRAME, 1 / RATE)
_USED = (_HZ >= LOW_HZ) & (_HZ <= HIGH_HZ)
_FOLD = np.zeros((int(_USED.sum()), 12), np.float32)
_FOLD[np.arange(len(_FOLD)), np.round(12 * np.log2(_HZ[_USED] / 440)).astype(int) % 12] = 1
_HANN = np.hanning(FRAME).astype(np.float32)


def chroma(samples: np.ndarray) -> np.ndarray:
    """Pitch-class energy of every frame, each frame with length one (zero if silent)."""
    n = (len(samples) - FRAME) // HOP + 1
    if n <= 0:
        return np.zeros((0, 12), np.float32)
    frames = np.lib.stride_tricks.sliding_window_view(samples, FRAME)[::HOP]
    out = np.concatenate([np.abs(np.fft.rfft(frames[k : k + 512] * _HANN, axis=1)[:, _USED]).astype(np.float32) ** 2 @ _FOLD for k in range(0, n, 512)])
    size = np.linalg.norm(out, axis=1, keepdims=True)
    return np.where(size > 1e-3, out / np.maximum(size, 1e-3), 0)


def readings(frames: np.ndarray) -> np.ndarray:
    """Log ratio of each filter's areas at each place with WIDTH frames: places by filters."""
    n = max(0, len(frames) - WIDTH + 1)
    image = np.zeros((len(frames) + 1, 13))
    image[1:, 1:] = frames.astype(np.float64).cumsum(0).cumsum(1)
    at, out = np.arange(n), np.zeros((n, len(FILTERS)))

    def area(t0: int, t1: int, p0: int, p1: int) -> np.ndarray:
        return image[at + t1, p1] - image[at + t0, p1] - image[at + t1, p0] + image[at + t0, p0]

    for k, (kind, p, high, wide) in enumerate(FILTERS):
        q, half_p, half_t = min(12, p + high), min(12, p + high) - (min(12, p + high) - p) // 2, wide // 2
        if kind == "pitch":
            a, b = area(0, wide, p, half_p), area(0, wide, half_p, q)
        elif kind == "time":
            a, b = area(0, half_t, p, q), area(half_t, wide, p, q)
        elif kind == "cross":
            a = area(0, half_t, p, half_p) + area(half_t, wide, half_p, q)
            b = area(half_t, wide, p, half_p) + area(0, half_t, half_p, q)
        else:
            a = area(wide // 4, wide - wide // 4, p, q)
            b = area(0, wide, p, q) - a
        # Sums of like numbers may differ by rounding; steps far above that make ties alike anywhere.
        out[:, k] = np.round(np.log((1 + a) / (1 + b)), 6)
    return out


def packed(level: np.ndarray) -> np.ndarray:
    """Levels of all filters as one integer (uint32) for each place, two bits of Gray code a filter."""
    out = np.zeros(len(level), np.uint32)
    for k in range(len(FILTERS)):
        out = (out << np.uint32(2)) | (level[:, k] ^ (level[:, k] >> 1)).astype(np.uint32)
    return out


def integers(frames: np.ndarray) -> np.ndarray:
    """One packed integer (uint32) for each place with WIDTH frames."""
    return packed(np.searchsorted(CUTS, readings(frames)))


def probes(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Integers that a recording is asked for with, their places and shifts."""
    cuts, found = np.array(CUTS), []
    for shift in range(SHIFTS):
        value = readings(chroma(samples[shift * HOP // SHIFTS :]))
        level = np.searchsorted(CUTS, value)
        off = np.abs(value[:, :, None] - cuts)
        nearest = off.argmin(2)
        unsure = np.argsort(off.min(2), axis=1, kind="stable")[:, :FLIPS]
        for bits in range(1 << FLIPS):
            other = level.copy()
            for j in range(FLIPS):
                if bits >> j & 1:
                    rows, k = np.arange(len(level)), unsure[:, j]
                    # Over the nearest cut: from above it to below, or the other way.
                    other[rows, k] = np.where(level[rows, k] > nearest[rows, k], nearest[rows, k], nearest[rows, k] + 1)
            found.append(np.stack([packed(other).astype(np.int64), np.arange(len(level)), np.full(len(level), shift)]))
    return tuple(np.unique(np.concatenate(found, axis=1), axis=1))


def decoded(decode: Callable, media) -> np.ndarray:
    if not media:
        return np.zeros(0, np.float32)
    try:
        return decode(media)
    except ImportError:
        raise
    except Exception:
        # Defined: what can't be decoded has no integers.
        return np.zeros(0, np.float32)


def fingerprints(media: DataFrame, ident: str, column: str, decode: Callable = pcm16) -> DataFrame:
    """id, key, fp (array of int): ``key`` tells fingerprints apart by 64 bits, those without integers by row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, len(b), 256):
                ids, fps, keys = b.column(0)[k : k + 256], [], []
                for i, x in zip(ids, b.column(1)[k : k + 256], strict=True):
                    fp = integers(chroma(decoded(decode, x.as_py())))
                    fps.append(fp.view(np.int32))
                    keys.append(xxhash.xxh3_64_intdigest(fp.tobytes() if len(fp) else repr(i.as_py()), seed=int(not len(fp))) - (1 << 63))
                yield pa.RecordBatch.from_arrays([ids, pa.array(keys, pa.int64()), pa.array(fps, pa.list_(pa.int32()))], ["id", "key", "fp"])

    return media.select(F.col(ident).cast("long").alias("id"), column).mapInArrow(run, "id long, key long, fp array<int>")


def questions(media: DataFrame, decode: Callable) -> DataFrame:
    """query_id, fp, and the probes of each (seeds, places) of media (query_id, fp, media)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, len(b), 64):
                found = [probes(decoded(decode, x.as_py()))[:2] for x in b.column(2)[k : k + 64]]
                packed_up = [pa.array([x[j].astype(np.uint32).view(np.int32).tobytes() for x in found], pa.binary()) for j in (0, 1)]
                yield pa.RecordBatch.from_arrays([*(c[k : k + 64] for c in b.columns[:2]), *packed_up], ["query_id", "fp", "seeds", "places"])

    return media.select("query_id", "fp", "media").mapInArrow(run, "query_id long, fp array<int>, seeds binary, places binary")


class Asked:
    """A block of queries: ids, fingerprints, and all probes in the order of their seeds."""

    def __init__(self, rows: list):
        self.ids = np.array([r["query_id"] for r in rows], np.int64)
        self.fps = [np.array(r["fp"], np.int32) for r in rows]
        seeds, places = ([np.frombuffer(r[name], np.int32) for r in rows] for name in ("seeds", "places"))
        seed = np.concatenate(seeds)
        order = np.argsort(seed, kind="stable")
        self.seed, self.place = seed[order], np.concatenate(places)[order]
        self.query = np.repeat(np.arange(len(rows)), [len(x) for x in seeds])[order]

    def hits(self, v: np.ndarray, row: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """Row, query and offset with VOTES stretches that hit, of classes' integers with their rows (under 4096) and places."""
        lo = np.searchsorted(self.seed, v)
        width = np.searchsorted(self.seed, v, "right") - lo
        some = np.flatnonzero(width)
        ends, i, keys = np.cumsum(width[some]), 0, [np.zeros(0, np.int64)]
        while i < len(some):
            j = max(i + 1, int(np.searchsorted(ends, ends[i] - width[some[i]] + HITS, "right")))
            own, w = some[i:j], width[some[i:j]]
            probe = np.arange(w.sum()) + np.repeat(lo[own] - np.r_[0, np.cumsum(w)[:-1]], w)
            offset = np.repeat(at[own], w) - self.place[probe].astype(np.int64) + (1 << 31)
            key = (np.repeat(row[own], w) * QUERIES + self.query[probe]) << 32 | offset
            keys.append(np.unique(key * 64 + self.place[probe] // SLOT % 64))
            i = j
        key, n = np.unique(np.unique(np.concatenate(keys)) // 64, return_counts=True)
        key = key[n >= VOTES]
        return zip((key >> 32) // QUERIES, (key >> 32) % QUERIES, (key & ((1 << 32) - 1)) - (1 << 31), strict=True)


def asked_blocks(queries: DataFrame) -> Iterator[Asked]:
    """Blocks of queries, read one at a time."""
    rows, size = [], 0
    for r in queries.toLocalIterator():
        rows.append(r)
        size += len(r["seeds"]) // 4
        if size >= PROBES or len(rows) == QUERIES:
            yield Asked(rows)
            rows, size = [], 0
    if rows:
        yield Asked(rows)


def unlike(a: np.ndarray, b: np.ndarray, offset: int) -> tuple[int, int]:
    """Unlike bits and places of overlap where place t of ``a`` lies on t + offset of ``b``."""
    lo, hi = max(0, -offset), min(len(a), len(b) - offset)
    if hi <= lo:
        return 0, 0
    return int(np.bitwise_count(a[lo:hi].view(np.uint32) ^ b[lo + offset : hi + offset].view(np.uint32)).sum()), hi - lo


def aligned(classes: DataFrame, media: DataFrame, decode: Callable) -> DataFrame:
    """query_id, match_id, offset, unlike_bits, places: for each pair its best offset. classes: class_id, fp; media: query_id (a class), its fp, media."""
    schema, out = "query_id long, match_id long, offset int, unlike_bits long, places long", None
    names = [f.split()[0] for f in schema.split(", ")]
    sc = classes.sparkSession.sparkContext
    for block in asked_blocks(cut(questions(media, decode))):
        shared = sc.broadcast(block)

        def compare(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            asked = shared.value
            for whole in batches:
                for k in range(0, len(whole), 1024):
                    b = whole.slice(k, 1024)
                    ids, off = b.column(0).to_numpy(), b.column(1).offsets.to_numpy()
                    v, off = b.column(1).values.to_numpy(zero_copy_only=False)[off[0] : off[-1]], off - off[0]
                    row = np.repeat(np.arange(len(ids)), np.diff(off))
                    # Once in each run of equal integers.
                    first = np.flatnonzero(np.r_[True, (v[1:] != v[:-1]) | (row[1:] != row[:-1])]) if len(v) else np.zeros(0, np.int64)
                    best: dict = {}
                    for r, q, offset in asked.hits(v[first], row[first], first - off[row[first]]):
                        if asked.ids[q] != ids[r]:
                            # Places of a query begun within a hop lie between two of its own.
                            for o in (int(offset), int(offset) - 1):
                                bits, n = unlike(asked.fps[q], v[off[r] : off[r + 1]], o)
                                if n >= OVERLAP and bits <= UNLIKE * 32 * n:
                                    best[q, r] = min(best.get((q, r), (9.0,)), (bits / n, -n, o, bits))
                    rows = [(int(asked.ids[q]), int(ids[r]), x[2], x[3], -x[1]) for (q, r), x in best.items()]
                    cols = list(zip(*rows, strict=True)) or [()] * 5
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if k == 2 else pa.int64()) for k, c in enumerate(cols)], names)

        found = classes.select("class_id", "fp").mapInArrow(compare, schema)
        out = found if out is None else out.unionByName(found)
    return out if out is not None else classes.sparkSession.createDataFrame([], schema)


def search(media: DataFrame, ident: str, column: str, decode: Callable, asked: Column) -> DataFrame:
    """Membership rows (id, class_id, frames, nulls) and a row for each aligned pair of a class with a query in it and another class.

    ``class_id`` is the smallest id of equal fingerprints; in rows of pairs, ``id`` is the query's class.
    ``asked`` picks the queries by the column ``id``.
    """
    rows = cut(fingerprints(media, ident, column, decode))
    classes = cut(rows.groupBy("key").agg(F.min("id").alias("class_id"), F.first("fp").alias("fp")))
    known = classes.where("class_id is not null")
    # One recording asks for each class: of the smallest id that is asked.
    ids = rows.where(F.coalesce(asked, F.lit(False))).groupBy("key").agg(F.min("id").alias("id")).join(known.select("key", "class_id"), "key").select("id", F.col("class_id").alias("query_id"))
    own = media.select(F.col(ident).cast("long").alias("id"), F.col(column).alias("media")).where(F.coalesce(asked, F.lit(False))).join(ids, "id")
    own = own.groupBy("query_id").agg(F.first("media").alias("media")).join(known.select(F.col("class_id").alias("query_id"), "fp"), "query_id")
    pairs = aligned(known.select("class_id", "fp"), own, decode)
    member = rows.select("id", "key", F.size("fp").cast("long").alias("places")).join(classes.select("key", "class_id"), "key")
    null = F.lit(None)
    return member.select("id", "class_id", "places", null.cast("long").alias("match_id"), null.cast("int").alias("offset"), null.cast("long").alias("unlike_bits")).unionByName(
        pairs.select(F.col("query_id").alias("id"), F.col("query_id").alias("class_id"), "places", "match_id", "offset", "unlike_bits")
    )


def op7(spark, sf_dir: str) -> DataFrame:
    """The tables hold no recordings: every vector of ``embeddings`` is played as tones."""
    found = search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "embedding", tones, F.col("id") % 50 == 0)
    return found.withColumnRenamed("id", "vec_id")
