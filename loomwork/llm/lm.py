"""Language-model scores from a log-frequency Bloom filter.

Counts of words and of pairs of words are quantised to levels of a logarithm; a key with level j
stands in the filter under (key, 1) to (key, j), and a reader asks level after level until one
is missing. Keys are dealt to shards by hash, as many as the corpus has ``SHARD`` bytes, and each shard's part of
the filter has as many bits as its entries need at ``LOAD``: no count is left out, however large the corpus. Parts
are broadcast in blocks of at most ``BITS`` bits; where there are several, each asks in a pass of its own, and
the levels found so far travel with the texts.

A pair's probability is ``(c(vw) + MU * p(w)) / (c(v) + MU)`` with counts read from the filter and
``p(w) = (c(w) + 0.5) / (N + 0.5 * (V + 1))``. The unigram base is exact: frequent words come from a
broadcast list of at most ``HOT_KEYS`` words, all others from a shuffled join.

Defined results: null text is empty and consists of the end token; repeated rows each get a row;
a null id is trained on as the empty string's remainder says; an empty table gives an empty result, and
scores against an empty training table are those of unseen tokens.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwork.llm.lookup import finish, frequent
from loomwork.llm.words import U, blocks, mix, raw, row_keys, tokens, trimmed
from loomwork.session import cut

BITS = 1 << 30
SHARD = 8 << 20
#: Bytes of text scored at once.
STEP = 1 << 20
PROBES = 4
LOAD = 0.5
MU = 4.0
HOT_KEYS = 1 << 19
END = U(0xE7037ED1A0B428DB)
PAIR = U(0x8EBC6AF09C88C6E3)
#: Least count of each level.
LEVELS = np.unique(np.floor(1.5 ** np.arange(0, 100)).astype(np.float64))


def with_ends(h: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """An end token after each row's words."""
    at = np.searchsorted(row, np.arange(n), "right")
    return np.insert(h, at, END), np.insert(row, at, np.arange(n))


def pairs(h: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Key of each token with the one before it (at the start of a text, an end token), and that token."""
    before = np.r_[END, h[:-1]]
    before[np.r_[True, row[1:] != row[:-1]]] = END
    return mix(before * PAIR ^ h), before


def shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    return ((keys >> U(32)) * U(shards) >> U(32)).astype(np.int64)


def places(keys: np.ndarray, level: int, size: np.ndarray | int) -> Iterator[np.ndarray]:
    """The bits of (key, level) in a part of ``size`` bits."""
    a = mix(keys + U(level * 0x9E3779B97F4A7C15 % (1 << 64)))
    b = mix(a ^ U(0x589965CC75374CC3)) | U(1)
    for k in range(PROBES):
        yield (a + U(k) * b) % np.asarray(size, U)


def bits_for(entries: int) -> int:
    """Bits of a part, in whole bytes, so that its load stays at LOAD."""
    return max(8, -(-int(entries * PROBES / -np.log(1 - LOAD)) // 8) * 8)


class Filter:
    """Parts ``first`` to ``first + len(sizes)`` of a filter of ``shards`` parts, one after another."""

    def __init__(self, parts: np.ndarray, sizes: np.ndarray, first: int, shards: int):
        self.parts, self.sizes, self.first, self.shards = parts, sizes, first, shards
        self.at = np.r_[0, np.cumsum(sizes)[:-1]].astype(U) if len(sizes) else sizes

    def levels(self, keys: np.ndarray) -> np.ndarray:
        """Levels of keys; 0 for those of other parts."""
        out = np.zeros(len(keys), np.uint8)
        shard = shard_of(keys, self.shards) - self.first
        left = np.flatnonzero((shard >= 0) & (shard < len(self.sizes)))
        level = 1
        while len(left):
            held, part = keys[left], shard[left]
            hit = np.ones(len(left), bool)
            for at in places(held, level, self.sizes[part]):
                at = at + self.at[part]
                hit &= (self.parts[at >> U(3)] >> (at & U(7)).astype(np.uint8)) & 1 > 0
            left = left[hit]
            out[left] = level
            level += 1
        return out


def counts(level: np.ndarray) -> np.ndarray:
    """Middle of a level's counts; 0 where no level is held."""
    low = LEVELS[np.maximum(level.astype(np.int64) - 1, 0)]
    high = LEVELS[np.minimum(level, len(LEVELS) - 1)] - 1
    return np.where(level > 0, (low + np.maximum(high, low)) / 2, 0.0)


def train(docs: DataFrame, shard: int = SHARD) -> tuple[DataFrame, int]:
    """Counts of all words and pairs, merged by shard: a row per shard with its words, their counts, its keys, and its part of the filter; the number of shards."""
    shards = max(8, -(-int(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // shard))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, off = raw(b.column(0))
            for lo, hi in blocks(off):
                h, row = with_ends(*tokens(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]), hi - lo)
                cols: list[list] = [[], [], [], []]
                for kind, keys in ((1, h), (2, pairs(h, row)[0])):
                    keys, n = np.unique(keys, return_counts=True)
                    own = shard_of(keys, shards)
                    first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
                    for s, e in zip(first.tolist(), [*first[1:].tolist(), len(own)], strict=True):
                        for c, v in zip(cols, (int(own[s]), kind, keys[s:e].tobytes(), n[s:e].astype(np.uint32).tobytes()), strict=True):
                            c.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)], ["shard", "kind", "keys", "counts"])

    def merge(group: pa.Table) -> pa.Table:
        kinds = group["kind"].to_numpy()
        out = {}
        for kind in (1, 2):
            own = np.flatnonzero(kinds == kind)
            keys = np.concatenate([np.zeros(0, U), *(np.frombuffer(group["keys"][int(i)].as_buffer(), U) for i in own)])
            n = np.concatenate([np.zeros(0, np.uint32), *(np.frombuffer(group["counts"][int(i)].as_buffer(), np.uint32) for i in own)])
            order = np.argsort(keys, kind="stable")
            keys, n = keys[order], n[order].astype(np.int64)
            first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
            out[kind] = keys[first], np.add.reduceat(n, first) if len(first) else n
        keys, n = (np.concatenate([out[1][i], out[2][i]]) for i in (0, 1))
        level = np.searchsorted(LEVELS, n, "right")
        size = bits_for(int(level.sum()))
        return pa.table(
            {
                "shard": pa.array([group["shard"][0].as_py()], pa.int32()),
                "n_tokens": pa.array([int(out[1][1].sum())], pa.int64()),
                "n_words": pa.array([len(out[1][0])], pa.int64()),
                "words": pa.array([out[1][0].tobytes()], pa.binary()),
                "counts": pa.array([out[1][1].tobytes()], pa.binary()),
                "bits": pa.array([size], pa.int64()),
                "part": pa.array([filled(keys, level, size)], pa.binary()),
            }
        )

    def filled(keys: np.ndarray, level: np.ndarray, size: int) -> bytes:
        flags = np.zeros(size, bool)
        step = 1
        while len(keys := keys[level >= step]):
            level = level[level >= step]
            for at in places(keys, step, size):
                flags[at] = True
            step += 1
        return np.packbits(flags, bitorder="little").tobytes()

    schema = "shard int, kind int, keys binary, counts binary"
    merged = "shard int, n_tokens long, n_words long, words binary, counts binary, bits long, part binary"
    return cut(docs.select("text").mapInArrow(trimmed(count), schema).groupBy("shard").applyInArrow(merge, merged)), shards


def filters(trained: DataFrame, shards: int, bits: int = BITS) -> Iterator[Filter]:
    """The filter in blocks of whole parts, at most ``bits`` bits or one part each; at least one block."""
    sizes = np.full(shards, 8, np.int64)
    for r in trained.select("shard", "bits").toLocalIterator():
        sizes[r[0]] = r[1]
    first = 0
    while first < shards:
        held = np.cumsum(sizes[first:])
        end = first + max(1, int(np.searchsorted(held, bits, "right")))
        parts = np.zeros(int(held[end - first - 1]) // 8, np.uint8)
        begins = np.r_[0, held // 8]
        for r in trained.where((F.col("shard") >= first) & (F.col("shard") < end)).select("shard", "part").toLocalIterator():
            at = int(begins[r[0] - first])
            parts[at : at + len(r[1])] = np.frombuffer(r[1], np.uint8)
        yield Filter(parts, sizes[first:end], first, shards)
        first = end


def word_counts(counted: DataFrame) -> DataFrame:
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for words, n in zip(b.column(0), b.column(1), strict=True):
                w, n = np.frombuffer(words.as_buffer(), np.int64), np.frombuffer(n.as_buffer(), np.int64)
                for i in range(0, len(w), 100_000):
                    yield pa.RecordBatch.from_arrays([pa.array(w[i : i + 100_000]), pa.array(n[i : i + 100_000])], ["word", "c"])

    return counted.select("words", "counts").mapInArrow(rows, "word long, c long")


def score(docs: DataFrame, training: DataFrame, bits: int = BITS, hot_keys: int = HOT_KEYS, shard: int = SHARD) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score and score of every row of ``docs`` (doc_id, text)."""
    sc = docs.sparkSession.sparkContext
    trained, shards = train(training, shard)
    n_all, n_words = (int(x or 0) for x in trained.agg(F.sum("n_tokens"), F.sum("n_words")).first())
    words = word_counts(trained)
    hot = frequent(words, "c", hot_keys).toArrow()
    order = np.argsort(w := hot["word"].to_numpy().view(U))
    known = sc.broadcast((w[order], hot["c"].to_numpy()[order]))
    norm = n_all + 0.5 * (n_words + 1)
    schema = "row_key long, doc_id long, word long, times long, n_tokens long, known long, held_base double, score double"
    names = [f.split()[0] for f in schema.split(", ")]

    def parsed(b: pa.RecordBatch) -> Iterator[tuple]:
        """Range of rows, their bytes, token hashes and rows, and levels found before."""
        data, off = raw(b.column(1))
        for lo, hi in blocks(off, STEP):
            h, row = with_ends(*tokens(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]), hi - lo)
            before = b.column(2).slice(lo, hi - lo)
            held = np.zeros((2, len(h)), np.uint8) if before.null_count else np.concatenate([np.zeros((2, 0), np.uint8), *(np.frombuffer(x.as_buffer(), np.uint8).reshape(2, -1) for x in before)], axis=1)
            yield lo, hi, data, off, h, row, held

    def asked(lfbf: Filter, keys: np.ndarray, held: np.ndarray) -> np.ndarray:
        """Levels found before or now; probes once per distinct key."""
        u, back = np.unique(keys, return_inverse=True)
        return np.maximum(held, lfbf.levels(u)[back])

    def probe(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for lo, hi, _, _, h, row, held in parsed(b):
                    held = np.stack([asked(shared.value, h, held[0]), asked(shared.value, pairs(h, row)[0], held[1])])
                    ends = np.searchsorted(row, np.arange(1, hi - lo))
                    blobs = [np.ascontiguousarray(x).tobytes() for x in np.split(held, ends, axis=1)]
                    yield pa.RecordBatch.from_arrays([*b.slice(lo, hi - lo).columns[:2], pa.array(blobs, pa.binary())], ["doc_id", "text", "levels"])

        return run

    def final(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            hot_words, hot_counts = known.value
            for b in batches:
                ids = b.column(0)
                for lo, hi, data, off, h, row, held in parsed(b):
                    n = hi - lo
                    key, before = pairs(h, row)
                    c1 = counts(asked(shared.value, h, held[0]))
                    # The token before is the neighbour's, or, at the start of a text, its end token.
                    last = np.searchsorted(row, np.arange(n), "right") - 1
                    context = np.r_[0.0, c1[:-1]]
                    begins = np.r_[0, last[:-1] + 1]
                    context[begins] = c1[last]
                    p1 = (c1 + 0.5) / norm
                    p = (counts(asked(shared.value, key, held[1])) + MU * p1) / (context + MU)
                    total = np.bincount(row, np.log10(np.minimum(p, 1.0)), n)
                    # Exact counts of frequent words here; the rest is emitted.
                    u, back = np.unique(h, return_inverse=True)
                    at = np.minimum(np.searchsorted(hot_words, u), max(len(hot_words) - 1, 0))
                    is_hot = hot_words[at] == u if len(hot_words) else np.zeros(len(u), bool)
                    c = np.where(is_hot, hot_counts[at] if len(hot_words) else 0, 0)
                    hot_here = is_hot[back]
                    base = np.bincount(row, np.where(hot_here, np.log10((c[back] + 0.5) / norm), 0.0), n)
                    n_hot = np.bincount(row, hot_here, n).astype(np.int64)
                    keys = row_keys(ids, data, off, lo, hi)
                    docs_here = ids.slice(lo, n)
                    rest = np.flatnonzero(~hot_here)
                    order = np.lexsort((back[rest], row[rest]))
                    r, w = row[rest][order], back[rest][order]
                    first = np.flatnonzero(np.r_[True, (r[1:] != r[:-1]) | (w[1:] != w[:-1])]) if len(r) else np.zeros(0, np.int64)
                    times = np.diff(np.r_[first, len(r)])
                    nothing = lambda t, m: pa.nulls(m, t)
                    m = len(first)
                    yield pa.RecordBatch.from_arrays([pa.array(keys), docs_here, pa.array(keys), pa.array(np.zeros(n, np.int64)), pa.array(np.bincount(row, minlength=n)), pa.array(n_hot), pa.array(base), pa.array(total)], names)
                    yield pa.RecordBatch.from_arrays([pa.array(keys[r[first]]), docs_here.take(pa.array(r[first])), pa.array(u[w[first]].view(np.int64)), pa.array(times), nothing(pa.int64(), m), nothing(pa.int64(), m), nothing(pa.float64(), m), nothing(pa.float64(), m)], names)

        return run

    docs, shared = docs.select(F.col("doc_id").cast("long"), "text", F.lit(None).cast("binary").alias("levels")), None
    for part in filters(trained, shards, bits):
        if shared is not None:
            # Written, so that only one block of the filter is in a worker's memory.
            docs = cut(docs.mapInArrow(trimmed(probe(shared)), "doc_id long, text string, levels binary"))
            shared.unpersist()
        shared = sc.broadcast(part)
    rows = docs.mapInArrow(trimmed(final(shared)), schema)
    c = F.coalesce("c", F.lit(0))
    out = finish(rows, words, "word", ["n_tokens", "known", "held_base", "score"], {"more": (c > 0).cast("long"), "base": F.log10((c + 0.5) / F.lit(norm))})
    return out.select("doc_id", "n_tokens", (F.col("known") + F.col("more").cast("long")).alias("n_known"), F.lit(n_all).cast("long").alias("train_tokens"), (F.col("held_base") + F.col("base")).alias("base_score"), "score")


def remainder(doc_id: Column, of: int) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % of


def op6(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    held_out = remainder(F.col("doc_id"), 5) == 1
    out = score(docs, docs.where(~held_out))
    return out.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
