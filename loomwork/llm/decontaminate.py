"""Benchmark decontamination: seeds that no passage over the threshold can lack, then Smith-Waterman alignment.

Words are runs of bytes other than white space and ASCII punctuation, A-Z in lower case. The
alignment scores words (match 2, else -1; gap -1) between an item and a text, as a share of the
item's own score. Of an item of n words, an alignment with m matches and e others that reaches
``threshold`` has ``2m - e >= 2 * threshold * n``, so ``m >= threshold * n``, and the matches are in
at most e + 1 runs, so ``(2 * threshold - 1) * n - 1`` or more pairs of neighbours match. A text and an
item are aligned where so many of the item's pairs of words (of its words, if it is so short
that none need be) are in the text, around these, and where so many of its words are there. Nothing
else is skipped: the pairs found and their scores are those of aligning everything.

The benchmark is the query set: it is read in blocks of at most ``SEEDS`` seeds, each broadcast and
compared with all texts, so a larger benchmark takes more passes and no more memory.

Defined results: null and empty texts and items share nothing; an item of one word is in every
text that has it; repeated rows of either side each count; empty tables give an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.llm.words import LOOSE, blocks, mix, raw, tokens, trimmed

SEEDS = 1 << 20
#: Items met at once.
STEP = 1 << 20
MATCH, MISS, GAP = 2.0, -1.0, -1.0
THRESHOLD = 0.6


def align(item: np.ndarray, text: np.ndarray) -> float:
    """Best local alignment's score."""
    slope = -GAP * np.arange(len(text) + 1)
    h = np.zeros(len(text) + 1)
    best = 0.0
    for w in item:
        new = np.maximum(0.0, h + GAP)
        new[1:] = np.maximum(new[1:], h[:-1] + np.where(text == w, MATCH, MISS))
        h = np.maximum.accumulate(new + slope) - slope
        h[0] = 0.0
        best = max(best, float(h.max()))
    return best


def item_words(texts: list[str | None]) -> list[np.ndarray]:
    data, off = raw(pa.array(texts, pa.string()))
    h, row = tokens(data, off, LOOSE)
    return np.split(h, np.searchsorted(row, np.arange(1, len(texts))))


def seeds(h: np.ndarray, row: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of k words (one or two) within rows, and their places."""
    if k == 1:
        return h, np.arange(len(h))
    at = np.flatnonzero(row[1:] == row[:-1])
    return mix(mix(h[at]) ^ h[at + 1]), at


def at_least(x: float) -> int:
    return int(np.ceil(x - 1e-9))


class Block:
    """Items with their seeds, sorted: runs of ``k`` words, of two or of one."""

    def __init__(self, ids: list[int], texts: list[str | None], threshold: float):
        self.ids, self.words = ids, item_words(texts)
        self.matches = [at_least(threshold * len(w)) for w in self.words]
        self.reach = [len(w) + at_least(2 * (1 - threshold) * len(w)) for w in self.words]
        pairs = [at_least((2 * threshold - 1) * len(w) - 1) for w in self.words]
        self.k = [2 if n > 0 else 1 for n in pairs]
        self.need = np.array([n if n > 0 else max(m, 1) for n, m in zip(pairs, self.matches, strict=True)], np.int64)
        self.own, found = [], []
        for i, (w, k) in enumerate(zip(self.words, self.k, strict=True)):
            s, n = np.unique(seeds(w, np.zeros(len(w), np.int64), k)[0], return_counts=True)
            self.own.append(s)
            found.append((s, np.full(len(s), i), n))
        s, items, n = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.argsort(s, kind="stable")
        #: Item and number of places of each seed; those of distinct seed j are ``first[j]`` to ``first[j + 1]``.
        self.items, self.times = items[order], n[order]
        self.distinct, first = np.unique(s[order], return_index=True)
        self.first = np.r_[first, len(s)]
        self.ks = sorted(set(self.k))


def item_blocks(items: DataFrame, threshold: float) -> Iterator[Block]:
    """Blocks of at most SEEDS seeds, read one at a time."""
    ids, texts, size = [], [], 0
    for r in items.select(F.col("item_id").cast("long"), "text").toLocalIterator():
        ids.append(r[0])
        texts.append(r[1])
        size += len((r[1] or "").split())
        if size >= SEEDS:
            yield Block(ids, texts, threshold)
            ids, texts, size = [], [], 0
    if ids:
        yield Block(ids, texts, threshold)


def hits(h: np.ndarray, row: np.ndarray, b: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each seed found: its place among the words, its row, its index; by place."""
    found = []
    for k in b.ks if len(b.distinct) else ():
        s, at = seeds(h, row, k)
        j = np.minimum(np.searchsorted(b.distinct, s), len(b.distinct) - 1)
        held = b.distinct[j] == s
        found.append((at[held], j[held]))
    at, seed = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 2
    order = np.argsort(at, kind="stable")
    return at[order], row[at[order]], seed[order]


def candidates(seed: np.ndarray, b: Block) -> np.ndarray:
    """Items of which enough places are among the seeds of one text."""
    seed, total = np.unique(seed), np.zeros(len(b.ids), np.int64)
    width = b.first[seed + 1] - b.first[seed]
    ends = np.cumsum(width)
    i = 0
    while i < len(seed):
        j = max(i + 1, int(np.searchsorted(ends, ends[i] - width[i] + STEP, "right")))
        w = width[i:j]
        at = np.arange(w.sum()) + np.repeat(b.first[seed[i:j]] - np.r_[0, np.cumsum(w)[:-1]], w)
        total += np.bincount(b.items[at], b.times[at], len(total)).astype(np.int64)
        i = j
    return np.flatnonzero(total >= b.need)


def best_score(i: int, at: np.ndarray, text: np.ndarray, b: Block) -> float:
    """Score of item i in one text, of which ``at`` are the places of its seeds, or 0 if under the threshold."""
    item, reach, best, k = b.words[i], b.reach[i], 0.0, 0
    while k < len(at):
        # One window holds all alignments with seeds within an item's length; the next starts at the first beyond.
        end = int(at[k]) + len(item)
        part = text[max(0, int(at[k]) - reach) : end + reach]
        if np.isin(item, part).sum() >= b.matches[i]:
            best = max(best, align(item, part))
        k = int(np.searchsorted(at, end))
    return best / (MATCH * len(item))


def matches(column: pa.Array, b: Block, threshold: float) -> Iterator[tuple[int, int | None, float]]:
    """Row, item and score of every pair of a text of the column and an item of the block at or above the threshold."""
    data, off = raw(column)
    for lo, hi in blocks(off):
        h, row = tokens(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], LOOSE)
        at, srow, seed = hits(h, row, b)
        edge = np.r_[np.flatnonzero(np.r_[True, srow[1:] != srow[:-1]]), len(srow)] if len(srow) else [0]
        for s, e in zip(edge[:-1], edge[1:], strict=True):
            r, text = int(srow[s]), None
            for i in candidates(seed[s:e], b).tolist():
                if text is None:
                    first, last = np.searchsorted(row, r), np.searchsorted(row, r, "right")
                    text, places, held = h[first:last], at[s:e] - first, b.distinct[seed[s:e]]
                score = best_score(i, places[np.isin(held, b.own[i])], text, b)
                if score >= threshold:
                    yield lo + r, b.ids[i], score


def aligned(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, item_id, score of every pair at or above the threshold."""
    spark, out = docs.sparkSession, None
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    for block in item_blocks(items, threshold):
        shared = spark.sparkContext.broadcast(block)

        def compare(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for x in batches:
                rows = [(x.column(0)[r].as_py(), i, score) for r, i, score in matches(x.column(1), shared.value, threshold)]
                cols = list(zip(*rows, strict=True)) or [()] * 3
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.float64()), strict=True)], ["doc_id", "item_id", "score"])

        found = docs.mapInArrow(trimmed(compare), "doc_id long, item_id long, score double")
        out = found if out is None else out.union(found)
    return out if out is not None else spark.createDataFrame([], "doc_id long, item_id long, score double")


def without_leaks(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose text is aligned with no item, whatever their ids; columns as they were."""
    at = docs.columns.index("text")
    for block in item_blocks(items, threshold):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def keep(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for x in batches:
                clean = np.ones(len(x), bool)
                clean[[r for r, _, _ in matches(x.column(at), shared.value, threshold)]] = False
                yield x.filter(pa.array(clean))

        docs = docs.mapInArrow(trimmed(keep), docs.schema)
    return docs


def op3(spark, sf_dir: str) -> DataFrame:
    return aligned(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
