"""N-gram Jaccard join with adaptive multi-match prefixes, and the classes that its links form.

Texts become sets of hashed word shingles; equal sets are one class from the start. All shingles
are counted over all sets (in blocks by hash), and a set's shingles are ordered from rare to
frequent. If two sets overlap by at least ``t = ceil(threshold * size)``, then for any l the first
``size - t + l`` shingles of both share at least l. Each set picks its own l: a longer prefix costs
postings but leaves fewer candidates to verify, and both follow from the counts. A pair needs
as many shared shingles as the smaller of its two l. Shingles that one set alone holds never
match, so a set whose shared ones are under t has no partner at all, and overlaps need the shared ones only.

What is returned are classes, so not all pairs inside a group are made. First each set is
verified against the best of the leaders of its postings; then all candidates that are not yet
in one class, none left out; links of both give the components.

Defined results: null, empty and blank texts have an empty set and no links; a text with fewer
words than a shingle has its whole sequence as its only shingle; rows with equal sets are linked;
rows that repeat are rows of their own; a component whose rows have no id has none. Shingles are told apart by 64 bits, sets by 64 bits and their size; a column named
__n, __sig or __root is not allowed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.llm.words import U, blocks, give_back, mix, raw, shingles, tokens, trimmed
from loomwork.operators.graph import components
from loomwork.session import cut

#: Longest extension of a prefix, and what verifying one shingle costs against one posting.
MOST = 24
#: Longs of parity bits that a set carries; two sets differ by at least as many shingles as bits.
LONGS = 8
VERIFY = 1 / 16
#: Bytes of text whose shingles are counted in one group.
PART = 32 << 20
#: Bytes of text taken at once.
STEP = 1 << 20


def sets_of(data: np.ndarray, off: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles sorted in each row, their rows, and each row's size and signature (0 where empty)."""
    n = len(off) - 1
    h, row = shingles(*tokens(data, off), k)
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    keep = np.r_[True, (h[1:] != h[:-1]) | (row[1:] != row[:-1])] if len(h) else np.zeros(0, bool)
    h, row = h[keep], row[keep]
    size = np.bincount(row, minlength=n).astype(np.int64)
    sig = np.zeros(n, U)
    full = np.flatnonzero(size)
    if len(full):
        at = np.r_[0, np.cumsum(size)[:-1]][full]
        sig[full] = mix(np.add.reduceat(mix(h ^ U(0x2545F4914F6CDD1D)), at) ^ (size[full].astype(U) << U(32)))
    return h, row, size, sig


def with_signatures(docs: DataFrame, k: int) -> DataFrame:
    """``docs`` with the size of each text's set and its signature, null where empty."""
    names = docs.columns

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, off = raw(b.column(names.index("text")))
            for lo, hi in blocks(off, STEP):
                _, _, size, sig = sets_of(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], k)
                yield pa.RecordBatch.from_arrays([*b.slice(lo, hi - lo).columns, pa.array(size), pa.array(sig.view(np.int64), mask=size == 0)], [*names, "__n", "__sig"])

    from pyspark.sql.types import LongType, StructType

    return docs.mapInArrow(trimmed(add), StructType([*docs.schema.fields]).add("__n", LongType()).add("__sig", LongType()))


def parity(tok: np.ndarray) -> np.ndarray:
    """For each of 64 * LONGS places, whether an odd number of shingles fall there."""
    odd = np.bincount((mix(tok ^ U(0x1D8E4E27C47D124F)) % U(64 * LONGS)).astype(np.int64), minlength=64 * LONGS) & 1
    return np.packbits(odd.astype(bool)).view(np.int64)


def stretches(x: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """Value, start and end of each run of equal values."""
    first = np.flatnonzero(np.r_[True, x[1:] != x[:-1]]) if len(x) else np.zeros(0, np.int64)
    return zip(x[first].tolist(), first.tolist(), np.r_[first, len(x)][1:].tolist(), strict=True)


def joined(column: pa.ChunkedArray, kind: type) -> np.ndarray:
    return np.concatenate([np.zeros(0, kind), *(np.frombuffer(x.as_buffer(), kind) for x in column)])


def active_sets(docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """Sets that may have partners: sig, n, ell, prefix, first (length of the prefix of l = 1), held (shingles that others have too), mass (mean log of their counts), bits (parity of the shared ones), tokens (those shared, sorted, as bytes)."""
    # Groups of about PART bytes of text, so that what a task holds does not grow with the input.
    size = int(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // PART))

    def scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in batches:
            data, off = raw(b.column(0))
            for lo, hi in blocks(off, 2 * STEP):
                h, row, size, sig = sets_of(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], k)
                new = np.zeros(hi - lo, bool)
                for i in np.flatnonzero(size):
                    if (s := int(sig[i])) not in seen:
                        seen.add(s)
                        new[i] = True
                keep = new[row]
                h, row = h[keep], row[keep]
                part = (h % U(parts)).astype(np.int64)
                order = np.argsort(part, kind="stable")
                h, row, part = h[order], row[order], part[order]
                cols: list[list] = [[] for _ in range(5)]
                for p, s, e in stretches(part):
                    r = row[s:e]
                    first = np.flatnonzero(np.r_[True, r[1:] != r[:-1]])
                    own = r[first]
                    for c, v in zip(cols, (p, h[s:e].tobytes(), sig[own].tobytes(), size[own].astype(np.uint32).tobytes(), np.diff(np.r_[first, len(r)]).astype(np.uint32).tobytes()), strict=True):
                        c.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), *[pa.binary()] * 4), strict=True)], ["part", "shingles", "sigs", "sizes", "counts"])

    def count(group: pa.Table) -> pa.Table:
        give_back()
        tok = joined(group["shingles"], U)
        counts = joined(group["counts"], np.uint32)
        sig, size = np.repeat(joined(group["sigs"], U), counts), np.repeat(joined(group["sizes"], np.uint32), counts)
        order = np.lexsort((sig, tok))
        tok, sig, size = tok[order], sig[order], size[order]
        keep = np.r_[True, (tok[1:] != tok[:-1]) | (sig[1:] != sig[:-1])]
        tok, sig, size = tok[keep], sig[keep], size[keep]
        first = np.flatnonzero(np.r_[True, tok[1:] != tok[:-1]])
        times = np.diff(np.r_[first, len(tok)])
        df = np.repeat(times, times)
        keep = df > 1
        tok, sig, size, df = tok[keep], sig[keep], size[keep], df[keep].astype(np.uint32)
        to = (sig % U(parts)).astype(np.int64)
        order = np.lexsort((sig, to))
        tok, sig, size, df, to = (x[order] for x in (tok, sig, size, df, to))
        cols: list[list] = [[] for _ in range(6)]
        for q, lo, hi in stretches(to):
            own, s = slice(lo, hi), sig[lo:hi]
            first = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
            for c, v in zip(cols, (q, tok[own].tobytes(), df[own].tobytes(), s[first].tobytes(), size[own][first].tobytes(), np.diff(np.r_[first, len(s)]).astype(np.uint32).tobytes()), strict=True):
                c.append(v)
        return pa.table([pa.array(c, t) for c, t in zip(cols, (pa.int32(), *[pa.binary()] * 5), strict=True)], names=["to", "shingles", "dfs", "sigs", "sizes", "counts"])

    def prefixes(group: pa.Table) -> pa.Table:
        give_back()
        tok, df, counts = joined(group["shingles"], U), joined(group["dfs"], np.uint32), joined(group["counts"], np.uint32)
        sig, size = np.repeat(joined(group["sigs"], U), counts), np.repeat(joined(group["sizes"], np.uint32), counts).astype(np.int64)
        order = np.lexsort((tok, df, sig))
        tok, df, sig, size = tok[order], df[order].astype(np.int64), sig[order], size[order]
        first = np.flatnonzero(np.r_[True, sig[1:] != sig[:-1]])
        held = np.diff(np.r_[first, len(sig)])
        need = -(-num * size[first] // den)
        mass = np.add.reduceat(np.log(df), first) if len(first) else held
        cols: list[list] = [[] for _ in range(9)]
        for i in np.flatnonzero(held >= need):
            own, t = slice(first[i], first[i] + held[i]), int(need[i])
            start = int(held[i]) - t + 1
            ells = np.arange(1, min(MOST, t) + 1)
            postings = np.cumsum(df[own] - 1)[start - 1 + ells - 1]
            ell = int(ells[np.argmin(postings + postings / ells * (held[i] * VERIFY))])
            for c, v in zip(cols, (sig[first[i]].view(np.int64), size[first[i]], ell, tok[own][: start + ell - 1].view(np.int64), start, held[i], mass[i] / size[first[i]], parity(tok[own]), np.sort(tok[own]).tobytes()), strict=True):
                c.append(v)
        return pa.table([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.int32(), pa.int64(), pa.float64(), pa.list_(pa.int64()), pa.binary()), strict=True)], names=["sig", "n", "ell", "prefix", "first", "held", "mass", "bits", "tokens"])

    blobs = docs.select("text").mapInArrow(trimmed(scatter), "part int, shingles binary, sigs binary, sizes binary, counts binary")
    shared = blobs.groupBy("part").applyInArrow(count, "to int, shingles binary, dfs binary, sigs binary, sizes binary, counts binary")
    return cut(shared.groupBy("to").applyInArrow(prefixes, "sig long, n long, ell int, prefix array<long>, first int, held long, mass double, bits array<long>, tokens binary"))


def verified(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) whose sets meet the threshold, with what they share."""
    left = sets.select(F.col("sig").alias("a"), F.col("n").alias("n_a"), F.col("tokens").alias("t_a"))
    right = sets.select(F.col("sig").alias("b"), F.col("n").alias("n_b"), F.col("tokens").alias("t_b"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "n_a", "n_b", "t_a", "t_b")

    def overlap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            common = np.array([len(np.intersect1d(np.frombuffer(s.as_buffer(), U), np.frombuffer(t.as_buffer(), U), assume_unique=True)) for s, t in zip(x.column(4), x.column(5), strict=True)], np.int64)
            keep = pa.array(den * common >= num * (x.column(2).to_numpy() + x.column(3).to_numpy() - common))
            yield pa.RecordBatch.from_arrays([x.column(0), x.column(1), pa.array(common)], ["a", "b", "common"]).filter(keep)

    return both.mapInArrow(trimmed(overlap), "a long, b long, common long")


def links(sets: DataFrame, num: int, den: int) -> DataFrame:
    """Enough links between sets to connect all that chains of links connect: columns a, b."""
    postings = sets.select("sig", "n", "ell", "held", "mass", "first", F.posexplode("prefix").alias("pos", "tok"))
    postings = postings.withColumn("level", F.greatest(F.lit(1), F.col("pos") - F.col("first") + 2)).drop("first")
    shared = postings.groupBy("tok").agg(F.count(F.lit(1)).alias("others")).where("others > 1")
    postings = cut(postings.join(shared.select("tok"), "tok"))
    found = None
    # In a large group the set whose shingles are the most common links with most others; it leads first.
    for order in (-F.col("mass"), F.xxhash64(F.lit(1), "sig")):
        leaders = postings.groupBy("tok").agg(F.min(F.struct(order.alias("h"), F.col("sig").alias("leader")))["leader"].alias("leader"))
        votes = postings.join(leaders, "tok").where("sig <> leader").groupBy("sig", "leader").agg(F.count(F.lit(1)).alias("shared"))
        best = votes.groupBy("sig").agg(F.max(F.struct("shared", "leader"))["leader"].alias("leader"))
        pairs = best.select(F.least("sig", "leader").alias("a"), F.greatest("sig", "leader").alias("b"))
        found = pairs if found is None else found.union(pairs).distinct()
    tied = cut(verified(found, sets, num, den).select("a", "b"))
    roots = cut(components(tied))
    placed = postings.join(roots.withColumnRenamed("node", "sig"), "sig", "left").withColumn("root", F.coalesce("root", "sig"))
    mixed = placed.groupBy("tok").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("tok")
    placed = placed.join(mixed, "tok").join(sets.select("sig", *[F.col("bits")[k].alias(f"bits{k}") for k in range(LONGS)]), "sig")
    x, y = (placed.select("tok", *[F.col(c).alias(f"{c}_{s}") for c in ("sig", "n", "ell", "level", "root", "held", "pos", *[f"bits{k}" for k in range(LONGS)])]) for s in "xy")
    ell = F.least("ell_x", "ell_y")
    # The most that two sets can share, given where in both a common shingle stands among the shared ones.
    most = F.least("pos_x", "pos_y") + 1 + F.least(F.col("held_x") - F.col("pos_x") - 1, F.col("held_y") - F.col("pos_y") - 1)
    unlike = sum((F.bit_count(F.col(f"bits{k}_x").bitwiseXOR(F.col(f"bits{k}_y"))) for k in range(LONGS)), F.lit(0))
    most = F.least(most, (F.col("held_x") + F.col("held_y") - unlike) / 2)
    near = (F.col("sig_x") < F.col("sig_y")) & (F.col("root_x") != F.col("root_y")) & ((num + den) * most >= num * (F.col("n_x") + F.col("n_y")))
    pairs = x.join(y, "tok").where(near & (F.greatest("level_x", "level_y") <= ell))
    pairs = pairs.groupBy(F.col("sig_x").alias("a"), F.col("sig_y").alias("b"), ell.alias("ell")).agg(F.count(F.lit(1)).alias("shared")).where("shared >= ell").select("a", "b")
    return tied.union(verified(pairs, sets, num, den).select("a", "b"))


def classes(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """``docs`` (with doc_id and text) with __n, the set's size, __sig, and __root, which rows of one class share (null where the set is empty)."""
    signed = with_signatures(docs, k)
    roots = cut(components(links(active_sets(docs, k, num, den), num, den)))
    return signed.join(roots.select(F.col("node").alias("__sig"), F.col("root").alias("__root")), "__sig", "left").withColumn("__root", F.coalesce("__root", "__sig"))


def near_components(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id of every row."""
    rows = cut(classes(docs.select("doc_id", "text"), k, num, den).select("doc_id", "__n", "__root"))
    least = rows.where("__root is not null").groupBy("__root").agg(F.min("doc_id").alias("__least"))
    return rows.join(least, "__root", "left").select("doc_id", F.col("__n").alias("n_shingles"), F.coalesce("__least", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The row with the smallest doc_id of each class, and all rows with empty sets; columns as in ``docs``."""
    rows = classes(docs.select("doc_id", "text"), k, num, den).select("doc_id", "__sig", "__root")
    best = cut(rows.where("__root is not null").groupBy("__root").agg(F.min(F.struct("doc_id", "__sig")).alias("first")).select(F.col("first.doc_id").alias("__id"), F.col("first.__sig").alias("__sig")))
    signed = with_signatures(docs, k)
    kept = signed.join(best.hint("shuffle_hash"), (signed["__sig"] == best["__sig"]) & signed["doc_id"].eqNullSafe(best["__id"]), "left_semi").dropDuplicates(["doc_id", "__sig"])
    return kept.union(signed.where("__n = 0")).select(*docs.columns)


def op2(spark, sf_dir: str) -> DataFrame:
    return near_components(spark.read.parquet(f"{sf_dir}/documents.parquet"), k=4, num=85, den=100)
