"""Null models of count matrices as grouped sums over their coordinates (cell, feature, value)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwork.operators.rank import ranked
from loomwork.session import cut


def canonical(counts: DataFrame) -> DataFrame:
    """Duplicate coordinates summed, zeros dropped."""
    return counts.groupBy("cell", "feature").agg(F.sum("value").alias("value")).where("value <> 0")


def depths(counts: DataFrame, cells: DataFrame) -> DataFrame:
    """cell, depth (its sum, 0 where it has no counts) and s, the depth over the mean depth (null if that is 0)."""
    sums = cells.select("cell").join(counts.groupBy("cell").agg(F.sum("value").alias("depth")), "cell", "left").withColumn("depth", F.coalesce("depth", F.lit(0.0)))
    return sums.crossJoin(F.broadcast(sums.agg(F.avg("depth").alias("__mean")))).select("cell", "depth", F.try_divide("depth", "__mean").alias("s"))


def nb_null(counts: DataFrame, depth: DataFrame, features: DataFrame | None = None) -> DataFrame:
    """Method of moments: feature, baseline (log rate) and dispersion, in one pass over the coordinates.

    ``features`` (feature) are those to be fitted, with or without counts; unless given, those with counts.
    """
    total = depth.agg(F.sum("s").alias("s1"), F.sum(F.col("s") * F.col("s")).alias("s2"))
    x, s = F.col("value"), F.col("s")
    sums = counts.join(depth.select("cell", "s"), "cell").groupBy("feature").agg(F.sum(x).alias("x1"), F.sum(x * x).alias("x2"), F.sum(x * s).alias("xs"))
    if features is not None:
        sums = features.select("feature").join(sums, "feature", "left").na.fill(0.0, ["x1", "x2", "xs"])
    sums = sums.crossJoin(F.broadcast(total))
    r = F.greatest(F.col("x1") / F.greatest("s1", F.lit(1e-12)), F.lit(1e-10))
    out = sums.withColumn("r", r)
    r = F.col("r")
    excess = F.col("x2") - 2 * r * F.col("xs") + r * r * F.col("s2") - r * F.col("s1")
    phi = F.least(F.greatest(excess / F.greatest(r * r * F.col("s2"), F.lit(1e-12)), F.lit(1e-4)), F.lit(1e3))
    return out.select("feature", F.log("r").alias("baseline"), phi.alias("dispersion"))


def equal_count_bins(depth: DataFrame, bins: int) -> DataFrame:
    """Cells in the order of depth and id, cut into bins of equal counts: bin = floor(rank * bins / n)."""
    n = depth.agg(F.count(F.lit(1)).alias("__n"))
    out = ranked(depth, "depth", "cell").crossJoin(F.broadcast(n))
    return out.withColumn("bin", F.expr(f"cast(rank * least({bins}, __n) div __n as int)")).drop("__n", "rank")


def bin_sizes(binned: DataFrame) -> DataFrame:
    """Geometric mean size factor and number of cells of each bin."""
    return binned.groupBy("bin").agg(F.exp(F.avg(F.log("s"))).alias("s_bin"), F.count(F.lit(1)).alias("n_cells"))


def nb_null_at(m: Column, phi: Column) -> Column:
    """Minus the residual of a zero; its square is the Fisher weight."""
    return F.sqrt(m / F.greatest(1 + phi * m, F.lit(1e-8)))


def nb_residual(x: Column, m: Column, phi: Column) -> Column:
    return (x - m) / F.sqrt(F.greatest(m + phi * m * m, F.lit(1e-8)))


#: Distinct depths that are broadcast at once, and products computed at once.
DEPTHS = 1 << 20
STEP = 1 << 20
_NEAR_1 = 1 - 1e-12


def expected(q: np.ndarray, depth: np.ndarray, cells: np.ndarray) -> np.ndarray:
    """Expected detections at each rate."""
    out, log = np.zeros(len(q)), np.log1p(-np.minimum(q, _NEAR_1))
    size = max(1, STEP // max(1, len(q)))
    for k in range(0, len(depth), size):
        out -= np.expm1(np.outer(log, depth[k : k + size])) @ cells[k : k + size]
    return out


def bernoulli_rates(detected: DataFrame, depth: DataFrame, rounds: int = 40, features: DataFrame | None = None, depths: int | None = None) -> DataFrame:
    """feature, q: sum over cells of 1 - (1 - q) ** depth equals the feature's detections, by geometric bisection; 0 where there are none.

    The sum depends on the depths through their histogram alone. It is broadcast if it has at most ``depths``
    bars; else blocks of it are summed up in a pass each, round by round.
    """
    hist = cut(depth.groupBy("depth").agg(F.count(F.lit(1)).cast("double").alias("n")))
    totals = detected.groupBy("feature").agg(F.count(F.lit(1)).cast("double").alias("total"))
    if features is not None:
        totals = features.select("feature").join(totals, "feature", "left").na.fill(0.0, ["total"])
    blocks = max(1, -(-hist.count() // (depths or DEPTHS)))
    kind = totals.schema["feature"].dataType.simpleString()
    sc = detected.sparkSession.sparkContext

    def block(k: int):
        part = hist.where(F.pmod(F.xxhash64("depth"), F.lit(blocks)) == k).toArrow()
        order = np.argsort(part["depth"].to_numpy())
        return sc.broadcast((part["depth"].to_numpy()[order], part["n"].to_numpy()[order]))

    def halved(lo: np.ndarray, hi: np.ndarray, got: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        over, mid = got > total, np.sqrt(lo * hi)
        return np.where(over, lo, mid), np.where(over, mid, hi)

    def rate(lo: np.ndarray, hi: np.ndarray, total: np.ndarray) -> np.ndarray:
        return np.where(total > 0, np.minimum(np.sqrt(lo * hi), _NEAR_1), 0.0)

    if blocks == 1:
        one = block(0)

        def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                total = b.column(1).to_numpy()
                lo, hi = np.full(len(total), 1e-12), np.ones(len(total))
                for _ in range(rounds):
                    lo, hi = halved(lo, hi, expected(np.sqrt(lo * hi), *one.value), total)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rate(lo, hi, total))], ["feature", "q"])

        return totals.mapInArrow(solve, f"feature {kind}, q double")
    state = cut(totals.select("feature", "total", F.lit(1e-12).alias("lo"), F.lit(1.0).alias("hi"), F.lit(0.0).alias("got")))
    names, schema = ["feature", "total", "lo", "hi", "got"], f"feature {kind}, total double, lo double, hi double, got double"
    for _ in range(rounds):
        for k in range(blocks):
            held = block(k)

            def add(batches: Iterator[pa.RecordBatch], held=held, last=k == blocks - 1) -> Iterator[pa.RecordBatch]:
                for b in batches:
                    total, lo, hi, got = (b.column(i).to_numpy() for i in range(1, 5))
                    got = got + expected(np.sqrt(lo * hi), *held.value)
                    if last:
                        (lo, hi), got = halved(lo, hi, got, total), np.zeros(len(got))
                    yield pa.RecordBatch.from_arrays([b.column(0), *map(pa.array, (total, lo, hi, got))], names)

            state = cut(state.mapInArrow(add, schema))
            held.unpersist()
    q = F.when(F.col("total") > 0, F.least(F.sqrt(F.col("lo") * F.col("hi")), F.lit(_NEAR_1))).otherwise(0.0)
    return state.select("feature", q.alias("q"))
