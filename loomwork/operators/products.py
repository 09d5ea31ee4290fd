"""Products with the residual matrix Z = V - N[bin(cell), feature] that never make it.

V has the observed coordinates only; N has a row per depth bin. So Z times a table over features is a
sum over the coordinates minus a sum per bin, and Z transposed is the same with cells summed by bin first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.operators.nulls import nb_null_at, nb_residual


def observed(counts: DataFrame, binned: DataFrame, null: DataFrame, *more: str) -> DataFrame:
    """cell, feature, bin, v: observed terms, with each cell's own size factor, plus the bin's null that Z takes off again.

    ``more`` are columns of ``null`` to be kept. Rows lie by cell after the joins, for sums over cells.
    """
    r = F.exp("baseline")
    x = counts.join(null, "feature").join(binned.select("cell", "bin", "s"), "cell")
    m = F.col("s") * r
    return x.select("cell", "feature", "bin", *more, (F.col("value") / F.sqrt(F.greatest(m + F.col("dispersion") * m * m, F.lit(1e-8)))).alias("v"))


def null_block(sizes: DataFrame, null: DataFrame) -> DataFrame:
    """bin, feature, n_cells, null. Bins are few by construction (a parameter), so their table is broadcast."""
    return null.crossJoin(F.broadcast(sizes)).select("bin", "feature", "n_cells", nb_null_at(F.col("s_bin") * F.exp("baseline"), F.col("dispersion")).alias("null"))


def matmat(v: DataFrame, block: DataFrame, binned: DataFrame, right: DataFrame) -> DataFrame:
    """Z times a column over features (feature, r): cell, z."""
    sparse = v.join(right, "feature").groupBy("cell").agg(F.sum(F.col("v") * F.col("r")).alias("p"))
    dense = block.join(right, "feature").groupBy("bin").agg(F.sum(F.col("null") * F.col("r")).alias("q"))
    return binned.select("cell", "bin").join(sparse, "cell", "left").join(F.broadcast(dense), "bin").select("cell", (F.coalesce("p", F.lit(0.0)) - F.col("q")).alias("z"))


def rmatmat(v: DataFrame, block: DataFrame, binned: DataFrame, left: DataFrame) -> DataFrame:
    """Z transposed times a column over cells (cell, b): feature, z."""
    sparse = v.join(left, "cell").groupBy("feature").agg(F.sum(F.col("v") * F.col("b")).alias("p"))
    by_bin = binned.select("cell", "bin").join(left, "cell").groupBy("bin").agg(F.sum("b").alias("b"))
    dense = block.join(F.broadcast(by_bin), "bin").groupBy("feature").agg(F.sum(F.col("null") * F.col("b")).alias("q"))
    return dense.join(sparse, "feature", "left").select("feature", (F.coalesce("p", F.lit(0.0)) - F.col("q")).alias("z"))


def column_sumsq(v: DataFrame, block: DataFrame) -> DataFrame:
    """Squares of Z summed by feature: all cells' nulls, corrected at the observed coordinates."""
    all_cells = block.groupBy("feature").agg(F.sum(F.col("n_cells") * F.col("null") * F.col("null")).alias("d"))
    seen = v.join(block.select("bin", "feature", "null"), ["bin", "feature"]).groupBy("feature").agg(F.sum(F.col("v") * F.col("v") - 2 * F.col("v") * F.col("null")).alias("o"))
    return all_cells.join(seen, "feature", "left").select("feature", (F.col("d") + F.coalesce("o", F.lit(0.0))).alias("sumsq"))


__all__ = ["column_sumsq", "matmat", "nb_residual", "null_block", "observed", "rmatmat"]
