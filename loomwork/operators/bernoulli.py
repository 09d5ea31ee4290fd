"""The Bernoulli null: chance of a detection at a depth, averaged within depth bins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwork.operators.nulls import equal_count_bins


def chance(q: Column, depth: Column) -> Column:
    """1 - (1 - q) ** depth without loss near 0."""
    return -F.expm1(depth * F.log1p(-q))


def binarised(counts: DataFrame) -> DataFrame:
    """Positive coordinates with value 1."""
    return counts.where("value > 0").select("cell", "feature", F.lit(1.0).alias("value"))


def residual(x: Column, p: Column) -> Column:
    """Pearson residual, 0 where the variance is."""
    usable = p * (1 - p) > 0
    return F.when(usable, (x - p) / F.sqrt(p * (1 - p))).otherwise(0.0)


def depth_bins(depth: DataFrame, bins: int) -> DataFrame:
    """cell, depth, bin: cells without depth have bin 0 to themselves, the others equal-count bins after it."""
    dry = depth.where("depth = 0")
    wet = depth.where("depth > 0")
    if dry.isEmpty():
        return equal_count_bins(wet, bins).select("cell", "depth", "bin")
    n = depth.count()
    out = equal_count_bins(wet, max(1, min(bins, n) - 1)).select("cell", "depth", (F.col("bin") + 1).alias("bin"))
    return out.union(dry.select("cell", "depth", F.lit(0).alias("bin")))


def bin_block(binned: DataFrame, rates: DataFrame) -> DataFrame:
    """bin, feature, n_cells, p: the mean of the exact chances in the bin, so that bins add up to the fitted totals.

    The mean depends on a bin's depths through their histogram, one small array per bin; bins are few (a parameter).
    """
    hist = binned.groupBy("bin", "depth").agg(F.count(F.lit(1)).alias("n"))
    hist = hist.groupBy("bin").agg(F.sum("n").alias("n_cells"), F.sort_array(F.collect_list(F.struct("depth", "n"))).alias("hist"))
    total = F.aggregate("hist", F.lit(0.0), lambda a, h: a + h["n"] * chance(F.col("q"), h["depth"]))
    p = F.least(F.greatest(total / F.col("n_cells"), F.lit(0.0)), F.lit(1.0))
    return rates.crossJoin(F.broadcast(hist)).select("bin", "feature", "n_cells", p.alias("p"))


def null_block(block: DataFrame) -> DataFrame:
    """``block`` with the null (minus the residual of a zero), Fisher weight, its root, and the root-weighted null."""
    p = F.col("p")
    usable = p * (1 - p) > 0
    return block.select("bin", "feature", "n_cells", "p", F.when(usable, F.sqrt(p / (1 - p))).otherwise(0.0).alias("null"), (p * (1 - p)).alias("weight"), F.sqrt(p * (1 - p)).alias("root_weight"), F.when(usable, p).otherwise(0.0).alias("root_null"))


def observed(detected: DataFrame, binned: DataFrame, block: DataFrame) -> DataFrame:
    """cell, feature, bin, v, root_v: observed terms of the residual and of its root-weighted form."""
    x = detected.join(binned.select("cell", "bin"), "cell").join(block.select("bin", "feature", "p"), ["bin", "feature"])
    var = F.col("p") * (1 - F.col("p"))
    return x.select("cell", "feature", "bin", F.when(var > 0, F.col("value") / F.sqrt(var)).otherwise(0.0).alias("v"), F.when(var > 0, F.col("value")).otherwise(0.0).alias("root_v"))
