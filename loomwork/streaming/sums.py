"""Running sums of a null model over a stream of counts. An extension: the sums that fit a null are additive, so a stream can hold them.

The stream has cell, feature, value and the cell's size factor s; what comes out per feature, in complete mode, is what
``moments`` turns into baseline and dispersion once the sums over all cells' sizes are known.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def feature_sums(entries: DataFrame) -> DataFrame:
    """feature, x1, x2, xs of a batch or stream of entries, each coordinate standing once."""
    x, s = F.col("value"), F.col("s")
    return entries.groupBy("feature").agg(F.sum(x).alias("x1"), F.sum(x * x).alias("x2"), F.sum(x * s).alias("xs"))


def moments(sums: DataFrame, s1: float, s2: float) -> DataFrame:
    """feature, baseline, dispersion from sums and the sums of sizes and of their squares."""
    r = F.greatest(F.col("x1") / max(s1, 1e-12), F.lit(1e-10))
    excess = F.col("x2") - 2 * r * F.col("xs") + r * r * s2 - r * s1
    phi = F.least(F.greatest(excess / F.greatest(r * r * s2, F.lit(1e-12)), F.lit(1e-4)), F.lit(1e3))
    return sums.select("feature", F.log(r).alias("baseline"), phi.alias("dispersion"))
