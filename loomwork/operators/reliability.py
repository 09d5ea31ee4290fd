"""Support, kurtosis, contrast and dependence of components (row, k, v)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomwork.operators.residual import matrix, sums_of


def effective_support(x: DataFrame) -> DataFrame:
    sq = F.col("v") * F.col("v")
    return x.groupBy("k").agg((F.pow(F.sum(sq), 2) / F.greatest(F.sum(sq * sq), F.lit(1e-300))).alias("support"))


def excess_kurtosis(x: DataFrame) -> DataFrame:
    return x.groupBy("k").agg(F.kurtosis("v").alias("kurtosis"))


def logcosh(x: DataFrame) -> DataFrame:
    """Minus the mean log cosh, which stays finite for large values."""
    a = F.abs("v")
    return x.groupBy("k").agg((-F.avg(a + F.log1p(F.exp(-2 * a)) - F.log(F.lit(2.0)))).alias("contrast"))


def _sums(x: DataFrame) -> tuple[np.ndarray, list[int]]:
    """Sums of products of 1, values and squares over rows that have all components, and the components."""
    names = [r[0] for r in x.select("k").distinct().orderBy("k").collect()]
    width = len(names)
    wide = x.groupBy("row").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "v"))), lambda y: y["v"]).alias("vec")).where(F.size("vec") == width)

    def make(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        total = np.zeros((2 * width + 1, 2 * width + 1))
        for b in batches:
            v = matrix(b.column(0), width)
            full = np.c_[np.ones(len(v)), v, v * v]
            total += full.T @ full
        return total

    return sums_of(wide.select("vec"), (2 * width + 1, 2 * width + 1), make), names


def _table(x: DataFrame, values: np.ndarray, names: list[int], name: str) -> DataFrame:
    rows = [(names[i], names[j], None if np.isnan(values[i, j]) else float(values[i, j])) for i in range(len(names)) for j in range(i + 1, len(names))]
    return x.sparkSession.createDataFrame(rows, f"a long, b long, {name} double")


def _correlation(total: np.ndarray, first: int, width: int) -> np.ndarray:
    n = total[0, 0]
    mean = total[0, first : first + width] / n
    c = total[first : first + width, first : first + width] / n - np.outer(mean, mean)
    s = np.sqrt(np.maximum(np.diag(c), 0))
    with np.errstate(divide="ignore", invalid="ignore"):
        return c / np.outer(s, s)


def abs_correlation(x: DataFrame) -> DataFrame:
    """a, b, abs_r of all pairs of components; components are few (a parameter), rows are summed up where they lie."""
    total, names = _sums(x)
    return _table(x, np.abs(_correlation(total, 1, len(names))), names, "abs_r")


def energy_z(x: DataFrame) -> DataFrame:
    """Correlation of squares times the root of n - 1, its exact null deviation."""
    total, names = _sums(x)
    return _table(x, _correlation(total, 1 + len(names), len(names)) * np.sqrt(total[0, 0] - 1), names, "z")


def ranked_partners(z: DataFrame, top: int) -> DataFrame:
    """The partners of largest z of each component; both ways of every pair."""
    both = z.select("a", "b", "z").union(z.select(F.col("b").alias("a"), F.col("a").alias("b"), "z"))
    return both.withColumn("rank", F.row_number().over(Window.partitionBy("a").orderBy(F.desc_nulls_last("z"), "b"))).where(F.col("rank") <= top)


def mutual_groups(z: DataFrame, top: int = 2, z_min: float = 5.0) -> DataFrame:
    """Components linked where each is among the other's top partners at z_min or more: node, root. Pairs of components are few."""
    from loomwork.operators import stability

    rows = z.collect()
    names = sorted({r["a"] for r in rows} | {r["b"] for r in rows})
    at = {k: i for i, k in enumerate(names)}
    full = np.full((len(names), len(names)), np.nan)
    for r in rows:
        full[at[r["a"]], at[r["b"]]] = full[at[r["b"]], at[r["a"]]] = np.nan if r["z"] is None else r["z"]
    groups = stability.mutual_groups(full, np.ones(len(names), bool), top, z_min) if names else []
    return z.sparkSession.createDataFrame([(names[i], names[x[0]]) for x in groups for i in x], "node long, root long")
