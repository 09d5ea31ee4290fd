"""Columns that part features or entries in two."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def alternating_blocks(features: DataFrame, position: str, block_size: int, group: str | None = None) -> DataFrame:
    """``features`` with half: true in every other window of ``block_size``; groups, in the order of their names, begin in turn."""
    if isinstance(block_size, bool) or not isinstance(block_size, int) or block_size < 1:
        raise ValueError(f"block_size must be a positive integer, not {block_size!r}")
    turn: Column = F.floor(F.col(position) / block_size)
    if group is None:
        return features.withColumn("half", F.pmod(turn, F.lit(2)) == 0)
    # A row per group.
    codes = features.select(F.col(group).alias("__group")).distinct().withColumn("__code", F.row_number().over(Window.orderBy("__group")) - 1)
    out = features.join(F.broadcast(codes), F.col(group).eqNullSafe(F.col("__group")))
    return out.withColumn("half", F.pmod(turn + F.col("__code"), F.lit(2)) == 0).drop("__group", "__code")


def hash_split(entries: DataFrame, fraction: float, seed: int = 0) -> DataFrame:
    """``entries`` (cell, feature) with held: true for about ``fraction`` of them, whatever the partitioning."""
    return entries.withColumn("held", F.pmod(F.xxhash64("cell", "feature", F.lit(seed)), F.lit(1 << 24)) < int(fraction * (1 << 24)))
