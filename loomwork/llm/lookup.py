"""Sums over a corpus table for each row of a text table, with skew in hand.

Keys that many rows hold (words such as "the") are looked up in a broadcast list whose length is
a parameter; all others go through a shuffled join. Rows that a task emits are the base row of
each text, with what the list gave, and a row per further key. Texts that repeat with their id
have equal row keys: their sums are divided by their number, and each is given back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def frequent(table: DataFrame, count: str, limit: int) -> DataFrame:
    """The rows of the largest counts, at most ``limit`` (all of those with a count or none)."""
    band = F.floor(F.log(F.col(count).cast("double")) * 16).cast("int")
    held, least = 0, 1 << 30
    for b, n in sorted(table.groupBy(band.alias("b")).count().collect(), reverse=True):
        if held + n > limit:
            break
        held, least = held + n, b
    return table.where(band >= least)


def finish(rows: DataFrame, table: DataFrame, key: str, carried: list[str], sums: dict[str, Column]) -> DataFrame:
    """``rows``: row_key, doc_id, key, times (0 in base rows), carried columns (null but in base rows); gives doc_id, carried, sums."""
    joined = rows.join(table, key, "left")
    base = F.col("times") == 0
    out = joined.groupBy("doc_id", "row_key").agg(
        F.sum(base.cast("long")).alias("__rows"),
        *[F.max(c).alias(c) for c in carried],
        *[F.coalesce(F.sum(F.when(~base, F.col("times") * v)), F.lit(0)).alias(c) for c, v in sums.items()],
    )
    return out.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__rows").cast("int")))).select("doc_id", *carried, *[(F.col(c) / F.col("__rows")).alias(c) for c in sums])
