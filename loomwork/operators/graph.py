"""Connected components of a table of links, by alternating stars.

Every node's links are moved to the smallest node it knows (to larger neighbours in one step, to
smaller ones in the next) until all point at the smallest node of their component. Only minima
are aggregated, so a node with very many links is combined before the shuffle. Once at most ``HELD`` links are left
(rounds lose repeated ones), one task joins them up, which is a bounded amount of work and saves the last rounds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.session import cut

HELD = 1 << 20


def joined(edges: DataFrame) -> DataFrame:
    """node, root of at most HELD links (u, v), by one task that lets every node point at the least it reaches, over and over."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
        if not parts:
            return
        u, v = (np.concatenate(x) for x in zip(*parts, strict=True))
        nodes, at = np.unique(np.r_[u, v], return_inverse=True)
        a, b = at[: len(u)], at[len(u) :]
        root = np.arange(len(nodes))
        while True:
            low = np.minimum(root[a], root[b])
            new = root.copy()
            # Roots of both ends move to the lower one, then all follow their root.
            np.minimum.at(new, root[a], low)
            np.minimum.at(new, root[b], low)
            while ((further := new[new]) != new).any():
                new = further
            if (new == root).all():
                break
            root = new
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[root])], ["node", "root"])

    return edges.select("u", "v").repartition(1).mapInArrow(run, "node long, root long")


def components(links: DataFrame) -> DataFrame:
    """``links``: columns a and b. Returns node, root: root is the smallest node of the component; nodes without links don't appear."""
    edges = cut(links.select(F.greatest("a", "b").cast("long").alias("u"), F.least("a", "b").cast("long").alias("v")).where("u <> v").distinct())
    while edges.count() > HELD:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).distinct()
        edges = cut(small)
        # Done when each node has one link, to a node without one.
        ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("v", F.lit(0), F.lit(1)))
        if ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or up = 1 and down = 1").isEmpty():
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
    return joined(edges)
