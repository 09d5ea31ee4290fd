"""Row- and column-selective reads of a count matrix kept as three tables: counts (cell, feature, value), cells and features.

A selection is semi-joins, so only what is selected is read further; Parquet sources prune columns and skip row groups.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwork.operators.rank import ranked

Mask = Column | Callable[[DataFrame], Column] | DataFrame | Sequence[bool]


@dataclass(frozen=True)
class Selected:
    counts: DataFrame
    cells: DataFrame
    features: DataFrame
    record: dict


def masked(table: DataFrame, key: str, mask: Mask) -> DataFrame:
    """Rows of ``table`` by a condition, a function that gives one, a table of ids, or one boolean per row in the order of ids."""
    if isinstance(mask, DataFrame):
        return table.join(mask.select(key), key, "left_semi")
    if isinstance(mask, Column) or callable(mask):
        return table.where(mask if isinstance(mask, Column) else mask(table))
    flags, n = [bool(x) for x in mask], table.count()
    if len(flags) != n:
        raise ValueError(f"a mask over {key} needs {n} booleans, not {len(flags)}")
    places = table.sparkSession.createDataFrame([(i,) for i, x in enumerate(flags) if x], "__place long")
    return ranked(table, key, name="__place").join(F.broadcast(places), "__place", "left_semi").drop("__place")


def read_rows(counts: DataFrame, cells: DataFrame, features: DataFrame, cell_mask: Mask | None = None, cell_query: str | None = None, feature_mask: Mask | None = None, value: str = "value", cell_columns: Sequence[str] | None = None) -> Selected:
    """The selected cells and features with their counts; all where nothing selects.

    ``cell_query`` is a condition in SQL over columns of ``cells``; ``value`` names the layer; ``cell_columns`` are kept beside cell.
    """
    if cell_mask is not None and cell_query is not None:
        raise ValueError("give a mask or a query of cells, not both")
    all_cells = cells
    if cell_mask is not None:
        cells = masked(cells, "cell", cell_mask)
    elif cell_query is not None:
        cells = cells.where(F.expr(cell_query))
    chosen = features if feature_mask is None else masked(features, "feature", feature_mask)
    x = counts.select("cell", "feature", F.col(value).cast("double").alias("value"))
    x = x.join(cells.select("cell"), "cell", "left_semi").join(chosen.select("feature"), "feature", "left_semi")
    if cell_columns is not None:
        cells = cells.select("cell", *[c for c in cell_columns if c != "cell"])
    return Selected(x, cells, chosen, {"layer": value, "cell_query": cell_query, "columns": list(cell_columns) if cell_columns is not None else all_cells.columns})
