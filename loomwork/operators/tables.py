"""Labelled tables of fits, a row per cell, feature or component, and the data behind their plots."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwork.operators import genome
from loomwork.operators.copynumber import GATES, Profiles
from loomwork.operators.decomposition import PCA
from loomwork.operators.rotation import GICA
from loomwork.operators.stability import Dependence, Stability

#: Columns of a copy-number table, in their order.
STATISTICS = ("chrom_share", "chrom_share_chrom", "chrom_share_pole", "run_z", "run_chrom", "run_start", "run_end", "run_sign", "opposite_arms_z", "opposite_arms_chrom", "top_arm", "top_arm_z", "second_chrom_arm", "second_chrom_arm_z")


def labelled(block: DataFrame, width: int, prefix: str = "c") -> DataFrame:
    """A block's arrays as columns c0, c1 and so on."""
    key = block.columns[0]
    return block.select(key, *[F.col("vec")[k].alias(f"{prefix}{k}") for k in range(width)])


def activities(g: GICA) -> DataFrame:
    return labelled(g.activities, g.width)


def loadings(g: GICA) -> DataFrame:
    return labelled(g.loadings, g.width)


def pcs(found: PCA) -> DataFrame:
    return labelled(found.scores, found.width, "PC")


def stability_table(g: GICA, found: Stability | None, depend: Dependence | None = None, routes: DataFrame | None = None) -> DataFrame:
    """component, k, and every reliability statistic that was computed, a row per component."""
    if found is None:
        raise KeyError("there are no stability results; ask for stability first")
    number = lambda x: None if x is None or np.isnan(x) else float(x)
    columns: list[tuple[str, str, list]] = [
        ("component", "string", [f"c{k}" for k in range(g.width)]), ("k", "long", list(range(g.width))),
        ("excess_kurtosis", "double", [*map(number, g.excess_kurtosis)]), ("effective_support", "double", [*map(number, found.support)]),
    ]
    for name, held, what in (("schedule_worst_abs_r", found.schedule, "worst_abs_r"), ("restart_worst_abs_r", found.restart, "worst_abs_r"), ("bootstrap_worst_abs_r", found.bootstrap, "worst_abs_r"), ("split_half_abs_cos_min", found.split_half, "abs_cos_min")):
        if held is not None:
            columns.append((name, "double", [*map(number, held[what])]))
    columns.append(("stable", "boolean", [*map(bool, found.stable)]))
    if depend is not None:
        top = [p[0] if p else None for p in depend.partners]
        columns.append(("top_partner", "string", ["" if t is None else f"c{t}" for t in top]))
        columns.append(("top_partner_z", "double", [None if t is None else number(depend.chosen[k, t]) for k, t in enumerate(top)]))
    if found.groups is not None:
        held = found.groups
        columns += [("group", "string", ["" if x is None else "+".join(f"c{m}" for m in x) for x in held["group_of"]]), ("group_worst_min_cancorr", "double", held["group_worst"]), ("group_refits_below_gate", "long", held["group_below_gate"]), ("verdict", "string", held["verdict"])]
    rows = list(zip(*(x for *_, x in columns), strict=True))
    out = g.activities.sparkSession.createDataFrame(rows, ", ".join(f"{n} {t}" for n, t, _ in columns))
    return out if routes is None else out.join(copy_number_table(routes).drop("component"), "k", "left")


def copy_number_table(routes: DataFrame) -> DataFrame:
    """component, k, the statistics, the routes that fire (joined by +) and whether any does."""
    fired = F.concat_ws("+", *[F.when(F.col(f"route_{name}"), F.lit(name)) for name in GATES])
    return routes.select(F.concat(F.lit("c"), F.col("k").cast("string")).alias("component"), "k", *STATISTICS, fired.alias("cn_routes"), "copy_number")


# ------------------------------------------------------------------ data of plots


def _some(table: DataFrame, components: Iterable[int] | None) -> DataFrame:
    return table if components is None else table.where(F.col("k").isin(*components))


def plot_autocorrelation(profile: DataFrame, components: Iterable[int] | None = None, highlight: str | Iterable[int] | None = "flat") -> DataFrame:
    """component, lag (its number), label in kb, value, highlighted; profile: what ``genome.autocorrelation`` gives."""
    red: Column = F.col("flat") if isinstance(highlight, str) else F.col("k").isin(*(highlight or ()))
    lags = F.array(*[F.struct(F.lit(i).alias("lag"), F.lit(f"{lo // 1000}-{hi // 1000}").alias("label"), F.col(f"lag{i}").alias("value")) for i, (lo, hi) in enumerate(genome.LAG_BINS)])
    return _some(profile, components).select("k", red.alias("highlighted"), F.explode(lags).alias("x")).select(F.format_string("c%02d", "k").alias("component"), "x.lag", "x.label", "x.value", "highlighted")


def plot_effects(effects: DataFrame, components: Iterable[int] | None = None, drop: tuple[str, ...] = ("chrY",)) -> DataFrame:
    """component, region, place (its column), effect, dominant. Regions of dropped chromosomes go, whole names alone."""
    chrom = F.regexp_replace("region", "[pq]$", "")
    shown = _some(effects, components).where(~chrom.isin(*drop))
    # A row per region.
    regions = shown.select("region").distinct().withColumn("place", F.row_number().over(Window.orderBy(genome.genomic_place(chrom), chrom, "region")) - 1)
    first = Window.partitionBy("k").orderBy(F.abs("effect").desc(), "place")
    out = shown.join(F.broadcast(regions), "region")
    return out.select(F.format_string("c%02d", "k").alias("component"), "region", "place", "effect", (F.row_number().over(first) == 1).alias("dominant"))


def plot_routes(routes: DataFrame, gates: dict | None = None, label: str | None = "unique", max_labels: int = 8) -> DataFrame:
    """component, route, value, gate, point (fired, other or none), label: that of the points that fire this route alone ("unique") or at all ("called"), unless too many."""
    gates = GATES | (gates or {})
    fires = sum((F.col(f"route_{name}").cast("int") for name in gates), F.lit(0))
    each = F.array(*[F.struct(F.lit(name).alias("route"), F.col(name).alias("value"), F.lit(float(gate)).alias("gate"), F.col(f"route_{name}").alias("fired")) for name, gate in gates.items()])
    x = routes.select(F.format_string("c%02d", "k").alias("component"), "copy_number", fires.alias("n"), F.explode(each).alias("x")).select("component", "copy_number", "n", "x.*")
    point = F.when(F.col("fired"), "fired").when(F.col("copy_number"), "other").otherwise("none")
    picked = {"unique": F.col("fired") & (F.col("n") == 1), "called": F.col("fired")}.get(label, F.lit(False))
    x = x.withColumn("picked", picked)
    few = F.sum(F.col("picked").cast("int")).over(Window.partitionBy("route")) <= max_labels
    return x.select("component", "route", "value", "gate", point.alias("point"), F.when(F.col("picked") & few, F.col("component")).alias("label"))


def genome_axis(bins: DataFrame, gap_mb: float = 8.0) -> DataFrame:
    """chrom, offset and tick in Mb: chromosomes in order, each as long as the end of its last bin's first Mb, with a gap between."""
    spans = bins.groupBy("chrom").agg(((F.max("start_bp") + 1_000_000) / 1e6).alias("span"))
    # A row per chromosome.
    before = Window.orderBy(genome.genomic_place(F.col("chrom")), "chrom").rowsBetween(Window.unboundedPreceding, -1)
    return spans.withColumn("offset", F.coalesce(F.sum(F.col("span") + gap_mb).over(before), F.lit(0.0))).select("chrom", "offset", (F.col("offset") + F.col("span") / 2).alias("tick"))


def plot_profiles(found: Profiles, components: Iterable[int] | None = None, per_page: int = 5) -> DataFrame:
    """component, page, chrom, bin, x (Mb along the genome), y, low, high (two errors off), fit_per_ic and fit_joint where fitted."""
    fits = [c for c in ("fit_per_ic", "fit_joint") if c in found.bins.columns]
    x = found.bins.join(F.broadcast(genome_axis(found.bins)), "chrom")
    zipped = x.select("chrom", "bin", (F.col("offset") + F.col("start_bp") / 1e6).alias("x"), F.posexplode(F.arrays_zip("y", "se", *fits)).alias("k", "v"))
    chosen = sorted(range(found.binned.width) if components is None else components)
    page = F.element_at(F.create_map(*[F.lit(v) for i, k in enumerate(chosen) for v in (k, i // per_page)]), F.col("k"))
    zipped = zipped.where(F.col("k").isin(*chosen))
    return zipped.select(F.format_string("c%02d", "k").alias("component"), page.alias("page"), "chrom", "bin", "x", "v.y", (F.col("v.y") - 2 * F.col("v.se")).alias("low"), (F.col("v.y") + 2 * F.col("v.se")).alias("high"), *[F.col(f"v.{c}") for c in fits])
