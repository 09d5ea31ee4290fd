"""Queries of the Bernoulli null and of root-weighted products."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomwork.operators import bernoulli, nulls, products
from loomwork.plans.catalogue import BIN_SQL, BINS, COUNTS_SQL, QUERIES, SQL, counts, fitted, query
from loomwork.session import cut, table

DEP_SQL = COUNTS_SQL + ", seen as (select o_custkey as cell, count(*)::double as depth from lineitem join orders on l_orderkey = o_orderkey group by 1), dep as (select c_custkey as cell, coalesce(depth, 0) as depth from customer left join seen on cell = c_custkey)"
RATE_SQL = DEP_SQL + """, h as (select depth, count(*) as n from dep group by 1), t as (select feature, count(*)::double as total from counts group by 1),
b as (select feature, total, 1e-12::double as lo, 1.0::double as hi, 0 as i from t
  union all select feature, total, case when got > total then lo else mid end, case when got > total then mid else hi end, i + 1
  from (select b.feature, b.total, b.lo, b.hi, b.i, sqrt(b.lo * b.hi) as mid, sum(n * (1 - pow(1 - least(sqrt(b.lo * b.hi), 1 - 1e-12), depth))) as got from b, h where i < 40 group by 1, 2, 3, 4, 5)),
rate as (select feature, least(sqrt(lo * hi), 1 - 1e-12) as q from b where i = 40)"""
BLOCK_SQL = RATE_SQL + f""", tally as (select count(*) n, count(*) filter (depth = 0) dry from dep),
wet as (select cell, depth, row_number() over (order by depth, cell) - 1 as rk, count(*) over () as n from dep where depth > 0),
binned as (select cell, depth, case when dry = 0 then (rk * least({BINS}, wet.n) // wet.n)::int else 1 + (rk * least(least({BINS}, tally.n) - 1, wet.n) // wet.n)::int end as bin from wet, tally union all select cell, depth, 0 from dep where depth = 0),
bh as (select bin, depth, count(*) as n from binned group by 1, 2),
blk as (select bin, feature, sum(n)::bigint as n_cells, least(greatest(sum(n * (1 - pow(1 - q, depth))) / sum(n), 0), 1) as p from bh, rate group by 1, 2),
block as (select *, case when p * (1 - p) > 0 then sqrt(p / (1 - p)) else 0 end as nul, case when p * (1 - p) > 0 then p else 0 end as root_nul from blk),
v as (select cell, feature, bin, case when p * (1 - p) > 0 then 1 / sqrt(p * (1 - p)) else 0 end as v, case when p * (1 - p) > 0 then 1 else 0 end as root_v from counts join binned using (cell) join block using (bin, feature) where value > 0)"""


def model(spark, d):
    x = cut(bernoulli.binarised(counts(spark, d)))
    seen = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).groupBy(F.col("o_custkey").alias("cell")).agg(F.count(F.lit(1)).cast("double").alias("depth"))
    depth = cut(table(spark, d, "customer").select(F.col("c_custkey").alias("cell")).join(seen, "cell", "left").select("cell", F.coalesce("depth", F.lit(0.0)).alias("depth")))
    rates = cut(nulls.bernoulli_rates(x, depth))
    binned = cut(bernoulli.depth_bins(depth, BINS))
    block = cut(bernoulli.null_block(bernoulli.bin_block(binned, rates)))
    return x, depth, rates, binned, block, bernoulli.observed(x, binned, block)


@query("bernoulli_depth_bins", f"with recursive {BLOCK_SQL} select cell, depth, bin from binned")
def bernoulli_depth_bins(spark, d):
    return model(spark, d)[3]


@query("bernoulli_null_block", f'with recursive {BLOCK_SQL} select bin, feature, n_cells, p, nul as "null", p * (1 - p) as weight, sqrt(p * (1 - p)) as root_weight, root_nul as root_null from block')
def bernoulli_null_block(spark, d):
    return model(spark, d)[4]


@query("bernoulli_residual", f"with recursive {RATE_SQL}, r as (select cell, feature, 1 - pow(1 - q, depth) as p from counts join dep using (cell) join rate using (feature)) select cell, feature, case when p * (1 - p) > 0 then (1 - p) / sqrt(p * (1 - p)) else 0 end as residual from r")
def bernoulli_residual(spark, d):
    x, depth, rates, *_ = model(spark, d)
    return x.join(depth, "cell").join(rates, "feature").select("cell", "feature", bernoulli.residual(F.col("value"), bernoulli.chance(F.col("q"), F.col("depth"))).alias("residual"))


MATMAT_SQL = "r as (select distinct feature, sin(feature) as r from block), p as (select cell, sum({v} * r) as p from v join r using (feature) group by 1), q as (select bin, sum({n} * r) as q from block join r using (feature) group by 1) select cell, coalesce(p, 0) - q as z from binned left join p using (cell) join q using (bin)"
RMATMAT_SQL = "b2 as (select cell, bin, cos(cell) as b from binned), p as (select feature, sum({v} * b) as p from v join b2 using (cell) group by 1), bb as (select bin, sum(b) as b from b2 group by 1), q as (select feature, sum({n} * b) as q from block join bb using (bin) group by 1) select feature, coalesce(p, 0) - q as z from q left join p using (feature)"


def add(name: str, head: str, parts, v: str, null: str, sql_v: str, sql_null: str) -> None:
    """Both products of one residual matrix with fixed probes. ``parts`` gives binned cells, observed terms and null block."""

    def sides(spark, d):
        binned, seen, block = parts(spark, d)
        return binned, seen.select("cell", "feature", "bin", F.col(v).alias("v")), block.select("bin", "feature", "n_cells", F.col(null).alias("null"))

    @query(f"{name}_matmat_probe", f"{head}, {MATMAT_SQL.format(v=sql_v, n=sql_null)}")
    def matmat(spark, d):
        binned, seen, block = sides(spark, d)
        return products.matmat(seen, block, binned, block.select("feature").distinct().withColumn("r", F.sin("feature")))

    @query(f"{name}_rmatmat_probe", f"{head}, {RMATMAT_SQL.format(v=sql_v, n=sql_null)}")
    def rmatmat(spark, d):
        binned, seen, block = sides(spark, d)
        return products.rmatmat(seen, block, binned, binned.select("cell", F.cos("cell").alias("b")))


def of_bernoulli(spark, d):
    *_, binned, block, seen = model(spark, d)
    return binned, seen, block


def of_nb(spark, d):
    """Observed terms times the root of their bin's weight; the null becomes the weight."""
    _, binned, _, v, block = fitted(spark, d)
    block = cut(block.withColumn("root_null", F.col("null") * F.col("null")))
    return binned, v.join(block.select("bin", "feature", "null"), ["bin", "feature"]).withColumn("root_v", F.col("v") * F.col("null")), block


add("bernoulli", f"with recursive {BLOCK_SQL}", of_bernoulli, "v", "null", "v", "nul")
add("bernoulli_root_weighted", f"with recursive {BLOCK_SQL}", of_bernoulli, "root_v", "root_null", "root_v", "root_nul")
add("nb_root_weighted", f"with {BIN_SQL}, rv as (select v.cell, v.feature, v.bin, v.v * block.nul as root_v from v join block using (bin, feature))", of_nb, "root_v", "root_null", "root_v", "(nul * nul)")
for name in ("nb_root_weighted_matmat_probe", "nb_root_weighted_rmatmat_probe"):
    SQL[name] = SQL[name].replace("from v join r ", "from rv join r ").replace("from v join b2 ", "from rv join b2 ")


@query("bernoulli_column_sumsq", f"with recursive {BLOCK_SQL}, dd as (select feature, sum(n_cells * nul * nul) as dd from block group by 1), oo as (select feature, sum(v * v - 2 * v * nul) as oo from v join block using (bin, feature) group by 1) select feature, dd + coalesce(oo, 0) as sumsq from dd left join oo using (feature)")
def bernoulli_column_sumsq(spark, d):
    *_, block, seen = model(spark, d)
    return products.column_sumsq(seen, block)


@query("nb_residual", f"with {BIN_SQL} select cell, feature, (value - s * exp(baseline)) / sqrt(greatest(s * exp(baseline) + dispersion * (s * exp(baseline)) ** 2, 1e-8)) as residual from counts join depth using (cell) join nb using (feature)")
def nb_residual(spark, d):
    x, binned, null, *_ = fitted(spark, d)
    return x.join(binned.select("cell", "s"), "cell").join(null, "feature").select("cell", "feature", nulls.nb_residual(F.col("value"), F.col("s") * F.exp("baseline"), F.col("dispersion")).alias("residual"))


__all__ = ["QUERIES"]
