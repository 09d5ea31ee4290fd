"""Registered queries over the fixture tables, and the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.operators import genome, nulls, products, reliability
from loomwork.session import cut, table

BINS = 16
SQL: dict = {}
QUERIES: dict = {}

COUNTS_SQL = "counts as (select o_custkey as cell, l_partkey as feature, sum(l_quantity) as value from lineitem join orders on l_orderkey = o_orderkey group by 1, 2 having sum(l_quantity) <> 0)"
DEPTH_SQL = COUNTS_SQL + ", sums as (select c.cell, sum(value) as depth from counts c group by 1), depth as (select cell, depth, depth / (select avg(depth) from sums) as s from sums)"
NULL_SQL = DEPTH_SQL + """, tot as (select sum(s) s1, sum(s * s) s2 from depth),
f0 as (select feature, sum(value) x1, sum(value * value) x2, sum(value * s) xs from counts join depth using (cell) group by 1),
f1 as (select *, greatest(x1 / greatest(s1, 1e-12), 1e-10) as r from f0, tot),
nb as (select feature, ln(r) as baseline, least(greatest((x2 - 2 * r * xs + r * r * s2 - r * s1) / greatest(r * r * s2, 1e-12), 1e-4), 1e3) as dispersion from f1)"""
BIN_SQL = NULL_SQL + f""", ranked as (select *, row_number() over (order by depth, cell) - 1 as rk, count(*) over () as n from depth),
binned as (select cell, depth, s, (rk * least({BINS}, n) // n)::int as bin from ranked),
sizes as (select bin, exp(avg(ln(s))) as s_bin, count(*) as n_cells from binned group by 1),
block as (select bin, feature, n_cells, sqrt(s_bin * exp(baseline) / greatest(1 + dispersion * s_bin * exp(baseline), 1e-8)) as nul from nb, sizes),
v as (select cell, feature, bin, value / sqrt(greatest(s * exp(baseline) + dispersion * s * exp(baseline) * s * exp(baseline), 1e-8)) as v from counts join binned using (cell) join nb using (feature))"""
LOAD_SQL = "l as (select vec_id as feature, k - 1 as k, embedding[k]::double as v from embeddings, range(1, 65) t(k))"
COORD_SQL = "c as (select vec_id as feature, 'chr' || (vec_id % 4 + 1) as chrom, ((vec_id // 4 // 6) % 24) * 7000000 + (vec_id // 4 // 6 // 24) * 1000000 + [500, 2000, 5000, 17500, 60500, 500500][(vec_id // 4) % 6 + 1] as mid from embeddings)"
ARM_SQL = COORD_SQL + ", arms as (select *, case when mid < case chrom when 'chr1' then 123.4e6 when 'chr2' then 93.9e6 when 'chr3' then 90.9e6 else 50e6 end then 'p' else 'q' end as arm from c)"
Z_SQL = LOAD_SQL + ", st as (select k, avg(v) m, stddev_pop(v) s from l group by 1), z as (select feature, l.k, (v - m) / greatest(s, 1e-300) as z from l join st using (k))"


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def counts(spark: SparkSession, d: str) -> DataFrame:
    joined = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return nulls.canonical(joined.select(F.col("o_custkey").alias("cell"), F.col("l_partkey").alias("feature"), F.col("l_quantity").alias("value")))


def fitted(spark: SparkSession, d: str):
    x = cut(counts(spark, d))
    depth = cut(nulls.depths(x, x.select("cell").distinct()))
    null = cut(nulls.nb_null(x, depth))
    binned = cut(nulls.equal_count_bins(depth, BINS))
    return x, binned, null, products.observed(x, binned, null), products.null_block(nulls.bin_sizes(binned), null)


def loadings(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("feature"), F.posexplode("embedding").alias("k", "v")).select("feature", F.col("k").cast("long"), F.col("v").cast("double"))


def coords(spark: SparkSession, d: str) -> DataFrame:
    mid = "((vec_id div 4 div 6) % 24) * 7000000 + (vec_id div 4 div 6 div 24) * 1000000 + array(500, 2000, 5000, 17500, 60500, 500500)[cast((vec_id div 4) % 6 as int)]"
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("feature"), F.expr("'chr' || (vec_id % 4 + 1)").alias("chrom"), F.expr(mid).cast("long").alias("mid"))


@query("canonical_counts", f"with {COUNTS_SQL} select * from counts")
def canonical_counts(spark, d):
    return counts(spark, d)


@query("select_cells_features", f"with {COUNTS_SQL} select counts.* from counts where cell in (select c_custkey from customer where c_mktsegment = 'BUILDING') and feature in (select p_partkey from part where p_size > 25)")
def select_cells_features(spark, d):
    cells = table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("cell"))
    features = table(spark, d, "part").where("p_size > 25").select(F.col("p_partkey").alias("feature"))
    return counts(spark, d).join(cells, "cell", "left_semi").join(features, "feature", "left_semi").select("cell", "feature", "value")


@query("cell_depth", f"with {COUNTS_SQL}, sums as (select c_custkey as cell, coalesce(sum(value), 0) as depth from customer left join counts on cell = c_custkey group by 1) select cell, depth, depth / (select avg(depth) from sums) as s from sums")
def cell_depth(spark, d):
    return nulls.depths(counts(spark, d), table(spark, d, "customer").select(F.col("c_custkey").alias("cell")))


@query("nb_null", f"with {NULL_SQL} select * from nb")
def nb_null(spark, d):
    x = counts(spark, d)
    return nulls.nb_null(x, nulls.depths(x, x.select("cell").distinct()))


@query("depth_bins_nb", f"with {BIN_SQL} select * from sizes")
def depth_bins(spark, d):
    return nulls.bin_sizes(fitted(spark, d)[1])


@query("nb_observed_terms", f"with {BIN_SQL} select * from v")
def nb_observed_terms(spark, d):
    return fitted(spark, d)[3]


@query("nb_null_block", f'with {BIN_SQL} select bin, feature, n_cells, nul as "null", nul * nul as weight from block')
def nb_null_block(spark, d):
    return fitted(spark, d)[4].withColumn("weight", F.col("null") * F.col("null"))


@query("nb_matmat_probe", f"with {BIN_SQL}, r as (select feature, sin(feature) as r from nb), p as (select cell, sum(v * r) as p from v join r using (feature) group by 1), q as (select bin, sum(nul * r) as q from block join r using (feature) group by 1) select cell, coalesce(p, 0) - q as z from binned left join p using (cell) join q using (bin)")
def nb_matmat(spark, d):
    _, binned, null, v, block = fitted(spark, d)
    return products.matmat(v, block, binned, null.select("feature", F.sin("feature").alias("r")))


@query("nb_rmatmat_probe", f"with {BIN_SQL}, b as (select cell, bin, cos(cell) as b from binned), p as (select feature, sum(v * b) as p from v join b using (cell) group by 1), bb as (select bin, sum(b) as b from b group by 1), q as (select feature, sum(nul * b) as q from block join bb using (bin) group by 1) select feature, coalesce(p, 0) - q as z from q left join p using (feature)")
def nb_rmatmat(spark, d):
    _, binned, _, v, block = fitted(spark, d)
    return products.rmatmat(v, block, binned, binned.select("cell", F.cos("cell").alias("b")))


@query("residual_column_means", f"with {BIN_SQL}, p as (select feature, sum(v) as p from v group by 1), q as (select feature, sum(nul * n_cells) as q from block group by 1) select feature, (coalesce(p, 0) - q) / (select count(*) from binned) as mean from q left join p using (feature)")
def column_means(spark, d):
    _, binned, _, v, block = fitted(spark, d)
    n = binned.count()
    return products.rmatmat(v, block, binned, binned.select("cell", F.lit(1.0).alias("b"))).select("feature", (F.col("z") / n).alias("mean"))


SUMSQ_SQL = ", dd as (select feature, sum(n_cells * nul * nul) as dd from block group by 1), oo as (select feature, sum(v * v - 2 * v * nul) as oo from v join block using (bin, feature) group by 1), sq as (select feature, dd + coalesce(oo, 0) as sumsq from dd left join oo using (feature))"


@query("nb_column_sumsq", f"with {BIN_SQL}{SUMSQ_SQL} select * from sq")
def nb_column_sumsq(spark, d):
    *_, v, block = fitted(spark, d)
    return products.column_sumsq(v, block)


@query("total_centred_variance", f"with {BIN_SQL}{SUMSQ_SQL}, p as (select feature, sum(v) as p from v group by 1), q as (select feature, sum(nul * n_cells) as q from block group by 1), mu as (select feature, (coalesce(p, 0) - q) / (select count(*) from binned) as mean from q left join p using (feature)) select (sum(sumsq) - (select count(*) from binned) * sum(mean * mean)) / ((select count(*) from binned) - 1) as variance from sq join mu using (feature)")
def total_centred_variance(spark, d):
    _, binned, _, v, block = fitted(spark, d)
    n = binned.count()
    means = products.rmatmat(v, block, binned, binned.select("cell", F.lit(1.0).alias("b"))).select("feature", (F.col("z") / n).alias("mean"))
    return products.column_sumsq(v, block).join(means, "feature").agg(((F.sum("sumsq") - n * F.sum(F.col("mean") * F.col("mean"))) / (n - 1)).alias("variance"))


@query("bernoulli_rate", f"""with recursive {COUNTS_SQL}, dep as (select o_custkey as cell, count(*)::double as depth from lineitem join orders on l_orderkey = o_orderkey group by 1),
h as (select depth, count(*) as n from dep group by 1), t as (select feature, count(*)::double as total from counts group by 1),
b as (select feature, total, 1e-12::double as lo, 1.0::double as hi, 0 as i from t
  union all select feature, total, case when got > total then lo else mid end, case when got > total then mid else hi end, i + 1
  from (select b.feature, b.total, b.lo, b.hi, b.i, sqrt(b.lo * b.hi) as mid, sum(n * (1 - pow(1 - least(sqrt(b.lo * b.hi), 1 - 1e-12), depth))) as got from b, h where i < 40 group by 1, 2, 3, 4, 5))
select feature, least(sqrt(lo * hi), 1 - 1e-12) as q from b where i = 40""")
def bernoulli_rate(spark, d):
    deps = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).groupBy(F.col("o_custkey").alias("cell")).agg(F.count(F.lit(1)).cast("double").alias("depth"))
    return nulls.bernoulli_rates(counts(spark, d), deps)


@query("feature_coordinates", f"with {COORD_SQL} select feature, chrom, mid - 250 as start, mid + 250 as \"end\", mid from c")
def feature_coordinates(spark, d):
    c = coords(spark, d)
    name = F.expr("case feature % 3 when 0 then chrom || ':' || (mid - 250) || '-' || (mid + 250) when 1 then chrom || '-' || (mid - 250) || '-' || (mid + 250) else chrom || '_' || (mid - 250) || '_' || (mid + 250) end")
    return genome.parse_names(c.select("feature", name.alias("name")))


@query("arm_assignment", f"with {ARM_SQL} select feature, chrom, mid, arm from arms")
def arm_assignment(spark, d):
    return genome.arms(coords(spark, d))


@query("zscore_loadings", f"with {Z_SQL} select * from z")
def zscore_loadings(spark, d):
    return genome.zscores(loadings(spark, d))


@query("winsorise", f"with {LOAD_SQL}, m as (select k, median(v) as mid from l group by 1), s as (select k, mid, median(abs(v - mid)) * 1.4826 as sd from l join m using (k) group by 1, 2) select feature, k, least(greatest(v, mid - 2 * sd), mid + 2 * sd) as v, v < mid - 2 * sd or v > mid + 2 * sd as clipped, sd from l join s using (k)")
def winsorise(spark, d):
    return genome.winsorise(loadings(spark, d), 2.0)


@query("genomic_autocorr", f"with {Z_SQL}, {COORD_SQL}, x as (select k, z, chrom, mid from z join c using (feature)), s as (select k, z, " + ", ".join(f"sum(z) over w{i} as s{i}, count(z) over w{i} as n{i}" for i in range(6)) + " from x window " + ", ".join(f"w{i} as (partition by k, chrom order by mid range between {lo + 1} following and {hi} following)" for i, (lo, hi) in enumerate(genome.LAG_BINS)) + "), a as (select k, " + ", ".join(f"coalesce(sum(z * s{i}), 0) / greatest(sum(n{i}), 1) as lag{i}" for i in range(6)) + " from s group by 1) select *, lag5 / greatest(lag0, 1e-12) as ratio, lag5 / greatest(lag0, 1e-12) > 0.5 as flat from a")
def genomic_autocorr(spark, d):
    return genome.autocorrelation(loadings(spark, d), coords(spark, d))


EFFECT_SQL = f"{LOAD_SQL}, {ARM_SQL}, sd as (select k, stddev_pop(v) as sd from l group by 1), e as (select k, chrom || arm as region, count(*) as n, avg(v) as m from l join arms using (feature) group by 1, 2), eff as (select k, region, n, case when n < 10 then 0 else m / greatest(sd, 1e-300) end as effect from e join sd using (k))"


@query("arm_effects", f"with {EFFECT_SQL} select * from eff")
def arm_effects(spark, d):
    return genome.effects(loadings(spark, d), genome.arms(coords(spark, d)).select("feature", F.concat("chrom", "arm").alias("region")), 10)


@query("dominant_region", f"with {EFFECT_SQL} select k, region as dominant, effect from eff qualify row_number() over (partition by k order by abs(effect) desc, region) = 1")
def dominant_region(spark, d):
    return genome.dominant(arm_effects(spark, d))


@query("top_feature_share", f"with {LOAD_SQL}, {COORD_SQL}, p as (select k, feature, chrom, 0 as pole, v as key from l join c using (feature) union all select k, feature, chrom, 1, -v from l join c using (feature)), t as (select * from p qualify row_number() over (partition by k, pole order by key desc, feature) <= 50), n as (select k, pole, chrom, count(*) as n from t group by 1, 2, 3), s as (select *, n / sum(n) over (partition by k, pole) as share from n) select k, chrom, share, case pole when 0 then '+' else '-' end as pole from s qualify row_number() over (partition by k order by share desc, s.pole, chrom) = 1")
def top_feature_share(spark, d):
    return genome.top_share(loadings(spark, d), coords(spark, d), 50)


@query("contiguous_run", f"with {Z_SQL}, {COORD_SQL}, x as (select k, chrom, mid, avg(z) over w as m, count(z) over w as n, last_value(mid) over w as end_mid from z join c using (feature) window w as (partition by k, chrom order by mid, feature rows between current row and 9 following)) select k, chrom, mid as start_mid, end_mid, abs(m) as run_z, sign(m)::double as sign from x where n = 10 qualify row_number() over (partition by k order by round(abs(m), 9) desc, chrom, mid) = 1")
def contiguous_run(spark, d):
    return genome.contiguous_run(loadings(spark, d), coords(spark, d), 10)


def by_row(spark, d):
    return loadings(spark, d).withColumnRenamed("feature", "row")


@query("effective_support", f"with {LOAD_SQL} select k, pow(sum(v * v), 2) / greatest(sum(v * v * v * v), 1e-300) as support from l group by 1")
def effective_support(spark, d):
    return reliability.effective_support(by_row(spark, d))


@query("excess_kurtosis", f"with {LOAD_SQL} select k, kurtosis_pop(v) as kurtosis from l group by 1")
def excess_kurtosis(spark, d):
    return reliability.excess_kurtosis(by_row(spark, d))


@query("logcosh", f"with {LOAD_SQL} select k, -avg(ln(cosh(v))) as contrast from l group by 1")
def logcosh(spark, d):
    return reliability.logcosh(by_row(spark, d))


PAIR_SQL = f"{LOAD_SQL}, p as (select x.k as a, y.k as b, x.v as va, y.v as vb from l x join l y on x.feature = y.feature and x.k < y.k)"


@query("abs_corr_matrix", f"with {PAIR_SQL} select a, b, abs(corr(va, vb)) as abs_r from p group by 1, 2")
def abs_corr_matrix(spark, d):
    return reliability.abs_correlation(by_row(spark, d))


ENERGY_SQL = f"{PAIR_SQL}, e as (select a, b, corr(va * va, vb * vb) * sqrt(count(*) - 1) as z from p group by 1, 2)"


@query("energy_dependence_z", f"with {ENERGY_SQL} select * from e")
def energy_dependence_z(spark, d):
    return reliability.energy_z(by_row(spark, d))


@query("ranked_partners", f"with {ENERGY_SQL}, b2 as (select * from e union all select b, a, z from e) select a, b, z, row_number() over (partition by a order by z desc nulls last, b) as rank from b2 qualify row_number() over (partition by a order by z desc nulls last, b) <= 3")
def ranked_partners(spark, d):
    return reliability.ranked_partners(energy_dependence_z(spark, d), 3)


@query("mutual_top_groups", f"with recursive {ENERGY_SQL}, b2 as (select * from e union all select b, a, z from e), n as (select a, b from (select *, row_number() over (partition by a order by z desc nulls last, b) as r from b2) where r <= 2 and z >= 0), m as (select x.a, x.b from n x join n y on x.a = y.b and x.b = y.a), reach as (select a as node, a as other from m union select node, b from reach join m on other = a) select node, min(other) as root from reach group by 1")
def mutual_top_groups(spark, d):
    return reliability.mutual_groups(energy_dependence_z(spark, d), 2, 0.0)
