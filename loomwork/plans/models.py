"""Queries of fitted nulls as operators: selections, validation of shapes, block products, centring and principal components."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomwork.operators import decomposition, residual
from loomwork.plans.bernoulli import BLOCK_SQL
from loomwork.plans.catalogue import BIN_SQL, BINS, COUNTS_SQL, SUMSQ_SQL, counts, query
from loomwork.session import cut, dropped, table
from loomwork.sources.selection import read_rows


def matrix(spark, d):
    """Counts, cells with a depth (line items) and features, all of them."""
    x = cut(counts(spark, d))
    lines = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).groupBy(F.col("o_custkey").alias("cell")).agg(F.count(F.lit(1)).cast("double").alias("lines"))
    cells = table(spark, d, "customer").withColumnRenamed("c_custkey", "cell").join(lines, "cell", "left").na.fill(0.0, ["lines"])
    return x, cells, table(spark, d, "part").withColumnRenamed("p_partkey", "feature")


def nb_operator(spark, d, **how):
    """The operator of the cells and features with counts, as in the queries on tables."""
    null = residual.residual_null(counts(spark, d), None, None, depth_bins=BINS)
    return null, residual.residual_operator(null, **how)


def bernoulli_operator(spark, d, **how):
    x, cells, _ = matrix(spark, d)
    null = residual.residual_null(x, cells, x.select("feature").distinct(), "bernoulli", "lines", BINS)
    return null, residual.residual_operator(null, **how)


PICK = "c_mktsegment = 'BUILDING' and c_acctbal > 0"


@query("read_rows_by_query", f"with {COUNTS_SQL} select cell, feature, value from counts join customer on cell = c_custkey join part on feature = p_partkey where {PICK} and p_size > 25")
def read_rows_by_query(spark, d):
    x, cells, features = matrix(spark, d)
    return read_rows(x, cells, features, cell_query=PICK, feature_mask=lambda f: F.col("p_size") > 25, cell_columns=["c_nationkey"]).counts


@query("read_rows_columns", f"select c_custkey as cell, c_nationkey from customer where {PICK}")
def read_rows_columns(spark, d):
    return read_rows(*matrix(spark, d), cell_mask=F.expr(PICK), cell_columns=["c_nationkey"]).cells


ALL_SQL = f"with {COUNTS_SQL}, x as (select counts.* from counts join customer on cell = c_custkey where c_mktsegment = 'BUILDING'), sums as (select cell, sum(value) as depth from x group by 1), depth as (select cell, depth / (select avg(depth) from sums) as s from sums), tot as (select sum(s) s1, sum(s * s) s2 from depth), f0 as (select feature, sum(value) x1, sum(value * value) x2, sum(value * s) xs from x join depth using (cell) group by 1), f1 as (select p_partkey as feature, coalesce(x2, 0) x2, coalesce(xs, 0) xs, greatest(coalesce(x1, 0) / greatest(s1, 1e-12), 1e-10) as r, s1, s2 from part left join f0 on p_partkey = feature cross join tot) select feature, ln(r) as baseline, least(greatest((x2 - 2 * r * xs + r * r * s2 - r * s1) / greatest(r * r * s2, 1e-12), 1e-4), 1e3) as dispersion from f1"


@query("nb_null_all_features", ALL_SQL)
def nb_null_all_features(spark, d):
    x, cells, features = matrix(spark, d)
    some = read_rows(x, cells, features, cell_query="c_mktsegment = 'BUILDING'")
    held = some.cells.join(some.counts.select("cell").distinct(), "cell", "left_semi")
    return residual.residual_null(some.counts, held, features, depth_bins=None).parameters


@query("nb_null_with_parent_bins", f"with {BIN_SQL}, own as (select binned.* from binned join customer on cell = c_custkey where c_mktsegment = 'BUILDING') select bin, s_bin, count(*) as n_cells from own join sizes using (bin) group by 1, 2")
def nb_null_with_parent_bins(spark, d):
    parent, _ = nb_operator(spark, d)
    some = table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("cell"))
    own = parent.bins.join(parent.sizes, "bin").join(some, "cell", "left_semi")
    return residual.residual_null(parent.counts, own.select("cell"), parent.parameters.select("feature"), assignment=own.select("cell", "bin", "s_bin")).sizes


R3 = "unnest([0, 1, 2]) as c"
NB_MATMAT = f"with {BIN_SQL}, r as (select feature, c, sin(feature * (c + 1)) as r from nb, (select {R3})), p as (select cell, c, sum(v * r) as p from v join r using (feature) group by 1, 2), q as (select bin, c, sum(nul * r) as q from block join r using (feature) group by 1, 2) select cell, q.c, coalesce(p, 0) - q as z from binned join q using (bin) left join p on p.cell = binned.cell and p.c = q.c"
NB_RMATMAT = f"with {BIN_SQL}, b as (select cell, bin, c, cos(cell * (c + 1)) as b from binned, (select {R3})), p as (select feature, c, sum(v * b) as p from v join b using (cell) group by 1, 2), bb as (select bin, c, sum(b) as b from b group by 1, 2), q as (select feature, c, sum(nul * b) as q from block join bb using (bin) group by 1, 2) select feature, q.c, coalesce(p, 0) - q as z from q left join p using (feature, c)"


def waves(ids, key: str, wave):
    return ids.select(key, F.array(*[wave(F.col(key) * k) for k in (1, 2, 3)]).alias("vec"))


def by_column(block):
    return block.select(block.columns[0], F.posexplode("vec").alias("c", "z"))


@query("nb_matmat_block", NB_MATMAT.replace("select cell, q.c", "select binned.cell, q.c"))
def nb_matmat_block(spark, d):
    _, op = nb_operator(spark, d)
    return by_column(residual.matmat(op, waves(op.features, "feature", F.sin)))


@query("nb_rmatmat_block", NB_RMATMAT)
def nb_rmatmat_block(spark, d):
    _, op = nb_operator(spark, d)
    return by_column(residual.rmatmat(op, waves(op.rows, "cell", F.cos)))


B_MATMAT = f"with recursive {BLOCK_SQL}, r as (select feature, c, sin(feature * (c + 1)) as r from (select distinct feature from block), (select {R3})), p as (select cell, c, sum({{v}} * r) as p from v join r using (feature) group by 1, 2), q as (select bin, c, sum({{n}} * r) as q from block join r using (feature) group by 1, 2) select binned.cell, q.c, coalesce(p, 0) - q as z from binned join q using (bin) left join p on p.cell = binned.cell and p.c = q.c"


@query("bernoulli_matmat_block", B_MATMAT.format(v="v", n="nul"))
def bernoulli_matmat_block(spark, d):
    _, op = bernoulli_operator(spark, d)
    return by_column(residual.matmat(op, waves(op.features, "feature", F.sin)))


@query("bernoulli_root_weighted_matmat_block", B_MATMAT.format(v="root_v", n="root_nul"))
def bernoulli_root_weighted_matmat_block(spark, d):
    _, op = bernoulli_operator(spark, d, root_weighted=True)
    return by_column(residual.matmat(op, waves(op.features, "feature", F.sin)))


MEAN_SQL = ", mp as (select feature, sum(v) as p from v group by 1), mq as (select feature, sum(nul * n_cells) as q from block group by 1), mu as (select feature, (coalesce(p, 0) - q) / (select count(*) from binned) as mean from mq left join mp using (feature))"


@query("nb_column_moments", f"with {BIN_SQL}{SUMSQ_SQL}{MEAN_SQL} select feature, mean, sumsq from sq join mu using (feature)")
def nb_column_moments(spark, d):
    return residual.column_moments(nb_operator(spark, d)[1]).drop("j")


@query("nb_centred_matmat", f"with {BIN_SQL}{MEAN_SQL}, r as (select feature, sin(feature) as r from nb), p as (select cell, sum(v * r) as p from v join r using (feature) group by 1), q as (select bin, sum(nul * r) as q from block join r using (feature) group by 1), m as (select sum(mean * r) as m from mu join r using (feature)) select cell, coalesce(p, 0) - q - m as z from binned left join p using (cell) join q using (bin), m")
def nb_centred_matmat(spark, d):
    _, op = nb_operator(spark, d)
    own = residual.centred(op, residual.column_moments(op))
    return residual.matmat(own, op.features.select("feature", F.array(F.sin("feature")).alias("vec"))).select("cell", F.col("vec")[0].alias("z"))


@query("nb_centred_column_sums", f"with {BIN_SQL} select feature, 0.0::double as total from nb")
def nb_centred_column_sums(spark, d):
    """The transposed product of the centred operator with ones is nothing."""
    _, op = nb_operator(spark, d)
    own = residual.centred(op, residual.column_moments(op))
    return residual.rmatmat(own, op.rows.select("cell", F.array(F.lit(1.0)).alias("vec"))).select("feature", F.round(F.col("vec")[0], 6).alias("total"))


DENSE_SQL = "select cell, sum(z) as total, sum(z * z) as squares from z group by 1"


@query("nb_dense_rows", f"with {BIN_SQL}, z as (select binned.cell, coalesce(v, 0) - nul as z from binned join block using (bin) left join v on v.cell = binned.cell and v.feature = block.feature) {DENSE_SQL}")
def nb_dense_rows(spark, d):
    null, op = nb_operator(spark, d, turned=False)
    dropped(null.counts, null.parameters)
    return residual.dense(op, sums=True)


@query("nb_exact_dense_rows", f"with {BIN_SQL}, z as (select depth.cell, (coalesce(value, 0) - s * exp(baseline)) / sqrt(greatest(s * exp(baseline) + dispersion * (s * exp(baseline)) ** 2, 1e-8)) as z from depth cross join nb left join counts on counts.cell = depth.cell and counts.feature = nb.feature) {DENSE_SQL}")
def nb_exact_dense_rows(spark, d):
    null = residual.residual_null(counts(spark, d), None, None, depth_bins=None)
    return residual.exact_dense(null, sums=True)


COMPS = 8


def pca_of(spark, d, **how):
    null, op = nb_operator(spark, d)
    dropped(null.counts, null.parameters)
    return op, decomposition.pca(op, COMPS, oversample=12, n_power=how.pop("n_power", 5), **how)


@query("pca_component_products", f"select a, b, case when a = b then 1.0 else 0.0 end::double as product from (select unnest(range({COMPS})) as a), (select unnest(range({COMPS})) as b)")
def pca_component_products(spark, d):
    """Components are orthonormal."""
    g = decomposition.gram(pca_of(spark, d)[1].components, COMPS)
    return spark.createDataFrame([(a, b, round(float(g[a, b]), 6) + 0.0) for a in range(COMPS) for b in range(COMPS)], "a long, b long, product double")


@query("pca_checks", "select unnest(['centring', 'other seed', 'probes', 'score invariant', 'total variance', 'variances fall', 'variances of scores']) as name, true as ok")
def pca_checks(spark, d):
    """What must hold of any decomposition: scores are Z - mean on components, variances are those of scores and fall, another sketch finds the span."""
    op, p = pca_of(spark, d, check_seed=1, probe_blocks=2, probe_width=256, n_power=7)
    scores = decomposition.covariances(p.scores, p.scores)[0] * op.n_cells / (op.n_cells - 1)
    ok = {
        "centring": p.record["centring_residual"] < 1e-8, "score invariant": p.record["score_invariant"] < 1e-8, "other seed": p.record["check"]["mean_squared_cosine"] > 0.9,
        "probes": all(x["relative_error"] < 1e-8 for x in p.record["probes"]), "variances of scores": bool(abs(scores - decomposition.np.diag(p.explained)).max() < 1e-6 * p.explained[0]),
        "variances fall": bool((decomposition.np.diff(p.explained) <= 0).all()), "total variance": 0 < p.ratio.sum() < 1,
    }
    return spark.createDataFrame([(k, bool(v)) for k, v in ok.items()], "name string, ok boolean")


@query("pca_scores")
def pca_scores(spark, d):
    from loomwork.operators.tables import pcs

    return pcs(pca_of(spark, d)[1])
