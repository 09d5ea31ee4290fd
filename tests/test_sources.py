import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomwork.sources import csr
from loomwork.sources.selection import read_rows


@pytest.fixture(scope="module")
def parts(spark):
    rng = np.random.default_rng(3)
    x = rng.integers(1, 9, (300, 40)) * (rng.random((300, 40)) < 0.2)
    counts = spark.createDataFrame([(int(i), int(j), int(x[i, j])) for i, j in np.argwhere(x)], "cell long, feature long, value int")
    cells = spark.createDataFrame([(i, ("paired", "rna")[i % 2], "abc"[i % 3]) for i in range(300)], "cell long, modality string, state string")
    features = spark.createDataFrame([(j, j >= 25) for j in range(40)], "feature long, is_peak boolean")
    return x, counts, cells, features


def dense(df, shape):
    out = np.zeros(shape)
    for r in df.collect():
        out[r.cell, r.feature] = r.value
    return out


def test_selections_are_fancy_indexing(spark, parts):
    x, counts, cells, features = parts
    i = np.arange(300)
    want = np.where(((i % 2 == 0) & (i % 3 == 1))[:, None] & (np.arange(40) >= 25), x, 0)
    keep = (i % 2 == 0) & (i % 3 == 1)
    for how in ({"cell_query": "modality = 'paired' and state = 'b'"}, {"cell_mask": (F.col("modality") == "paired") & (F.col("state") == "b")}, {"cell_mask": lambda c: c.state.eqNullSafe("b") & (c.modality == "paired")}, {"cell_mask": keep.tolist()}, {"cell_mask": cells.where("modality = 'paired' and state = 'b'")}):
        got = read_rows(counts, cells, features, feature_mask=F.col("is_peak"), cell_columns=["state"], **how)
        assert np.array_equal(dense(got.counts, x.shape), want) and got.cells.columns == ["cell", "state"] and got.cells.count() == keep.sum() and got.features.count() == 15
    with pytest.raises(ValueError, match="not both"):
        read_rows(counts, cells, features, cell_mask=F.lit(True), cell_query="true")
    with pytest.raises(ValueError, match="40 booleans"):
        read_rows(counts, cells, features, feature_mask=[True] * 39)


def test_arrays_are_read_by_rows(spark, parts, tmp_path):
    x, *_ = parts
    spark.dataSource.register(csr.CsrSource)
    at = [np.flatnonzero(r) for r in x]
    csr.write_csr(str(tmp_path / "sparse"), np.cumsum([0, *map(len, at)]), np.concatenate(at), x[x != 0], 40)
    csr.write_dense(str(tmp_path / "dense"), x)
    rows = np.array([5, 3, 299, 17])
    mask = np.isin(np.arange(300), rows)
    for folder in ("sparse", "dense"):
        path = str(tmp_path / folder)
        np.save(f"{path}/rows.npy", rows)
        np.save(f"{path}/mask.npy", mask)
        read = lambda **o: spark.read.format("rows_of_arrays").options(path=path, rowBlock=7, **o).load()  # noqa: E731, B023
        assert np.array_equal(dense(read(), x.shape), x)
        for name in ("rows.npy", "mask.npy"):
            assert np.array_equal(dense(read(rows=name), x.shape), np.where(mask[:, None], x, 0))
    with open(f"{path}/meta.json", "w") as f:
        json.dump({"encoding": "csc_matrix", "shape": [300, 40]}, f)
    with pytest.raises(Exception, match="csc_matrix"):
        read().collect()


def test_streamed_sums_fit_the_same_null(spark, parts, tmp_path):
    from loomwork.operators import nulls
    from loomwork.streaming import sums

    _, counts, cells, _ = parts
    x = counts.withColumn("value", F.col("value").cast("double"))
    depth = nulls.depths(x, cells)
    entries = x.join(depth.select("cell", "s"), "cell")
    entries.repartition(5).write.parquet(str(tmp_path / "in"))
    stream = sums.feature_sums(spark.readStream.schema(entries.schema).option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "in")))
    run = stream.writeStream.outputMode("complete").format("memory").queryName("held").trigger(availableNow=True).start()
    run.awaitTermination()
    s1, s2 = depth.agg(F.sum("s"), F.sum(F.col("s") * F.col("s"))).first()
    got = {r.feature: (r.baseline, r.dispersion) for r in sums.moments(spark.table("held"), s1, s2).collect()}
    want = {r.feature: (r.baseline, r.dispersion) for r in nulls.nb_null(x, depth).collect()}
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k]) for k in want)
