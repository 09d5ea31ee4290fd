import pytest

from compare import compare
from loomwork.plans import registry as catalogue

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_same_rows_as_sql(spark, name):
    said = compare(spark, SF, name, catalogue.QUERIES[name], catalogue.SQL[name])
    assert ": same " in said, said


@pytest.mark.parametrize("held", [0, 30, 1 << 20])
def test_components_of_chains_stars_and_random_links(spark, monkeypatch, held):
    import random

    from loomwork.operators import graph

    monkeypatch.setattr(graph, "HELD", held)
    rnd = random.Random(4)
    edges = [(i, i + 1) for i in range(10, 20)] + [(100, j) for j in range(101, 120)] + [(rnd.randrange(1000, 1200), rnd.randrange(1000, 1200)) for _ in range(120)] + [(5, 5)]
    root = {i: i for e in edges for i in e if e[0] != e[1]}
    for a, b in edges:
        if a != b:
            low, high = sorted((root[a], root[b]))
            root = {i: low if r == high else r for i, r in root.items()}
    got = graph.components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert len(got) == len(root) and {r.node: r.root for r in got} == root
    assert graph.components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_ranks_are_global_and_bins_are_equal_counts(spark):
    from loomwork.operators.nulls import equal_count_bins

    df = spark.createDataFrame([(float(i % 3), i) for i in range(10)], "depth double, cell long")
    got = sorted((r.depth, r.cell, r.bin) for r in equal_count_bins(df, 4).collect())
    assert [b for *_, b in got] == [k * 4 // 10 for k in range(10)]


def test_bad_feature_names_are_named(spark):
    from loomwork.operators.genome import parse_names

    with pytest.raises(Exception, match="chrom5"):
        parse_names(spark.createDataFrame([(1, "chrom5")], "feature long, name string")).collect()
