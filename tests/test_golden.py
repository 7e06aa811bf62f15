"""Worked examples with known results."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellweave.functions import expressions as X
from cellweave.model import Experiment
from cellweave.operators import annotate as A
from cellweave.operators import forest, graph, louvain, metrics, soft, stats
from cellweave.operators import normalize as N
from cellweave.operators import similarity as S
from cellweave.plans import methods


def experiment(spark, matrix):
    n = matrix.select(F.max("cell")).first()[0] + 1
    cells = spark.createDataFrame([(c, f"c{c}") for c in range(n)], "cell long, barcode string")
    genes = spark.createDataFrame([(g, f"g{g}", f"s{g}") for g in range(3)], "gene long, gene_id string, symbol string")
    return Experiment(matrix, cells, genes)


@pytest.fixture(scope="module")
def norm(spark, matrix):
    return N.normalize(experiment(spark, matrix))


def test_normalisation(norm):
    got = {(r.cell, r.gene): round(r.value, 6) for r in norm.expr.collect()}
    for cell in (0, 2, 3, 4):
        assert [got[cell, g] for g in range(3)] == [1.94591, 1.098612, 1.098612]
    assert [got[1, g] for g in range(3)] == [0.767255, 0.325422, 2.247235]
    assert {r.cell: r.n_counts for r in norm.cells.collect()} == {0: 5, 1: 26, 2: 5, 3: 10, 4: 10}


def test_gene_statistics(norm):
    rows = stats.gene_stats(norm.expr, 5).orderBy("gene").collect()
    assert [round(r["mean"], 6) for r in rows] == [1.710179, 0.943974, 1.328337]
    assert [round(r.var_pop, 6) for r in rows] == [0.222276, 0.095652, 0.211093]


def test_both_correlations(norm):
    exact = {(r.i, r.j): r.r for r in S.pearson(norm.expr, norm.cells, 5, 3).pairs().collect()}
    union = {(r.i, r.j): r.r for r in S.pearson_union_trunc(norm.expr, norm.cells, 5).pairs().collect()}
    assert len(exact) == len(union) == 10
    for pair in exact:
        if 1 in pair:
            assert round(exact[pair], 6) == -0.297736 and round(union[pair], 6) == 0.140319
        else:
            assert exact[pair] == union[pair] == 1.0


def test_both_methods(spark, matrix):
    exact = {r.cell: r.cluster for r in methods.kmst(experiment(spark, matrix), "none").collect()}
    assert len(exact) == 5 and list(exact.values()).count(exact[1]) == 1
    union = methods.kmst_union(experiment(spark, matrix))
    assert union.edges.filter("i = 1 OR j = 1").count() > 0
    assert union.clusters.count() == 5


ROUND_PAIRS = [(0, 1, .9), (0, 2, .8), (0, 3, .1), (0, 4, .3), (1, 2, .7), (1, 3, -.2), (1, 4, 0.), (2, 3, .4), (2, 4, .5), (3, 4, .6)]


def test_two_rounds(spark):
    edges = spark.createDataFrame([(i, j, 1 - r) for i, j, r in ROUND_PAIRS if r > 0], "i long, j long, cost double")
    expected = {1: {(0, 1), (0, 2), (3, 4), (2, 4)}, 2: {(1, 2), (2, 3), (0, 4), (0, 3)}}
    for found in (forest.spanning_forests(edges, 2), forest.distributed_rounds(edges, 2)):
        rows = found.collect()
        assert {t: {(r.i, r.j) for r in rows if r["round"] == t} for t in (1, 2)} == expected


def test_rounds_for():
    assert [forest.rounds_for(n, m) for n in (2, 5, 100) for m in ("floor", "round")] == [0, 1, 1, 2, 4, 5]


def planted(spark, sizes, inner=10.0, outer=1.0):
    rows, start = [], 0
    for size in sizes:
        rows += [(a, b, inner) for a in range(start, start + size) for b in range(a + 1, start + size)]
        if start:
            rows.append((start - 1, start, outer))
        start += size
    vertices = spark.range(start).withColumnRenamed("id", "cell")
    return vertices, spark.createDataFrame(rows, "i long, j long, weight double")


@pytest.mark.parametrize("gamma", [1.0, 0.5])
def test_planted_groups(spark, gamma):
    sizes = [5, 4, 6]
    vertices, edges = planted(spark, sizes)
    expected = [c for c, size in enumerate(sizes) for _ in range(size)]
    for bound in (louvain.TASK_EDGES, 0):
        found = louvain.louvain(vertices, edges, gamma, task_edges=bound)
        assert [r.cluster for r in found.orderBy("cell").collect()] == expected


def test_modularity_by_hand(spark):
    vertices, edges = planted(spark, [3, 3], 1.0, 1.0)
    labels = vertices.select("cell", (F.col("cell") >= 3).cast("long").alias("cluster"))
    assert graph.modularity(edges, labels, 1.0).first()["q"] == pytest.approx(6 / 7 - 0.5)
    assert graph.modularity(edges, labels, 0.5).first()["q"] == pytest.approx(6 / 7 - 0.25)
    assert graph.total_weight(edges).first()[0] == 14.0
    assert {(r.ci, r.cj): r.weight for r in graph.contract_graph(edges, labels).collect()} == {(0, 0): 3.0, (0, 1): 1.0, (1, 1): 3.0}


def test_isolated_vertices_stay_alone(spark):
    vertices, edges = planted(spark, [3, 3])
    more = vertices.unionByName(spark.range(6, 8).withColumnRenamed("id", "cell"))
    got = [r.cluster for r in louvain.louvain(more, edges).orderBy("cell").collect()]
    assert got == [0, 0, 0, 1, 1, 1, 2, 3]
    none = louvain.louvain(more, edges.limit(0)).orderBy("cell").collect()
    assert [r.cluster for r in none] == list(range(8))


def test_annotation(spark):
    atlas = spark.createDataFrame(
        [(s, t, "k", "c", v) for t, row in (("P0", (10., 0., 2.)), ("P1", (1., 8., 3.))) for s, v in zip(("s0", "s1", "s2"), row)],
        "symbol string, tissue string, type string, cluster string, read_count double")
    rows = [(5, 0, 1), (0, 4, 2), (1, 2, 9), (2, 2, 2)]
    expr = spark.createDataFrame([(c, g, float(v)) for c, row in enumerate(rows) for g, v in enumerate(row) if v],
                                 "cell long, gene long, value double")
    got = {r.barcode: (r.tissue, None if r.max_corr is None else round(r.max_corr, 6))
           for r in A.annotate(experiment(spark, expr), atlas).collect()}
    assert got == {"c0": ("P0", 1.0), "c1": ("P1", 0.970725), "c2": ("P1", -0.127257), "c3": (None, None)}


def test_annotation_ties_take_the_first_profile_and_first_symbol(spark):
    atlas = spark.createDataFrame(
        [(s, t, "k", "c", v) for t in ("B", "A") for s, v in (("s0", 1.), ("s1", 2.), ("s2", 4.))],
        "symbol string, tissue string, type string, cluster string, read_count double")
    expr = spark.createDataFrame([(0, 0, 1.), (0, 1, 2.), (0, 2, 4.), (0, 3, 900.)], "cell long, gene long, value double")
    exp = experiment(spark, expr)
    twice = spark.createDataFrame([(g, "", f"s{g % 3}") for g in range(4)], "gene long, gene_id string, symbol string")
    row = A.annotate(exp.with_(genes=twice), atlas).first()
    assert (row.tissue, row.max_corr) == ("A", 1.0)


def test_zinb(spark):
    data = [(0., 1.5, 2., .1, 1., 0.931715), (3., 1.5, 2., .1, 1., 2.380191), (3., 1.5, 2., .1, 2., 2.084124), (10., 4., .5, .3, .5, 5.128982)]
    df = spark.createDataFrame(data, "x double, m double, d double, p double, s double, e double")
    for row in df.select(X.zinb_nll(*map(F.col, "xmdps")).alias("got"), "e").collect():
        assert round(row.got, 6) == row.e
    zs = [1e-4, 0.3, 1.0, 2.5, 17.0, 1e4]
    got = spark.createDataFrame([(z,) for z in zs], "z double").select(X.lgamma(F.col("z"))).collect()
    assert [r[0] for r in got] == pytest.approx([math.lgamma(z) for z in zs], abs=1e-10)


@pytest.fixture(scope="module")
def three(spark):
    return spark.createDataFrame([(0, [0., 0.]), (1, [1., 0.]), (2, [4., 3.])], "id long, z array<double>").coalesce(1)


MU = np.array([[0., 0.], [4., 4.]])


def test_soft_assignment(three):
    soft_q = soft.student_t_assign(three, MU)
    q = np.array([r.q for r in soft_q.orderBy("id").collect()])
    assert np.round(q, 6).tolist() == [[0.970588, 0.029412], [0.928571, 0.071429], [0.071429, 0.928571]]
    target = soft.target_distribution(soft_q)
    p = np.array([r.p for r in target.orderBy("id").collect()])
    assert np.round(p, 6).tolist() == [[0.998245, 0.001755], [0.9888, 0.0112], [0.003082, 0.996918]]
    assert round(soft.kl_loss(target).first()[0], 6) == 0.041868


def test_mixture(three):
    found = soft.gmm_responsibilities(three, MU, [0.2, 0.7])
    p = np.array([r.p for r in found.orderBy("id").collect()])
    expected = [[3.775406e-01, 7.004856e-08], [3.775383e-01, 3.824499e-06], [2.319676e-06, 6.224555e-01]]
    assert p == pytest.approx(np.array(expected), rel=1e-5)
    assert soft.gmm_loss(found).first()[0] == pytest.approx(0.00242223, abs=1e-8)


def test_supervised_scores(spark):
    df = spark.createDataFrame(list(zip([1, 1, 1, 2, 2, 2], [0, 0, 1, 1, 1, 1])), "y_true int, y_pred int")
    row = metrics.supervised_metrics(df).first()
    assert (row.acc, row.nmi, row.ari) == (0.833, 0.479, 0.324)
    same = spark.createDataFrame([(1, 5), (1, 5)], "y_true int, y_pred int")
    assert metrics.supervised_metrics(same).first() == (1.0, 1.0, 1.0)


def test_unsupervised_scores(spark):
    points = spark.createDataFrame([(0, [0., 0.], 0), (1, [0., 1.], 0), (2, [4., 0.], 1), (3, [5., 0.], 1)],
                                   "id long, z array<double>, label long")
    row = metrics.unsupervised_metrics(points, None).first()
    assert (row.sil, row.chs, row.dbs) == (0.77916, 41.0, 0.22086)
    alone = points.unionByName(spark.createDataFrame([(4, [9., 9.], 2)], points.schema))
    assert 0 < metrics.silhouette(alone).first()[0] < 1


def test_constant_rows_have_no_correlation(spark):
    expr = spark.createDataFrame([(0, g, 2.0) for g in range(3)] + [(1, 0, 1.0), (2, 0, 3.0)], "cell long, gene long, value double")
    rows = spark.createDataFrame([(c,) for c in range(4)], "cell long")
    got = {(r.i, r.j): r.r for r in S.pearson(expr, rows, 4, 3).pairs().collect()}
    assert got == {(0, 1): None, (0, 2): None, (0, 3): None, (1, 2): 1.0, (1, 3): None, (2, 3): None}


def test_unknown_options_are_refused(spark, matrix):
    with pytest.raises(ValueError):
        methods.kmst(experiment(spark, matrix), "varianse")
    with pytest.raises(ValueError):
        N.assert_counts(matrix.withColumn("value", F.col("value") + 0.5))
