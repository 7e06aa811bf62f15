"""Operators against brute force, with bounds lowered so that every path runs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellweave.config import TASK_EDGES
from cellweave.operators import constraints, distribution, forest, graph, louvain, metrics, quantile, soft, stats, tiles
from cellweave.operators import normalize as N
from cellweave.operators import similarity as S
from cellweave.operators.keys import dense_index, grid, lookup_join
from cellweave.plans import catalog
from tests import oracle


def peel(edges, n, k):
    """k times: Kruskal on the remaining edges."""
    rest, out = sorted(edges, key=lambda e: (e[2], e[0], e[1])), {}
    for t in range(1, k + 1):
        top, left = list(range(n)), []

        def find(v):
            while top[v] != v:
                v = top[v]
            return v

        for i, j, c in rest:
            a, b = find(i), find(j)
            if a == b:
                left.append((i, j, c))
            else:
                top[a] = b
                out[i, j] = t
        rest = left
    return out


def random_edges(seed, n, share, levels):
    rng = np.random.default_rng(seed)
    return [(i, j, float(rng.integers(levels))) for i in range(n) for j in range(i + 1, n) if rng.random() < share]


@pytest.mark.parametrize("seed,levels", [(0, 3), (1, 1000), (2, 1), (3, 20)])
def test_first_fit_is_peeling(seed, levels):
    edges = random_edges(seed, 40, 0.4, levels)
    order = np.random.default_rng(seed).permutation(len(edges))
    i, j, c = (np.array(x)[order] for x in zip(*edges))
    pick, rounds = forest.first_fit(i, j, c, 4)
    assert {(int(i[p]), int(j[p])): int(r) for p, r in zip(pick, rounds)} == peel(edges, 40, 4)


def test_all_merging_paths_agree(spark):
    edges = random_edges(7, 30, 0.5, 6)
    expected = peel(edges, 30, 3)
    df = spark.createDataFrame(edges, "i long, j long, cost double")
    tagged = df.select((F.col("i") % 16).cast("int").alias("bi"), (F.col("j") % 16).cast("int").alias("bj"), "i", "j", "cost")
    as_dict = lambda found: {(r.i, r.j): r["round"] for r in found.collect()}
    assert as_dict(forest.spanning_forests(df, 3)) == expected
    assert as_dict(forest.merge_forests(tagged, 3, task_edges=150)) == expected   # grouped merges
    assert as_dict(forest.merge_forests(tagged, 3, task_edges=5)) == expected     # distributed rounds


def skewed_matrix(spark, n=150, genes=40, seed=0):
    """Gene 0 in every cell and cell 0 with every gene: each holds a large share of the rows."""
    rng = np.random.default_rng(seed)
    dense = rng.poisson(0.15, (n, genes)).astype(float)
    dense[:, 0] = rng.integers(1, 9, n)
    dense[0, :] = rng.integers(1, 9, genes)
    data = [(int(c) * 7, int(g), float(dense[c, g])) for c, g in zip(*np.nonzero(dense))]
    expr = spark.createDataFrame(data, "cell long, gene long, value double")
    return dense, expr, spark.range(n).select((F.col("id") * 7).alias("cell"))


@pytest.mark.parametrize("block_rows,cost", [(16, 1e-9), (2048, 1e9), (64, 64)])
def test_tiled_correlation_is_exact(spark, block_rows, cost):
    """Dense and entry-wise products, many and few blocks, columns split over buffers."""
    dense, expr, rows = skewed_matrix(spark)

    def measure(tile, inner=S._pearson_measure(dense.shape[1])):
        return inner(tile)

    side = (expr, tiles.row_stats(expr, rows))
    emit = S._emit_pairs(measure, None)
    found = tiles.run_tiles(side, None, len(dense), None, emit, S.PAIR_SCHEMA, True, block_rows=block_rows,
                            tuning=(7, 50, cost)).collect()
    expected = np.corrcoef(dense)
    assert len(found) == len(dense) * (len(dense) - 1) // 2
    for r in found:
        assert r.r == pytest.approx(expected[r.i // 7, r.j // 7], abs=1e-9)


def test_neighbours_histogram_and_forest_from_tiles(spark):
    dense, expr, rows = skewed_matrix(spark, 80)
    n = len(dense)
    r = np.round(np.corrcoef(dense), 12)
    sim = S.pearson(expr, rows, n, dense.shape[1])
    k = 4
    expected = {}
    for i in range(n):
        order = sorted((j for j in range(n) if j != i), key=lambda j: (-np.trunc(np.round(r[i, j] * 1e4, 6)), j))
        expected[i * 7] = [j * 7 for j in order[:k]]
    got = {}
    for row in sim.nearest(k).collect():
        got.setdefault(row.i, []).append(row.j)
    assert {i: sorted(v) for i, v in got.items()} == {i: sorted(v) for i, v in expected.items()}
    bins = np.trunc(np.round(r[np.triu_indices(n, 1)] * 10 + 10, 9)).astype(int)
    assert {x.bin: x.n for x in sim.histogram().collect()} == dict(zip(*np.unique(bins, return_counts=True)))
    edges = [(i, j, 1 - r[i, j]) for i in range(n) for j in range(i + 1, n) if r[i, j] > 0]
    found = {(x.i // 7, x.j // 7): x["round"] for x in forest.kmst_graph(sim, 3).collect()}
    assert found == peel(edges, n, 3)
    top = {(x.i // 7, x.j // 7): x["round"] for x in forest.kmst_graph(sim, 2, threshold=0.1, inverse=False).collect()}
    assert top == peel([(i, j, r[i, j]) for i in range(n) for j in range(i + 1, n) if r[i, j] > 0.1], n, 2)


def test_best_match_across_blocks(spark):
    dense, expr, rows = skewed_matrix(spark, 70)
    other, right, right_rows = skewed_matrix(spark, 30, seed=5)
    right, right_rows = right.withColumn("cell", F.col("cell") / 7).select(F.col("cell").cast("long"), "gene", "value"), \
        spark.range(30).withColumnRenamed("id", "cell")
    r = np.round(np.corrcoef(dense, other)[:70, 70:], 12)
    got = {x.i // 7: (x.j, round(x.r, 9)) for x in S.best_match(expr, right, 70, 30, 40, rows, right_rows).collect()}
    assert got == {i: (int(r[i].argmax()), round(float(r[i].max()), 9)) for i in range(70)}
    assert S.cross_pearson(expr, right, 70, 30, 40, rows, right_rows).count() == 70 * 30


def test_distances_and_their_quantiles(spark):
    rng = np.random.default_rng(3)
    z = rng.normal(size=(90, 5))
    z[10:30] = z[9]                                    # copies: zero distances are left out
    z[40:60] = np.round(z[40:60])
    points = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(z)], "id long, z array<double>")
    d = np.sqrt(((z[:, None] - z[None]) ** 2).sum(2))
    flat = d[np.triu_indices(90, 1)]
    flat = flat[flat > 0]
    assert S.euclidean_pairs(points, 90).count() == len(flat)
    probs = [0.0, 0.1, 0.5, 0.9, 1.0]
    assert S.distance_quantiles(points, 90, probs, bins=16, bound=10) == pytest.approx(np.quantile(flat, probs), abs=1e-9)


@pytest.mark.parametrize("values", [
    np.arange(1000) % 7, np.random.default_rng(0).normal(size=2001), np.zeros(500), np.r_[np.zeros(900), np.arange(100)]])
def test_quantiles_beyond_the_bound(spark, values):
    df = spark.createDataFrame([(float(v),) for v in values], "x double")
    probs = [0.0, 0.25, 0.5, 0.77, 1.0]
    assert quantile.exact_quantiles(df, "x", probs, bound=20) == pytest.approx(np.quantile(values, probs))
    assert quantile.exact_quantiles(df, "x", probs) == pytest.approx(np.quantile(values, probs))


def test_components_on_both_paths(spark):
    edges = [(i, i + 1, 1.0) for i in range(0, 40) if i % 10 != 9] + [(60, 70, 1.0), (70, 80, 1.0)]
    df = spark.createDataFrame(edges, "i long, j long, weight double")
    vertices = spark.range(82).withColumnRenamed("id", "cell")
    expected = {v: v // 10 * 10 if v < 40 else v for v in range(82)} | {40: 40, 70: 60, 80: 60}
    for bound in (TASK_EDGES, 0):
        got = {r.cell: r.component for r in graph.connected_components(vertices, df, bound).collect()}
        assert got == expected


def test_louvain_is_a_local_optimum_and_independent_of_the_path(spark):
    rng = np.random.default_rng(4)
    n = 40
    group = np.arange(n) // 10
    edges = [(i, j, float(rng.uniform(0.1, 1))) for i in range(n) for j in range(i + 1, n)
             if rng.random() < (0.7 if group[i] == group[j] else 0.08)]
    df = spark.createDataFrame(edges, "i long, j long, weight double")
    vertices = spark.range(n).withColumnRenamed("id", "cell")
    near = louvain.louvain(vertices, df).orderBy("cell").collect()
    far = louvain.louvain(vertices, df.repartition(3), task_edges=10).orderBy("cell").collect()
    assert near == far
    w = np.zeros((n, n))
    for i, j, x in edges:
        w[i, j] = w[j, i] = x
    deg, m2 = w.sum(1), w.sum()

    def q(labels):
        same = labels[:, None] == labels[None, :]
        return ((w - np.outer(deg, deg) / m2) * same).sum() / m2

    labels = np.array([r.cluster for r in near])
    best = q(labels)
    assert best >= q(group) - 1e-6
    for v in range(n):
        for c in set(labels):
            trial = labels.copy()
            trial[v] = c
            assert q(trial) <= best + 1e-6


def test_dense_index_and_joins(spark):
    df = spark.createDataFrame([(x,) for x in (50, 3, 9, 7, 100)], "k long")
    assert {r.k: r.n for r in dense_index(df, ["k"], "n", 3).collect()} == {3: 0, 7: 1, 9: 2, 50: 3, 100: 4}
    big = spark.createDataFrame([(1, x) for x in range(100)] + [(2, 1)], "k long, x long")
    small = spark.createDataFrame([(1, "a"), (3, "c")], "k long, y string")
    for rows in (2, 10**9):                              # broadcast, salted
        assert lookup_join(big, small, "k", rows).count() == 100
        assert lookup_join(big, small, "k", rows, "left").filter("y IS NULL").count() == 1
    assert grid(big.select("x").distinct(), small, ["x"]).count() == 200


def test_pruned_tiles_hold_all_pairs(spark):
    """Clustered rows, constant rows, copies: the same pairs and forests from a fraction of the tiles."""
    rng = np.random.default_rng(9)
    group = np.arange(200) % 5
    dense = np.round(np.maximum(0, rng.normal(size=(5, 40))[group] * 3 + rng.normal(0, 0.3, (200, 40)) + 4), 3)
    dense[7] = 0
    dense[11] = 2.0
    dense[20:60:5] = dense[15]
    entries = [(c * 3, g, float(v)) for c, row in enumerate(dense) for g, v in enumerate(row) if v]
    expr = spark.createDataFrame(entries, "cell long, gene long, value double")
    rows = spark.range(200).select((F.col("id") * 3).alias("cell"))
    whole, pruned = (S.pearson(expr, rows, 200, 40) for _ in range(2))
    pruned.block_rows = 10
    for least, inclusive in ((0.8, False), (0.3, True)):
        asked, found = (sorted(map(tuple, sim.pairs(least, inclusive).collect())) for sim in (whole, pruned))
        assert len(asked) > 1000 and [p[:2] for p in found] == [p[:2] for p in asked]
        assert max(abs(a[2] - b[2]) for a, b in zip(asked, found)) < 1e-9
        assert whole.skipped == 0 and pruned.skipped > 0.5
    trees = [{(e.i, e.j): e["round"] for e in forest.kmst_graph(sim, 2, threshold=0.4).collect()} for sim in (whole, pruned)]
    assert trees[0] == trees[1] and pruned.skipped > 0.5
    copies = S.pearson(expr.filter("cell % 15 = 0"), rows.filter("cell % 15 = 0"), 40, 40)
    copies.block_rows = 2
    assert copies.pairs(0.0).count() == S.pearson(expr.filter("cell % 15 = 0"), rows.filter("cell % 15 = 0"), 40, 40).pairs(0.0).count()


def test_colours_part_neighbours_and_agree_in_both_forms(spark):
    rng = np.random.default_rng(3)
    pairs = np.unique(np.sort(rng.integers(0, 60, (240, 2)) * 7, axis=1), axis=0)
    pairs = pairs[pairs[:, 0] != pairs[:, 1]]
    nodes, ends = np.unique(pairs, return_inverse=True)
    a, b = ends.reshape(pairs.shape).T
    colour = louvain._array_colours(nodes, np.concatenate((a, b)), np.concatenate((b, a)), 5)
    assert (colour[a] != colour[b]).all() and colour.max() <= np.bincount(np.concatenate((a, b))).max()
    arcs = spark.createDataFrame([(int(x), int(y)) for x, y in np.concatenate((pairs, pairs[:, ::-1]))], "u long, v long")
    table = spark.createDataFrame([(int(x),) for x in nodes], "cell long")
    found = {r.cell: r.colour for r in louvain.colour_classes(table, arcs, 5, len(nodes)).collect()}
    assert found == dict(zip(nodes.tolist(), colour.tolist()))


def test_louvain_sweeps_are_bounded_on_a_chain(spark):
    n = 10_000
    i, w = np.arange(n - 1), np.full(n - 1, 1 << 20)
    report = []
    cells, where = louvain._array_levels(i, i + 1, w, 1.0, 123, report)
    assert max(r["sweeps"] for r in report) < 16 and len(report) < 12
    m = float(w.sum())
    degree = np.bincount(np.searchsorted(np.unique(where), where), weights=np.bincount(i, w, n) + np.bincount(i + 1, w, n))
    assert w[where[i] == where[i + 1]].sum() / m - (degree ** 2).sum() / (4 * m * m) > 0.97
    edges = spark.createDataFrame([(k, k + 1, 1.0) for k in range(90)], "i long, j long, weight double")
    vertices = spark.range(91).withColumnRenamed("id", "cell")
    told = []
    far = louvain.louvain(vertices, edges, task_edges=0, report=told).orderBy("cell").collect()
    assert far == louvain.louvain(vertices, edges).orderBy("cell").collect()
    assert told[0]["nodes"] == 91 and all(t["colours"] <= 3 and t["sweeps"] < 16 for t in told)


def test_automatic_bins_and_density(spark):
    rng = np.random.default_rng(12)
    for values in (rng.normal(0.4, 0.1, 700), np.concatenate((rng.beta(2, 5, 300), np.full(40, 0.25))), np.repeat([0.1, 0.2, 0.9], [60, 3, 3]), np.array([0.3, 0.7])):
        df = spark.createDataFrame([(float(v),) for v in values] + [(None,), (float("nan"),), (float("inf"),)], "x double").repartition(4)
        count, edges = np.histogram(values, "auto")
        bins = distribution.automatic_histogram(df, "x").orderBy("bin").collect()
        assert [b.bin for b in bins] == list(range(len(count))) and sum(b.n for b in bins) == len(values)
        assert np.abs(np.cumsum([b.n for b in bins]) - np.cumsum(count)).max() <= 1  # a value at an edge may round to either side
        assert [b.low for b in bins] + [bins[-1].high] == pytest.approx(edges.tolist())
        curve = distribution.density_curve(df, "x").orderBy("x").collect()
        h = values.std(ddof=1) * len(values) ** -0.2
        x = np.linspace(values.min(), values.max(), 200)
        direct = np.exp(-0.5 * ((x[:, None] - values) / h) ** 2).sum(1) / (len(values) * h * np.sqrt(2 * np.pi))
        assert [c.x for c in curve] == pytest.approx(x.tolist()) and np.abs(np.array([c.density for c in curve]) - direct).max() < 1e-6
    same = spark.createDataFrame([(2.0,)] * 5, "x double")
    assert [tuple(b) for b in distribution.automatic_histogram(same, "x").collect()] == [(0, 1.5, 2.5, 5)]
    assert distribution.density_curve(same, "x").count() == distribution.automatic_histogram(same.limit(0), "x").count() == 0


def test_moments_and_scaling(spark):
    dense, expr, rows = skewed_matrix(spark, 60)
    n = len(dense)
    got = {r.gene: (r["mean"], r.var_pop) for r in stats.gene_stats(expr, n).collect()}
    for g in range(dense.shape[1]):
        assert got[g] == pytest.approx((dense[:, g].mean(), dense[:, g].var()))
    sd = dense.std(0, ddof=1)
    z = (dense - dense.mean(0)) / np.where(sd == 0, 1, sd)
    scaled = N.scale_genes(expr, n)
    genes = scaled.groupBy("gene").agg(F.max("z_zero").alias("zero"))
    full = N.densify(scaled.select("cell", "gene", F.col("z").alias("value")), rows, genes, "zero").collect()
    assert len(full) == z.size
    assert max(abs(r.value - z[r.cell // 7, r.gene]) for r in full) < 1e-9


def test_trend_fit_finds_the_curve(spark):
    rng = np.random.default_rng(2)
    mean = rng.uniform(0.05, 6, 300)
    var = 3.0 * mean / (mean ** 1.4 + 2.0) + rng.normal(0, 0.01, 300)
    table = spark.createDataFrame([(g, float(m), float(v)) for g, (m, v) in enumerate(zip(mean, var))],
                                  "gene long, mean double, var_pop double")
    a, n, b = stats.fit_trend(table)
    assert (a, n, b) == pytest.approx((3.0, 1.4, 2.0), rel=0.05)
    assert stats.fit_trend(table.repartition(3)) == pytest.approx((a, n, b), rel=1e-6)
    with pytest.raises(RuntimeError):
        stats.fit_trend(table, max_steps=2)
    fitted = a * mean / (mean ** n + b)
    assert ((var - fitted) ** 2).sum() <= ((var - 3.0 * mean / (mean ** 1.4 + 2.0)) ** 2).sum()


def test_trend_fit_of_flat_valleys(spark):
    """Data of which only a ratio of parameters is determined: the fit still ends, at the valley's error."""
    rng = np.random.default_rng(4)
    mean = rng.uniform(0.5, 4, 200)
    noise = rng.normal(0, 0.05, 200)
    for var, order in [(2 * mean + noise, 1.0), (3 * mean ** -0.5 + noise, -0.5)]:
        table = spark.createDataFrame([(g, float(m), float(v)) for g, (m, v) in enumerate(zip(mean, var))], "gene long, mean double, var_pop double")
        a, n, b = stats.fit_trend(table)
        plain = mean ** order
        least = ((var - (var @ plain) / (plain @ plain) * plain) ** 2).sum()
        assert ((var - a * mean / (mean ** n + b)) ** 2).sum() <= least * (1 + 1e-9)
    assert stats.fit_trend(table.limit(0)) == stats.fit_trend(table.withColumn("mean", F.lit(0.0))) == (1.0, 1.0, 1.0)
    flat = stats.fit_trend(table.withColumn("mean", F.lit(2.0)))
    assert flat[0] * 2 / (2 ** flat[1] + flat[2]) == pytest.approx(var.mean())


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.1"])
def test_trend_fit_of_the_other_tables(spark, sf):
    for name in ("trend_residual", "mean_variance_genes"):
        found = catalog.QUERIES[name](spark, f"/root/testdata/{sf}").toPandas()
        expected = oracle.database(f"/root/testdata/{sf}").sql(catalog.ORACLES[name]).df()
        key = "gene" if "gene" in found else "n_genes"
        both = found.merge(expected, on=key, suffixes=("", "_sql"))
        value = [c for c in found.columns if c != key][0]
        assert len(both) >= 0.999 * len(expected) and abs(both[value] - both[f"{value}_sql"]).max() < 1e-5


def test_assignment_is_optimal():
    from itertools import permutations

    rng = np.random.default_rng(0)
    for _ in range(100):
        n = int(rng.integers(1, 7))
        cost = rng.integers(-5, 9, (n, n)).astype(float)
        chosen = metrics.assignment(cost)
        assert sorted(chosen) == list(range(n))
        assert cost[np.arange(n), chosen].sum() == min(sum(cost[i, p[i]] for i in range(n)) for p in permutations(range(n)))


def test_constraints_hold_and_are_complete(spark):
    rng = np.random.default_rng(1)
    z = rng.normal(size=(60, 4))
    label = rng.integers(0, 3, 60)
    points = spark.createDataFrame([(i * 3, z[i].tolist(), int(label[i])) for i in range(60)], "id long, z array<double>, label long")
    rows = constraints.label_constraints(points, 200).collect()
    assert len(rows) == 200 and len({frozenset((r.a, r.b)) for r in rows}) == 200
    assert all((r.kind == "ML") == (label[r.a // 3] == label[r.b // 3]) for r in rows)
    flipped = constraints.label_constraints(points, 200, error_rate=0.1).collect()
    wrong = [r for r in flipped if (r.kind == "ML") != (label[r.a // 3] == label[r.b // 3])]
    assert len(wrong) == 20 and max(r.draw for r in wrong) < min(r.draw for r in flipped if r not in wrong)
    d = np.sqrt(((z[:, None] - z[None]) ** 2).sum(2))
    low, high = np.quantile(d[np.triu_indices(60, 1)], [0.1, 0.9])
    for r in constraints.distance_constraints(points, 50).collect():
        assert d[r.a // 3, r.b // 3] < low if r.kind == "ML" else d[r.a // 3, r.b // 3] > high
    few = points.limit(4)
    assert constraints.label_constraints(few, 100).count() == 6      # all pairs there are


def test_weighted_covariance(spark):
    rng = np.random.default_rng(6)
    z = rng.normal(size=(40, 3))
    mu = np.array([[0., 0, 0], [1., 1, 1]])
    points = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(z)], "id long, z array<double>")
    shares = soft.student_t_assign(points, mu).withColumnRenamed("q", "p")
    q = np.array([r.p for r in shares.orderBy("id").collect()])
    got = {r.cluster: np.array(r.cov).reshape(3, 3) for r in soft.weighted_covariance(points, mu, shares).collect()}
    for c in (0, 1):
        diff = z - mu[c]
        assert got[c] == pytest.approx((q[:, c, None] * diff).T @ diff / q[:, c].sum())
