"""Bounds, refusals and independence of partitioning."""

import os
import tracemalloc
import warnings
from dataclasses import replace
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cellweave.config import GMM_SETTINGS
from cellweave.functions import expressions as X
from cellweave.functions import network as net
from cellweave.model import Experiment
from cellweave.operators import autoencoder as ae
from cellweave.operators import constraints, forest, keys, metrics, tiles
from cellweave.operators import normalize as N
from cellweave.operators import similarity as S
from cellweave.session import cut, release, shared_dir
from cellweave.sources import readers


def counts(spark, n, genes=12):
    rng = np.random.default_rng(0)
    dense = rng.poisson(2.0, (n, genes))
    expr = spark.createDataFrame([(int(c), int(g), float(dense[c, g])) for c, g in zip(*np.nonzero(dense))], "cell long, gene long, value double")
    cells = spark.createDataFrame([(c, f"c{c}") for c in range(n)], "cell long, barcode string")
    return Experiment(expr, cells, spark.createDataFrame([(g, "", f"s{g}") for g in range(genes)], "gene long, gene_id string, symbol string"))


def training(spark, n):
    exp = N.normalize(counts(spark, n))
    return ae.training_set(exp.raw, exp.expr, exp.cells, shard_rows=40)


def test_training_does_not_depend_on_partitions(spark):
    settings = replace(GMM_SETTINGS, hidden=(8, 6), latent=3, batch_size=16, pretrain_epochs=6, passes=3)
    data = training(spark, 150)
    shards = data.rows.select("shard", F.spark_partition_id().alias("p")).distinct().collect()
    assert data.shards == 4 and len({r.shard for r in shards}) == len(shards) == 4
    one = ae.pretrain(data, settings)
    other = ae.pretrain(replace(data, rows=data.rows.coalesce(1)), settings)
    assert all(np.array_equal(one.params[k], other.params[k]) for k in one.params)
    assert len(one.losses) == 2 and one.losses[-1] < one.losses[0]


def test_one_cell_more_trains_the_same_way(spark):
    settings = replace(GMM_SETTINGS, hidden=(8, 6), latent=3, batch_size=16, pretrain_epochs=4, passes=2)
    models = [ae.pretrain(training(spark, n), settings) for n in (160, 161)]
    assert len(models[0].losses) == len(models[1].losses) == 2
    assert models[0].losses[-1] == pytest.approx(models[1].losses[-1], rel=0.1)


def test_pairs_of_unknown_cells_are_counted(spark):
    settings = replace(GMM_SETTINGS, hidden=(8, 6), latent=3, batch_size=16, pretrain_epochs=1, epochs=1)
    data = training(spark, 60)
    model = ae.pretrain(data, settings)
    pairs = spark.createDataFrame([(0, 1, "ML"), (2, 999, "CL")], "a long, b long, kind string")
    with pytest.warns(UserWarning, match="1 constraint"):
        ae.fit_divergence(data, model, 2, pairs, restarts=1)
    assert model.dropped_pairs == 1


def test_scaled_rows(spark):
    data = training(spark, 30)
    z = np.array([r.z for r in ae.scaled(data).orderBy("id").collect()])
    assert z.mean(axis=0) == pytest.approx(0, abs=1e-9) and z.std(axis=0, ddof=1) == pytest.approx(1)
    same = N.normalize(counts(spark, 30), scale=True).expr.groupBy("cell").pivot("gene").agg(F.first("value")).orderBy("cell").toPandas()
    assert same.drop(columns="cell").to_numpy() == pytest.approx(z)


def test_unmatched_labels_are_refused(spark):
    truth = spark.createDataFrame([("a", 1), ("b", 2)], "k string, y_true long")
    good = spark.createDataFrame([("b", 5), ("a", 6)], "k string, y_pred long")
    assert metrics.align_labels(truth, good, "k").count() == 2
    for rows in ([("a", 1)], [("a", 1), ("c", 2)], [("a", 1), ("a", 2)]):
        with pytest.raises(ValueError):
            metrics.align_labels(truth, spark.createDataFrame(rows, "k string, y_pred long"), "k")


def test_scores_of_narrow_points(spark):
    rng = np.random.default_rng(1)
    points = spark.createDataFrame([(i, (rng.normal(size=3) + 5 * (i % 2)).tolist(), i % 2) for i in range(40)], "id long, z array<double>, label long")
    assert metrics.unsupervised_metrics(points, 32).first() == metrics.unsupervised_metrics(points, None).first()


def test_large_contingency_tables_are_refused(spark, monkeypatch):
    monkeypatch.setattr(metrics, "MATCH_CELLS", 3)
    with pytest.raises(ValueError):
        metrics.cluster_accuracy(spark.createDataFrame([(1, 1), (2, 2)], "y_true long, y_pred long"))


def test_all_pairs_are_judged_when_few_qualify(spark):
    points = spark.createDataFrame([(i, i // 2) for i in range(12)], "id long, label long")
    indexed, n = constraints.numbered(points)
    only = lambda x, y: F.when(x("label") == y("label"), constraints.MUST)
    with pytest.warns(UserWarning, match="only 6 pairs"):
        rows = constraints.draw_constraints(indexed, n, 40, only).collect()
    assert {frozenset((r.a, r.b)) for r in rows} == {frozenset((2 * k, 2 * k + 1)) for k in range(6)}
    pairs = constraints._all_positions(spark, 50, 7).collect()
    assert {(r.pb, r.pa) for r in pairs} == {(a, b) for a in range(50) for b in range(a)} and min(r.draw for r in pairs) == 7
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        assert constraints.draw_constraints(indexed, n, 5, only).count() == 5


def test_constraints_from_own_clusters(spark):
    rng = np.random.default_rng(2)
    points = spark.createDataFrame([(i, (rng.normal(size=2) * 0.1 + 10 * (i % 2)).tolist()) for i in range(40)], "id long, z array<double>")
    rows = constraints.cluster_constraints(points, 30, far=0.2, n_clusters=2).collect()
    assert len(rows) == 30 and all((r.kind == "ML") == ((r.a - r.b) % 2 == 0) for r in rows)


def test_lookups_beyond_the_bound_copy_nothing(spark, monkeypatch):
    monkeypatch.setattr(keys, "BROADCAST_VALUES", 0)
    big = spark.range(1000).select((F.col("id") % 10).alias("k"), "id")
    small = spark.range(10).select(F.col("id").alias("k"), F.col("id").alias("v"))
    joined = keys.lookup_join(big, small, "k")
    assert joined.count() == 1000 and "Generate" not in joined._jdf.queryExecution().toString()


def test_long_strings_weigh_in(spark, monkeypatch):
    monkeypatch.setattr(keys, "BROADCAST_VALUES", 100)
    short = spark.createDataFrame([(i, "x") for i in range(20)], "k long, s string")
    assert keys.may_broadcast(short, 20) and not keys.may_broadcast(short.withColumn("s", F.repeat("s", 800)), 20)


def test_dense_rows_by_either_way(spark, monkeypatch):
    exp = counts(spark, 20)
    genes = exp.genes.select("gene", (F.col("gene") + 0.5).alias("fill"))
    one = N.densify(exp.expr, exp.cells, genes, "fill")
    assert "Join" not in one._jdf.queryExecution().optimizedPlan().toString().split("MapInArrow")[0]
    packed = {(r.cell, r.gene): r.value for r in one.collect()}
    monkeypatch.setattr(N, "BROADCAST_VALUES", 0)
    assert packed == {(r.cell, r.gene): r.value for r in N.densify(exp.expr, exp.cells, genes, "fill").collect()}
    assert len(packed) == 20 * 12


def test_lines_of_a_folder_are_numbered_by_file(spark, tmp_path):
    for name, first in (("b.txt", 3), ("a.txt", 0)):
        (tmp_path / name).write_text("".join(f"line{first + i}\n" for i in range(3)))
    rows = readers.numbered_lines(spark, str(tmp_path), "n").orderBy("n").collect()
    assert [(r.n, r.value) for r in rows] == [(i, f"line{i}") for i in range(6)]


def test_tables_are_released(spark):
    folder = shared_dir(spark).removeprefix("file:")
    before = set(os.listdir(folder))
    frame = cut(spark.range(3))
    made = set(os.listdir(folder)) - before
    assert frame.count() == 3 and any(f.startswith("cut-") for f in made)
    assert release(spark) >= 1 and not made & set(os.listdir(folder))
    assert release(spark) == 0


def test_tiles_shuffle_no_more_for_more_blocks(spark):
    """Tiles read the packed blocks: no exchange carries a block to each other block, and a task folds its tiles."""
    rng = np.random.default_rng(5)
    dense = rng.poisson(0.7, (90, 40)).astype(float)
    expr = spark.createDataFrame([(int(i), int(j), float(dense[i, j])) for i, j in zip(*np.nonzero(dense))], "cell long, gene long, value double")
    rows = spark.range(90).select(F.col("id").alias("cell"))
    found = []
    for block_rows in (6, 2048):
        sim = S.Similarity(expr, rows, 90, S._pearson_measure(40), block_rows=block_rows)
        plan = sim.pairs()._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" in plan and "Exchange" not in plan
        found.append((sorted(map(tuple, sim.nearest(3).collect())), sorted(map(tuple, forest.kmst_graph(sim, 3).collect()))))
    assert found[0] == found[1]


def test_blocks_hold_a_bounded_number_of_entries():
    assert tiles.rows_of_block(60_000, 36_000_000) == 2048
    assert tiles.rows_of_block(1_000, 1_000 * 1_000_000) == 2
    assert tiles.rows_of_block(0, 0) == 2048 and tiles.rows_of_block(1, 10 ** 9) == 1


def test_likelihood_of_a_dense_grid_stays_in_the_task(spark):
    """Array code and column expression agree; a block of the grid leaves its task as one row."""
    rng = np.random.default_rng(3)
    x, mean, size = rng.poisson(1.0, (20, 7)).astype(float), rng.uniform(0.1, 3, 7), rng.uniform(0.5, 2, 20)
    found = net.zinb_nll(x, mean, 2.0, 0.1, size)
    rows = [(float(x[c, g]), float(mean[g]), float(size[c]), float(found[c, g])) for c in range(20) for g in range(7)]
    nll = X.zinb_nll(F.col("x"), F.col("m"), F.lit(2.0), F.lit(0.1), F.col("s"))
    assert spark.createDataFrame(rows, "x double, m double, s double, e double").agg(F.max(F.abs(nll - F.col("e")))).first()[0] < 1e-9
    expr = spark.createDataFrame([(c, g, float(x[c, g])) for c in range(20) for g in range(7) if x[c, g]], "cell long, gene long, value double")
    cells = spark.createDataFrame([(c, float(size[c])) for c in range(20)], "cell long, s double")
    genes = spark.createDataFrame([(g, 0.0, float(mean[g])) for g in range(7)], "gene long, _fill double, mean double")

    def emit(ids, own, table, dense):
        yield S.batch_of(("n", "v"), [dense.size], [net.zinb_nll(dense, table["mean"].to_numpy(), 2.0, 0.1, own["s"]).sum()])

    sums = N.dense_blocks(expr.coalesce(1), cells.coalesce(1), genes, emit, "n long, v double").collect()
    assert sum(r.n for r in sums) == 140 and len(sums) <= 4
    assert abs(sum(r.v for r in sums) - found.sum()) < 1e-9


def test_entries_without_a_row_are_in_no_pair(spark):
    """Null row keys and rows that aren't asked for take no part; a null vector raises instead of shifting the others."""
    rows = [(0, 1, 1.0), (0, 2, 2.0), (1, 1, 3.0), (1, 3, 1.0), (None, 2, 9.0), (7, 1, 5.0)]
    expr = spark.createDataFrame(rows, "cell long, gene long, value double")
    sim = S.jaccard(expr, spark.range(2).select(F.col("id").alias("cell")), 2, 1.0)
    assert [(r.i, r.j, r.r) for r in sim.pairs().collect()] == [(0, 1, 1 / 3)]
    points = spark.createDataFrame([(0, [1.0, 2.0], 0), (1, None, 0)], "id long, z array<double>, label long")
    with pytest.raises(Exception, match="null or differ"):
        S.euclidean_pairs(points, 2).collect()


@pytest.mark.parametrize("rows", [300, 4])
def test_quantiles_look_where_a_few_rows_point(spark, monkeypatch, rows):
    """Two passes over all pairs when the guess holds; the same values, in more passes, when it does not."""
    rng = np.random.default_rng(6)
    z = rng.normal(size=(400, 3))
    points = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(z)], "id long, z array<double>")
    runs, run = [], tiles.run_vector_tiles
    monkeypatch.setattr(tiles, "run_vector_tiles", lambda *a, **k: runs.append(1) or run(*a, **k))
    monkeypatch.setattr(S, "_GUESS_ROWS", rows, raising=False)
    flat = np.sqrt(((z[:, None] - z[None]) ** 2).sum(2))[np.triu_indices(400, 1)]
    found = S.distance_quantiles(points, 400, [0.25, 0.75], bins=64, bound=1000)
    assert found == pytest.approx(np.quantile(flat, [0.25, 0.75]), abs=1e-9)
    assert rows == 4 or len(runs) == 2


@pytest.mark.parametrize("copies", [1, 2])
def test_silhouette_sends_few_sums_however_many_labels(spark, monkeypatch, copies):
    """Of a label that a task has whole only the least mean leaves it; ids that come twice are told apart by nothing."""
    rng = np.random.default_rng(8)
    label = np.append(np.arange(640) % 64, [900, -5])  # two labels of one point each
    z = rng.normal(size=(len(label), 4)) + label[:, None] % 5
    rows = [(i, v.tolist(), int(k)) for i, (v, k) in enumerate(zip(z, label))] * copies
    points = spark.createDataFrame(rows, "id long, z array<double>, label long")
    made, run = [], tiles.run_vector_tiles
    monkeypatch.setattr(tiles, "run_vector_tiles", lambda *a, **k: made.append(run(*a, **k)) or made[-1])
    d, one = np.sqrt(((z[:, None] - z[None]) ** 2).sum(2)), label[None, :] == np.unique(label)[:, None]
    sums, n = copies * d @ one.T, copies * one.sum(1)
    own = one.T
    a, b = sums[own] / np.maximum((n * own).sum(1) - 1, 1), np.where(own, np.inf, sums / n).min(1)
    s = np.where((n * own).sum(1) == 1, 0.0, (b - a) / np.maximum(a, b))
    assert metrics.silhouette(points).first()["sil"] == pytest.approx(s.mean(), abs=1e-9)
    if copies == 1:
        assert made[0].count() < 40 * len(label)


def test_forest_lists_few_pairs_of_a_tile_at_a_time(spark, monkeypatch):
    """Whatever the size of a tile, the pairs listed at once are bounded, and the forest is that of the whole tile."""
    rng = np.random.default_rng(9)
    dense = rng.poisson(1.0, (120, 30)).astype(float)
    expr = spark.createDataFrame([(i, j, float(v)) for (i, j), v in np.ndenumerate(dense) if v], "cell long, gene long, value double")
    sim = S.pearson(expr, spark.range(120).withColumnRenamed("id", "cell"), 120, 30)
    sizes, listed = [], forest.oriented_pairs
    monkeypatch.setattr(forest, "oriented_pairs", lambda tile, score, rows: sizes.append((rows.stop - rows.start) * score.shape[1]) or listed(tile, score, rows))
    monkeypatch.setattr(forest, "SLICE_PAIRS", 1000, raising=False)
    kept = []
    monkeypatch.setattr(forest, "merge_forests", lambda edges, k: edges)
    monkeypatch.setattr(sim, "_run", lambda consumer, *a, **k: kept.append(consumer))
    forest.kmst_graph(sim, 3)
    gram, stats = dense @ dense.T, np.stack([dense.sum(1), (dense ** 2).sum(1), (dense > 0).sum(1), dense.sum(1)])
    tile = tiles.Tile(np.arange(120), np.arange(120), stats, stats.copy(), gram, None, True)
    batch, = kept[0](tile)
    assert max(sizes) <= 1000
    r = np.round(np.corrcoef(dense), 12)
    i, j = np.nonzero(np.triu(r > 0, 1))
    pick, _ = forest.first_fit(i, j, 1 - r[i, j], 3)
    assert set(zip(batch.column("i").to_pylist(), batch.column("j").to_pylist())) == set(zip(i[pick].tolist(), j[pick].tolist()))


def test_matching_against_few_rows_holds_few_products_at_a_time():
    rng, n, each, width = np.random.default_rng(5), 10_000, 40, 75
    genes = np.arange(64)
    dense = np.vstack([rng.integers(1, 50, (64, width)), np.zeros(width)]).astype(float)
    lengths = np.where(np.arange(n) % 3, each, 0)  # some rows have no entry
    found = np.concatenate([np.sort(rng.choice(70, m, replace=False)) for m in lengths])
    values = rng.integers(1, 50, len(found)).astype(float)
    cuts = pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32))
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(n)), pa.ListArray.from_arrays(cuts, pa.array(found)),
                                        pa.ListArray.from_arrays(cuts, pa.array(values))], ["cell", "genes", "values"])
    best = lambda ids, others, score: [(ids, np.nan_to_num(score, nan=-2.0).argmax(1), score)]
    work = S._few_work(genes, np.arange(width), dense, S._pearson_measure(64), best)
    tracemalloc.start()
    ids = [r[0] for r in work(iter([batch]))]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert np.array_equal(np.concatenate(ids), np.arange(n))
    assert peak < 60 << 20
    full = np.zeros((n, 71))
    full[np.repeat(np.arange(n), lengths), found] = values
    for rows, _, score in work(iter([batch])):
        l = full[rows]
        whole = lambda x: (x.sum(-1), (x * x).sum(-1))
        wanted = S._pearson_measure(64)(SimpleNamespace(gram=l[:, :64] @ dense[:64], left_stats=whole(l), right_stats=whole(dense.T)))
        assert np.allclose(score, wanted, equal_nan=True)
