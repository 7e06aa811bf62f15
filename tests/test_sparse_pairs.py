"""All-pairs work on rows that share few columns: what is scored and listed, and that the result is the whole one."""

import numpy as np
import pytest

from cellweave.operators import forest, tiles
from cellweave.operators import similarity as S


def sparse(rows, columns, each, seed):
    rng = np.random.default_rng(seed)
    dense = np.zeros((rows, columns))
    for row in dense:
        row[rng.choice(columns, each, replace=False)] = rng.integers(1, 9, each)
    return dense


def table(spark, dense):
    expr = spark.createDataFrame([(int(i), int(g), float(dense[i, g])) for i, g in zip(*np.nonzero(dense))], "cell long, gene long, value double")
    return expr, spark.range(len(dense)).withColumnRenamed("id", "cell")


def stats_of(dense):
    return np.stack([dense.sum(1), (dense ** 2).sum(1), (dense != 0).sum(1), dense.sum(1)]).astype(float)


def by_hand(dense, k):
    r = np.round(np.corrcoef(dense), 12)
    i, j = np.nonzero(np.triu(r > 0, 1))
    pick, rounds = forest.first_fit(i, j, 1 - r[i, j], k)
    return {(int(i[p]), int(j[p])): int(t) for p, t in zip(pick, rounds)}


def test_forest_scores_only_pairs_that_share_a_column(spark, monkeypatch):
    dense = sparse(160, 900, 6, 3)
    sim = S.pearson(*table(spark, dense), 160, 900)
    listed, kept = [], []
    monkeypatch.setattr(forest, "oriented_pairs", lambda *a: listed.append(a))
    monkeypatch.setattr(forest, "merge_forests", lambda edges, k: edges)
    monkeypatch.setattr(sim, "_run", lambda consumer, *a, **k: kept.append(consumer))
    forest.kmst_graph(sim, 3)
    stats = stats_of(dense)
    halves = [(slice(0, 70), slice(70, 160), False), (slice(0, 70),) * 2 + (True,), (slice(70, 160),) * 2 + (True,)]
    found = []
    for a, b, diagonal in halves:
        made = tiles.Tile(np.arange(160)[a], np.arange(160)[b], stats[:, a].copy(), stats[:, b].copy(), dense[a] @ dense[b].T, None, diagonal)
        for batch in kept[0](made):
            found.append([batch.column(c).to_numpy() for c in ("i", "j", "cost")])
    assert not listed  # pairs without a product are not even listed
    i, j, cost = (np.concatenate(c) for c in zip(*found))
    assert (i < j).all() and len(set(zip(i, j))) == len(i)
    pick, rounds = forest.first_fit(i, j, cost, 3)
    assert {(int(i[p]), int(j[p])): int(t) for p, t in zip(pick, rounds)} == by_hand(dense, 3)


@pytest.mark.parametrize("sign", [1.0, -1.0])
def test_sparse_forest_is_whole(spark, monkeypatch, sign):
    """In blocks of few rows; negative row sums, where pairs without a product may qualify, take the dense way."""
    dense = sparse(90, 500, 5, 4)
    dense[::3] *= sign
    expr, rows = table(spark, dense)
    sim = S.Similarity(expr, rows, 90, S._pearson_measure(500), metric_genes=500, block_rows=16)
    found = {(e.i, e.j): e["round"] for e in forest.kmst_graph(sim, 3).collect()}
    assert found == by_hand(dense, 3)


@pytest.mark.parametrize("bound", [1 << 24, 0])
def test_tile_products_by_shared_columns(monkeypatch, bound):
    """Products of two blocks, with the table of places and without it, on columns far apart too."""
    monkeypatch.setattr(tiles, "TABLE_COLUMNS", bound)
    a, b = sparse(12, 60, 7, 5), sparse(9, 60, 7, 6)
    a[:, :5], b[:, 55:] = 0, 0
    names = np.arange(60) * 3 - 20

    def side(dense, prefix, block):
        gene, slot = np.nonzero(dense.T)
        import pyarrow as pa
        columns = [pa.array([block], pa.int32())] + [tiles._list(c) for c in (
            np.arange(len(dense)), stats_of(dense).ravel(), names[gene], slot.astype(np.int32), dense.T[gene, slot])]
        return tiles._Side(pa.RecordBatch.from_arrays(columns, [prefix + c for c in ("block", "ids", "stats", "genes", "slots", "vals")]), 0, prefix)

    left, right = side(a, "", 0), side(b, "r_", 1)
    for tuning in (tiles.TUNING, (8, 20, 1)):
        made = tiles._Building(left, right, False, True, tuning)
        assert np.allclose(made.gram, a @ b.T) and np.array_equal(made.support, (a != 0) * 1.0 @ (b != 0).T)
        own = tiles._Building(left, left, True, True, tuning)
        assert np.allclose(own.gram, a @ a.T)


def test_rows_without_clusters_are_not_placed_around_pivots(spark, monkeypatch):
    """Some rows tell that no tile can be left out: the others are never matched against the pivots."""
    dense = sparse(400, 700, 5, 7)
    expr, rows = table(spark, dense)
    sim = S.Similarity(expr, rows, 400, S._pearson_measure(700), metric_genes=700, block_rows=64)
    matched, match = [], S.best_match
    monkeypatch.setattr(S, "PROBED", 4)
    monkeypatch.setattr(S, "best_match", lambda left, right, n_left, *a: matched.append(n_left) or match(left, right, n_left, *a))
    found = {(e.i, e.j): e["round"] for e in forest.kmst_graph(sim, 2).collect()}
    assert sim.skipped == 0 and matched and sum(matched) < 300
    assert found == by_hand(dense, 2)


@pytest.mark.parametrize("k", [1, 3, 40])
def test_best_places_are_the_first_of_a_stable_order(monkeypatch, k):
    monkeypatch.setattr(S, "RANKED", 50)
    rng = np.random.default_rng(k)
    score = np.round(rng.normal(size=(30, 17)) * 3) / 1e4  # many ties
    score[rng.random(score.shape) < 0.2] = np.nan
    score[4] = np.nan
    monkeypatch.setattr(np, "argsort", None)  # whole rows are never sorted
    found = set(zip(*(c.tolist() for c in S._best_places(score, k))))
    expected = set()
    for i, row in enumerate(score.tolist()):
        ranked = sorted((j for j in range(17) if row[j] == row[j]), key=lambda j: (-int(round(row[j] * 1e4, 6)), j))
        expected |= {(i, j) for j in ranked[:k]}
    assert found == expected
