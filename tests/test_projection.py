"""Principal components by the distributed range finder against the exact decomposition."""

import numpy as np
import pytest

from cellweave.operators import projection


def frame(spark, rows, parts=5):
    return spark.createDataFrame([(i, None if r is None else [float(x) for x in r]) for i, r in enumerate(rows)],
                                 "id long, z array<double>").repartition(parts)


def distances(x):
    return np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))


def test_distances_equal_those_of_the_exact_projection(spark):
    """Wide vectors, so that the subspace is grown, cut back and grown again."""
    rng = np.random.default_rng(1)
    x = rng.standard_normal((250, 400)) * np.exp(-np.arange(400) / 60)
    axes, singular, passes = projection.principal_axes(frame(spark, x).select("z"), 4)
    exact = np.linalg.svd(x, full_matrices=False)
    assert passes > 3 and np.allclose(singular, exact[1][:4], rtol=1e-9)
    assert np.allclose(axes.T @ axes, np.eye(4), atol=1e-10)
    found = projection.projected(frame(spark, x), axes).orderBy("id").collect()
    assert np.abs(distances(np.array([r.z for r in found])) - distances(x @ exact[2][:4].T)).max() < 1e-6


def test_partitions_do_not_matter(spark):
    x = np.random.default_rng(2).standard_normal((60, 70)) * np.linspace(3, 0.1, 70)
    one, many = (projection.principal_axes(frame(spark, x, parts).select("z"), 3)[0] for parts in (1, 40))
    assert np.abs(one - many).max() < 1e-8


@pytest.mark.parametrize("x", [np.zeros((5, 40)), np.outer(np.arange(1, 6), np.ones(40)), np.eye(3, 40), np.ones((1, 1))])
def test_fewer_directions_than_asked_for(spark, x):
    k = min(6, x.shape[1])
    axes, singular, _ = projection.principal_axes(frame(spark, x).select("z"), k)
    assert axes.shape == (x.shape[1], k) and np.allclose(axes.T @ axes, np.eye(k), atol=1e-10)
    assert np.allclose(x @ axes @ axes.T, x, atol=1e-9)
    exact = np.linalg.svd(x, compute_uv=False)[:k]
    assert np.allclose(singular, np.pad(exact, (0, k - len(exact))), atol=1e-9)


def test_singular_values_are_not_squared_away(spark):
    """1e-9 of the largest is lost in a covariance of doubles, but not in the triangles."""
    x = np.diag([1.0, 1e-3, 1e-9])
    assert np.allclose(projection.principal_axes(frame(spark, x).select("z"), 3)[1], [1.0, 1e-3, 1e-9], rtol=1e-6)


def test_nulls_stay_and_unfit_vectors_raise(spark):
    axes, _, _ = projection.principal_axes(frame(spark, [[1, 2, 3], None, [3, 2, 2]]).select("z"), 2)
    found = projection.projected(frame(spark, [[1, 2, 3], None, [3, 2, 2]]), axes).orderBy("id").collect()
    assert found[1].z is None and [len(found[i].z) for i in (0, 2)] == [2, 2]
    for rows in ([[1, 2], [1, 2, 3]], [[1, float("nan")], [1, 2]], [[1, float("inf")], [1, 2]], [None], []):
        with pytest.raises(ValueError):
            projection.principal_axes(frame(spark, rows).select("z"), 1)


def test_too_wide_raises(spark, monkeypatch):
    monkeypatch.setattr(projection, "MODEL_BYTES", 100)
    with pytest.raises(ValueError, match="bound"):
        projection.principal_axes(frame(spark, [[1, 2, 3]]).select("z"), 1)
