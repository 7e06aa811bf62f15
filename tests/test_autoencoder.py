"""Gradients of the network and training on partitions."""

from dataclasses import replace

import numpy as np
import pytest

from cellweave.config import DEC_SETTINGS, GMM_SETTINGS
from cellweave.functions import network as net
from cellweave.model import Experiment
from cellweave.operators import autoencoder as ae
from cellweave.operators import normalize as N
from cellweave.plans import methods

SMALL = replace(GMM_SETTINGS, hidden=(7, 5), latent=3, noise=0.3)


def batch():
    rng = np.random.default_rng(1)
    raw = rng.poisson(1.2, (9, 6)).astype(float)
    return np.log1p(raw), raw, rng.uniform(0.5, 2, 9), rng


def assert_gradients(params, function):
    _, grads = function(params)
    for name, value in params.items():
        for at in list(np.ndindex(value.shape))[::max(1, value.size // 5)]:
            moved = {k: v.copy() for k, v in params.items()}
            moved[name][at] += 1e-6
            up = function(moved)[0]
            moved[name][at] -= 2e-6
            slope = (up - function(moved)[0]) / 2e-6
            assert slope == pytest.approx(grads[name][at], rel=1e-3, abs=1e-6), (name, at)


def test_gradients():
    x, raw, size, rng = batch()
    plain = net.init_params(6, SMALL, np.float64)
    noise = lambda: np.random.default_rng(3)
    assert_gradients(plain, lambda p: net.batch_grads(p, x, raw, size, SMALL, noise()))
    centred = {**plain, "mu": rng.normal(size=(4, 3))}
    target = rng.uniform(size=(9, 4))
    target /= target.sum(1, keepdims=True)
    assert_gradients(centred, lambda p: net.batch_grads(p, x, raw, size, SMALL, noise(), target))
    mixed = {**centred, "logits": rng.normal(size=4)}
    assert_gradients(mixed, lambda p: net.batch_grads(p, x, raw, size, SMALL, noise()))
    flip = (x[::-1], raw[::-1], size[::-1])
    for must in (True, False):
        assert_gradients(centred, lambda p: net.pair_grads(p, (x, raw, size), flip, must, SMALL, noise()))


@pytest.fixture(scope="module")
def groups(spark):
    """Three groups of cells, each with genes of its own."""
    rng = np.random.default_rng(0)
    label = np.arange(150) % 3
    rate = np.full((3, 24), 0.3)
    for g in range(3):
        rate[g, g * 8:(g + 1) * 8] = 8.0
    dense = rng.poisson(rate[label])
    expr = spark.createDataFrame([(int(c), int(g), float(dense[c, g])) for c, g in zip(*np.nonzero(dense))],
                                 "cell long, gene long, value double")
    cells = spark.createDataFrame([(c, f"c{c}") for c in range(150)], "cell long, barcode string")
    genes = spark.createDataFrame([(g, f"g{g}", f"s{g}") for g in range(24)], "gene long, gene_id string, symbol string")
    return Experiment(expr, cells, genes), label


BRIEF = {"hidden": (32, 16), "latent": 8, "batch_size": 32, "noise": 0.5, "pretrain_epochs": 60}


def agreement(clusters, label):
    rows = clusters.orderBy("cell").select("cluster").collect()
    table = np.zeros((3, 3))
    for r, truth in zip(rows, label):
        table[r.cluster, truth] += 1
    from cellweave.operators.metrics import assignment
    return table[np.arange(3), assignment(-table)].sum() / len(rows)


def test_mixture_recovers_groups(groups):
    exp, label = groups
    result = methods.ae_gmm(exp, 3, replace(GMM_SETTINGS, pretrain_rate=5e-3, epochs=10, **BRIEF), restarts=3)
    assert agreement(result.clusters, label) > 0.95
    assert result.clusters.count() == 150 and len(result.clusters.first().p) == 3
    assert methods.latent_metrics(result).first().sil > 0.1


def test_divergence_with_constraints_and_saved_weights(spark, groups):
    exp, label = groups
    pairs = spark.createDataFrame([(i, i + 3, "ML") for i in range(0, 60, 2)] + [(i, i + 1, "CL") for i in range(0, 60, 2)],
                                  "a long, b long, kind string")
    settings = replace(DEC_SETTINGS, pretrain_rate=5e-3, epochs=4, **BRIEF)
    result = methods.dec(exp, 3, settings, pairs, restarts=3)
    assert agreement(result.clusters, label) > 0.95
    saved = ae.parameter_table(spark, result.model)
    again = methods.dec(exp, 3, replace(settings, epochs=0), weights=saved, restarts=3)
    assert agreement(again.clusters, label) > 0.95


def test_many_tasks_and_averaging(groups):
    exp, label = groups
    norm = N.normalize(exp)
    data = ae.training_set(norm.raw, norm.expr, norm.cells, shard_rows=40)
    assert data.rows.rdd.getNumPartitions() == 4
    settings = replace(GMM_SETTINGS, pretrain_rate=5e-3, **BRIEF)
    model = ae.Model(settings, net.init_params(data.width, settings))
    optimiser = {}
    step = lambda p, g, state: net.adam_step(p, g, state, settings.pretrain_rate)
    for epoch in range(6):
        ae._train(data, model, optimiser, step, 1, epoch, True)
    assert model.losses[-1] < model.losses[0]
    latent = ae.encode(data, model)
    assert latent.count() == 150 and latent.select("id").distinct().count() == 150


class Killed(Exception):
    pass


@pytest.mark.parametrize("kind", ["mixture", "divergence"])
def test_resumed_training_equals_an_unbroken_run(spark, groups, kind, tmp_path, monkeypatch):
    exp, _ = groups
    norm = N.normalize(exp)
    data = ae.training_set(norm.raw, norm.expr, norm.cells, shard_rows=60)
    base = GMM_SETTINGS if kind == "mixture" else replace(DEC_SETTINGS, update_interval=2, tol=0.0)
    settings = replace(base, **{**BRIEF, "pretrain_epochs": 6, "passes": 2, "epochs": 8 if kind == "mixture" else 4})
    plain = ae._train

    def run(folder, stop=None, resume=False):
        calls = [0]

        def train(*args, **more):
            calls[0] += 1
            if calls[0] == stop:
                raise Killed
            return plain(*args, **more)

        monkeypatch.setattr(ae, "_train", train)
        model = ae.pretrain(data, settings, checkpoint=str(folder), resume=resume, every=2)
        if kind == "mixture":
            return ae.fit_mixture(data, model, 3, 2), calls[0]
        return ae.fit_divergence(data, model, 3, None, 2), calls[0]

    whole, rounds = run(tmp_path / "whole")
    assert rounds == 7
    for stop in (3, 6):  # in the second pretraining round after a save, and in the phase after
        with pytest.raises(Killed):
            run(tmp_path / f"cut{stop}", stop)
        again, left = run(tmp_path / f"cut{stop}", resume=True)
        assert left < rounds and again.losses == whole.losses and again.params.keys() == whole.params.keys()
        assert all(v.dtype == whole.params[k].dtype and (v == whole.params[k]).all() for k, v in again.params.items())
    newest = max((tmp_path / "cut6").iterdir())
    (newest / "_SUCCESS").unlink()  # a state that wasn't written whole doesn't count
    found = ae.last_state(spark, str(tmp_path / "cut6"))
    assert f"{found.phase}-{found.done:06d}" != newest.name
    assert ae.last_state(spark, str(tmp_path / "nothing")) is None
    with pytest.raises(ValueError):
        ae.pretrain(data, replace(settings, batch_size=16), checkpoint=str(tmp_path / "whole"), resume=True)
    ae.pretrain(data, replace(settings, pretrain_epochs=0), checkpoint=str(tmp_path / "cut3"))
    assert ae.last_state(spark, str(tmp_path / "cut3")) is None  # a new run doesn't leave another's states


def test_estimated_clusters(groups):
    exp, _ = groups
    result = methods.ae_gmm(exp, None, replace(GMM_SETTINGS, pretrain_rate=5e-3, epochs=2, **BRIEF), restarts=2)
    assert result.n_clusters == len(result.model.params["mu"]) >= 2


def test_oversized_models_are_refused():
    with pytest.raises(ValueError):
        ae.check_size(1 << 40)


@pytest.mark.parametrize("dtype", [np.float32, np.float64])
def test_shards_send_their_arrays_as_they_are(dtype):
    arrays = {"w": np.arange(700_000, dtype=dtype).reshape(700, 1000), "t": np.array([3.0]), "none": np.zeros(0, dtype)}
    rows = [r for b in ae._emit(arrays, 5, 2) for r in b.to_pylist()]
    assert sum(len(r["values"]) for r in rows) == sum(a.nbytes for a in arrays.values())
    for name in ("w", "t"):
        found = np.concatenate([np.frombuffer(r["values"], r["kind"]) for r in rows if r["name"] == name])
        assert found.dtype == arrays[name].dtype and np.array_equal(found, arrays[name].ravel())


def test_slices_give_what_whole_batches_give(monkeypatch):
    _, raw, size, rng = batch()
    outputs = [rng.normal(size=raw.shape) for _ in range(3)]
    found = []
    for values in (1, 13, 1 << 20):
        monkeypatch.setattr(net, "_SLICE", values)
        heads, p, state = [o.copy() for o in outputs], {"w": raw.copy()}, {}
        loss = net._heads(raw, *heads, size)
        net.adam_step(p, {"w": heads[0]}, state, 0.1)
        net.adadelta_step(p, {"w": heads[1]}, state, 0.1, 0.9)
        found.append((loss, *heads, p["w"], *(state[k] for k in sorted(state))))
    for other in found[1:]:
        assert all(np.array_equal(x, y) for x, y in zip(found[0], other))
