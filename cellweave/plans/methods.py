"""The clustering and annotation methods, end to end."""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweave.config import DEC_SETTINGS, GMM_SETTINGS, AutoencoderSettings
from cellweave.functions import network as net
from cellweave.model import Experiment
from cellweave.operators import autoencoder as ae
from cellweave.operators import forest, graph, louvain, metrics, similarity, soft, stats
from cellweave.operators import normalize as N
from cellweave.session import cut


def kmst(exp: Experiment, gene_filter: str = "variance", top: int = stats.TOP_GENES, weight: str = "cost",
         gamma: float = 1.0, seed: int = 123) -> DataFrame:
    """(cell, barcode, n_counts, cluster): communities of the k-round spanning graph.

    ``weight`` is what communities are found on: the cost 1 - r or the correlation.
    """
    norm = N.normalize(exp)
    cells = cut(norm.cells.select("cell", "barcode", "n_counts"))
    n_cells = cells.count()
    expr = cut(stats.select_genes(norm.expr, n_cells, gene_filter, top))
    n_genes = expr.agg(F.count_distinct("gene")).first()[0]
    sim = similarity.pearson(expr, cells, n_cells, n_genes)
    edges = forest.kmst_graph(sim, forest.rounds_for(n_cells, "floor"))
    return _communities(cells, edges, weight, gamma, seed)


def kmst_union(exp: Experiment, seed: int = 123) -> "UnionResult":
    """The variant with union-support correlation, rounded k and half resolution."""
    expr = N.drop_empty(N.drop_empty(exp.expr, "gene"), "cell")
    kept = exp.expr.select("cell").distinct()
    order = N.dense_index(kept, ["cell"], "_dense").join(exp.cells, "cell").select(F.col("_dense").alias("cell"), "barcode")
    totals = cut(N.cell_totals(expr))
    cells = cut(order.join(totals, "cell").select("cell", "barcode", "n_counts"))
    norm = cut(N.scale_depth(expr, totals, N.median_depth(totals)))
    n = cells.count()
    sim = similarity.pearson_union_trunc(norm, cells, n)
    edges = cut(forest.kmst_graph(sim, forest.rounds_for(n, "round")))
    return UnionResult(_communities(cells, edges, "cost", 0.5, seed), edges, sim, norm, expr)


@dataclass
class UnionResult:
    clusters: DataFrame
    edges: DataFrame
    similarity: similarity.Similarity
    normalized: DataFrame
    counts: DataFrame


def _communities(cells: DataFrame, edges: DataFrame, weight: str, gamma: float, seed: int) -> DataFrame:
    if weight not in ("cost", "correlation"):
        raise ValueError(f"unknown edge weight {weight!r}: use cost or correlation")
    value = F.col("cost") if weight == "cost" else 1.0 - F.col("cost")
    weighed = cut(edges.select("i", "j", value.alias("weight")))
    labels = louvain.louvain(cells, weighed, gamma, seed)
    return cells.join(labels, "cell")


@dataclass
class LatentResult:
    """clusters: cells with cluster (and the array p); latent: (id, z); model: the trained network; data: its input."""

    clusters: DataFrame
    latent: DataFrame
    model: ae.Model
    n_clusters: int
    data: ae.TrainingSet


def _training(exp: Experiment) -> tuple[ae.TrainingSet, DataFrame]:
    norm = N.normalize(exp)
    cells = cut(norm.cells.select("cell", "barcode", "n_counts", "size_factor"))
    raw = cut(norm.raw.join(cells.select("cell"), "cell", "left_semi"))
    return ae.training_set(raw, norm.expr, cells), cells


def ae_gmm(exp: Experiment, n_clusters: int | None = None, settings: AutoencoderSettings = GMM_SETTINGS,
           restarts: int = 20, checkpoint: str | None = None, resume: bool = False) -> LatentResult:
    """Autoencoder with a mixture on its latent space; 0 or None clusters are estimated.

    Labels are the most probable component of the final responsibilities. ``resume`` goes on from the last state in
    ``checkpoint``.
    """
    data, cells = _training(exp)
    model = ae.fit_mixture(data, ae.pretrain(data, settings, checkpoint=checkpoint, resume=resume), n_clusters, restarts)
    latent = ae.encode(data, model)
    found = soft.gmm_responsibilities(latent, model.params["mu"], model.params["logits"].tolist())
    labelled = found.select(F.col("id").alias("cell"), "p",
                            (F.array_position("p", F.array_max("p")) - 1).alias("cluster"))
    return LatentResult(cells.join(labelled, "cell"), latent, model, len(model.params["mu"]), data)


def dec(exp: Experiment, n_clusters: int, settings: AutoencoderSettings = DEC_SETTINGS, constraints: DataFrame | None = None,
        weights: DataFrame | None = None, restarts: int = 20, checkpoint: str | None = None, resume: bool = False) -> LatentResult:
    """Autoencoder trained towards its own sharpened assignment.

    ``weights`` is a saved parameter table that takes the place of pretraining. ``resume`` goes on from the last state in
    ``checkpoint``.
    """
    N.assert_counts(exp.expr)
    data, cells = _training(exp)
    if weights is None:
        model = ae.pretrain(data, settings, checkpoint=checkpoint, resume=resume)
    else:
        model = ae.pretrain(data, replace(settings, pretrain_epochs=0), checkpoint=checkpoint, resume=resume)
        if not model.kept:
            model = ae.load_parameters(weights, model)
        model.settings = settings
    model = ae.fit_divergence(data, model, n_clusters, constraints, restarts)
    latent = ae.encode(data, model)
    found = soft.student_t_assign(latent, model.params["mu"], settings.alpha)
    labelled = found.select(F.col("id").alias("cell"), F.col("q").alias("p"),
                            (F.array_position("q", F.array_max("q")) - 1).alias("cluster"))
    return LatentResult(cells.join(labelled, "cell"), latent, model, n_clusters, data)


def scaled_metrics(result: LatentResult) -> DataFrame:
    """sil, chs and dbs of the clusters on the scaled input matrix."""
    points = ae.scaled(result.data).join(result.clusters.select(F.col("cell").alias("id"), F.col("cluster").alias("label")), "id")
    return metrics.unsupervised_metrics(points, None)


def latent_metrics(result: LatentResult) -> DataFrame:
    """sil, chs and dbs of the clusters in latent space."""
    points = result.latent.join(result.clusters.select(F.col("cell").alias("id"), F.col("cluster").alias("label")), "id")
    return metrics.unsupervised_metrics(points, None)


def score_files(truth: DataFrame, predicted: DataFrame) -> DataFrame:
    """acc, nmi, ari of two (barcode, label) tables matched by barcode."""
    pairs = metrics.align_labels(truth.select("barcode", F.col("label").alias("y_true")),
                                 predicted.select("barcode", F.col("label").alias("y_pred")), "barcode")
    return metrics.supervised_metrics(pairs)
