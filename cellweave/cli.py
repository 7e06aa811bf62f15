"""Command line: one sub-command per method."""

from __future__ import annotations

import argparse
from dataclasses import replace

from cellweave.config import DEC_SETTINGS, GMM_SETTINGS
from cellweave.operators import annotate as A
from cellweave.operators.autoencoder import parameter_table
from cellweave.plans import methods
from cellweave.session import cut, get_spark, release
from cellweave.sources import readers, writers


# Names of the sub-commands and options, and their defaults.
def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="cellweave")
    sub = top.add_subparsers(dest="method", required=True)

    def method(name: str) -> argparse.ArgumentParser:
        p = sub.add_parser(name, formatter_class=argparse.ArgumentDefaultsHelpFormatter)
        p.add_argument("path_input")
        p.add_argument("path_results")
        return p

    p = method("kmst")
    p.add_argument("--filter", default="variance", choices=["variance", "mean-variance", "none"])
    p.add_argument("--weight", default="cost", choices=["cost", "correlation"])
    method("kmst-union")
    p = method("ae-gmm")
    p.add_argument("--n_clusters", type=int, default=0, help="0 estimates the number")
    p.add_argument("--resume", action="store_true", help="go on from the checkpoints in the results folder")
    p = method("correlations")
    p.add_argument("--atlas", required=True)
    p = method("scdcc")
    p.add_argument("--n_clusters", type=int, required=True)
    p.add_argument("--batch_size", type=int, default=256)
    p.add_argument("--maxiter", type=int, default=2000)
    p.add_argument("--pretrain_epochs", type=int, default=300)
    p.add_argument("--gamma", type=float, default=1.0)
    p.add_argument("--update_interval", type=int, default=1)
    p.add_argument("--tol", type=float, default=0.001)
    p.add_argument("--ae_weights", default=None, help="parameter table that replaces pretraining")
    p.add_argument("--ae_weight_file", default="ae_weights")
    p.add_argument("--resume", action="store_true", help="go on from the checkpoints in the results folder")
    p = sub.add_parser("metrics")
    p.add_argument("gs_labels")
    p.add_argument("test_labels")
    p.add_argument("--no_header", action="store_true")
    p.add_argument("--truth_column", type=int, default=1)
    p.add_argument("--test_column", type=int, default=1)
    return top


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    spark = get_spark()
    if args.method == "metrics":
        truth = readers.read_labels(spark, args.gs_labels, not args.no_header, label=args.truth_column)
        tested = readers.read_labels(spark, args.test_labels, not args.no_header, label=args.test_column)
        row = methods.score_files(truth, tested).first()
        print(f"ACC: {row['acc']} NMI: {row['nmi']} ARI: {row['ari']}")
        return
    exp = readers.load_experiment(spark, args.path_input)
    out = lambda name: f"{args.path_results.rstrip('/')}/{name}"
    if args.method == "kmst":
        writers.write_clusters(methods.kmst(exp, args.filter, weight=args.weight), out("clusters.csv"))
    elif args.method == "kmst-union":
        result = methods.kmst_union(exp)
        cells = result.clusters.select("cell")
        genes = result.normalized.select("gene").distinct()
        writers.write_matrix(result.normalized, cells, genes, out("matrix.tsv"))
        writers.write_matrix(result.counts, cells, genes, out("counts.tsv"))
        writers.write_similarity(result.similarity.pairs(), out("similarity.tsv"))
        writers.write_csv(result.similarity.histogram(), out("histogram.csv"))
        writers.write_graph(result.edges, out("graph.tsv"))
        writers.write_cluster_lines(result.clusters, out("clusters.tsv"))
    elif args.method == "correlations":
        found = cut(A.annotate(exp, readers.read_atlas(spark, args.atlas)))
        writers.write_csv(found, out("results.csv"))
        writers.write_csv(A.tissue_counts(found), out("tissue_counts.csv"))
        writers.write_csv(A.max_corr_histogram(found), out("max_corr_histogram.csv"))
        writers.write_csv(A.max_corr_bins(found), out("max_corr_bins.csv"))
        writers.write_csv(A.max_corr_density(found), out("max_corr_density.csv"))
    elif args.method == "ae-gmm":
        result = methods.ae_gmm(exp, args.n_clusters, GMM_SETTINGS, checkpoint=out("checkpoints"), resume=args.resume)
        writers.write_clusters(result.clusters, out("gmm_clusters.csv"))
        writers.write_probabilities(result.clusters, out("gmm_clusters_prob.csv"), result.n_clusters)
        writers.write_latent(result.latent, out("Z.csv"), GMM_SETTINGS.latent)
        parameter_table(spark, result.model).write.mode("overwrite").parquet(out("model"))
        writers.write_losses(spark, result.model.losses, out("losses.csv"))
        print(methods.scaled_metrics(result).first().asDict())
    else:
        settings = replace(DEC_SETTINGS, batch_size=args.batch_size, epochs=args.maxiter, gamma=args.gamma, tol=args.tol,
                           pretrain_epochs=args.pretrain_epochs, update_interval=args.update_interval)
        weights = spark.read.parquet(args.ae_weights) if args.ae_weights else None
        result = methods.dec(exp, args.n_clusters, settings, weights=weights, checkpoint=out("checkpoints"), resume=args.resume)
        parameter_table(spark, result.model).write.mode("overwrite").parquet(out(args.ae_weight_file))
        writers.write_losses(spark, result.model.losses, out("losses.csv"))
        writers.write_clusters(result.clusters.drop("size_factor"), out("scdcc_clusters.csv"))
    release(spark)


if __name__ == "__main__":
    main()
