"""Annotating rows by their correlation to a reference atlas."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweave.model import Experiment
from cellweave.operators.distribution import automatic_histogram, density_curve
from cellweave.operators.keys import dense_index, lookup_join, may_broadcast
from cellweave.operators.normalize import dedup_symbols
from cellweave.operators.similarity import best_match, cross_pearson
from cellweave.session import cut

PROFILE = ["tissue", "type", "cluster"]


def atlas_mean(atlas: DataFrame) -> DataFrame:
    """Mean read count per (tissue, type, cluster) profile and gene symbol."""
    return atlas.groupBy(*PROFILE, "symbol").agg(F.avg("read_count").alias("mean"))


def complete_symbols(means: DataFrame, n_profiles: int) -> DataFrame:
    """Symbols measured in every profile; others would leave correlations undefined."""
    return means.groupBy("symbol").count().filter(F.col("count") == n_profiles).select("symbol")


def shared_genes(left: DataFrame, right: DataFrame) -> DataFrame:
    """Distinct symbols that both sides have."""
    return left.select("symbol").distinct().join(right.select("symbol").distinct(), "symbol", "left_semi")


@dataclass
class Prepared:
    """What annotation takes from an atlas, whatever the experiment: profile means, numbered profiles, complete symbols."""

    means: DataFrame
    profiles: DataFrame
    n_profiles: int
    symbols: DataFrame


def prepare(atlas: DataFrame) -> Prepared:
    """Average and number an atlas once, for any number of experiments or chunks."""
    means = cut(atlas_mean(atlas))
    profiles = cut(dense_index(means.select(*PROFILE).distinct(), PROFILE, "profile"))
    count = profiles.count()
    return Prepared(means, profiles, count, cut(complete_symbols(means, count)))


class Matching:
    """Atlas profiles and experiment rows brought to the same numbered columns."""

    def __init__(self, exp: Experiment, atlas: DataFrame | Prepared):
        ready = atlas if isinstance(atlas, Prepared) else prepare(atlas)
        means, self.profiles, self.n_profiles = ready.means, ready.profiles, ready.n_profiles
        symbols = dedup_symbols(exp.genes)
        common = shared_genes(ready.symbols, symbols)
        common = cut(dense_index(common, ["symbol"], "column"))
        self.n_genes = common.count()
        wanted = cut(symbols.join(common, "symbol").select("gene", "column"))
        self.cells = cut(exp.cells)
        self.n_cells = self.cells.count()
        self.expr = cut(lookup_join(exp.expr, wanted, "gene", self.n_genes)
                        .select("cell", F.col("column").alias("gene"), "value"))
        known = lookup_join(means, common, "symbol", self.n_genes)
        named = F.broadcast(self.profiles) if may_broadcast(self.profiles, self.n_profiles) else self.profiles
        self.atlas = (known.join(named, PROFILE)
                      .select(F.col("profile").alias("cell"), F.col("column").alias("gene"), F.col("mean").alias("value"))
                      .filter("value <> 0"))
        self.atlas_rows = self.profiles.select(F.col("profile").alias("cell"))

    def _sides(self):
        return (self.expr, self.atlas, self.n_cells, self.n_profiles, self.n_genes,
                self.cells.select("cell"), self.atlas_rows)

    def correlations(self) -> DataFrame:
        """(cell, profile, tissue, type, cluster, r) for all combinations."""
        pairs = cross_pearson(*self._sides()).select(F.col("i").alias("cell"), F.col("j").alias("profile"), "r")
        return lookup_join(pairs, self.profiles, "profile", self.n_profiles)

    def best(self) -> DataFrame:
        """(cell, tissue, type, max_corr); rows without a defined correlation get NULLs."""
        found = best_match(*self._sides()).select(F.col("i").alias("cell"), F.col("j").alias("profile"), "r")
        named = lookup_join(found, self.profiles, "profile", self.n_profiles)
        return self.cells.join(named.select("cell", "tissue", "type", F.col("r").alias("max_corr")), "cell", "left")


def annotate(exp: Experiment, atlas: DataFrame | Prepared) -> DataFrame:
    """(barcode, tissue, type, max_corr): the best profile of each row, counts as given; ``atlas`` as read or prepared."""
    return Matching(exp, atlas).best().select("barcode", "tissue", "type", "max_corr")


def tissue_counts(annotated: DataFrame) -> DataFrame:
    return annotated.groupBy("tissue").agg(F.count("*").alias("n"))


def max_corr_histogram(annotated: DataFrame, bins: int = 20) -> DataFrame:
    """Rows per equal-width bin of [0, 1]; 0 is below and bins + 1 at or above the range."""
    return (annotated.filter("max_corr IS NOT NULL")
            .groupBy(F.expr(f"width_bucket(max_corr, 0D, 1D, {bins})").alias("bin")).agg(F.count("*").alias("n")))


def max_corr_bins(annotated: DataFrame) -> DataFrame:
    """(bin, low, high, n): the histogram of the best correlations in automatic bins."""
    return automatic_histogram(annotated, "max_corr")


def max_corr_density(annotated: DataFrame, points: int = 200) -> DataFrame:
    """(x, density): the curve over that histogram."""
    return density_curve(annotated, "max_corr", points)
