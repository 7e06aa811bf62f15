"""The data model: a sparse matrix in long form with keyed row and column tables."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame


@dataclass(frozen=True)
class Experiment:
    """A count matrix.

    expr:  (cell LONG, gene LONG, value DOUBLE), unique per (cell, gene), zeros omitted
    cells: (cell LONG, barcode STRING, ...)
    genes: (gene LONG, gene_id STRING, symbol STRING)
    raw:   the counts as they were before normalisation, once normalised
    """

    expr: DataFrame
    cells: DataFrame
    genes: DataFrame
    raw: DataFrame | None = None

    def with_(self, **changes) -> "Experiment":
        return replace(self, **changes)

    def transpose(self) -> "Experiment":
        """Swap rows and columns; free in long form."""
        flip = lambda df: df.selectExpr("gene AS cell", "cell AS gene", "value")
        cells = self.genes.selectExpr("gene AS cell", "symbol AS barcode")
        genes = self.cells.selectExpr("cell AS gene", "barcode AS gene_id", "barcode AS symbol")
        return Experiment(flip(self.expr), cells, genes, None if self.raw is None else flip(self.raw))
