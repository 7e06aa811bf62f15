"""Filtering and per-row normalisation of the long count matrix."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweave.config import BROADCAST_VALUES
from cellweave.model import Experiment
from cellweave.operators.keys import dense_index, grid, lookup_join
from cellweave.operators.quantile import exact_quantiles
from cellweave.session import cut, ship

# values of a dense batch
DENSE_VALUES = 1 << 20


def to_matrix(triples: DataFrame) -> DataFrame:
    """Sum duplicate (cell, gene) entries and drop zeros."""
    return (triples.groupBy("cell", "gene")
            .agg(F.sum("value").cast("double").alias("value"))
            .filter("value <> 0"))


def from_dense(rows: DataFrame, cell: str = "cell", values: str = "values") -> DataFrame:
    """Melt one array per cell to long form; position is the gene, zeros skipped."""
    return (rows.select(F.col(cell).cast("long").alias("cell"), F.posexplode(values).alias("gene", "value"))
            .select("cell", F.col("gene").cast("long"), F.col("value").cast("double"))
            .filter("value <> 0"))


def drop_sparse(expr: DataFrame, axis: str, min_counts: float = 1.0) -> DataFrame:
    """Drop rows or columns whose total is below ``min_counts``.

    Only the failing keys travel: for integer counts there are none, so the
    anti-join side is empty and the data is not shuffled for it.
    """
    failing = expr.groupBy(axis).agg(F.sum("value").alias("t")).filter(F.col("t") < min_counts).select(axis)
    return expr.join(failing, axis, "left_anti")


def drop_empty(expr: DataFrame, axis: str) -> DataFrame:
    """Keys of ``axis`` that keep at least one stored entry, densely renumbered."""
    keys = dense_index(expr.select(axis).distinct(), [axis], "_dense")
    other = "gene" if axis == "cell" else "cell"
    return (lookup_join(expr, keys, axis)
            .withColumn(axis, F.col("_dense")).drop("_dense").select("cell", "gene", "value"))


def cell_totals(expr: DataFrame) -> DataFrame:
    return expr.groupBy("cell").agg(F.sum("value").alias("n_counts"))


def median_depth(totals: DataFrame) -> float | None:
    return exact_quantiles(totals, "n_counts", [0.5])[0]


def size_factors(totals: DataFrame, median: float | None = None) -> DataFrame:
    median = median_depth(totals) if median is None else median
    return totals.withColumn("size_factor", F.col("n_counts") / F.lit(median))


def scale_depth(expr: DataFrame, totals: DataFrame, median: float, log: bool = True,
                n_cells: int | None = None) -> DataFrame:
    """value * median / n_counts, then ln(1 + x) when ``log``."""
    value = F.col("value") * (F.lit(median) / F.col("n_counts"))
    return (lookup_join(expr, totals.select("cell", "n_counts"), "cell", n_cells)
            .select("cell", "gene", (F.log1p(value) if log else value).alias("value")))


def normalize(exp: Experiment, filter_min_counts: bool = True, size_factor: bool = True,
              log: bool = True, scale: bool = False) -> Experiment:
    """Filter, depth-normalise and log-transform; ``cells`` gains n_counts and size_factor.

    With ``scale`` the matrix is z-scored by gene, and dense.

    The matrix is materialised once. Where nothing fails a filter, which is the rule
    for counts, no join is planned for it; dropped cells leave through the join that
    brings each entry its depth.
    """
    expr = cut(exp.expr)
    if filter_min_counts:
        failing = expr.groupBy("gene").agg(F.sum("value").alias("t")).filter("t < 1").select("gene")
        if not failing.isEmpty():
            expr = cut(expr.join(failing, "gene", "left_anti"))
    totals = cut(cell_totals(expr))
    kept = totals.filter("n_counts >= 1") if filter_min_counts else totals
    n_kept = kept.count()
    raw = expr
    if n_kept < totals.count():
        raw = lookup_join(expr, kept.select("cell"), "cell", n_kept, "left_semi")
    if size_factor:
        median = median_depth(kept)
        kept = size_factors(kept, median)
        norm = scale_depth(expr, kept, median, log, n_kept)
    else:
        kept = kept.withColumn("size_factor", F.lit(1.0))
        norm = raw.withColumn("value", F.log1p("value")) if log else raw
    cells = exp.cells.join(kept, "cell", "inner" if filter_min_counts else "left")
    if scale:
        scaled = cut(scale_genes(cut(norm), cells.count()))
        genes = scaled.groupBy("gene").agg(F.max("z_zero").alias("zero"))
        norm = densify(scaled.select("cell", "gene", F.col("z").alias("value")), cells, genes, "zero")
    return exp.with_(expr=norm, cells=cells, raw=raw)


def assert_counts(expr: DataFrame) -> None:
    """Raise unless all values are whole numbers."""
    if expr.filter(F.col("value") != F.floor("value")).limit(1).count():
        raise ValueError("the matrix must hold unnormalised integer counts")


def column_moments(expr: DataFrame, n_cells: int) -> DataFrame:
    """Per gene mean and centred sum of squares over all cells, zeros included.

    The second pass centres on the mean, so large means do not cancel.
    """
    stored = expr.groupBy("gene").agg(
        F.count("*").alias("nnz"), F.sum("value").alias("s1"),
        F.avg("value").alias("m_nz"), (F.var_pop("value") * F.count("*")).alias("ss_nz"))
    mean = F.col("s1") / F.lit(n_cells)
    zeros = F.lit(n_cells) - F.col("nnz")
    # merge the stored part with the block of zeros (parallel variance formula)
    spread = F.col("ss_nz") + F.col("m_nz") * F.col("m_nz") * F.col("nnz") * zeros / F.lit(n_cells)
    return stored.select("gene", mean.alias("mean"), spread.alias("ss"), "nnz")


def scale_genes(expr: DataFrame, n_cells: int) -> DataFrame:
    """Per-gene z-score with sample deviation, in sparse-affine form.

    Returns (cell, gene, z, z_zero): every stored entry with its z and the z that
    each absent entry of the gene takes. ``densify`` turns it into the dense grid.
    """
    moments = column_moments(expr, n_cells)
    deviation = F.sqrt(F.col("ss") / F.lit(max(n_cells - 1, 1)))
    stats = moments.select("gene", "mean",
                           F.when(deviation == 0, 1.0).otherwise(deviation).alias("sd"))
    return lookup_join(expr, cut(stats), "gene").select(
        "cell", "gene", ((F.col("value") - F.col("mean")) / F.col("sd")).alias("z"),
        (-F.col("mean") / F.col("sd")).alias("z_zero"))


def densify(expr: DataFrame, cells: DataFrame, genes: DataFrame, fill="0") -> DataFrame:
    """The full (cell, gene, value) grid; ``fill`` is 0 or a column of ``genes``.

    Entries are packed once, one row per cell, and the absent ones are filled in where the cell is: the genes, whose
    number is checked, go to every task. For more genes than that the grid is made by a join.
    """
    cols = cut(genes.select(F.col("gene").cast("long").alias("gene"), F.expr(str(fill)).cast("double").alias("_fill")))
    n = cols.count()
    if n > BROADCAST_VALUES:
        full = grid(cells.select("cell"), cols, ["cell"])
        return (full.join(expr.select("cell", "gene", "value"), ["cell", "gene"], "left")
                .select("cell", "gene", F.coalesce("value", "_fill").alias("value")))
    def melt(ids, _own, table, dense):
        names = table["gene"].to_numpy()
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(ids, len(names))), pa.array(np.tile(names, len(ids))), pa.array(dense.ravel())], ["cell", "gene", "value"])

    return dense_blocks(expr, cells.select("cell"), cols, melt, "cell long, gene long, value double")


def dense_blocks(expr: DataFrame, cells: DataFrame, genes: DataFrame, emit, schema: str) -> DataFrame:
    """The full grid in the tasks, some cells at a time: ``emit(ids, own, genes, dense)`` yields record batches.

    ``own`` has the other columns of ``cells``, which are doubles, ``genes`` the columns of ``genes`` in order of ``gene``;
    absent entries are its ``_fill``. The genes, whose number the caller has checked, go to every task.
    """
    table = genes.orderBy("gene").toPandas()
    names, empty = table["gene"].to_numpy(), table["_fill"].to_numpy()
    n, carried = len(names), [c for c in cells.columns if c != "cell"]
    entry = F.collect_list(F.struct(F.col("gene").cast("long").alias("gene"), F.col("value").cast("double").alias("value"))).alias("e")
    packed = cells.select(F.col("cell").cast("long").alias("cell"), *carried).join(
        expr.groupBy(F.col("cell").cast("long").alias("cell")).agg(entry), "cell", "left").select(
        "cell", F.coalesce(F.col("e.gene"), F.array().cast("array<long>")).alias("genes"),
        F.coalesce(F.col("e.value"), F.array().cast("array<double>")).alias("values"), *carried)

    def spread(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, max(1, DENSE_VALUES // max(1, n))):
                part = batch.slice(lo, max(1, DENSE_VALUES // max(1, n)))
                found, values = part.column(1).flatten().to_numpy(), part.column(2).flatten().to_numpy()
                owner = np.repeat(np.arange(part.num_rows), part.column(1).value_lengths().to_numpy())
                slot = np.minimum(np.searchsorted(names, found), n - 1) if n else np.zeros(0, int)
                dense = np.tile(empty, (part.num_rows, 1))
                mine = names[slot] == found if n else np.zeros(0, bool)
                dense[owner[mine], slot[mine]] = values[mine]
                yield from emit(part.column(0).to_numpy(), {c: part.column(c).to_numpy() for c in carried}, table, dense)

    ship(expr.sparkSession)
    return packed.mapInArrow(spread, schema)


def at_least(expr: DataFrame, minimum: float) -> DataFrame:
    return expr.filter(F.col("value") >= minimum)


def zero_fraction(expr: DataFrame) -> DataFrame:
    """Share of zeros in the matrix spanned by the cells and genes present."""
    cells = expr.select("cell").distinct().agg(F.count("*").alias("nc"))
    genes = expr.select("gene").distinct().agg(F.count("*").alias("ng"))
    stored = expr.filter("value <> 0").agg(F.count("*").alias("nnz"))
    one = F.lit(1.0)
    return stored.select((one - F.col("nnz") / (cells.scalar() * genes.scalar())).alias("zero_fraction"))


def dedup_symbols(genes: DataFrame) -> DataFrame:
    """First gene of every symbol; a plain minimum, so hot symbols combine map-side."""
    return genes.groupBy("symbol").agg(F.min("gene").alias("gene"))
