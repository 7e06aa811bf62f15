"""Writing results. Every writer makes a folder of part files; nothing is gathered."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellweave.operators.normalize import densify


def write_csv(df: DataFrame, path: str, sep: str = ",", header: bool = True) -> None:
    df.write.mode("overwrite").csv(path, sep=sep, header=header)


def write_clusters(result: DataFrame, path: str) -> None:
    """CSV of barcode, n_counts (when present) and cluster."""
    columns = [c for c in ("barcode", "n_counts", "size_factor", "cluster") if c in result.columns]
    write_csv(result.select(columns), path)


def write_probabilities(result: DataFrame, path: str, n_clusters: int) -> None:
    """As ``write_clusters``, with one column prob_cluster<i> per cluster from the array ``p``."""
    probabilities = [F.get("p", F.lit(c)).alias(f"prob_cluster{c}") for c in range(n_clusters)]
    columns = [c for c in ("barcode", "n_counts", "size_factor", "cluster") if c in result.columns]
    write_csv(result.select(*columns, *probabilities), path)


def write_latent(latent: DataFrame, path: str, width: int) -> None:
    write_csv(latent.select("id", *[F.get("z", F.lit(c)).alias(str(c)) for c in range(width)]), path)


def fixed_number(value: Column, decimals: int) -> Column:
    return F.call_function("format_number", value, F.lit("0." + "0" * decimals))


def short_number(value: Column) -> Column:
    """At most four decimals, half to even, at least one."""
    text = F.rtrim(fixed_number(F.bround(value, 4), 4), F.lit("0"))
    return F.when(F.endswith(text, F.lit(".")), F.concat(text, F.lit("0"))).otherwise(text)


def write_matrix(expr: DataFrame, cells: DataFrame, genes: DataFrame, path: str, decimals: int | None = None,
                 transposed: bool = False) -> None:
    """Dense tab-separated rows, led by the row key: one line per cell, or per gene."""
    value = F.col("value").cast("string") if decimals is None else fixed_number(F.col("value"), decimals)
    row, col = ("gene", "cell") if transposed else ("cell", "gene")
    line = F.array_sort(F.collect_list(F.struct(F.col(col).alias("k"), value.alias("v"))))
    rows = densify(expr, cells, genes).groupBy(row).agg(line.alias("e"))
    rows.select(F.concat_ws("\t", F.col(row).cast("string"), F.col("e.v")).alias("value")).write.mode("overwrite").text(path)


def write_similarity(pairs: DataFrame, path: str) -> None:
    """Lines i, j, r with the short number format; the matrix stays in pair form."""
    write_csv(pairs.select("i", "j", short_number(F.col("r")).alias("r")), path, "\t", False)


def write_graph(edges: DataFrame, path: str) -> None:
    """Lines v1, v2, weight, or v1, v2, correlation, cost of a graph that has costs 1 - r."""
    columns = ["weight"] if "weight" in edges.columns else [(1.0 - F.col("cost")).alias("r"), "cost"]
    write_csv(edges.select("i", "j", *columns), path, "\t", False)


def write_losses(spark, losses: list[float], path: str) -> None:
    """Round and mean loss, in order of training."""
    write_csv(spark.createDataFrame(list(enumerate(losses)), "round int, loss double").coalesce(1), path)


def write_cluster_lines(result: DataFrame, path: str) -> None:
    """Lines index, barcode, cluster."""
    write_csv(result.select("cell", "barcode", "cluster"), path, "\t", False)
