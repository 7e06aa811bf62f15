"""Seeing a star schema as count matrices, atlases and latent vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.model import Experiment
from cellweave.operators.keys import dense_index, lookup_join
from cellweave.operators.normalize import to_matrix
from cellweave.session import cut


class Tables:
    """Parquet tables of one folder, read lazily."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def supplier_matrix(t: Tables) -> DataFrame:
    """Suppliers x parts, total quantity."""
    return to_matrix(t.lineitem.select(F.col("l_suppkey").alias("cell"), F.col("l_partkey").alias("gene"),
                                       F.col("l_quantity").alias("value")))


def supplier_experiment(t: Tables) -> Experiment:
    expr = supplier_matrix(t)
    cells = t.supplier.select(F.col("s_suppkey").alias("cell"), F.col("s_name").alias("barcode"))
    genes = t.part.select(F.col("p_partkey").alias("gene"), F.col("p_partkey").cast("string").alias("gene_id"),
                          F.col("p_name").alias("symbol"))
    return Experiment(expr, cells, genes)


def _lines(t: Tables) -> DataFrame:
    line = t.lineitem.select("l_orderkey", "l_partkey", "l_quantity")
    order = t.orders.select("o_orderkey", "o_custkey", "o_orderstatus")
    part = t.part.select("p_partkey", "p_name")
    return (line.join(order, line.l_orderkey == order.o_orderkey).join(part, line.l_partkey == part.p_partkey)
            .select("o_custkey", "o_orderstatus", "p_name", "l_quantity"))


def customer_experiment(t: Tables) -> Experiment:
    """Customers x part names, total quantity."""
    names = dense_index(t.part.select(F.col("p_name").alias("symbol")).distinct(), ["symbol"], "gene")
    genes = names.select("gene", F.col("symbol").alias("gene_id"), "symbol")
    lines = _lines(t).groupBy(F.col("o_custkey").alias("cell"), F.col("p_name").alias("symbol")).agg(
        F.sum("l_quantity").alias("value"))
    expr = cut(lookup_join(lines, names, "symbol").select("cell", "gene", "value").filter("value <> 0"))
    cells = expr.select("cell").distinct().withColumn("barcode", F.col("cell").cast("string"))
    return Experiment(expr, cells, genes)


def order_atlas(t: Tables) -> DataFrame:
    """Atlas rows: region, market segment and order status as profile, part name as gene."""
    region = (t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
              .join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
              .select(F.col("c_custkey"), F.col("r_name").alias("tissue"), F.col("c_mktsegment").alias("type")))
    lines = _lines(t)
    return lines.join(region, lines.o_custkey == region.c_custkey).select(
        F.col("p_name").alias("symbol"), "tissue", "type", F.col("o_orderstatus").alias("cluster"),
        F.col("l_quantity").alias("read_count"))


def latent_points(t: Tables) -> DataFrame:
    return t.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("z"),
                               F.col("label").cast("long").alias("label"))
