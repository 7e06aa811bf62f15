"""Key handling: skew-safe lookups and dense numbering."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from cellweave.config import BROADCAST_VALUES, GRID_SLICES
from cellweave.session import cut


def may_broadcast(df: DataFrame, rows: int) -> bool:
    """Whether a counted table is small enough, arrays at their longest included."""
    arrays = [f.name for f in df.schema if isinstance(f.dataType, ArrayType)]
    strings = [f.name for f in df.schema if isinstance(f.dataType, StringType)]
    # a string weighs as many values as its longest has eight bytes
    values = len(df.columns)
    if rows * values > BROADCAST_VALUES:
        return False
    if (arrays or strings) and rows:
        longest = df.agg(*[F.max(F.size(c)).alias(c) for c in arrays], *[F.max(F.octet_length(c) / 8).alias(c) for c in strings]).first()
        values += sum(longest[c] or 0 for c in (*arrays, *strings))
    return rows * values <= BROADCAST_VALUES


def lookup_join(big: DataFrame, small: DataFrame, on: str, small_rows: int | None = None, how: str = "inner") -> DataFrame:
    """Join ``big`` to ``small``, whose ``on`` values are unique.

    A small side of checked size is broadcast. A larger one is shuffled as it is: a key that holds a large share of
    ``big`` makes one large partition of that side, which adaptive execution splits and meets with the one row of
    ``small`` in every piece. Nothing is copied for keys that aren't hot.
    """
    if small_rows is None:
        small_rows = small.count()
    if may_broadcast(small, small_rows):
        return big.join(F.broadcast(small), on, how)
    return big.join(small, on, how)


def dense_index(df: DataFrame, keys: list[str], name: str, parts: int | None = None) -> DataFrame:
    """Add ``name`` = 0-based position of the row in ``keys`` order (keys unique).

    Range partitioning gives the order between partitions, a per-partition count
    gives each one its offset; no single task sees all rows.
    """
    spark = df.sparkSession
    ranged = df.repartitionByRange(parts, *keys) if parts else df.repartitionByRange(*keys)
    tagged = cut(ranged.withColumn("_part", F.spark_partition_id()))
    counts = {r["_part"]: r["count"] for r in tagged.groupBy("_part").count().collect()}
    offsets, total = [], 0
    for part in sorted(counts):
        offsets.append((part, total))
        total += counts[part]
    start = spark.createDataFrame(offsets or [(0, 0)], "_part int, _start long")
    order = Window.partitionBy("_part").orderBy(*keys)
    return (tagged.withColumn("_pos", F.row_number().over(order))
            .join(F.broadcast(start), "_part")
            .withColumn(name, F.col("_start") + F.col("_pos") - F.lit(1))
            .drop("_part", "_pos", "_start"))


def grid(rows: DataFrame, cols: DataFrame, salt_by: list[str]) -> DataFrame:
    """Every (row, column) combination, for operators whose result is dense.

    The column table is copied to a fixed number of slices and met by hash-spread
    rows, so each task produces its own slice of the dense result.
    """
    slices = GRID_SLICES
    spread = rows.withColumn("_salt", F.pmod(F.xxhash64(*salt_by), F.lit(slices)).cast("int"))
    copies = cols.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
    return spread.join(copies, "_salt").drop("_salt")
