"""Reading matrices, ids, labels, atlases and edge lists from files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cellweave.config import GZIP_SCHEMES
from cellweave.model import Experiment
from cellweave.session import ship
from cellweave.sources.gzip_lines import RANGE_BYTES, GzipLines

# File names of an experiment and column names of the atlas.
MATRIX_FILE, BARCODE_FILE = "matrix.mtx", "barcodes.tsv"
GENE_FILES = ("features.tsv", "genes.tsv")
ATLAS_COLUMNS = {"Gene name": "symbol", "Tissue": "tissue", "Cell type": "type", "Cluster": "cluster",
                 "Read count": "read_count"}


def find_files(spark: SparkSession, location: str) -> tuple[str, str, str]:
    """(matrix, barcodes, genes) under a folder, or a path prefix, on any file system."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    found: list[str] = []
    for pattern in (location.rstrip("/") + "/*", location + "*"):
        path = jvm.org.apache.hadoop.fs.Path(pattern)
        found += [s.getPath().toString() for s in (path.getFileSystem(conf).globStatus(path) or [])]
    pick = lambda name: next((f for f in sorted(found) if name in f.rsplit("/", 1)[-1]), None)
    chosen = (pick(MATRIX_FILE), pick(BARCODE_FILE), pick(GENE_FILES[0]) or pick(GENE_FILES[1]))
    for what, path in zip(("matrix", "barcodes", "features"), chosen):
        if path is None:
            raise FileNotFoundError(f"no {what} file at {location}")
    return chosen


def text_lines(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(value, _file, _split, _row): lines in the order of ``_row`` within a split of a file.

    A gzip file on a file system of ``GZIP_SCHEMES`` is split at its members, any other is one task, as Spark reads it.
    """
    row = F.monotonically_increasing_id().alias("_row")
    if path.endswith(".gz"):
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        system = where.getFileSystem(spark._jsc.hadoopConfiguration())
        full = system.makeQualified(where)
        if full.toUri().getScheme() in GZIP_SCHEMES and system.exists(where) and system.getFileStatus(where).isFile():
            ship(spark).dataSource.register(GzipLines)
            return spark.read.format("gzip_lines").option("rangeBytes", range_bytes).load(full.toString()).select(
                "value", F.lit(full.toString()).alias("_file"), F.col("start").alias("_split"), row)
    return spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_split"), row)


def numbered_lines(spark: SparkSession, path: str, name: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(name LONG, value): lines with their 0-based number; of a folder, files follow one another by path.

    Lines are counted per file split; a split's rows get their number from the
    splits before it, so splits are numbered in parallel.
    """
    lines = text_lines(spark, path, range_bytes)
    counts = sorted((r["_file"], r["_split"], r["count"]) for r in lines.groupBy("_file", "_split").count().collect())
    starts, total = [], 0
    for file, split, count in counts:
        starts.append((file, split, total))
        total += count
    offsets = spark.createDataFrame(starts or [("", 0, 0)], "_file string, _split long, _start long")
    within = F.row_number().over(Window.partitionBy("_file", "_split").orderBy("_row"))
    return (lines.withColumn("_n", within).join(F.broadcast(offsets), ["_file", "_split"])
            .select((F.col("_start") + F.col("_n") - 1).alias(name), "value"))


def read_barcodes(spark: SparkSession, path: str) -> DataFrame:
    """(cell, barcode): first tab field of every line."""
    return numbered_lines(spark, path, "cell").select(
        "cell", F.substring_index("value", "\t", 1).alias("barcode"))


def read_genes(spark: SparkSession, path: str) -> DataFrame:
    """(gene, gene_id, symbol); a file with one field uses it as the symbol."""
    fields = F.split("value", "\t")
    return numbered_lines(spark, path, "gene").select(
        "gene", F.get(fields, F.lit(0)).alias("gene_id"),
        F.coalesce(F.get(fields, F.lit(1)), F.get(fields, F.lit(0))).alias("symbol"))


def read_ids(spark: SparkSession, path: str, name: str = "cell") -> DataFrame:
    """(name, id): the text before the first blank, if any comes after the start."""
    return numbered_lines(spark, path, name).select(
        name, F.when(F.instr("value", " ") > 1, F.substring_index("value", " ", 1)).otherwise(F.col("value")).alias("id"))


def read_mtx(spark: SparkSession, path: str, integer: bool = False, check: bool = True) -> DataFrame:
    """(cell, gene, value) of a genes x cells coordinate file, plain or gzipped.

    The first line that is no comment gives the dimensions. It is told apart from
    an entry of the same text by counting, so one pass over the file is enough.
    Duplicate entries are summed; ``integer`` rejects other than whole numbers.
    ``check`` reads the file once more, to raise unless it has as many entries as
    its dimensions say, all of them inside.
    """
    lines = text_lines(spark, path).select(F.trim("value").alias("line")).filter("line <> '' AND NOT startswith(line, '%')")
    head = lines.first()
    if head is None:
        raise ValueError(f"{path} has no dimensions line")
    size = head["line"]
    fields = F.split("line", "\\s+")
    if check:
        told = size.split()
        if len(told) != 3 or not all(x.isdigit() for x in told):
            raise ValueError(f"{path} has no dimensions line, but {size[:80]!r}")
        genes, cells, n = map(int, told)
        place = [F.get(fields, F.lit(k)).try_cast("long") for k in (0, 1)]
        inside = place[0].between(1, genes) & place[1].between(1, cells)
        found = lines.agg(F.count("*").alias("n"), F.count_if(~F.coalesce(inside, F.lit(False)) & (F.col("line") != size)).alias("out")).first()
        if found.n - 1 != n:
            raise ValueError(f"{path} has {found.n - 1} entries where its dimensions say {n}")
        if found.out:
            raise ValueError(f"{found.out} entries of {path} lie outside its {genes} x {cells}")
    number = F.get(fields, F.lit(2))
    entries = lines.select(
        (F.get(fields, F.lit(1)).cast("long") - 1).alias("cell"), (F.get(fields, F.lit(0)).cast("long") - 1).alias("gene"),
        (number.cast("int").cast("double") if integer else number.cast("double")).alias("value"),
        (F.col("line") == size).alias("like_size"))
    summed = entries.groupBy("cell", "gene").agg(
        F.sum(F.when(~F.col("like_size"), F.col("value"))).alias("plain"),
        F.count_if("like_size").alias("alike"), F.max(F.when(F.col("like_size"), F.col("value"))).alias("of_alike"))
    repeats = F.greatest(F.col("alike") - 1, F.lit(0))
    value = F.coalesce("plain", F.lit(0.0)) + F.when(repeats > 0, repeats * F.col("of_alike")).otherwise(0.0)
    return summed.select("cell", "gene", value.alias("value")).filter("value <> 0")


def load_experiment(spark: SparkSession, location: str, integer: bool = False) -> Experiment:
    matrix, barcodes, genes = find_files(spark, location)
    return Experiment(read_mtx(spark, matrix, integer), read_barcodes(spark, barcodes), read_genes(spark, genes))


def read_triples(spark: SparkSession, path: str) -> DataFrame:
    """(cell, gene, value) from ``cell gene count`` lines."""
    fields = F.split(F.trim("value"), "\\s+")
    return spark.read.text(path).filter("trim(value) <> ''").select(
        F.get(fields, F.lit(0)).cast("long").alias("cell"), F.get(fields, F.lit(1)).cast("long").alias("gene"),
        F.get(fields, F.lit(2)).cast("double").alias("value"))


def read_edges(spark: SparkSession, path: str) -> DataFrame:
    """(i, j, weight) from ``v1 v2 w`` lines; blanks at the line end do not matter."""
    return read_triples(spark, path).select(F.col("cell").alias("i"), F.col("gene").alias("j"),
                                            F.col("value").alias("weight"))


def read_labels(spark: SparkSession, path: str, header: bool = True, key: int = 0, label: int = 1) -> DataFrame:
    """(barcode, label) of a CSV by column position, with or without a header line."""
    table = spark.read.csv(path, header=header)
    return table.select(F.col(f"`{table.columns[key]}`").alias("barcode"), F.col(f"`{table.columns[label]}`").alias("label"))


def read_atlas(spark: SparkSession, path: str) -> DataFrame:
    """(symbol, tissue, type, cluster, read_count) of a tab-separated atlas with a header."""
    table = spark.read.csv(path, header=True, sep="\t")
    columns = [F.col(f"`{old}`").alias(new) for old, new in ATLAS_COLUMNS.items()]
    return table.select(columns).withColumn("read_count", F.col("read_count").cast("double"))


def read_gene_list(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.trim("value").alias("symbol")).filter("symbol <> ''").distinct()


def read_dense(spark: SparkSession, path: str, cell: str = "cell", x: str = "X", y: str = "Y") -> tuple[DataFrame, DataFrame]:
    """Long matrix and labels from a parquet table with an array column X and a column Y."""
    from cellweave.operators.normalize import from_dense

    table = spark.read.parquet(path)
    return from_dense(table, cell, x), table.select(F.col(cell).alias("cell"), F.col(y).cast("double").alias("label"))
