"""Session helpers: building a session and cutting lineage safely."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def get_spark(app: str = "cellweave", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators rely on; cluster settings win."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return ship(builder.getOrCreate())


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the Python workers, once per application.

    Spark distributes the archive itself, so the package need not be installed on
    the executors, nor the driver be started from its folder.
    """
    context = spark.sparkContext
    if getattr(context, "_cellweave_shipped", False):
        return spark
    package = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="cellweave-code-")) / "cellweave.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for source in sorted(package.rglob("*.py")):
            out.write(source, source.relative_to(package.parent))
    context.addPyFile(str(archive))
    context._cellweave_shipped = True
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by the cluster.

    Only a local session, where driver and executors share one machine, may fall
    back to a temporary folder of its own.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if configured:
        if not current:
            context.setCheckpointDir(configured)
        return configured
    if current:
        return current
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
    folder = tempfile.mkdtemp(prefix="cellweave-")
    context.setCheckpointDir(folder)
    return context.getCheckpointDir() or folder


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` once as a table in the shared folder and read it back.

    Iterative operators call this each round: the plan stays short, lost executors
    re-read files instead of replaying the rounds, and the optimizer knows the size.
    The table stays until ``release``.
    """
    spark = ship(df.sparkSession)
    path = f"{shared_dir(spark).rstrip('/')}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _tables(spark).append(path)
    return spark.read.schema(df.schema).parquet(path)


def _tables(spark: SparkSession) -> list[str]:
    context = spark.sparkContext
    if not hasattr(context, "_cellweave_tables"):
        context._cellweave_tables = []
    return context._cellweave_tables


def release(spark: SparkSession) -> int:
    """Delete the tables that this application has cut so far; no frame made before may be used after. Says how many."""
    jvm, conf, found = spark._jvm, spark._jsc.hadoopConfiguration(), _tables(spark)
    for name in found:
        path = jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(conf).delete(path, True)
    n = len(found)
    found.clear()
    return n


def pin(df: DataFrame) -> DataFrame:
    """As ``cut``, but keeping the partitions of ``df``, for data that is scanned many times."""
    shared_dir(ship(df.sparkSession))
    return df.checkpoint(eager=True)
