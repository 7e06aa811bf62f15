"""Annotation of cells that arrive in chunks.

A chunk is a micro-batch of rows (cell, barcode, gene, value) with whole cells. The
atlas is static, and annotating one cell does not depend on any other, so chunk by
chunk gives the same result as all at once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from cellweave.model import Experiment
from cellweave.operators.annotate import annotate, prepare

CHUNK_SCHEMA = "cell long, barcode string, gene long, value double"


def annotate_stream(chunks: DataFrame, genes: DataFrame, atlas: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Annotate every micro-batch of ``chunks`` and write it to ``out`` as parquet, one folder per batch.

    A batch that is retried after a failure overwrites its own folder. The atlas is prepared once, before the first batch.
    """
    known = prepare(atlas)

    def each(batch: DataFrame, number: int) -> None:
        exp = Experiment(batch.select("cell", "gene", "value"), batch.select("cell", "barcode").distinct(), genes)
        annotate(exp, known).write.mode("overwrite").parquet(f"{out.rstrip('/')}/batch={number}")

    return (chunks.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())
