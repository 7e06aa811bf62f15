"""A corpus pipeline of five of the operators: toxicity, near duplicates, repeated passages, mixing, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; every stage is written as Parquet and read again before
the next. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.llm import arrays as A
from cellweave.llm import mixing, overlap, pieces, substrings, toxicity
from cellweave.session import cut

#: documents whose toxicity reaches this score go
TOXIC = 0.5


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a model of the folder's labels doesn't score as toxic. Null and empty texts stay."""
    labels = A.ready(spark).read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet")
    model = toxicity.fit(docs, labels)
    judged = toxicity.score(docs.select(*docs.columns, *([F.col("score").alias("own__")] if "score" in docs.columns else [])), model)
    empty = F.length(F.trim(F.coalesce(F.col("text"), F.lit("")))) == 0
    return judged.filter((F.col("score") < TOXIC) | empty).select(*[F.col("own__").alias(c) if c == "score" else F.col(f"`{c}`") for c in docs.columns])


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate class: the one with the smallest id, and of its repeated rows one.

    A class is what links of Jaccard similarity 0.8 or more of five-word shingles connect. An id on rows of different
    classes is kept once for each that it leads. Texts without a word have nothing to compare; they stay, as do rows
    without an id.
    """
    rows = docs.select("*", F.xxhash64("doc_id", "text").alias("row__"))
    worded = F.coalesce(F.col("text").rlike(mixing.WORD), F.lit(False)) & F.col("doc_id").isNotNull()
    classes = cut(overlap.near_duplicates(rows.filter(worded).select("doc_id", "row__", "text"), "row__"))
    best = classes.groupBy("component").agg(F.min(F.struct("doc_id", "row__")).alias("best__")).select("best__.doc_id", "best__.row__")
    chosen = classes.join(best, ["doc_id", "row__"]).groupBy("doc_id", "row__").agg(F.count("*").alias("n__"))
    kept = rows.filter(worded).join(chosen, ["doc_id", "row__"])
    once = kept.filter("n__ = 1").union(kept.filter("n__ > 1").dropDuplicates(["doc_id", "row__"]))
    return once.select(docs.columns).union(rows.filter(~worded).select(docs.columns))


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the byte strings of 200 that are repeated; a run gives up characters that it would split."""
    rest = [c for c in docs.columns if c != "text"]
    done = substrings.remove_repeats(docs.withColumn("null__", F.col("text").isNull()), [*rest, "null__"], digest=False).withColumn(
        "text", F.when(~F.col("null__"), F.col("kept_text")))
    if "n_chars" in rest:
        done = done.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast(docs.schema["n_chars"].dataType))
    return done.select(docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents in the shares of their sources' weights, some cut out, some repeated."""
    return mixing.mixed_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, and the piece numbers of each whole text."""
    return pieces.encode(docs, keep=["doc_id", "lang", "source"])


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", without_toxic),
    ("simhash near-dedup", one_of_each),
    ("suffix-array dedup", without_repeats),
    ("mixing to target weights", mixed),
    ("SentencePiece encoding", tokens),
]

#: Learned scores, fingerprints and the shortest paths of a transducer are not SQL; the stages are tested one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = A.ready(spark).read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
