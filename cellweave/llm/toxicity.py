"""Toxicity scores by non-negative positive-unlabelled learning.

Only confirmed toxic texts carry a label in training; all other text is unlabelled and may hold more of them. A linear
model over hashed words and byte 5-grams minimises the class-prior-corrected risk

    prior * E_P[loss(+)] + max(0, E_U[loss(-)] - prior * E_P[loss(-)]),

whose second term estimates the risk on the unseen negatives and is kept from going below zero, where the model would
only be memorising the positives.

The model is fitted on a bounded sample: about ``max_positive`` confirmed and ``max_unlabelled`` other rows, chosen by a
hash of the id. Feature counts of the sample are Spark aggregates; only the chosen features (``features``) and the
sample's hits on them reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellweave.llm import arrays as A
from cellweave.session import cut

BITS = 22
GRAM = 5
MAX_POSITIVE = 4096
MAX_UNLABELLED = 12288
FEATURES = 4096
#: standard deviations that a feature's rates among positives and unlabelled must lie apart
Z_LEAST = 4.0
LETTER = np.zeros(256, bool)
LETTER[97:123] = LETTER[128:] = True


@dataclass(frozen=True)
class PuModel:
    """Hashed features with their weights; a text's logit is the bias plus the weights of the features it has."""

    features: np.ndarray
    weights: np.ndarray
    bias: float
    prior: float


def hashed_features(data: np.ndarray, offsets: np.ndarray, bits: int = BITS) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first text, text of each occurrence, hashed feature) for steps of whole texts."""
    top = np.uint64(64 - bits)
    for first, last in A.steps(offsets):
        at = offsets[first:last + 1] - offsets[first]
        body = A.LOWER[data[offsets[first]:offsets[last]]]
        grams = A.gram_hash(body, GRAM) >> top
        here = np.zeros(len(body), bool)
        here[:max(0, len(body) - GRAM + 1)] = True
        for back in range(1, GRAM):  # a gram must not run into the next text
            ends = at[1:] - back
            here[ends[(ends >= at[:-1]) & (ends >= 0)]] = False
        spots = np.flatnonzero(here)
        starts, ends = A.runs(LETTER[body], at)
        words = A.mix(A.range_hash(A.prefix_hash(body), starts, ends)) >> top
        where = np.concatenate([spots, starts])
        yield first, A.owner_of(at, where), np.concatenate([grams[spots], words]).astype(np.int64)


def _pairs(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Distinct (text, feature) pairs."""
    for first, text, feature in hashed_features(data, offsets):
        pair = np.unique(text << BITS | feature)
        yield first + (pair >> BITS), pair & ((1 << BITS) - 1)


def _counts(sample: DataFrame) -> DataFrame:
    """Texts that have each feature, among the positives and among the unlabelled."""
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, 1 << BITS), np.int32)
        for batch in it:
            known = np.array(batch.column(0).to_pylist(), np.int64)
            for text, feature in _pairs(*A.text_buffer(batch.column(1))):
                for y in (0, 1):
                    np.add.at(total[y], feature[known[text] == y], 1)
        some = np.flatnonzero(total.any(axis=0))
        for lo in range(0, len(some), 1 << 17):
            part = some[lo:lo + (1 << 17)]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(total[1, part].astype(np.int64)),
                                              pa.array(total[0, part].astype(np.int64))], ["feature", "p", "u"])

    return sample.select("known", "text").mapInArrow(A.lean(run), "feature long, p long, u long").groupBy("feature").agg(
        F.sum("p").alias("p"), F.sum("u").alias("u"))


def _hits(sample: DataFrame, features: np.ndarray) -> DataFrame:
    """known, hits: the chosen features, by rank, that each sampled text has."""
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = _lookup(features)
        for batch in it:
            rows: list[np.ndarray] = [np.zeros(0, np.int16)] * batch.num_rows
            for text, feature in _pairs(*A.text_buffer(batch.column(1))):
                rank = lookup[feature]
                text, rank = text[rank >= 0], rank[rank >= 0]
                cuts = np.searchsorted(text, np.arange(text[0], text[-1] + 2)) if len(text) else [0]
                for k in range(len(cuts) - 1):
                    rows[text[0] + k] = rank[cuts[k]:cuts[k + 1]]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.int16()))], ["known", "hits"])

    return sample.select("known", "text").mapInArrow(A.lean(run), "known int, hits array<smallint>")


def _lookup(features: np.ndarray) -> np.ndarray:
    table = np.full(1 << BITS, -1, np.int16)
    table[features] = np.arange(len(features))
    return table


def nonnegative_pu(known: np.ndarray, text: np.ndarray, feature: np.ndarray, n_features: int, prior: float,
                   steps: int = 400, rate: float = 0.05, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise the non-negative risk with the logistic loss, by full-batch Adam.

    known: 1 for a confirmed positive, 0 for an unlabelled text; (text, feature): the sparse 0/1 design.
    """
    n, positive = len(known), known == 1
    n_p, n_u = max(1, positive.sum()), max(1, (~positive).sum())
    w = np.zeros(n_features + 1)
    m, v = np.zeros_like(w), np.zeros_like(w)
    w[-1] = np.log(prior / (1 - prior))
    for t in range(1, steps + 1):
        logit = np.bincount(text, w[feature], minlength=n) + w[-1]
        p = 1 / (1 + np.exp(-np.clip(logit, -40, 40)))
        soft = np.logaddexp(0, logit)
        negative_risk = soft[~positive].sum() / n_u - prior * soft[positive].sum() / n_p
        grow = np.where(positive, -prior * p / n_p, p / n_u)  # gradient of the negative part
        if negative_risk >= 0:
            slope = grow + np.where(positive, -prior * (1 - p) / n_p, 0)
        else:
            slope = -grow
        gradient = np.append(np.bincount(feature, slope[text], minlength=n_features), slope.sum())
        gradient[:-1] += decay * w[:-1]
        m = 0.9 * m + 0.1 * gradient
        v = 0.999 * v + 0.001 * gradient ** 2
        w = w - rate * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8)
    return w[:-1], float(w[-1])


def fit(docs: DataFrame, labels: DataFrame, learn: Column | None = None, prior: float | None = None,
        max_positive: int = MAX_POSITIVE, max_unlabelled: int = MAX_UNLABELLED, features: int = FEATURES) -> PuModel:
    """Fit on ``docs(doc_id, text)`` and ``labels(doc_id, toxic)``, on rows where ``learn`` holds.

    ``prior``: share of toxic texts; by default their share among labelled rows, or 0.1 if no row is labelled
    otherwise. Without a confirmed positive the model is the prior alone. Rows with a null id or a null label teach
    nothing; an id labelled twice is toxic if one of its labels says so.
    """
    spark = A.ready(docs.sparkSession)
    learn = F.lit(True) if learn is None else learn
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 31))
    named = labels.select(F.col("doc_id").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter(
        F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).filter(learn).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n_known, n_toxic = named.agg(F.count("*"), F.sum("toxic")).first()
    n_toxic = n_toxic or 0
    if prior is None:
        prior = n_toxic / n_known if 0 < n_toxic < n_known else 0.1
    rows = docs.select(F.col("doc_id").alias("doc_id"), F.col("text").cast("string").alias("text")).filter(F.col("doc_id").isNotNull()).filter(learn)
    n_rows = rows.count()
    if not n_toxic or not n_rows:
        return PuModel(np.zeros(0, np.int64), np.zeros(0), float(np.log(prior / (1 - prior))), prior)
    chosen = F.broadcast(named.filter("toxic = 1").filter(draw < int(min(1, max_positive / n_toxic) * (1 << 31))).select("doc_id"))
    known = rows.join(chosen, "doc_id").select(F.lit(1).alias("known"), "text")
    other = rows.filter(draw < int(min(1, max_unlabelled / n_rows) * (1 << 31))).select(F.lit(0).alias("known"), "text")
    sample = cut(known.union(other).repartition(min(16, A.buckets(spark))))
    size = {r[0]: r[1] for r in sample.groupBy("known").count().collect()}
    n_p, n_u = size.get(1, 0), size.get(0, 0)
    if not n_p:
        return PuModel(np.zeros(0, np.int64), np.zeros(0), float(np.log(prior / (1 - prior))), prior)
    rate_p, rate_u = F.col("p") / n_p, F.col("u") / max(1, n_u)
    spread = F.abs(rate_p - rate_u) / F.sqrt((F.col("p") + F.col("u") + 1.0) / (n_p + n_u) * (1 / n_p + 1 / max(1, n_u)))
    best = _counts(sample).select("feature", spread.alias("z")).filter(F.col("z") >= Z_LEAST).orderBy(F.desc("z"), "feature").limit(
        min(features, 32000)).toPandas()
    ids = best["feature"].to_numpy(np.int64)
    table = _hits(sample, ids).toArrow()
    hits = table["hits"].combine_chunks()
    lengths = np.diff(hits.offsets.to_numpy())
    text = np.repeat(np.arange(table.num_rows), lengths)
    w, b = nonnegative_pu(table["known"].to_numpy(), text, hits.flatten().to_numpy().astype(np.int64), len(ids), prior)
    return PuModel(ids, w, b, prior)


def score(docs: DataFrame, model: PuModel, text: str = "text") -> DataFrame:
    """``docs`` with ``score`` (double, 0 to 1): how likely the whole text is toxic. Null and empty texts get the bias's score.

    A column of ``docs`` named ``score`` is replaced.
    """
    A.ready(docs.sparkSession)
    rest = [c for c in docs.columns if c != "score"]
    frame = docs.select(*[F.col(f"`{c}`") for c in rest], F.col(f"`{text}`").cast("string").alias("text__"))
    ids, weights, bias = model.features, model.weights, model.bias

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = _lookup(ids)
        for batch in it:
            logit = np.full(batch.num_rows, bias)
            for first, where, feature in hashed_features(*A.text_buffer(batch.column(len(rest)))):
                rank = lookup[feature]
                hit = rank >= 0
                pair = np.unique(where[hit] << 16 | rank[hit])
                if len(pair):
                    sums = np.bincount(pair >> 16, weights[pair & 0xFFFF])
                    logit[first:first + len(sums)] += sums
            value = 1 / (1 + np.exp(-np.clip(logit, -40, 40)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:len(rest)], pa.array(value)], [*rest, "score"])

    fields = ", ".join(f"`{c}` {frame.schema[c].dataType.simpleString()}" for c in rest)
    return frame.mapInArrow(A.lean(run), f"{fields}, score double")
