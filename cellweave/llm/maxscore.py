"""Exact top-k inner products by MaxScore over sharded postings.

Vectors are quantised to integers and seen as documents whose terms are the components. Each shard keeps a posting list
for every term and the largest and smallest impact in it, which bound what the term can add for a query. Terms are
taken by falling bound. As long as the terms left could still lift a document that was never met to the k-th best
score, they are essential and their postings are traversed; from then on only documents already met can win, and the
rest of the terms is probed for them alone, as long as they stay competitive. The k best of each shard are merged.

Queries are taken in blocks and meet every shard once; a block and a shard are bounded numbers of rows.

Vectors with components so large that doubles might round their scores are kept apart and scored in whole numbers.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellweave.llm import arrays as A
from cellweave.session import cut

SCALE = 256
SHARD_ROWS = 4096
BLOCK_QUERIES = 2048
#: bound of (largest quantised component)^2 x components within which sums of products are exact in doubles
EXACT = 2.0 ** 51
#: documents scored at once to raise the threshold
PROBES = 48
STRIDE = 8


class Postings:
    """The inverted lists of one shard: per term the documents that have it and their impacts."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.rows = ids[order], rows[order].astype(np.float64)
        self.lists = []
        for t in range(rows.shape[1]):
            docs = np.flatnonzero(self.rows[:, t])
            self.lists.append((docs, self.rows[docs, t]))
        zero = np.zeros(1)
        self.high = np.array([max(0.0, np.append(w, zero).max()) for _, w in self.lists])
        self.low = np.array([min(0.0, np.append(w, zero).min()) for _, w in self.lists])

    def top(self, query_id: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k best rows whose id isn't the query's: ids and scores, ties to the smaller id."""
        width = min(len(query), len(self.lists))
        query = query[:width].astype(np.float64)
        bound = np.maximum(query * self.high[:width], query * self.low[:width])
        terms = np.argsort(-bound, kind="stable")
        terms = terms[query[terms] != 0]
        left = np.append(np.cumsum(bound[terms][::-1])[::-1], 0.0)  # what terms[j:] can add at most
        others = self.ids != query_id
        score = np.zeros(len(self.ids))
        least, done = -math.inf, 0
        while done < len(terms):
            for t in terms[done:done + STRIDE]:
                docs, impact = self.lists[t]
                if len(docs) == len(score):
                    score += query[t] * impact
                else:
                    score[docs] += query[t] * impact
            done = min(done + STRIDE, len(terms))
            if others.sum() > PROBES:
                trial = np.where(others, score, -math.inf)
                near = np.argpartition(-trial, PROBES)[:PROBES]
                full = np.sort(self.rows[near][:, :width] @ query)
                if len(full) >= k:
                    least = max(least, full[-k])
            if left[done] < least:
                break  # the terms left are not essential
        found = np.flatnonzero(others & (score + left[done] >= least))
        while done < len(terms) and len(found):
            part = terms[done:done + STRIDE]
            score[found] += self.rows[np.ix_(found, part)] @ query[part]
            done = min(done + STRIDE, len(terms))
            found = found[score[found] + left[done] >= least]
        order = np.lexsort([self.ids[found], -score[found]])[:k]
        return self.ids[found[order]], score[found[order]].astype(np.int64)


def large(rows: np.ndarray, lengths: np.ndarray, scale: int) -> np.ndarray:
    """The unscaled rows that doubles might not score exactly."""
    with np.errstate(over="ignore"):
        return (np.abs(rows).max(axis=1, initial=0) * scale + 1) ** 2 * lengths > EXACT


def whole(rows: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale x component) as Python integers; a double of 2^60 or more is a whole number before it is scaled."""
    out = np.empty(rows.shape, object)
    out.ravel()[:] = [int(x) * scale if abs(x) >= 2.0 ** 60 else math.floor(x * scale) for x in rows.ravel().tolist()]
    return out


def exact_top(ids: np.ndarray, rows: np.ndarray, query_id: int, query: np.ndarray, k: int, scale: int) -> list[tuple[int, int]]:
    """(-score, id) of the k best rows whose id isn't the query's, in integers of any size. Unscaled rows and query.

    Scores beyond 64 bits have no place in a column of longs: such a pair is left out.
    """
    width = min(len(query), rows.shape[1])
    others = np.flatnonzero(ids != query_id)
    known = whole(query[:width], scale).tolist()
    scores = [(-sum(a * b for a, b in zip(row, known) if a and b), i)
              for row, i in zip(whole(rows[others][:, :width], scale).tolist(), ids[others].tolist())]
    return sorted(s for s in scores if -1 << 63 <= -s[0] < 1 << 63)[:k]


def complete(vectors: DataFrame, id_col: str, vector: str) -> DataFrame:
    """``id`` (long) and ``q`` (array<double>, not yet scaled), without the rows that take no part."""
    wide = F.col(vector).cast("array<double>")
    return vectors.select(F.col(id_col).cast("long").alias("id"), wide.alias("x")).filter(
        F.col("id").isNotNull() & F.col("x").isNotNull()
        & F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < math.inf))).select(
        "id", F.col("x").alias("q"))


def _matrix(rows: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The vectors, filled with zeros to one length, and their own lengths."""
    lists = rows.combine_chunks()
    lists = pa.concat_arrays(lists.chunks) if isinstance(lists, pa.ChunkedArray) else lists
    lengths = lists.value_lengths().to_numpy(zero_copy_only=False)
    out = np.zeros((len(lists), int(lengths.max(initial=0))))
    out[np.arange(out.shape[1])[None, :] < lengths[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
    return out, lengths


def top_k(vectors: DataFrame, queries: Column, k: int = 5, id_col: str = "vec_id", vector: str = "embedding",
          scale: int = SCALE, shard_rows: int = SHARD_ROWS, block: int = BLOCK_QUERIES) -> DataFrame:
    """The ``k`` highest inner products of each row for which ``queries``, a condition on ``id``, holds, over all other rows.

    query_id, rank (int, from 1), vec_id, score (long). Vectors that are null or hold a null or a non-finite number,
    and rows with a null id, take no part. A pair whose score doesn't fit a long is left out. Vectors of different lengths meet in the
    components both have. Rows with the query's own id are no candidates; a repeated id is otherwise a row of its own,
    a repeated query id one query. Fewer than k candidates give fewer rows; no query, none.
    """
    A.ready(vectors.sparkSession)
    rows = cut(complete(vectors, id_col, vector))
    asked = rows.filter(queries).dropDuplicates(["id"])
    shards = max(1, -(-rows.count() // shard_rows))
    blocks = max(1, -(-asked.count() // block))
    place = F.xxhash64("id", F.lit(1))
    candidates = rows.select("id", "q", F.pmod(place, F.lit(shards).cast("long")).alias("shard"),
                             F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    wanted = asked.select("id", "q", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("shard"),
                          F.pmod(F.xxhash64("id", F.lit(2)), F.lit(blocks).cast("long")).cast("int").alias("block"))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[list] = [[], [], []]
        if left.num_rows and right.num_rows:
            known, (rows, lengths) = left["id"].to_numpy(), _matrix(left["q"])
            wide = large(rows, lengths, scale)
            lists = Postings(known[~wide], np.floor(rows[~wide] * scale))
            queries, lengths = _matrix(right["q"])
            for number, query, far in zip(right["id"].to_pylist(), queries, large(queries, lengths, scale).tolist()):
                if far:
                    best = exact_top(known, rows, number, query, k, scale)
                else:
                    near, scores = lists.top(number, np.floor(query * scale), k)
                    best = list(zip((-scores).tolist(), near.tolist()))
                    if wide.any():
                        best = sorted(best + exact_top(known[wide], rows[wide], number, query, k, scale))[:k]
                ids, scores = [i for _, i in best], [-s for s, _ in best]
                out[0].append(np.full(len(ids), number))
                out[1].append(np.array(ids, np.int64))
                out[2].append(np.array(scores, np.int64))
        return pa.table([np.concatenate(x or [np.zeros(0)]).astype(np.int64) for x in out], ["query_id", "vec_id", "score"])

    met = candidates.groupBy("shard", "block").cogroup(wanted.groupBy("shard", "block")).applyInArrow(
        run, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return met.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
