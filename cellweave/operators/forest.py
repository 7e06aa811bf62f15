"""k rounds of minimum spanning forest.

Taking the minimum spanning forest k times, removing its edges each time, equals
one scan of the edges in (cost, i, j) order that puts each edge in the first of k
forests where it closes no cycle. That form is mergeable: edges a subset rejects
from all k forests are rejected in the whole graph too. So tiles prune their own
pairs first, groups of tiles prune again, and only survivors travel.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweave.config import TASK_EDGES
from cellweave.operators.keys import lookup_join
from cellweave.operators.similarity import Similarity, batch_of, oriented_pairs
from cellweave.session import cut

# Pairs of a tile that are listed at a time.
SLICE_PAIRS = 1 << 19
# Pairs of a tile that wait for the task's fold.
FEW_PAIRS = 1 << 17
EDGE_SCHEMA = "i long, j long, cost double, round int"
TAGGED = ("bi", "bj", "i", "j", "cost")


def first_fit(i: np.ndarray, j: np.ndarray, cost: np.ndarray, k: int):
    """Positions of the edges kept and their round (1..k)."""
    if not len(i):
        return np.empty(0, np.int64), np.empty(0, np.int32)
    ids, ends = np.unique(np.concatenate((i, j)), return_inverse=True)
    u, v = ends[:len(i)], ends[len(i):]
    forests = _Forests(len(ids), k)
    rest, step = np.arange(len(i)), 4 * len(ids)
    while len(rest):
        batch, rest = rest, rest[:0]
        if len(batch) > 4 * step:  # the lightest first, all of the last cost: what they rule out is never sorted
            light = cost[batch] <= np.partition(cost[batch], step)[step]
            batch, rest = batch[light], batch[~light]
        forests.add(batch, u, v, i, j, cost)
        rest = rest[~forests.joined(u[rest], v[rest])]
        step *= 2
    return forests.kept()


class _Forests:
    """k forests that edges are put into, the lightest first."""

    def __init__(self, n: int, k: int):
        self.n, self.parts = n, np.tile(np.arange(n), (k, 1))
        self.picked, self.rounds = [np.empty(0, np.int64)], [np.empty(0, np.int32)]

    def joined(self, u: np.ndarray, v: np.ndarray) -> np.ndarray:
        """Ends joined in the last forest are joined in all of them."""
        return self.parts[-1][u] == self.parts[-1][v]

    def add(self, batch, u, v, i, j, cost) -> None:
        """Edges at the places ``batch``, none lighter than those added before; all of one cost come at once."""
        order = np.argsort(cost[batch], kind="stable")
        if (np.diff(cost[batch][order]) == 0).any():
            order = np.lexsort((j[batch], i[batch], cost[batch]))
        order, step = batch[order], 4 * self.n
        while len(order):
            batch, order = order[:step], order[step:]
            for t, part in enumerate(self.parts):
                if not len(batch):
                    break
                fits = _spanning(part, u[batch], v[batch])
                self.picked.append(batch[fits])
                self.rounds.append(np.full(int(fits.sum()), t + 1, dtype=np.int32))
                batch = batch[~fits]
            order = order[~self.joined(u[order], v[order])]
            step *= 2

    def kept(self) -> tuple[np.ndarray, np.ndarray]:
        return np.concatenate(self.picked), np.concatenate(self.rounds)


def _spanning(part: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Which of the edges (in rank order) extend the forest; ``part`` is updated."""
    fits = np.zeros(len(u), dtype=bool)
    live = np.flatnonzero(part[u] != part[v])
    n = len(part)
    while len(live):
        a, b = part[u[live]], part[v[live]]
        best = np.full(n, len(u))
        other = np.full(n, len(u))
        best[a[::-1]] = live[::-1]   # last write wins: the lightest edge of each part
        other[b[::-1]] = live[::-1]
        best = np.minimum(best, other)
        own = np.flatnonzero(best < len(u))
        edge = best[own]
        fits[edge] = True
        parent = np.arange(n)
        ea, eb = part[u[edge]], part[v[edge]]
        parent[own] = np.where(ea == own, eb, ea)
        mutual = (parent[parent] == np.arange(n)) & (np.arange(n) < parent)
        parent[mutual] = np.flatnonzero(mutual)
        while True:
            hop = parent[parent]
            if (hop == parent).all():
                break
            parent = hop
        part[:] = parent[part]
        live = live[part[u[live]] != part[v[live]]]
    return fits


def rounds_for(n: int, mode: str = "floor") -> int:
    """Number of rounds for n rows: floor or round of ln n."""
    if n < 1:
        return 0
    return math.floor(math.log(n)) if mode == "floor" else math.floor(math.log(n) + 0.5)


def kmst_graph(sim: Similarity, k: int, threshold: float = 0.0, inverse: bool = True) -> DataFrame:
    """k-round forest over the pairs with r > threshold, without listing the pairs; tiles that hold none are skipped.

    cost is 1 - r, or r itself when ``inverse`` is off.
    """
    spark = sim.expr.sparkSession
    if k < 1:
        return spark.createDataFrame([], EDGE_SCHEMA)
    measure = sim.measure

    def listed(tile):
        """(i, j, r) of the pairs above the threshold, some at a time."""
        few = measure.positive(tile) if threshold >= 0 and hasattr(measure, "positive") else None
        if few is not None:
            a, b, r = few
            keep = (r > threshold) & (a < b) if tile.diagonal else r > threshold
            left, right = tile.left[a[keep]], tile.right[b[keep]]
            yield np.minimum(left, right), np.maximum(left, right), r[keep]
            return
        score = measure(tile)
        step = max(1, SLICE_PAIRS // max(1, score.shape[1]))
        for lo in range(0, score.shape[0] if score.size else 0, step):
            i, j, r = oriented_pairs(tile, score, slice(lo, min(lo + step, score.shape[0])))
            keep = r > threshold
            yield i[keep], j[keep], r[keep]

    def consume(tile):
        kept = []
        for i, j, r in listed(tile):  # a slice's pairs are pruned before the next are listed
            cost = 1.0 - r if inverse else r
            if len(cost) > FEW_PAIRS:
                pick, _ = first_fit(i, j, cost, k)
                i, j, cost = i[pick], j[pick], cost[pick]
            kept.append((i, j, cost))
        if not kept:
            return
        i, j, cost = (np.concatenate(c) for c in zip(*kept))
        pick = first_fit(i, j, cost, k)[0] if len(kept) > 1 else np.arange(len(i))
        bi, bj = (np.full(len(pick), g, np.int32) for g in tile.group)
        yield batch_of(TAGGED, bi, bj, i[pick], j[pick], cost[pick])

    def fold(batch: pa.RecordBatch) -> pa.RecordBatch:
        pick, _ = first_fit(*(batch.column(c).to_numpy() for c in ("i", "j", "cost")), k)
        return batch.take(pa.array(pick))

    return merge_forests(sim._run(consume, "bi int, bj int, i long, j long, cost double", threshold, fold=fold), k)


def spanning_forests(edges: DataFrame, k: int) -> DataFrame:
    """k-round forest of any edge table (i, j, cost), each pair once."""
    if k < 1:
        return edges.sparkSession.createDataFrame([], EDGE_SCHEMA)
    tagged = edges.select(
        F.pmod(F.xxhash64("i"), F.lit(64)).cast("int").alias("bi"),
        F.pmod(F.xxhash64("j"), F.lit(64)).cast("int").alias("bj"),
        F.col("i").cast("long"), F.col("j").cast("long"), F.col("cost").cast("double"))
    return merge_forests(tagged, k)


def merge_forests(edges: DataFrame, k: int, task_edges: int = TASK_EDGES) -> DataFrame:
    """Combine tile survivors (bi, bj, i, j, cost) into the k-round forest.

    Neighbouring tiles are merged four by four per axis while a group stays within
    the task bound. What then fits one task is finished there; more is finished by
    distributed rounds over the edge table.
    """
    edges = cut(edges)
    total = edges.count()
    while total > task_edges:
        quarter = lambda c: F.floor(F.col(c) / 4).cast("int").alias(c)
        groups = edges.select(quarter("bi"), quarter("bj"), "i", "j", "cost").groupBy("bi", "bj")
        largest = groups.count().agg(F.max("count")).first()[0]
        if largest > task_edges:
            return distributed_rounds(edges.select("i", "j", "cost"), k)

        def prune(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
            i, j, cost = (table.column(c).to_numpy() for c in ("i", "j", "cost"))
            pick, _ = first_fit(i, j, cost, k)
            keys = [pa.array(np.full(len(pick), c.as_py(), dtype=np.int32)) for c in key]
            return pa.Table.from_arrays([*keys, *map(pa.array, (i[pick], j[pick], cost[pick]))],
                                        names=["bi", "bj", "i", "j", "cost"])

        merged = cut(groups.applyInArrow(prune, edges.schema))
        left = merged.count()
        if left > 0.9 * total:
            return distributed_rounds(merged.select("i", "j", "cost"), k)
        edges, total = merged, left

    def finish(batches):
        parts = [tuple(b.column(c).to_numpy() for c in ("i", "j", "cost")) for b in batches]
        if parts:
            i, j, cost = (np.concatenate(c) for c in zip(*parts))
            pick, rounds = first_fit(i, j, cost, k)
            yield batch_of(("i", "j", "cost", "round"), i[pick], j[pick], cost[pick], rounds)

    return edges.select("i", "j", "cost").coalesce(1).mapInArrow(finish, EDGE_SCHEMA)


def distributed_rounds(edges: DataFrame, k: int) -> DataFrame:
    """k forests by repeated nearest-neighbour contraction, all on tables.

    In each step every component takes its lightest outgoing edge (an aggregate
    with map-side combine), the chosen edges are contracted by pointer jumping, and
    the edge ends are relabelled by lookups that are broadcast or salted.
    """
    remaining, done = edges, None
    for t in range(1, k + 1):
        forest = cut(minimum_forest(remaining))
        part = forest.withColumn("round", F.lit(t))
        done = part if done is None else done.unionByName(part)
        if t < k:
            remaining = cut(remaining.join(forest.select("i", "j"), ["i", "j"], "left_anti"))
    return done.select("i", "j", "cost", "round")


def minimum_forest(edges: DataFrame) -> DataFrame:
    """One minimum spanning forest under the (cost, i, j) order."""
    chosen = None
    for picked, _ in contraction_steps(edges):
        chosen = picked if chosen is None else chosen.unionByName(picked)
    return chosen if chosen is not None else edges.select("i", "j", "cost").limit(0)


def contraction_steps(edges: DataFrame):
    """Yield (edges chosen, (c, root) of every contracted component) until none is left."""
    live = edges.select("i", "j", "cost", F.col("i").alias("ci"), F.col("j").alias("cj"))
    while True:
        ends = live.select(F.explode(F.array(
            F.struct(F.col("ci").alias("c"), F.struct("cost", "i", "j", F.col("cj").alias("other")).alias("e")),
            F.struct(F.col("cj").alias("c"), F.struct("cost", "i", "j", F.col("ci").alias("other")).alias("e")),
        )).alias("x")).select("x.*")
        best = cut(ends.groupBy("c").agg(F.min("e").alias("e")).select("c", "e.*"))
        if best.isEmpty():
            return
        root = _contract(best.select("c", F.col("other").alias("parent")))
        yield best.select("i", "j", "cost").distinct(), root
        rows = root.count()
        for end in ("ci", "cj"):
            live = (lookup_join(live.withColumnRenamed(end, "c"), root, "c", rows, "left")
                    .withColumn(end, F.coalesce("root", "c")).drop("c", "root"))
        live = cut(live.filter("ci <> cj"))


def _contract(parents: DataFrame) -> DataFrame:
    """(c, root) from a table where every c points at another c; only 2-cycles occur."""
    back = parents.select(F.col("c").alias("parent"), F.col("parent").alias("c"))
    looped = parents.join(back, ["c", "parent"], "left_semi").filter("c < parent").select("c")
    state = cut(parents.join(looped.withColumn("top", F.lit(True)), "c", "left")
                .select("c", F.when(F.col("top"), F.col("c")).otherwise(F.col("parent")).alias("root")))
    while True:
        rows = state.count()
        up = state.select(F.col("c").alias("root"), F.col("root").alias("next"))
        state2 = cut(lookup_join(state, up, "root", rows)
                     .select("c", F.col("next").alias("root"), (F.col("next") != F.col("root")).alias("moved")))
        moved = state2.filter("moved").limit(1).count()
        state = state2.select("c", "root")
        if not moved:
            return state
