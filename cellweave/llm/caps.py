"""Near-duplicate embeddings by spherical-cap filters.

A filter is a direction; a vector passes it if their inner product is above a threshold, so a filter keeps a cap of the
sphere. Near vectors share many caps, far ones few. Directions form random product codes: a randomly rotated space is
split in two blocks, each with a small random codebook, and a direction is one code from each block. A vector is
list-decoded to all the directions it exceeds: block scores are sorted, and combinations below the threshold are never
formed. Several rotations, each with its own code, keep the number of filters that a vector passes even.

Vectors join on shared filters and are verified in double precision. The number of directions grows with the number of
vectors, so the rows of a filter stay few; a filter that many near copies share is cut into tiles. A pair counts in the
least filter both pass, never twice, and no pair is written: a tile yields each vector's number of links and a forest.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweave.llm import arrays as A
from cellweave.llm.components import components
from cellweave.session import cut

COSINE = 0.95
#: expected rows of a filter, with vectors spread evenly over the sphere
OCCUPANCY = 128
ROTATIONS = 32
#: filters that a vector passes, beyond those after which independent filters would miss a pair at the threshold once
#: in 100,000: the passes of a product code are not independent
MISS, SPARE = 1e-5, 1.5
#: rows of a tile's side
TILE = 1024
SEED = 11


def cap_share(t: float, d: int) -> float:
    """Share of the unit sphere in d dimensions whose first coordinate is at least t."""
    x = np.linspace(-1, 1, 20_001)
    density = np.maximum(1 - x * x, 0) ** ((d - 3) / 2) if d > 3 else np.ones_like(x)
    return float(density[x >= t].sum() / density.sum())


def both_share(t: float, cosine: float, d: int) -> float:
    """Chance that a vector at ``cosine`` to another that passes a filter passes it too."""
    rng = np.random.default_rng(5)
    z = rng.standard_normal((100_000, 2)) / math.sqrt(d)
    # first coordinates given that the first vector just exceeds t: the overshoot of a normal tail
    over = t + rng.exponential(1 / (d * max(t, 1e-3)), 100_000)
    return float((cosine * over + math.sqrt(1 - cosine ** 2) * z[:, 0] >= t).mean())


class ProductCode:
    """Directions for ``n`` vectors of ``d`` dimensions; the same numbers always give the same code."""

    def __init__(self, n: int, d: int, cosine: float = COSINE, miss: float = MISS, seed: int = SEED):
        blocks = 2 if d > 1 else 1
        size, wanted = 64, 16.0
        for _ in range(12):  # directions and passes that fit each other
            low, high = 0.0, 1.0
            for _ in range(30):
                t = (low + high) / 2
                low, high = (t, high) if cap_share(t, d) > wanted / size else (low, t)
            self.threshold = low
            wanted = -SPARE * math.log(miss) / max(both_share(low, cosine, d), 0.02)
            size = max(64, int(n * wanted / OCCUPANCY))
        self.codes = max(4, math.ceil((size / ROTATIONS) ** (1 / blocks)))
        self.width = self.codes if blocks == 2 else 1
        half = d // 2 if blocks == 2 else d
        self.parts = []
        for k in range(ROTATIONS):
            rng = np.random.default_rng([seed, d, k])
            turn = np.linalg.qr(rng.standard_normal((d, d)))[0]
            # parts whose squared lengths sum to one make directions of unit length
            books = [_unit(rng.standard_normal((self.codes, m))) * math.sqrt(m / d) for m in (half, d - half) if m]
            self.parts.append((turn[:, :half] @ books[0].T, turn[:, half:] @ books[1].T if len(books) > 1 else np.zeros((d, 1))))

    def decode(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, direction) of all directions that each unit vector exceeds, sorted by row and direction."""
        rows, directions = [], []
        for k, (first, second) in enumerate(self.parts):
            left, right = unit @ first, unit @ second
            order = np.argsort(-right, axis=1)
            right = np.take_along_axis(right, order, axis=1)
            row, a = np.nonzero(left + right[:, :1] >= self.threshold)
            rest = self.threshold - left[row, a]
            # how many of the sorted second codes reach the rest: bisection for all rows at once
            low, high = np.zeros(len(row), np.int64), np.full(len(row), right.shape[1], np.int64)
            while (active := low < high).any():
                mid = (low + high) // 2
                good = right[row, np.minimum(mid, right.shape[1] - 1)] >= rest
                low, high = np.where(active & good, mid + 1, low), np.where(active & ~good, mid, high)
            each = np.repeat(np.arange(len(row)), low)
            b = order[row[each], np.arange(low.sum()) - np.repeat(np.cumsum(low) - low, low)]
            rows.append(row[each])
            directions.append((k * self.codes + a[each]) * self.width + b)
        row, direction = np.concatenate(rows), np.concatenate(directions)
        order = np.lexsort([direction, row])
        return row[order], direction[order]


def forest(near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, first row of its component) of a boolean link matrix, where these differ."""
    m = len(near)
    label, seen = np.arange(m), np.zeros(m, bool)
    for i in range(m):
        if seen[i]:
            continue
        seen[i], edge = True, np.array([i])
        while len(edge):
            reach = near[edge].any(axis=0) & ~seen
            seen |= reach
            edge = np.flatnonzero(reach)
            label[edge] = i
    moved = np.flatnonzero(label != np.arange(m))
    return moved, label[moved]


def _earlier(lists: list[np.ndarray], here: int) -> np.ndarray:
    """Pairs of rows that share a filter below ``here``."""
    m = len(lists)
    row = np.repeat(np.arange(m), [np.searchsorted(x, here) for x in lists])
    name = np.concatenate([x[:np.searchsorted(x, here)] for x in lists]) if len(row) else np.zeros(0, np.int64)
    _, column, count = np.unique(name, return_inverse=True, return_counts=True)
    use = count[column] > 1
    row, (_, column) = row[use], np.unique(column[use], return_inverse=True)
    member = np.zeros((m, int(column.max(initial=-1)) + 1), np.float32)
    member[row, column] = 1
    return member @ member.T > 0


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding", cosine: float = COSINE,
                    miss: float = MISS, tile: int = TILE) -> DataFrame:
    """One row for each row of ``vectors``: vec_id, n_links, component_id, kept.

    Links are found pairs with a cosine of at least ``cosine`` in double precision, never one below; a pair at the
    threshold is missed with a chance of about ``miss``, a nearer one with less. Vectors that are null, empty, zero, or
    hold null or non-finite components, and rows with a null id, link with nothing: their component is their own id.
    Vectors of different lengths never link. Equal vectors link with one another and are searched once. An id that is
    repeated is one node for components. An empty table gives no rows.
    """
    spark = A.ready(vectors.sparkSession)
    kind = vectors.schema[vector].dataType.elementType.simpleString()
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector).alias("x"))
    sound = (F.col("vec_id").isNotNull() & F.col("x").isNotNull()
             & F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) < float("inf")))
             & F.exists("x", lambda v: v != 0))
    good = rows.filter(F.coalesce(sound, F.lit(False)))
    single = cut(good.groupBy("x").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies")))
    sizes = {r["d"]: r["n"] for r in single.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n")).collect()}
    codes = {d: ProductCode(n, d, cosine, miss) for d, n in sizes.items()}

    def decode(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            lists = batch.column(0)
            length = lists.value_lengths().to_numpy(zero_copy_only=False)
            at = np.concatenate([[0], np.cumsum(length)])
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            for d in np.unique(length):
                chosen = np.flatnonzero(length == d)
                values = flat[at[chosen][:, None] + np.arange(d)]
                row, direction = codes[int(d)].decode(_unit(values))
                start = np.searchsorted(row, np.arange(len(chosen) + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(chosen), d, np.int32)), pa.array([v.tobytes() for v in values], pa.binary()),
                     *[batch.column(k).take(pa.array(chosen)) for k in (1, 2, 3)],
                     pa.ListArray.from_arrays(pa.array(start), pa.array(direction))], ["d", "x", "rep", "copies", "uid", "passes"])

    uid = F.xxhash64("x").alias("uid")
    coded = cut(single.select("x", "rep", "copies", uid).mapInArrow(
        decode, "d int, x binary, rep long, copies long, uid long, passes array<long>"))
    crowd = coded.select("d", F.explode("passes").alias("filter")).groupBy("d", "filter").agg(F.count("*").alias("rows")).filter(
        F.col("rows") > tile)
    met = coded.select("*", F.explode("passes").alias("filter")).join(crowd, ["d", "filter"], "left").withColumn(
        "sides", F.ceil(F.coalesce("rows", F.lit(1)) / tile).cast("int")).withColumn(
        "side", F.pmod(F.col("uid"), F.col("sides").cast("long")).cast("int"))
    tiled = met.select("d", "filter", "uid", "rep", "copies", "passes", "x", "side",
                       F.explode(F.sequence(F.lit(0), F.col("sides") - 1)).alias("other")).withColumn(
        "i", F.least("side", "other")).withColumn("j", F.greatest("side", "other")).drop("other")
    number = np.dtype({"float": np.float32, "double": np.float64}.get(kind, np.float64))

    def verify(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in it if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held).combine_chunks()
        keys = [table[c].to_numpy() for c in ("d", "filter", "i", "j")]
        order = np.lexsort(keys[::-1])
        change = np.zeros(len(order), bool)
        for k in keys:
            k = k[order]
            change[1:] |= k[1:] != k[:-1]
        cuts = np.concatenate([[0], np.flatnonzero(change), [len(order)]])
        rep, copies, uid, side = (table[c].to_numpy() for c in ("rep", "copies", "uid", "side"))
        raw, lists = table["x"].chunk(0), table["passes"].chunk(0)
        ends, names = lists.offsets.to_numpy(), lists.values.to_numpy()
        out: list[list[np.ndarray]] = [[], [], [], []]
        for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            if hi - lo < 2:
                continue
            spot = order[lo:hi]
            spot = spot[np.argsort(rep[spot], kind="stable")]
            d, here, i, j = (int(k[spot[0]]) for k in keys)
            unit = _unit(np.frombuffer(b"".join(raw.take(pa.array(spot)).to_pylist()), number).reshape(-1, d))
            near = unit @ unit.T >= cosine
            np.fill_diagonal(near, False)
            if i != j:
                near &= side[spot][:, None] != side[spot][None, :]
            if not near.any():
                continue
            some = np.flatnonzero(near.any(axis=1))
            spot, near = spot[some], near[np.ix_(some, some)]
            near &= ~_earlier([names[ends[p]:ends[p + 1]] for p in spot.tolist()], here)
            total = near @ copies[spot]
            moved, top = forest(near)
            some = np.flatnonzero(total)
            out[0] += [uid[spot[some]], uid[spot[moved]]]  # links of a row, and edges that bear none
            out[1] += [total[some], np.zeros(len(moved), np.int64)]
            out[2] += [rep[spot[some]], rep[spot[moved]]]
            out[3] += [rep[spot[some]], rep[spot[top]]]
        if out[0]:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in out], ["uid", "links", "b", "a"])

    tiles = cut(tiled.repartition(A.buckets(spark), "d", "filter", "i", "j").mapInArrow(verify, "uid long, links long, b long, a long"))
    links = tiles.groupBy(F.col("b").alias("rep"), "uid").agg(F.sum("links").alias("links")).filter("links > 0")
    tops = components(tiles.select("a", "b"))
    named = single.select("*", uid).join(links, ["rep", "uid"], "left").join(tops, F.col("rep") == F.col("node"), "left").select(
        F.col("x").alias("y"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"), F.coalesce("component", "rep").alias("top"))
    linked = rows.withColumn("y0", F.when(F.coalesce(sound, F.lit(False)), F.col("x"))).join(named, F.col("y0") == F.col("y"), "left")
    component = F.coalesce("top", "vec_id")
    return linked.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
                         F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


def _unit(values: np.ndarray) -> np.ndarray:
    wide = values.astype(np.float64)
    wide = wide / np.abs(wide).max(axis=1, keepdims=True)  # lengths can't overflow
    return wide / np.sqrt((wide * wide).sum(axis=1, keepdims=True))
