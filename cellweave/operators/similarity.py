"""Row similarities and what is computed straight from the tiles."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellweave.config import BLOCK_ROWS, BROADCAST_VALUES
from cellweave.operators import tiles
from cellweave.operators.keys import dense_index, lookup_join
from cellweave.operators.tiles import Tile
from cellweave.session import cut, ship

PAIR_SCHEMA = "i long, j long, r double"
# Correlations are compared at this many decimals, so that the order of pairs does
# not depend on the order of a floating-point sum.
DECIMALS = 12
# Pairs are scored one by one if at most one in so many has a product.
FEW_SHARE = 4
# Scores ranked at a time; so many stay in a core's cache.
RANKED = 1 << 17

Measure = Callable[[Tile], np.ndarray]


def _pearson_measure(n: int) -> Measure:
    def measure(tile: Tile) -> np.ndarray:
        (l1, l2), (r1, r2) = tile.left_stats[:2], tile.right_stats[:2]
        var_l, var_r = n * l2 - l1 * l1, n * r2 - r1 * r1
        var_l[var_l <= 1e-12 * n * l2] = np.nan
        var_r[var_r <= 1e-12 * n * r2] = np.nan
        r, other = n * tile.gram, np.outer(l1, r1)
        r -= other
        np.multiply.outer(var_l, var_r, out=other)
        r /= np.sqrt(other, out=other)
        return np.round(np.clip(r, -1.0, 1.0, out=r), DECIMALS, out=r)

    def positive(tile: Tile) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
        """(left place, right place, score) of all pairs whose score may be above 0; None where most may be.

        Without negative row sums these have a product: pairs without a shared column are never scored.
        """
        (l1, l2), (r1, r2) = tile.left_stats[:2], tile.right_stats[:2]
        if (l1 < 0).any() or (r1 < 0).any():
            return None
        some = tile.gram.ravel() > 0
        if np.count_nonzero(some) * FEW_SHARE > some.size:
            return None
        a, b = np.divmod(np.flatnonzero(some), max(1, tile.gram.shape[1]))
        var_l, var_r = n * l2 - l1 * l1, n * r2 - r1 * r1
        var_l[var_l <= 1e-12 * n * l2] = np.nan
        var_r[var_r <= 1e-12 * n * r2] = np.nan
        r = (n * tile.gram[a, b] - l1[a] * r1[b]) / np.sqrt(var_l[a] * var_r[b])
        return a, b, np.round(np.clip(r, -1.0, 1.0), DECIMALS)

    measure.positive = positive
    return measure


def _union_measure(tile: Tile) -> np.ndarray:
    """Correlation over the union of the supports, means from whole-part sums."""
    (l1, l2, ln, lw), (r1, r2, rn, rw) = tile.left_stats, tile.right_stats
    n = ln[:, None] + rn[None, :] - tile.support
    with np.errstate(invalid="ignore", divide="ignore"):
        a, b = lw[:, None] / n, rw[None, :] / n
        cov = tile.gram - b * l1[:, None] - a * r1[None, :] + n * a * b
        var_l = l2[:, None] - 2 * a * l1[:, None] + n * a * a
        var_r = r2[None, :] - 2 * b * r1[None, :] + n * b * b
        den = np.sqrt(var_l * var_r)
        den[~(den > 0)] = np.nan
        return np.round(cov / den, DECIMALS)


def _jaccard_measure(tile: Tile) -> np.ndarray:
    union = tile.left_stats[2][:, None] + tile.right_stats[2][None, :] - tile.support
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.where(union > 0, tile.support / union, np.nan)


def oriented_pairs(tile: Tile, score: np.ndarray, rows: slice):
    """Ids and scores of the tile's pairs for a slice of its left rows, i < j."""
    mask = np.ones((rows.stop - rows.start, score.shape[1]), dtype=bool)
    if tile.diagonal:
        mask = np.arange(rows.start, rows.stop)[:, None] < np.arange(score.shape[1])[None, :]
    a, b = np.nonzero(mask)
    left, right = tile.left[rows][a], tile.right[b]
    return np.minimum(left, right), np.maximum(left, right), score[rows][a, b]


def batch_of(names, *columns) -> pa.RecordBatch:
    """A record batch in which NaN scores become NULL."""
    arrays = [pa.array(c, from_pandas=True) for c in columns]
    return pa.RecordBatch.from_arrays(arrays, names=list(names))


def _emit_pairs(measure: Measure, threshold: float | None, inclusive: bool = False):
    def consume(tile: Tile) -> Iterator[pa.RecordBatch]:
        score = measure(tile)
        step = max(1, 200_000 // max(1, score.shape[1]))
        for lo in range(0, score.shape[0], step):
            i, j, r = oriented_pairs(tile, score, slice(lo, min(lo + step, score.shape[0])))
            if threshold is not None:
                keep = r >= threshold if inclusive else r > threshold
                i, j, r = i[keep], j[keep], r[keep]
            yield batch_of("ijr", i, j, r)
    return consume


def _best_places(score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the ``k`` best defined scores of every row by trunc(10^4 r), ties to the first columns; some rows at a time."""
    rows, columns, step = [], [], max(1, RANKED // max(1, score.shape[1]))
    for lo in range(0, score.shape[0] if k > 0 else 0, step):
        part = score[lo:lo + step]
        rank = np.trunc(np.round(part * 10_000, 6))
        rank[np.isnan(rank)] = -np.inf
        if score.shape[1] > k:
            least = np.partition(rank, score.shape[1] - k, axis=1)[:, [score.shape[1] - k]]
        else:
            least = np.full((len(rank), 1), -np.inf)
        above = rank > least
        a, b = np.nonzero(above)
        left = k - np.bincount(a, minlength=len(rank))
        tie_a, tie_b = np.nonzero((rank == least) & (rank > -np.inf))
        first = np.searchsorted(tie_a, np.arange(len(rank)))
        fits = np.arange(len(tie_a)) - first[tie_a] < left[tie_a]
        rows += [lo + a, lo + tie_a[fits]]
        columns += [b, tie_b[fits]]
    return tuple(np.concatenate([np.zeros(0, np.int64), *c]) for c in (rows, columns))


class Similarity:
    """All-pairs similarity of the rows of a matrix, evaluated tile by tile.

    Nothing runs until one of the methods is used, and each method emits only what
    it is for; ``pairs`` alone materialises all pairs.
    """

    def __init__(self, expr: DataFrame, rows: DataFrame, n_rows: int, measure: Measure,
                 support: bool = False, metric_genes: int | None = None, block_rows: int = BLOCK_ROWS):
        self.expr, self.n_rows, self.measure, self.support = expr, n_rows, measure, support
        self.stats = tiles.row_stats(expr, rows)
        # columns over which the score is the cosine of an angle, if it is one
        self.metric_genes, self.block_rows = metric_genes, block_rows
        self.skipped = 0.0  # share of tiles that the last run left out

    def _run(self, consumer, schema, least: float | None = None, **kw) -> DataFrame:
        """Tiles to ``consumer``; with ``least`` only those that can hold a pair of at least that score."""
        plan, self.skipped, entries = None, 0.0, self.expr.count()
        if least is not None and self.metric_genes is not None and self.n_rows > 2 * self.block_rows:
            most = tiles.rows_of_block(self.n_rows, entries, self.block_rows)
            plan = _pivot_plan(self.expr, self.stats, self.n_rows, self.metric_genes, least, most)
            if plan.skipped <= WORTH:
                plan = None
            else:
                self.skipped = plan.skipped
        side = (self.expr, self.stats)
        return tiles.run_tiles(side, None, self.n_rows, None, consumer, schema, self.support, self.block_rows, plan=plan, entries=entries, **kw)

    def pairs(self, threshold: float | None = None, inclusive: bool = False) -> DataFrame:
        """(i, j, r) with i < j; undefined r is NULL, and absent under a threshold.

        A threshold (r above it, or at it when ``inclusive``) is applied inside the tiles, and large inputs skip tiles
        that hold no such pair.
        """
        return self._run(_emit_pairs(self.measure, threshold, inclusive), PAIR_SCHEMA, threshold)

    def histogram(self) -> DataFrame:
        """Pairs per bin trunc(10 r + 10), 0..20; undefined r counts in bin 0."""
        measure = self.measure

        def consume(tile):
            score = measure(tile)
            values = score[np.triu_indices_from(score, 1)] if tile.diagonal else score.ravel()
            bins = np.trunc(np.round(values * 10 + 10, 9))
            counts = np.bincount(np.nan_to_num(bins, nan=0.0).astype(int), minlength=21)
            yield batch_of(("bin", "n"), np.arange(len(counts)), counts)

        return (self._run(consume, "bin long, n long").groupBy("bin").agg(F.sum("n").alias("n"))
                .filter("n > 0"))

    def nearest(self, k: int) -> DataFrame:
        """(i, j, r): for each row its k best others by trunc(10^4 r), then by j.

        Every tile keeps k candidates per row, every task k of those of its tiles.
        """
        measure = self.measure

        def consume(tile):
            score = measure(tile)
            if tile.diagonal:
                score = score.copy()
                np.fill_diagonal(score, np.nan)
            views = [(tile.left, tile.right, score)]
            if not tile.diagonal:
                views.append((tile.right, tile.left, score.T))
            for own, other, s in views:
                place, at = _best_places(s, k)  # ids ascend, so ties by j
                r = s[place, at]
                yield batch_of("ijr", own[place], other[at], r)

        def fold(batch: pa.RecordBatch) -> pa.RecordBatch:
            i, j, r = (c.to_numpy() for c in batch.columns)
            order = np.lexsort((j, -np.trunc(np.round(r * 10_000, 6)), i))
            first = np.flatnonzero(np.concatenate(([True], np.diff(i[order]) != 0)))
            place = np.arange(len(order)) - np.repeat(first, np.diff(np.append(first, len(order))))
            return batch.take(pa.array(order[place < k]))

        found = self._run(consume, PAIR_SCHEMA, fold=fold)
        best = Window.partitionBy("i").orderBy(F.desc(rank_of("r")), "j")
        return found.withColumn("_n", F.row_number().over(best)).filter(F.col("_n") <= k).drop("_n")


# Share of tiles above which blocks around pivots, which are smaller and uneven, are used.
WORTH = 0.5
# Rows for each pivot that tell beforehand whether blocks around pivots may be of use.
PROBED = 16
# Angles come from scores rounded at DECIMALS; that much they may be off.
_SLACK = 1e-5


def _pivot_plan(expr: DataFrame, stats: DataFrame, n_rows: int, n_genes: int, least: float, block_rows: int) -> tiles.TilePlan:
    """Blocks around pivots, and the tiles that the triangle inequality cannot rule out.

    Centred rows of unit length have r = cos(angle), and angles obey the triangle inequality: two blocks whose pivots are
    further apart than both radii plus arccos(least) hold no pair of that score. Pivots are the rows first by hash, two for
    each block's worth of rows; a row joins its nearest, and what gathers at one pivot is split by hash into blocks of
    ``block_rows``, each with a radius of its own. Constant rows have no r with anything and no block. Where already the radii
    of some rows leave out few tiles, nothing is skipped and the others are not placed.
    """
    wanted = max(2, -(-2 * n_rows // block_rows))
    n = F.lit(float(n_genes))
    varied = stats.filter(n * F.col("s2") - F.col("s1") * F.col("s1") > 1e-12 * n * F.col("s2"))
    pivots = cut(varied.select("cell", F.xxhash64("cell").alias("_h")).orderBy("_h", "cell").limit(wanted).select("cell"))
    count = pivots.count()
    around = cut(lookup_join(expr, pivots, "cell", count, "left_semi"))
    apart = cut(cross_pearson(around, around, count, count, n_genes, pivots, pivots).select(
        F.col("i").alias("pivot"), F.col("j").alias("beside"), F.acos(F.greatest(F.least("r", F.lit(1.0)), F.lit(-1.0))).alias("apart")))
    reach = float(np.arccos(np.clip(least, -1.0, 1.0))) + _SLACK

    def angles(expr: DataFrame, rows: DataFrame, n: int) -> DataFrame:
        return cut(best_match(expr, around, n, count, n_genes, rows, pivots).filter("r IS NOT NULL").select(
            F.col("i").alias("cell"), F.col("j").alias("pivot"), F.acos(F.least("r", F.lit(1.0))).alias("angle")))

    one_in = n_rows // (PROBED * wanted)
    if one_in > 1:  # radii of all rows are no smaller than those of some, and so leave out no more
        some = cut(stats.select("cell").filter(F.pmod(F.xxhash64("cell", F.lit(1)), F.lit(one_in)) == 0))
        n_some = some.count()
        radii = angles(lookup_join(expr, some, "cell", n_some, "left_semi"), some, n_some).groupBy("pivot").agg(
            F.max("angle").alias("radius"), F.count("*").alias("n"))
        pairs = apart.join(radii, "pivot").join(radii.select(F.col("pivot").alias("beside"), F.col("radius").alias("_radius"), F.col("n").alias("_n")), "beside")
        weight = F.col("n") * F.col("_n")
        far = F.col("apart") > F.col("radius") + F.col("_radius") + F.lit(reach)
        share = pairs.agg(F.sum(F.when(far, weight).otherwise(0)) / F.sum(weight)).first()[0] or 0.0
        if share <= WORTH / 2:
            return tiles.TilePlan(some, apart, 1, 0.0)
    near = angles(expr, stats.select("cell"), n_rows)
    sizes = near.groupBy("pivot").agg(F.ceil(F.count("*") / block_rows).cast("long").alias("parts"))
    placed = lookup_join(near, sizes, "pivot", count).withColumn("part", F.pmod(F.xxhash64("cell"), "parts"))
    blocks = cut(dense_index(placed.groupBy("pivot", "part").agg(F.max("angle").alias("radius")), ["pivot", "part"], "block").withColumn(
        "block", F.col("block").cast("int")))
    rows = cut(placed.join(blocks, ["pivot", "part"]).select("cell", "block"))
    ours = blocks.select("pivot", "block", "radius")
    theirs = blocks.select(F.col("pivot").alias("beside"), F.col("block").alias("other"), F.col("radius").alias("_radius"))
    met = cut(apart.join(ours, "pivot").join(theirs, "beside").filter(
        F.col("apart") <= F.col("radius") + F.col("_radius") + F.lit(reach)).select("block", "other"))
    total, kept = blocks.count(), met.filter("block <= other").count()
    return tiles.TilePlan(rows, met, max(total, 1), 1.0 - kept / max(1, total * (total + 1) // 2))


def rank_of(r: str):
    return F.floor(F.abs(F.round(F.col(r) * 10_000, 6))) * F.signum(r)


def pearson(expr: DataFrame, rows: DataFrame, n_rows: int, n_genes: int) -> Similarity:
    """Pearson correlation over all ``n_genes`` columns, joint zeros included."""
    return Similarity(expr, rows, n_rows, _pearson_measure(n_genes), metric_genes=n_genes)


def pearson_union_trunc(expr: DataFrame, rows: DataFrame, n_rows: int) -> Similarity:
    """The union-support variant whose means come from sums of whole parts (values >= 0)."""
    return Similarity(expr, rows, n_rows, _union_measure, support=True)


def jaccard(expr: DataFrame, rows: DataFrame, n_rows: int, minimum: float = 5.0) -> Similarity:
    """Shared over united columns, counting values of at least ``minimum``."""
    return Similarity(expr.filter(F.col("value") >= minimum), rows, n_rows, _jaccard_measure, support=True)


# --- two-sided -----------------------------------------------------------------------

# Products of entries, or scores, that a task makes at a time against few right rows; one left row's may be more.
FEW_VALUES = 1 << 20


def _few_work(genes: np.ndarray, others: np.ndarray, dense: np.ndarray, measure: Measure, emit):
    """A task's function over packed left rows against ``others``, whose values of ``genes`` are the rows of ``dense``.

    Products are made ``FEW_VALUES`` at a time, so beyond the batch itself a worker's memory follows neither its rows nor its entries.
    """
    r1, r2 = dense.sum(0), (dense * dense).sum(0)
    width = max(1, len(others))

    def work(batches):
        for batch in batches:
            ids, lengths = batch.column(0).to_numpy(), batch.column(1).value_lengths().to_numpy()
            ends = np.cumsum(lengths)
            found, values = batch.column(1).flatten().to_numpy(), batch.column(2).flatten().to_numpy()
            at = np.minimum(np.searchsorted(genes, found), max(0, len(genes) - 1))
            at = np.where(genes[at] == found, at, len(genes)) if len(genes) else np.zeros(len(found), int)
            first = 0
            while first < len(ids):
                start = ends[first] - lengths[first]
                last = max(first + 1, min(first + FEW_VALUES // width, int(np.searchsorted(ends, start + FEW_VALUES // width, "right"))))
                part, rows = slice(start, ends[last - 1]), lengths[first:last]
                some, cuts = np.flatnonzero(rows), np.cumsum(rows) - rows
                gram, l1, l2 = np.zeros((last - first, len(others))), np.zeros(last - first), np.zeros(last - first)
                if len(some):
                    v = values[part]
                    gram[some] = np.add.reduceat(v[:, None] * dense[at[part]], cuts[some], axis=0)
                    l1[some], l2[some] = np.add.reduceat(v, cuts[some]), np.add.reduceat(v * v, cuts[some])
                yield from emit(ids[first:last], others, measure(SimpleNamespace(gram=gram, left_stats=(l1, l2), right_stats=(r1, r2))))
                first = last

    return work


def _against_few(left: DataFrame, right: DataFrame, n_genes: int, left_rows: DataFrame, right_rows: DataFrame, emit) -> DataFrame:
    """Correlations with a right side of checked size: its matrix goes to every task, left rows stay where they are."""
    ship(left.sparkSession)
    others = np.sort(right_rows.select(F.col("cell").cast("long")).toPandas().iloc[:, 0].to_numpy())
    table = right.select("cell", "gene", "value").toPandas()
    genes, slot = np.unique(table["gene"].to_numpy(np.int64), return_inverse=True)
    dense = np.zeros((len(genes) + 1, len(others)))  # the last row stands for columns the right side lacks
    np.add.at(dense, (slot, np.searchsorted(others, table["cell"].to_numpy(np.int64))), table["value"].to_numpy(float))
    entry = F.collect_list(F.struct(F.col("gene").cast("long").alias("gene"), F.col("value").cast("double").alias("value"))).alias("e")
    packed = left_rows.select(F.col("cell").cast("long").alias("cell")).join(
        left.groupBy(F.col("cell").cast("long").alias("cell")).agg(entry), "cell", "left").select(
        "cell", F.coalesce(F.col("e.gene"), F.array().cast("array<long>")).alias("genes"),
        F.coalesce(F.col("e.value"), F.array().cast("array<double>")).alias("values"))
    return packed.mapInArrow(_few_work(genes, others, dense, _pearson_measure(n_genes), emit), PAIR_SCHEMA)


def _few(n_right: int, n_genes: int, left_rows: DataFrame | None, right_rows: DataFrame | None) -> bool:
    return left_rows is not None and right_rows is not None and n_right * (n_genes + 1) <= BROADCAST_VALUES


def cross_pearson(left: DataFrame, right: DataFrame, n_left: int, n_right: int, n_genes: int,
                  left_rows: DataFrame | None = None, right_rows: DataFrame | None = None) -> DataFrame:
    """(i, j, r) for every left row i and right row j; undefined r is NULL."""
    if _few(n_right, n_genes, left_rows, right_rows):
        return _against_few(left, right, n_genes, left_rows, right_rows, lambda ids, others, score: [batch_of(
            "ijr", np.repeat(ids, len(others)), np.tile(others, len(ids)), score.ravel())])
    measure = _pearson_measure(n_genes)

    def consume(tile):
        score = measure(tile)
        step = max(1, 200_000 // max(1, score.shape[1]))
        for lo in range(0, score.shape[0], step):
            part = score[lo:lo + step]
            yield batch_of("ijr", np.repeat(tile.left[lo:lo + step], part.shape[1]),
                           np.tile(tile.right, part.shape[0]), part.ravel())

    return tiles.run_tiles((left, tiles.row_stats(left, left_rows)), (right, tiles.row_stats(right, right_rows)),
                           n_left, n_right, consume, PAIR_SCHEMA)


def best_match(left: DataFrame, right: DataFrame, n_left: int, n_right: int, n_genes: int,
               left_rows: DataFrame | None = None, right_rows: DataFrame | None = None) -> DataFrame:
    """(i, j, r): for every left row the right row of highest r, ties to the smallest j.

    A tile sends one candidate per left row; rows without a defined r get NULLs.
    """
    if _few(n_right, n_genes, left_rows, right_rows):
        def first(ids, others, score):
            if score.size:
                best = np.argmax(np.where(np.isnan(score), -np.inf, score), axis=1)
                r = score[np.arange(len(best)), best]
                keep = ~np.isnan(r)
                yield batch_of("ijr", ids[keep], others[best][keep], r[keep])

        return _against_few(left, right, n_genes, left_rows, right_rows, first)
    measure = _pearson_measure(n_genes)

    def consume(tile):
        if not len(tile.right):
            return
        score = measure(tile)
        best = np.argmax(np.where(np.isnan(score), -np.inf, score), axis=1)
        r = score[np.arange(len(best)), best]
        keep = ~np.isnan(r)
        yield batch_of("ijr", tile.left[keep], tile.right[best][keep], r[keep])

    found = tiles.run_tiles((left, tiles.row_stats(left, left_rows)), (right, tiles.row_stats(right, right_rows)),
                            n_left, n_right, consume, PAIR_SCHEMA)
    return found.groupBy("i").agg(F.max(F.struct("r", (-F.col("j")).alias("nj"))).alias("b")).select(
        "i", (-F.col("b.nj")).alias("j"), "b.r")


# --- dense vectors ----------------------------------------------------------------------

# Distances computed at a time; so many stay in a core's cache.
_SLICE = 1 << 17


def squared_slices(a: np.ndarray, b: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Squared Euclidean distances as (first row, block), some rows of ``a`` at a time; the block is reused for the next.

    Pairs too close for the expanded form are redone directly.
    """
    na, nb, scaled = (a * a).sum(1), (b * b).sum(1), -2.0 * a
    step = max(1, _SLICE // max(1, len(b)))
    room = np.empty((min(step, len(a)), len(b)))
    for lo in range(0, len(a), step):
        d2, own = room[:len(a) - lo], na[lo:lo + step]
        np.matmul(scaled[lo:lo + step], b.T, out=d2)
        d2 += own[:, None]
        d2 += nb
        near = d2 < 1e-6 * (own.max(initial=0.0) + nb.max(initial=0.0))
        if near.any():
            x, y = np.nonzero(near)
            close = d2[x, y] < 1e-6 * (own[x] + nb[y])
            x, y = x[close], y[close]
            for at in range(0, len(x), 10_000):
                i, j = x[at:at + 10_000], y[at:at + 10_000]
                d2[i, j] = ((a[lo + i] - b[j]) ** 2).sum(1)
        yield lo, d2


def distance_slices(a: np.ndarray, b: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """As ``squared_slices``, the distances themselves."""
    for lo, d2 in squared_slices(a, b):
        yield lo, np.sqrt(d2, out=d2)


def distance_block(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All distances of a tile at once."""
    out = np.empty((len(a), len(b)))
    for lo, d in distance_slices(a, b):
        out[lo:lo + len(d)] = d
    return out


def euclidean_pairs(points: DataFrame, n: int) -> DataFrame:
    """(i, j, d) with i < j and d > 0 over ``points(id, z)``."""
    def consume(il, zl, _xl, ir, zr, _xr, diagonal):
        for lo, d in distance_slices(zl, zr):
            keep = d > 0
            if diagonal:
                keep &= np.arange(lo, lo + len(d))[:, None] < np.arange(len(ir))[None, :]
            a, b = np.nonzero(keep)
            i, j = il[lo + a], ir[b]
            yield batch_of("ijd", np.minimum(i, j), np.maximum(i, j), d[a, b])

    return tiles.run_vector_tiles(points, n, consume, "i long, j long, d double")


# Rows whose distances tell where to look for a quantile.
_GUESS_ROWS = 1000


def distance_quantiles(points: DataFrame, n: int, probs: list[float], bins: int = 4096,
                       bound: int = 200_000) -> list[float]:
    """Exact interpolated quantiles of all positive pair distances.

    Tiles send histograms, not distances. The distances of a few rows tell which bands to look into first; in one pass all
    pairs are counted, those below each band too, and those within it by bins. That settles the bin of every rank that is
    in its band; other ranks are looked for in the whole range. Each further pass zooms into the bins that hold the wanted
    ranks, all of them at once, until the bins are small enough to be listed together in a last pass.
    """
    least_d = float(np.nextafter(0.0, 1.0))  # zero distances are in no band

    def slices(zl, zr, diagonal):
        for lo, d2 in squared_slices(zl, zr):
            if diagonal:  # each pair once: NaN is in no band
                d2[np.arange(lo, lo + len(d2))[:, None] >= np.arange(d2.shape[1])[None, :]] = np.nan
            yield d2

    def within(d2, square):
        return np.sqrt(d2[(d2 >= square[0]) & (d2 < square[1])])

    columns = ("band", "slot", "n", "least", "most")

    def fold(batch: pa.RecordBatch) -> pa.RecordBatch:
        band, slot, count, least, most = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
        order = np.lexsort((slot, band))
        band, slot = band[order], slot[order]
        first = np.flatnonzero(np.concatenate(([True], (np.diff(band) != 0) | (np.diff(slot) != 0))))
        return batch_of(columns, band[first], slot[first], np.add.reduceat(count[order], first),
                        np.minimum.reduceat(least[order], first), np.maximum.reduceat(most[order], first))

    def tally(bands: list[tuple[float, float]]) -> tuple[dict[tuple[float, float], list], dict[tuple[float, float], int], int]:
        """For each band the bins in use and the number of distances below it, and the number of all distances."""
        squares = [(_least_square(lo), _least_square(np.nextafter(hi, np.inf))) for lo, hi in bands]

        def consume(_il, zl, _xl, _ir, zr, _xr, diagonal):
            counts = np.zeros((len(bands), bins), np.int64)
            least, most = np.full(counts.shape, np.inf), np.full(counts.shape, -np.inf)
            below, every = np.zeros(len(bands), np.int64), 0
            for d2 in slices(zl, zr, diagonal):
                zero = np.count_nonzero(d2 == 0)
                every += np.count_nonzero(d2 > 0)
                for number, ((lo, hi), square) in enumerate(zip(bands, squares)):
                    below[number] += np.count_nonzero(d2 < square[0]) - zero
                    some = within(d2, square)
                    slot = np.minimum(((some - lo) * (bins / (hi - lo))).astype(np.int64), bins - 1)
                    counts[number] += np.bincount(slot, minlength=bins)
                    np.minimum.at(least[number], slot, some)
                    np.maximum.at(most[number], slot, some)
            number, used = np.nonzero(counts)
            yield batch_of(columns, number, used, counts[number, used], least[number, used], most[number, used])
            k = len(bands) + 1  # slot -1: distances below the band; of band -1, all
            yield batch_of(columns, np.arange(-1, len(bands)), np.full(k, -1), np.append([every], below), np.zeros(k), np.zeros(k))

        found = tiles.run_vector_tiles(points, n, consume, "band long, slot long, n long, least double, most double", fold=fold)
        out: dict[tuple[float, float], list] = {b: [] for b in bands}
        under, every = {b: 0 for b in bands}, 0
        for band, slot, count, least, most in found.groupBy("band", "slot").agg(F.sum("n"), F.min("least"), F.max("most")).orderBy("band", "slot").collect():
            if slot >= 0:
                out[bands[band]].append((count, least, most))
            elif band >= 0:
                under[bands[band]] = count
            else:
                every = count
        return out, under, every

    def listed(bands: list[tuple[float, float]]) -> dict[tuple[float, float], list]:
        squares = [(_least_square(lo), _least_square(np.nextafter(hi, np.inf))) for lo, hi in bands]

        def consume(_il, zl, _xl, _ir, zr, _xr, diagonal):
            for d2 in slices(zl, zr, diagonal):
                for number, square in enumerate(squares):
                    some = within(d2, square)
                    if len(some):
                        yield batch_of(("band", "d"), np.full(len(some), number), some)

        out: dict[tuple[float, float], list] = {b: [] for b in bands}
        for band, d, count in tiles.run_vector_tiles(points, n, consume, "band long, d double").groupBy("band", "d").count().orderBy("band", "d").collect():
            out[bands[band]].append((count, d, d))
        return out

    extent = points.agg(F.max(F.aggregate(F.transform("z", lambda x: x * x), F.lit(0.0), lambda a, x: a + x))).first()[0]
    whole = (least_d, 2.0 * float(np.sqrt(extent or 0.0)) * (1 + 1e-9) + 1e-300)
    guessed = _guessed_bands(points, probs, whole)
    counted, under, total = tally(guessed or [whole])
    if not total:
        raise ValueError("no positive distances")
    places = [(total - 1) * p for p in probs]
    ranks = {r for x in places for r in (int(np.floor(x)), int(np.ceil(x)))}
    # the band that a rank is in, and the distances before the band
    held = {r: next(((b, under[b]) for b in counted if under[b] <= r < under[b] + sum(c for c, *_ in counted[b])), (whole, 0)) for r in ranks}
    if whole not in counted and any(band == whole for band, _ in held.values()):
        counted |= tally([whole])[0]
    value: dict[int, float] = {}
    small: dict[int, tuple[tuple[float, float], int]] = {}

    def settle(rank: int, rows: list, below: int) -> None:
        """Find the rank's bin: its value, a band to list, or a band to look into."""
        for count, least, most in rows:
            if rank < below + count:
                break
            below += count
        if least == most:
            value[rank] = least
        else:
            (small if count <= bound else held)[rank] = ((least, most), below)

    while held:
        asked, held = held, {}
        for rank, (band, below) in asked.items():
            settle(rank, counted[band], below)
        if held:
            counted = tally(sorted({band for band, _ in held.values()}))[0]
    if small:
        lists = listed(sorted({band for band, _ in small.values()}))
        for rank, (band, below) in small.items():
            settle(rank, lists[band], below)
    low_high = [(value[int(np.floor(x))], value[int(np.ceil(x))], x - np.floor(x)) for x in places]
    return [float(low + (high - low) * part) for low, high, part in low_high]


def _least_square(d: float) -> float:
    """The least number whose square root, as rounded, is ``d`` or more."""
    square = d * d
    while square > 0 and np.sqrt(np.nextafter(square, 0.0)) >= d:
        square = np.nextafter(square, 0.0)
    while np.sqrt(square) < d:
        square = np.nextafter(square, np.inf)
    return float(square)


def _guessed_bands(points: DataFrame, probs: list[float], whole: tuple[float, float]) -> list[tuple[float, float]]:
    """Bands about the quantiles of the distances between a few rows, those first by hash; where a quantile is, is counted later."""
    rows = points.filter("z IS NOT NULL").orderBy(F.xxhash64("id"), "id").limit(_GUESS_ROWS).select("z").collect()
    width = max((len(r["z"]) for r in rows), default=0)
    z = np.array([r["z"] for r in rows if len(r["z"]) == width], dtype=float).reshape(-1, width)
    full = distance_block(z, z)
    d = np.sort(full[np.triu_indices(len(z), 1)])
    d = d[d > 0]
    if not len(d):
        return []
    bands = set()
    for p in probs:
        # the rank is off by about twice the spread of the rows' own ranks over the root of their number
        off = 0.001 + 10 * float((full < np.quantile(d, p)).mean(1).std()) / math.sqrt(len(z))
        lo, hi = (float(np.quantile(d, min(1.0, max(0.0, q)))) for q in (p - off, p + off))
        lo, hi = whole[0] if p <= off else lo, whole[1] if p >= 1 - off else hi
        if lo < hi:
            bands.add((lo, hi))
    return sorted(bands)
