"""Scores of a clustering, with and without reference labels."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from cellweave.config import MATCH_CELLS
from cellweave.operators import projection, tiles
from cellweave.operators.keys import lookup_join, may_broadcast
from cellweave.operators.similarity import batch_of, distance_block, euclidean_pairs
from cellweave.session import cut, ship


# --- against reference labels: df(y_true, y_pred) ----------------------------------------

def align_labels(truth: DataFrame, predicted: DataFrame, key: str) -> DataFrame:
    """Match (key, y_true) with (key, y_pred) by key rather than by position.

    Raises unless both sides have the same keys, each once: a score over the rest would pass for one over all.
    """
    both = cut(truth.join(predicted, key).select(key, "y_true", "y_pred"))
    sides = [truth.count(), predicted.count(), both.count()]
    if len(set(sides)) > 1 or both.select(key).distinct().count() < sides[0]:
        raise ValueError(f"labels don't match by {key}: {sides[0]} and {sides[1]} rows, {sides[2]} in both")
    return both


def contingency(df: DataFrame) -> DataFrame:
    return df.groupBy("y_true", "y_pred").agg(F.count("*").alias("n"))


def nmi(df: DataFrame) -> DataFrame:
    """Mutual information over the mean of both entropies, natural logarithm."""
    table = cut(contingency(df))
    n = F.lit(float(table.agg(F.sum("n")).first()[0] or 0))
    entropy = lambda c: (table.groupBy(c).agg((F.sum("n") / n).alias("p"))
                         .agg(-F.sum(F.col("p") * F.ln("p"))))
    rows = table.groupBy("y_true").agg(F.sum("n").alias("a"))
    cols = table.groupBy("y_pred").agg(F.sum("n").alias("b"))
    both = lookup_join(lookup_join(table, rows, "y_true"), cols, "y_pred")
    mutual = both.agg(F.sum(F.col("n") / n * F.ln(F.col("n") * n / (F.col("a") * F.col("b")))).alias("mi"))
    mean = (entropy("y_true").scalar() + entropy("y_pred").scalar()) / F.lit(2.0)
    return mutual.select(F.coalesce(F.try_divide(F.col("mi"), mean), F.lit(1.0)).alias("nmi"))


def ari(df: DataFrame) -> DataFrame:
    """Adjusted Rand index from pair counts."""
    table = cut(contingency(df))
    pairs = lambda c: F.col(c).cast("double") * (F.col(c) - 1) / 2.0
    side = lambda c: table.groupBy(c).agg(F.sum("n").alias("m")).agg(F.sum(pairs("m")))
    total = table.agg(F.sum("n").alias("t")).select(pairs("t"))
    a, b = side("y_true").scalar(), side("y_pred").scalar()
    expected = F.try_divide(a * b, total.scalar())
    return table.agg(F.sum(pairs("n")).alias("both")).select(
        F.coalesce(F.try_divide(F.col("both") - expected, (a + b) / 2.0 - expected), F.lit(1.0)).alias("ari"))


def cluster_accuracy(df: DataFrame) -> float:
    """Share of rows matched under the best one-to-one assignment of labels.

    Only the contingency table, clusters by clusters, comes to the driver, after its size was checked.
    """
    counts = cut(contingency(df))
    sides = counts.agg(F.count_distinct("y_true"), F.count_distinct("y_pred")).first()
    if max(sides) ** 2 > MATCH_CELLS:
        raise ValueError(f"matching {sides[0]} labels with {sides[1]} clusters exceeds the bound of {MATCH_CELLS} entries")
    table = counts.toPandas()
    if table.empty:
        return float("nan")
    rows, row = np.unique(table["y_true"], return_inverse=True)
    cols, col = np.unique(table["y_pred"], return_inverse=True)
    weight = np.zeros((max(len(rows), len(cols)),) * 2)
    weight[row, col] = table["n"]
    return float(weight[np.arange(len(weight)), assignment(-weight)].sum() / table["n"].sum())


def assignment(cost: np.ndarray) -> np.ndarray:
    """Column assigned to each row of a square matrix at least total cost.

    Rows enter one by one, each along a shortest augmenting path over reduced
    costs; the scan over columns runs on whole arrays. Slot n stands for "no column".
    """
    n = len(cost)
    row_price, col_price = np.zeros(n), np.zeros(n + 1)
    owner, came = np.full(n + 1, -1), np.full(n + 1, n)
    for start in range(n):
        owner[n], at = start, n
        slack, done = np.full(n + 1, np.inf), np.zeros(n + 1, dtype=bool)
        while owner[at] >= 0:
            done[at] = True
            row = owner[at]
            trial = np.append(cost[row] - row_price[row] - col_price[:n], np.inf)
            closer = ~done & (trial < slack)
            slack[closer], came[closer] = trial[closer], at
            after = int(np.argmin(np.where(done, np.inf, slack)))
            step = slack[after]
            row_price[owner[done]] += step
            col_price[done] -= step
            slack[~done] -= step
            at = after
        while at != n:
            owner[at] = owner[came[at]]
            at = came[at]
    result = np.empty(n, dtype=int)
    result[owner[:n]] = np.arange(n)
    return result


def supervised_metrics(df: DataFrame) -> DataFrame:
    """One row acc, nmi, ari, rounded to three decimals."""
    df = cut(df)
    return nmi(df).select(F.round(F.lit(cluster_accuracy(df)), 3).alias("acc"), F.round("nmi", 3).alias("nmi"),
                          F.round(ari(df).scalar(), 3).alias("ari"))


def delta_label(before: DataFrame, after: DataFrame) -> DataFrame:
    """Share of cells whose cluster changed."""
    moved = before.select("cell", F.col("cluster").alias("old")).join(after, "cell")
    return moved.agg(F.avg((F.col("old") != F.col("cluster")).cast("double")).alias("delta"))


def n_clusters(labels: DataFrame) -> DataFrame:
    return labels.agg(F.count_distinct("cluster").alias("n_clusters"))


# --- without reference labels: df(id, z, label) -------------------------------------------

def centroids(points: DataFrame) -> DataFrame:
    """(label, n, mu): mean vector per label, combined map-side per coordinate."""
    flat = points.select("label", F.posexplode("z").alias("pos", "x"))
    mean = flat.groupBy("label", "pos").agg(F.avg("x").alias("m"), F.count("*").alias("n"))
    return mean.groupBy("label").agg(
        F.max("n").alias("n"),
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda e: e["m"]).alias("mu"))


@F.pandas_udf(DoubleType())
def vector_distance(a: pd.Series, b: pd.Series) -> pd.Series:
    if not len(a):
        return pd.Series([], dtype=float)
    diff = np.stack(a.to_numpy()) - np.stack(b.to_numpy())
    return pd.Series(np.sqrt((diff * diff).sum(1)))


def own_distances(points: DataFrame, centers: DataFrame) -> DataFrame:
    """(id, label, d): distance of each point to the centroid of its label."""
    ship(points.sparkSession)
    joined = lookup_join(points, centers.select("label", "mu"), "label")
    return joined.select("id", "label", vector_distance("z", "mu").alias("d"))


def calinski_harabasz(points: DataFrame) -> DataFrame:
    centers = cut(centroids(points))
    size = centers.agg(F.sum("n").alias("n"), F.count("*").alias("k")).first()
    grand = (centers.select("n", F.posexplode("mu").alias("pos", "m"))
             .withColumn("w", F.col("m") * F.col("n")))
    mean = grand.groupBy("pos").agg((F.sum("w") / F.lit(float(size["n"]))).alias("g"))
    between = grand.join(mean, "pos").agg(F.sum(F.col("n") * F.pow(F.col("m") - F.col("g"), 2)))
    within = own_distances(points, centers).agg(F.sum(F.col("d") * F.col("d")).alias("w"))
    ratio = F.lit((size["n"] - size["k"]) / max(size["k"] - 1, 1))
    return within.select(F.try_divide(between.scalar() * ratio, F.col("w")).alias("chs"))


def davies_bouldin(points: DataFrame) -> DataFrame:
    centers = cut(centroids(points))
    spread = cut(own_distances(points, centers).groupBy("label").agg(F.avg("d").alias("s")))
    k = centers.count()
    gaps = euclidean_pairs(centers.select(F.col("label").cast("long").alias("id"), F.col("mu").alias("z")), k)
    both = gaps.select(F.explode(F.array(F.struct(F.col("i").alias("a"), F.col("j").alias("b")),
                                         F.struct(F.col("j").alias("a"), F.col("i").alias("b")))).alias("e"), "d") \
               .select("e.a", "e.b", "d")
    for end in ("a", "b"):
        side = spread.select(F.col("label").cast("long").alias(end), F.col("s").alias("s" + end))
        both = lookup_join(both, side, end, k)
    worst = both.groupBy("a").agg(F.max((F.col("sa") + F.col("sb")) / F.col("d")).alias("r"))
    return worst.agg(F.avg("r").alias("dbs"))


def silhouette(points: DataFrame) -> DataFrame:
    """Exact mean Euclidean silhouette.

    Blocks follow the labels, so that a task mostly has all points of a label: of those labels it sends a point's least mean
    distance only, and sums only for the point's own label and for labels that other tasks have points of. Pairs stay inside.
    """
    points = points.select(F.col("id").cast("long"), F.col("z").cast("array<double>"), F.col("label").cast("long"))
    sizes = cut(points.groupBy("label").agg(F.count("*").alias("n")))
    row = sizes.agg(F.sum("n"), F.count("*")).first()
    total = row[0]
    # a repeated id's sums belong together wherever its rows are: they are left as they are
    settles = may_broadcast(sizes, row[1]) and points.select("id").distinct().count() == total
    known = sizes.filter("label IS NOT NULL").orderBy("label").toPandas() if settles else None
    label_of, size_of = (known["label"].to_numpy(np.int64), known["n"].to_numpy(np.int64)) if settles else (None, None)
    columns = ("id", "label", "own", "n", "total")

    def consume(il, zl, xl, ir, zr, xr, diagonal):
        d = distance_block(zl, zr)
        if diagonal:
            np.fill_diagonal(d, 0.0)
        views = [(il, xl, d, xr)] if diagonal else [(il, xl, d, xr), (ir, xr, d.T, xl)]
        for ids, own, dist, labels in views:
            seen, slot = np.unique(labels, return_inverse=True)
            onehot = np.zeros((len(labels), len(seen)))
            onehot[np.arange(len(labels)), slot] = 1.0
            sums, label = dist @ onehot, np.tile(seen, len(ids))
            yield batch_of(columns, np.repeat(ids, len(seen)), label, np.repeat(own, len(seen)) == label,
                           np.tile(np.bincount(slot), len(ids)), sums.ravel())

    def fold(batch):
        ids, labels, own, n, totals = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
        best, least = ids[n < 0], totals[n < 0]  # of whole labels: no label, and a mean
        order = np.lexsort((labels, ids))
        order = order[n[order] >= 0]
        ids, labels, own, n = ids[order], labels[order], own[order], n[order]
        first = np.flatnonzero(np.concatenate(([True], (np.diff(ids) != 0) | (np.diff(labels) != 0)))[:len(ids)])
        totals, known = totals[order], ~np.isnan(totals[order])  # undefined sums are left out, as sum() does
        sums = np.where(np.add.reduceat(known.astype(int), first) > 0, np.add.reduceat(np.where(known, totals, 0.0), first), np.nan)
        ids, labels, own, n = ids[first], labels[first], own[first], np.add.reduceat(n, first)
        if not settles:
            return batch_of(columns, ids, labels, own, n, sums)
        whole = ~own & (size_of[np.searchsorted(label_of, labels)] == n)
        best, least = np.concatenate((best, ids[whole])), np.concatenate((least, sums[whole] / n[whole]))
        order = np.argsort(best, kind="stable")
        best, least = best[order], least[order]
        first = np.flatnonzero(np.concatenate(([True], np.diff(best) != 0))[:len(best)])
        best, least, rest = best[first], np.fmin.reduceat(least, first), ~whole
        none = np.zeros(len(best), np.int64)
        return batch_of(columns, *map(np.concatenate, ((ids[rest], best), (labels[rest], none), (own[rest], none.astype(bool)),
                                                       (n[rest], none - 1), (sums[rest], least))))

    sums = tiles.run_vector_tiles(points, total, consume, "id long, label long, own boolean, n long, total double", extra="label",
                                  fold=fold, by_extra=settles)
    whole = F.col("n") < 0
    if settles:
        sums = sums.groupBy("id", "label", "own", whole.alias("whole")).agg(F.sum("total").alias("total"), F.min("total").alias("least"))
        sums = lookup_join(sums, sizes, "label", row[1], "left")
        mine, mean = F.col("own"), F.when(F.col("whole"), F.col("least")).otherwise(F.col("total") / F.col("n"))
    else:
        sums = lookup_join(sums.groupBy("id", "label").agg(F.sum("total").alias("total")), sizes, "label", row[1])
        sums = sums.join(points.select("id", F.col("label").alias("own")), "id")
        mine, mean = F.col("label") == F.col("own"), F.col("total") / F.col("n")
    per = sums.groupBy("id").agg(F.max(F.when(mine, F.try_divide(F.col("total"), F.col("n") - 1))).alias("a"),
                                 F.min(F.when(~mine, mean)).alias("b"))
    s = F.coalesce(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")), F.lit(0.0))
    return per.agg(F.avg(F.when(F.col("a").isNull(), 0.0).otherwise(s)).alias("sil"))


def reduce_dimensions(points: DataFrame, k: int = 32) -> DataFrame:
    """Principal-component projection of ``z`` (uncentred; distances are unaffected).

    A vector of fewer columns than ``k`` keeps them all. No matrix of width x width is made (see ``projection``).
    """
    points = cut(points)
    width = points.select(F.max(F.size("z"))).first()[0]
    if not width or width <= k:
        return points
    axes, _, _ = projection.principal_axes(points.select("z"), k)
    return projection.projected(points, axes)


def unsupervised_metrics(points: DataFrame, components: int | None = 32) -> DataFrame:
    """One row sil, chs, dbs, rounded to five decimals; NULL where undefined."""
    if components:
        points = reduce_dimensions(points, components)
    points = cut(points.select("id", "z", "label"))
    return silhouette(points).select(
        F.round("sil", 5).alias("sil"), F.round(calinski_harabasz(points).scalar(), 5).alias("chs"),
        F.round(davies_bouldin(points).scalar(), 5).alias("dbs"))
