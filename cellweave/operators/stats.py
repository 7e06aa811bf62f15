"""Gene statistics and gene selection."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweave.operators.keys import lookup_join
from cellweave.operators.normalize import column_moments
from cellweave.operators.quantile import exact_quantiles
from cellweave.session import cut

TOP_GENES = 5000
# Bound of the trend's n and of |ln b|: beyond it the curve no longer changes in doubles.
BOX = 60.0
# Starts of the trend's search: n, and ln b from where both terms of the denominator are equal in the middle.
_BENDS, _OFFSETS = (-8.0, -4.0, -2.0, -1.0, 0.5, 1.0, 2.0, 4.0, 8.0, 16.0), (-9.0, -6.0, -3.0, -1.0, 0.0, 1.0, 3.0, 6.0, 9.0)


def gene_stats(expr: DataFrame, n_cells: int) -> DataFrame:
    """Mean and population variance per gene over all cells, zeros included."""
    return column_moments(expr, n_cells).select(
        "gene", "mean", (F.col("ss") / F.lit(n_cells)).alias("var_pop"))


def top_variance_genes(stats: DataFrame, k: int = TOP_GENES) -> DataFrame:
    return stats.select("gene", "var_pop").orderBy(F.desc("var_pop"), "gene").limit(k)


def sd_median(stats: DataFrame) -> float | None:
    """Median over genes of the population deviation."""
    return exact_quantiles(stats.select(F.sqrt("var_pop").alias("sd")), "sd", [0.5])[0]


def trend(mean, a: float, n: float, b: float):
    """Expected variance a*mean / (mean^n + b) as a column."""
    return F.lit(a) * mean / (F.pow(mean, F.lit(n)) + F.lit(b))


def fit_trend(stats: DataFrame, max_steps: int = 30, tol: float = 1e-9) -> tuple[float, float, float]:
    """Least-squares fit (a, n, b) of the mean-variance trend.

    For fixed n and b the best a is a ratio of two sums, so the search is over n and ln b alone, both without a scale. One
    aggregate scores a grid of starts around the middle of the means, with (1, 1) among them; the best is refined by damped
    steps, one aggregate each, which scores several of them at once. The search ends where the residual is orthogonal to
    what n and ln b can change (cosine below ``tol``), or where no step lowers the squared error; data along a flat valley
    of (a, b) end there too, at the edge of ``BOX`` if need be, with the error of the valley. Raises RuntimeError if
    neither is reached in ``max_steps`` passes. Columns without a positive mean take no part; without any, the start
    (1, 1, 1) is returned.
    """
    data = cut(stats.filter("mean > 0").select(F.col("mean").alias("m"), F.ln("mean").alias("l"), F.col("var_pop").alias("v")))
    middle = data.agg(F.avg("l")).first()[0]
    if middle is None:
        return 1.0, 1.0, 1.0
    return _projected_search(lambda at: _projected_sums(data, at), middle, max_steps, tol)


def _projected_sums(data: DataFrame, at: list[tuple[float, float]]) -> list[np.ndarray]:
    """For each (n, ln b): the sums of products of v, the curve g of unit a, and g's slopes in n and ln b.

    The curve is scaled by 1 + b, which a takes up; a slope's part along the curve is left out, since a takes that up too.
    """
    point = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(n).alias("n"), F.lit(b).alias("b")) for k, (n, b) in enumerate(at)]))
    rest = 1.0 / (1.0 + F.exp(F.col("p.n") * F.col("l") - F.col("p.b")))  # b / (m^n + b)
    curve = F.col("m") * F.col("rest") * (1.0 + F.exp(-F.col("p.b")))
    rows = data.withColumn("p", point).withColumn("rest", rest).withColumn("g", curve).select(
        F.col("p.k").alias("k"), "v", "g", (-F.col("g") * F.col("l") * (1.0 - F.col("rest"))).alias("dn"), (-F.col("g") * F.col("rest")).alias("db"))
    names = ("v", "g", "dn", "db")
    found = rows.groupBy("k").agg(*[F.sum(F.col(x) * F.col(y)).alias(f"{i}{j}")
                                    for i, x in enumerate(names) for j, y in enumerate(names) if i <= j]).collect()
    out = [np.full((4, 4), np.nan) for _ in at]
    for row in found:
        for i in range(4):
            for j in range(i, 4):
                out[row["k"]][i, j] = out[row["k"]][j, i] = row[f"{i}{j}"]
    return out


def _projected_search(score, middle: float, max_steps: int, tol: float) -> tuple[float, float, float]:
    """``score(points)`` gives for each (n, ln b) the 4 x 4 sums of ``_projected_sums``; ``middle`` is a typical ln mean."""
    starts = [(1.0, 0.0)] + [(n, float(np.clip(n * middle + off, -BOX, BOX))) for n in _BENDS for off in _OFFSETS]
    graded = [(_reduced(s), s, x) for s, x in zip(score(starts), starts)]
    (error, scale, normal, slope), sums, first = min(graded, key=lambda c: c[0][0])
    at = np.array(first)
    damping = 1e-2
    for _ in range(max_steps - 1):
        free = (np.abs(at) < BOX) | (slope * at < 0)  # at the edge only steps back into the box count
        free &= np.diag(normal) > 1e-24 * scale * scale * sums[1, 1]
        off = _cosine(error, normal, slope, free)
        if error <= 1e-15 * sums[0, 0] or off <= tol:
            return _trend_of(at, scale)
        keep = np.ix_(free, free)
        tried = []
        for grade in (-3, -2, -1, 0, 1, 2, 4, 6):
            step = np.zeros(2)
            lifted = normal[keep] + damping * 10.0 ** grade * np.diag(np.diag(normal)[free])
            step[free] = np.linalg.lstsq(lifted, slope[free], rcond=None)[0]
            tried.append((damping * 10.0 ** grade, np.clip(at + step, -BOX, BOX)))
        scored = [(_reduced(s), s, d, x) for s, (d, x) in zip(score([tuple(float(v) for v in x) for _, x in tried]), tried)]
        best = min(scored, key=lambda c: c[0][0])
        noise = 1e-12 * error + 1e-15 * sums[0, 0]
        if best[0][0] > error - noise:  # as good as equal errors: the residual's angle tells more
            best = min((c for c in scored if c[0][0] <= error + noise), default=None, key=lambda c: _cosine(*c[0][:1], *c[0][2:], free))
            if best is None or not _cosine(*best[0][:1], *best[0][2:], free) < 0.9 * off:
                return _trend_of(at, scale)
        (error, scale, normal, slope), sums, damping, at = best
        damping = min(max(damping, 1e-9), 1e9)
    raise RuntimeError(f"the mean-variance trend did not converge in {max_steps} steps")


def _cosine(error: float, normal: np.ndarray, slope: np.ndarray, free: np.ndarray) -> float:
    """Largest cosine between the residual and what a free parameter can change."""
    size = np.sqrt(np.diag(normal)[free] * error)
    return float((np.abs(slope[free])[size > 0] / size[size > 0]).max(initial=0.0))


def _reduced(sums: np.ndarray) -> tuple[float, float, np.ndarray, np.ndarray]:
    """(squared error, scaled a, J'J, J'r) with a at its best; an infinite error where the sums aren't finite."""
    if not np.isfinite(sums).all() or not sums[1, 1] > 0:
        return np.inf, 0.0, np.eye(2), np.zeros(2)
    scale = sums[0, 1] / sums[1, 1]
    along = sums[2:, 1]
    normal = scale * scale * (sums[2:, 2:] - np.outer(along, along) / sums[1, 1])
    return max(0.0, sums[0, 0] - scale * sums[0, 1]), scale, normal, scale * (sums[2:, 0] - scale * along)


def _trend_of(at: np.ndarray, scale: float) -> tuple[float, float, float]:
    return float(scale * (1.0 + math.exp(at[1]))), float(at[0]), float(math.exp(at[1]))


def trend_excess(stats: DataFrame, theta: tuple[float, float, float]) -> DataFrame:
    """Observed minus expected variance per gene."""
    return stats.select("gene", (F.col("var_pop") - trend(F.col("mean"), *theta)).alias("excess"))


def top_excess_genes(stats: DataFrame, theta: tuple[float, float, float], k: int = TOP_GENES) -> DataFrame:
    return trend_excess(stats, theta).orderBy(F.desc("excess"), "gene").limit(k)


def select_genes(expr: DataFrame, n_cells: int, kind: str, k: int = TOP_GENES) -> DataFrame:
    """Keep the entries of the chosen genes; ``kind`` is variance, mean-variance or none."""
    if kind == "none":
        return expr
    if kind not in ("variance", "mean-variance"):
        raise ValueError(f"unknown gene filter {kind!r}: use variance, mean-variance or none")
    stats = cut(gene_stats(expr, n_cells))
    if kind == "variance":
        chosen = top_variance_genes(stats, k)
    else:
        chosen = top_excess_genes(stats, fit_trend(stats), k)
    return lookup_join(expr, chosen.select("gene"), "gene", small_rows=k, how="left_semi")
