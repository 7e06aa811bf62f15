"""Pairwise must-link / cannot-link constraints.

Candidates are random draws, not all pairs: draw t names two positions through a
fixed integer recurrence. Draws are classified, repeated pairs keep their first
draw, and the first ``num`` accepted draws are the result. When a range of draws
does not give enough, a longer one is taken; the outcome does not depend on that.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellweave.operators.keys import dense_index, lookup_join
from cellweave.operators.kmeans import kmeans
from cellweave.operators.metrics import vector_distance
from cellweave.operators.quantile import exact_quantiles, order_statistic
from cellweave.operators.similarity import distance_quantiles
from cellweave.session import cut

MUST, CANNOT = "ML", "CL"

# Modulus and multipliers of the draw recurrence.
_P = 2_147_483_647
_M1, _M2, _M3 = 48_271, 69_621, 16_807


def _positions(draw: Column, n: int, seed: int) -> tuple[Column, Column]:
    mod = lambda x: F.pmod(x, F.lit(_P))
    turn = F.floor(draw / _P)  # the recurrence's period is over: go on from another start
    h1 = mod((mod(draw) + F.lit(1 + seed) + turn * F.lit(_M3)) * F.lit(_M1))
    h2 = mod(h1 * F.lit(_M2))
    h3 = mod(h2 * F.lit(_M3))
    h4 = mod(h3 * F.lit(_M1) + F.lit(12_345))
    h5 = mod(h4 * F.lit(_M2))
    size = F.lit(n).cast("long")
    return F.pmod(h2 * F.lit(_P) + h3, size), F.pmod(h4 * F.lit(_P) + h5, size)


def _all_positions(spark, n: int, after: int) -> DataFrame:
    """Every pair of positions, numbered behind the draws made so far."""
    k = F.col("id")
    high = F.floor((F.sqrt(k * 8 + 1) + 1) / 2)
    high = high + F.when(high * (high - 1) / 2 > k, -1).when((high + 1) * high / 2 <= k, 1).otherwise(0)  # root rounded
    return spark.range(n * (n - 1) // 2).select((k + after).alias("draw"), (k - high * (high - 1) / 2).cast("long").alias("pa"), high.cast("long").alias("pb"))


def draw_constraints(points: DataFrame, n: int, num: int, kind: Callable[[Callable[[str], Column], Callable[[str], Column]], Column],
                     seed: int = 0) -> DataFrame:
    """(draw, a, b, kind): the first ``num`` accepted draws over ``points(pos, id, ...)``.

    ``kind(first, second)`` is a column over the fields of both points: ML, CL or
    NULL to reject. If draws give too few although there are many more of them than
    pairs, all pairs are judged; a warning says if even these are fewer than ``num``.
    """
    spark = points.sparkSession
    fields = [c for c in points.columns if c != "pos"]

    def judge(pairs: DataFrame) -> DataFrame:
        for end in ("a", "b"):
            side = points.select(F.col("pos").alias("p" + end), *[F.col(f).alias(f + "_" + end) for f in fields])
            pairs = lookup_join(pairs, side, "p" + end, n)
        first, second = (lambda f: F.col(f + "_a")), (lambda f: F.col(f + "_b"))
        return pairs.select("draw", first("id").alias("a"), second("id").alias("b"), kind(first, second).alias("kind")).filter("kind IS NOT NULL")

    draws, possible = 4 * num + 64, n * (n - 1) // 2
    while True:
        a, b = _positions(F.col("draw"), n, seed)
        pairs = spark.range(draws).select(F.col("id").alias("draw")).select("draw", a.alias("pa"), b.alias("pb")).filter("pa <> pb")
        whole = draws > 64 * (possible + 1)
        judged = judge(pairs.union(_all_positions(spark, n, draws)) if whole else pairs)
        fresh = cut(judged.groupBy(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi"))
                    .agg(F.min(F.struct("draw", "a", "b", "kind")).alias("e")).select("e.*"))
        found = fresh.count()
        if found >= num or found >= possible or whole:
            break
        draws *= 4
    if found < num:
        warnings.warn(f"{num} constraints were asked for; only {found} pairs qualify", stacklevel=2)
    if found > num:
        last = order_statistic(fresh.select(F.col("draw").cast("double").alias("v")), num - 1, found)
        fresh = fresh.filter(F.col("draw") <= int(last))
    return fresh


def numbered(points: DataFrame) -> tuple[DataFrame, int]:
    indexed = cut(dense_index(points, ["id"], "pos"))
    return indexed, indexed.count()


def label_constraints(points: DataFrame, num: int, error_rate: float = 0.0, seed: int = 0) -> DataFrame:
    """Same label must link, different labels must not; the first error_rate * num are flipped."""
    indexed, n = numbered(points.select("id", "label"))
    same = lambda x, y: F.when(x("label") == y("label"), MUST).otherwise(CANNOT)
    found = draw_constraints(indexed, n, num, same, seed)
    wrong = error_rate * num
    if wrong > 0:
        rows = found.count()
        last = order_statistic(found.select(F.col("draw").cast("double").alias("v")),
                               min(rows, int(-(-wrong // 1))) - 1, rows)
        flip = F.when(F.col("kind") == MUST, CANNOT).otherwise(MUST)
        found = found.withColumn("kind", F.when(F.col("draw") <= int(last), flip).otherwise(F.col("kind")))
    return found


def distance_constraints(points: DataFrame, num: int, near: float = 0.1, far: float = 0.9, seed: int = 0) -> DataFrame:
    """Closer than the ``near`` quantile of all distances links, farther than ``far`` must not."""
    points = points.select(F.col("id").cast("long"), F.col("z").cast("array<double>"))
    indexed, n = numbered(points)
    low, high = distance_quantiles(indexed.select("id", "z"), n, [near, far])

    def kind(x, y):
        d = vector_distance(x("z"), y("z"))
        return F.when(d < low, MUST).when(d > high, CANNOT)

    return draw_constraints(indexed, n, num, kind, seed)


def cluster_constraints(points: DataFrame, num: int, far: float = 0.8, seed: int = 0, n_clusters: int | None = None) -> DataFrame:
    """Same cluster links; different clusters farther than the ``far`` quantile must not.

    ``n_clusters`` clusters the points first; without it they carry a ``label``.
    """
    if n_clusters:
        found, _ = kmeans(points.select("id", "z"), n_clusters)
        points = points.select("id", "z").join(found.select("id", F.col("cluster").cast("long").alias("label")), "id")
    points = points.select(F.col("id").cast("long"), F.col("z").cast("array<double>"), "label")
    indexed, n = numbered(points)
    high, = distance_quantiles(indexed.select("id", "z"), n, [far])

    def kind(x, y):
        return F.when(x("label") == y("label"), MUST).when(vector_distance(x("z"), y("z")) > high, CANNOT)

    return draw_constraints(indexed, n, num, kind, seed)


# Tests of the marker rules, as (marker, side of the cut, cut's marker, level).
# A rule holds for a pair when all tests of its first list hold for one cell and all
# tests of its second list for the other.
_OPPOSITE = ([(0, "<", 0, "low"), (1, ">", 1, "high")], [(0, ">", 0, "high"), (1, "<", 1, "low")])
_TOGETHER = [
    ([(1, ">", 1, "top"), (2, ">", 2, "top")], [(1, ">", 1, "top"), (2, ">", 2, "top")]),
    ([(1, ">", 1, "top"), (2, "<", 2, "bottom")], [(1, ">", 1, "top"), (2, "<", 2, "bottom")]),
    ([(0, ">", 0, "top"), (2, ">", 2, "top")], [(1, ">", 0, "top"), (2, ">", 2, "top")]),
    ([(0, ">", 0, "top"), (2, "<", 2, "bottom"), (3, ">", 3, "top")],
     [(1, ">", 0, "top"), (2, "<", 2, "bottom"), (3, ">", 3, "top")]),
    ([(0, ">", 0, "top"), (2, "<", 2, "bottom"), (3, "<", 3, "bottom")],
     [(1, ">", 0, "top"), (2, "<", 2, "bottom"), (3, "<", 3, "bottom")]),
]


def marker_constraints(points: DataFrame, num: int, low: float = 0.4, high: float = 0.6, bottom: float = 0.2,
                       top: float = 0.8, seed: int = 0) -> DataFrame:
    """Rules on four marker columns m0..m3 of ``points(id, m0, m1, m2, m3)``."""
    levels = {"low": low, "high": high, "bottom": bottom, "top": top}
    cuts = {(m, name): q for m in range(4)
            for name, q in zip(levels, exact_quantiles(points, f"m{m}", list(levels.values())))}
    indexed, n = numbered(points.select("id", "m0", "m1", "m2", "m3"))

    def holds(cell, tests):
        result = F.lit(True)
        for marker, side, of, level in tests:
            value, limit = cell(f"m{marker}"), F.lit(cuts[of, level])
            result = result & ((value < limit) if side == "<" else (value > limit))
        return result

    def kind(x, y):
        one, two = _OPPOSITE
        rule = F.when((holds(x, one) & holds(y, two)) | (holds(y, one) & holds(x, two)), CANNOT)
        for one, two in _TOGETHER:
            rule = rule.when(holds(x, one) & holds(y, two), MUST)
        return rule

    return draw_constraints(indexed, n, num, kind, seed)
