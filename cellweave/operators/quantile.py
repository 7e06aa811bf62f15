"""Exact quantiles that do not gather the values in one place."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweave.config import QUANTILE_ROWS
from cellweave.session import cut


def exact_quantiles(df: DataFrame, column: str, probs: list[float],
                    bound: int = QUANTILE_ROWS) -> list[float | None]:
    """Linear-interpolation quantiles of ``column``, one float per probability."""
    values = df.select(F.col(column).cast("double").alias("v")).filter("v IS NOT NULL")
    n = values.count()
    if n == 0:
        return [None] * len(probs)
    if n <= bound:
        row = values.agg(F.percentile("v", F.array(*map(F.lit, probs))).alias("q")).first()
        return list(row["q"])
    places = [(n - 1) * p for p in probs]
    ranks = {r for x in places for r in (math.floor(x), math.ceil(x))}
    found = order_statistics(cut(values), sorted(ranks), n, bound)
    return [found[math.floor(x)] + (found[math.ceil(x)] - found[math.floor(x)]) * (x - math.floor(x)) for x in places]


def order_statistic(values: DataFrame, rank: int, n: int, bound: int = QUANTILE_ROWS) -> float:
    """The value of 0-based ``rank`` in ``values(v)``."""
    return order_statistics(values, [rank], n, bound)[rank]


def order_statistics(values: DataFrame, ranks: list[int], n: int, bound: int = QUANTILE_ROWS) -> dict[int, float]:
    """The values of 0-based ``ranks`` in ``values(v)``, all in the same passes.

    For each rank a bounded quantile sketch proposes two pivots around it and exact counts tell which side of them it
    lies on; one pass sketches, one counts. Each round excludes the pivots themselves, so every band shrinks, whatever
    the ties. Bands that together fit the bound are listed in a last pass.
    """
    v, found = F.col("v"), {}
    bands = {r: (None, None, 0, n) for r in ranks}  # exclusive limits, values below, values inside

    def inside(rank: int):
        low, high, _, _ = bands[rank]
        return (F.lit(True) if low is None else v > low) & (F.lit(True) if high is None else v < high)

    while wide := [r for r in bands if bands[r][3] > max(1, bound // len(ranks))]:
        probes = {}
        for r in wide:
            centre = (r - bands[r][2]) / max(bands[r][3] - 1, 1)
            probes[r] = F.array(F.lit(max(0.0, centre - 0.01)), F.lit(min(1.0, centre + 0.01)))
        pivots = values.agg(*[F.percentile_approx(F.when(inside(r), v), probes[r], F.lit(20_000)) for r in wide]).first()
        counted = values.agg(*[F.count_if(test) for left, right in pivots
                               for test in (v < left, v <= left, v < right, v <= right)]).first()
        for k, (r, (left, right)) in enumerate(zip(wide, pivots)):
            low, high, below, size = bands[r]
            lt_left, le_left, lt_right, le_right = counted[4 * k:4 * k + 4]
            if lt_left <= r < le_left or lt_right <= r < le_right:
                found[r] = left if lt_left <= r < le_left else right
                del bands[r]
            elif r < lt_left:
                bands[r] = low, left, below, lt_left - below
            elif r >= le_right:
                bands[r] = right, high, le_right, below + size - le_right
            else:
                bands[r] = left, right, le_left, lt_right - le_left
    if bands:
        near = F.lit(False)
        for r in bands:
            near = near | inside(r)
        listed = [(row["v"], row["count"]) for row in values.filter(near).groupBy("v").count().orderBy("v").collect()]
        for r, (low, high, below, _) in bands.items():
            for value, count in listed:
                if (low is None or value > low) and (high is None or value < high):
                    below += count
                    if r < below:
                        found[r] = value
                        break
    return found
