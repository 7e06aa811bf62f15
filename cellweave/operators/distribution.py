"""The data behind a histogram with its density curve: automatic bins and a kernel estimate."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweave.operators.quantile import exact_quantiles
from cellweave.session import cut

#: steps of the density's fine grid in one bandwidth; the curve is off by about a twelfth of the inverse square
STEPS = 1000


def _values(df: DataFrame, column: str) -> tuple[DataFrame, tuple]:
    """The defined, finite values as ``v``, and their count, least, greatest and sample deviation."""
    v = F.col("v")
    values = cut(df.select(F.col(column).cast("double").alias("v")).filter(v.isNotNull() & ~F.isnan(v) & (F.abs(v) < math.inf)))
    return values, tuple(values.agg(F.count("*"), F.min("v"), F.max("v"), F.stddev_samp("v")).first())


def bin_count(n: int, low: float, high: float, quartiles: tuple[float, float]) -> int:
    """Number of equal bins by numpy's rule "auto": the narrower of the Sturges and the Freedman-Diaconis width, the latter
    at least half the square-root rule's, so that close quartiles don't make many bins."""
    if n == 0 or high <= low:
        return min(n, 1)
    sturges = (high - low) / (math.log2(n) + 1)
    spread = max(2.0 * (quartiles[1] - quartiles[0]) / n ** (1 / 3), (high - low) / math.sqrt(n) / 2)
    return math.ceil((high - low) / min(spread, sturges))


def automatic_histogram(df: DataFrame, column: str) -> DataFrame:
    """(bin, low, high, n) of equal bins from the least to the greatest value, empty ones included.

    The greatest value counts in the last bin. Equal values make one bin of width 1 around them. Null, NaN and infinite
    values are left out; without values there is no bin.
    """
    values, (n, low, high, _) = _values(df, column)
    bins = bin_count(n, low or 0.0, high or 0.0, tuple(exact_quantiles(values, "v", [0.25, 0.75])))
    if n and low == high:
        low, high = low - 0.5, high + 0.5
    spark = df.sparkSession
    if not bins:
        return spark.createDataFrame([], "bin long, low double, high double, n long")
    place = F.least(F.floor((F.col("v") - F.lit(low)) * F.lit(bins / (high - low))), F.lit(bins - 1)).cast("long")
    counts = values.groupBy(place.alias("bin")).agg(F.count("*").alias("n"))
    edge = lambda k: F.lit(low) + k * F.lit(high - low) / F.lit(float(bins))
    return spark.range(bins).withColumnRenamed("id", "bin").join(counts, "bin", "left").select(
        "bin", edge(F.col("bin")).alias("low"), edge(F.col("bin") + 1).alias("high"), F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def density_curve(df: DataFrame, column: str, points: int = 200, steps: int = STEPS) -> DataFrame:
    """(x, density): Gaussian kernel estimate at ``points`` places from the least to the greatest value.

    The bandwidth is the sample deviation times n^(-1/5). Values are shared out linearly between the two next places of a
    grid, ``steps`` of them a bandwidth, which one aggregate counts; the kernel is folded with the counts by Fourier
    transform, so the work after the aggregate depends on the grid alone: some 6 steps n^(1/5) places. Fewer than two
    different values have no density.
    """
    values, (n, low, high, deviation) = _values(df, column)
    spark = df.sparkSession
    if n < 2 or not deviation or high <= low:
        return spark.createDataFrame([], "x double, density double")
    width = deviation * n ** -0.2
    step = width / steps
    spot = (F.col("v") - F.lit(low)) / F.lit(step)
    left = F.floor(spot)
    shares = F.array(F.struct(left.alias("k"), (1.0 - (spot - left)).alias("w")), F.struct((left + 1).alias("k"), (spot - left).alias("w")))
    counts = values.select(F.inline(shares)).groupBy("k").agg(F.sum("w").alias("w")).toArrow()
    size = math.ceil((high - low) / step) + 2
    mass = np.zeros(size)
    mass[counts["k"].to_numpy()] = counts["w"].to_numpy()
    reach = 9 * steps  # the kernel is nothing beyond nine bandwidths
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / steps) ** 2) / math.sqrt(2 * math.pi)
    length = 1 << (size + 2 * reach).bit_length()
    folded = np.fft.irfft(np.fft.rfft(mass, length) * np.fft.rfft(kernel, length), length)[reach:reach + size]
    x = np.linspace(low, high, points)
    density = np.interp((x - low) / step, np.arange(size), folded) / (n * width)
    return spark.createDataFrame(list(zip(x.tolist(), np.maximum(density, 0.0).tolist())), "x double, density double")
