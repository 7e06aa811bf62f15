"""Principal components of wide vectors, without a width x width matrix anywhere.

A randomised range finder: a random block of directions is improved by products with the (uncentred) covariance, and the best
directions are read off the whole subspace met so far. A product is one pass over the vectors in which each task adds up a
width x block matrix; the driver holds only such thin matrices. Singular values come from a tall-skinny QR: every task reduces
its rows to one small triangle, triangles are merged in two steps, so nothing is squared.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweave.config import MODEL_BYTES
from cellweave.session import ship

#: directions of a block beyond those asked for
OVERSAMPLING = 16
#: blocks that the subspace may hold before it is cut back to its best directions
BLOCKS = 6
MOST_PASSES = 100
#: residual at which a direction is an eigenvector, as a share of the largest eigenvalue
TOLERANCE = 1e-10
SLICE_BYTES = 1 << 20
_PIECE = "slice int, part int, body binary"


def _rows(batch: pa.RecordBatch, width: int) -> np.ndarray:
    z = batch.column(0)
    return np.asarray(z.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(z), width)


def _pieces(part: int, pieces: list[tuple[int, np.ndarray]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([s for s, _ in pieces], pa.int32()), pa.array([part] * len(pieces), pa.int32()),
         pa.array([np.ascontiguousarray(x).tobytes() for _, x in pieces], pa.binary())], ["slice", "part", "body"])


def _reduced(vectors: DataFrame, first: Callable[[Iterator[pa.RecordBatch]], list[tuple[int, np.ndarray]]],
             merge: Callable[[np.ndarray, np.ndarray], np.ndarray], columns: int) -> dict[int, np.ndarray]:
    """Each task's pieces, merged by slice: by the square root of the number of tasks first, then by slice alone."""
    fan = max(1, int(np.ceil(np.sqrt(vectors.rdd.getNumPartitions()))))

    def made(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        yield _pieces(TaskContext.get().partitionId() % fan, first(it))

    def merged(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in it:
            for number, body in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                piece = np.frombuffer(body, np.float64).reshape(-1, columns)
                held[number] = merge(held[number], piece) if number in held else piece
        for number, piece in held.items():
            yield _pieces(0, [(number, piece)])

    pieces = vectors.mapInArrow(made, _PIECE).repartition("slice", "part").mapInArrow(merged, _PIECE)
    pieces = pieces.repartition("slice").mapInArrow(merged, _PIECE)
    return {r.slice: np.frombuffer(bytes(r.body), np.float64).reshape(-1, columns) for r in pieces.toLocalIterator()}


def covariance_product(vectors: DataFrame, width: int, block: np.ndarray) -> np.ndarray:
    """Sum over all vectors of z (z' block), in one pass."""
    columns = block.shape[1]
    step = max(1, SLICE_BYTES // (8 * columns))

    def first(it):
        total = np.zeros((width, columns))
        for batch in it:
            z = _rows(batch, width)
            total += z.T @ (z @ block)
        return [(n, total[lo:lo + step]) for n, lo in enumerate(range(0, width, step))]

    found = _reduced(vectors, first, np.add, columns)
    return np.concatenate([found[n] for n in sorted(found)])


def triangle(vectors: DataFrame, width: int, block: np.ndarray) -> np.ndarray:
    """R of the QR factors of (all vectors) x block, in one pass."""
    columns = block.shape[1]
    merge = lambda a, b: np.linalg.qr(np.concatenate([a, b]), mode="r")

    def first(it):
        held = np.zeros((columns, columns))
        for batch in it:
            held = merge(held, _rows(batch, width) @ block)
        return [(0, held)]

    return _reduced(vectors, first, merge, columns)[0]


def _new_directions(wanted: np.ndarray, basis: np.ndarray, room: int) -> np.ndarray:
    """Orthonormal directions of ``wanted`` outside ``basis``, at most ``room``."""
    size = np.linalg.norm(wanted, axis=0)
    wanted = wanted[:, size > 0] / size[size > 0]
    for _ in range(2):
        wanted = wanted - basis @ (basis.T @ wanted)
        u, s, _ = np.linalg.svd(wanted, full_matrices=False)
        wanted = u[:, s > 1e-8 * max(1.0, s[0] if len(s) else 0.0)][:, :room]
    return wanted


def principal_axes(vectors: DataFrame, k: int, seed: int = 345) -> tuple[np.ndarray, np.ndarray, int]:
    """(width x k axes, their singular values, passes over the data) of one array column of equal lengths.

    Raises if lengths differ, a component isn't finite, the thin matrices exceed ``MODEL_BYTES`` or ``MOST_PASSES`` don't
    suffice. Where singular values k and k + 1 are equal, the axes are one choice of many.
    """
    ship(vectors.sparkSession)
    name = vectors.columns[0]
    vectors = vectors.select(F.col(name).cast("array<double>").alias("z")).where(F.col("z").isNotNull())
    low, width = vectors.agg(F.min(F.size("z")), F.max(F.size("z"))).first()
    if not width or low != width:
        raise ValueError(f"vectors have {low} to {width} columns; principal components need one length above zero")
    k = min(k, width)
    size = min(width, k + OVERSAMPLING)
    if 8 * width * size * 2 * (BLOCKS + 1) > MODEL_BYTES:
        raise ValueError(f"{width} columns by {size} directions exceed the bound of {MODEL_BYTES} bytes")
    block = np.linalg.qr(np.random.default_rng(seed).standard_normal((width, size)))[0]
    basis = image = np.zeros((width, 0))
    for passes in range(1, MOST_PASSES + 1):
        product = covariance_product(vectors, width, block)
        if not np.isfinite(product).all():
            raise ValueError("principal components need finite vectors")
        basis, image = np.concatenate([basis, block], 1), np.concatenate([image, product], 1)
        small = basis.T @ image
        values, turn = np.linalg.eigh((small + small.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        axes, moved = basis @ turn[:, :size], image @ turn[:, :size]
        rest = moved - axes * values[:size]
        if np.linalg.norm(rest[:, :k], axis=0).max() <= TOLERANCE * values[0] or basis.shape[1] == width:
            break
        if basis.shape[1] + size > BLOCKS * size:
            keep = 2 * size
            basis, image = basis @ turn[:, :keep], image @ turn[:, :keep]
        block = _new_directions(rest, basis, width - basis.shape[1])
        if not block.shape[1]:
            break
    else:
        raise RuntimeError(f"principal components did not settle in {MOST_PASSES} passes")
    axes = np.linalg.qr(axes[:, :k])[0]
    _, singular, turn = np.linalg.svd(triangle(vectors, width, axes))
    axes = axes @ turn.T
    return axes * np.where(axes[np.abs(axes).argmax(0), np.arange(k)] < 0, -1.0, 1.0), singular, passes + 1


def projected(points: DataFrame, axes: np.ndarray, column: str = "z") -> DataFrame:
    """``column`` replaced by its coordinates along the axes; null stays null."""
    @F.pandas_udf("array<double>")
    def turned(z: pd.Series) -> pd.Series:
        some = z.notna().to_numpy()
        out = pd.Series([None] * len(z), dtype=object)
        if some.any():
            out[some] = pd.Series(list(np.stack(z[some].to_numpy()) @ axes), index=out.index[some], dtype=object)
        return out

    return points.withColumn(column, turned(F.col(column).cast("array<double>")))
