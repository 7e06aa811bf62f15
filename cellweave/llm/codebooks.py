"""Vector codes: codebooks of the parts of vectors, trained and searched in whole numbers by Orchard's method.

Every codebook entry keeps the list of all entries in order of their distance to it. A search walks the list of the best
entry so far, jumps to the list of any entry that is nearer, marks entries it has met, and stops where the list goes
beyond twice the current distance: no entry further off can be as near. A batch of vectors walks in step, each on its
own list.

A round is one pass over the vectors. Tasks send each entry's sums once, so what is shuffled and what reaches the driver
are as large as the codebooks, whatever the number of vectors. Sums are whole numbers; neither the partitioning nor a
task that runs again changes a result.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweave.llm import arrays as A
from cellweave.operators.keys import lookup_join
from cellweave.session import cut

SCALE = 1024
#: vectors that walk in step, and list places that a walk looks at in one step
WALKERS, STRIDE = 2048, 8
#: entries compared first, to start on a near one's list
STARTS = 8
#: squared distances below this bound are exact in doubles; larger ones are Python integers
EXACT = 2.0 ** 52
LONG = (1 << 63) - 1


class Book:
    """The entries of one part, with the distance-sorted neighbour list of each."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        apart = ((entries[:, None, :] - entries[None, :, :]) ** 2).sum(axis=2)
        self.order = np.argsort(apart, axis=1, kind="stable")
        self.gap = np.take_along_axis(apart, self.order, axis=1)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Nearest entry of each row, ties to the lower index, and its squared distance."""
        found = [self._walk(x[i:i + WALKERS]) for i in range(0, len(x), WALKERS)]
        return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])

    def _walk(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n, k = len(x), len(self.entries)
        starts = np.unique(np.linspace(0, k - 1, min(STARTS, k)).astype(int))
        first = ((x[:, None, :] - self.entries[None, starts, :]) ** 2).sum(axis=2)
        pick = first.argmin(axis=1)
        best, dist = starts[pick], first[np.arange(n), pick]
        met = np.zeros((n, k), bool)
        met[:, starts] = True
        place = np.zeros(n, np.int64)
        walking = np.arange(n)
        ahead = np.arange(STRIDE)
        while len(walking):
            spots = place[walking][:, None] + ahead
            inside = spots < k
            spots = np.minimum(spots, k - 1)
            home = best[walking][:, None]
            near = self.order[home, spots]
            reach = inside & (self.gap[home, spots] <= 4 * dist[walking][:, None]).astype(bool)
            who, step = np.nonzero(reach & ~met[walking[:, None], near])
            there = near[who, step]
            away = ((x[walking[who]] - self.entries[there]) ** 2).sum(axis=1)
            met[walking[who], there] = True
            seen = np.full(near.shape, math.inf, away.dtype if away.dtype == object else np.float64)
            seen[who, step] = away
            least = seen.min(axis=1)
            entry = np.where((seen == least[:, None]).astype(bool), near, k).min(axis=1)
            now, at = dist[walking], best[walking]
            jump = ((least < now) | ((least == now) & (entry < at))).astype(bool)
            movers = walking[jump]
            best[movers], dist[movers], place[movers] = entry[jump], least[jump], 0
            # a walk that didn't jump goes on while the whole stride was within reach
            place[walking[~jump]] += STRIDE
            walking = walking[jump | (reach.all(axis=1) & (place[walking] < k))]
        return best, dist


def kept_vectors(vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """``id``, ``label`` and ``x`` (array<double>) of the vectors that are complete and finite."""
    wide = vectors.select(F.col(id_col).alias("id"), F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("x"))
    return wide.filter(F.col("x").isNotNull() & F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < math.inf)))


def _matrix(column: pa.Array, width: int, exact: bool, scale: int = SCALE) -> np.ndarray:
    """floor(scale x component) of a batch, filled with zeros to ``width`` columns: doubles, or Python integers."""
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(column), width), np.float64 if exact else object)
    whole = np.floor(flat * scale) if exact else [
        math.floor(v * scale) if abs(v) < 2.0 ** 60 else int(v) * scale for v in flat.tolist()]
    if not exact:
        out[:] = 0
    out[np.arange(width)[None, :] < lengths[:, None]] = whole
    return out


def train(vectors: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = SCALE) -> list[np.ndarray]:
    """Codebooks, one array of (entry, component) integers for each part, from the rows of ``kept_vectors``.

    A part's entries start as that part of the ``entries`` vectors with the smallest ids (null ids last, ties by the
    vector). A round assigns every vector's part to the nearest entry and puts the floor of the mean in the entry's place;
    entries without a vector stay. Vectors of different lengths are filled with zeros to the longest, made a multiple of
    ``parts``. No vectors give empty codebooks. The result is of the codebooks' size.
    """
    longest, largest, n = vectors.agg(F.max(F.size("x")), F.max(F.array_max(F.transform("x", F.abs))), F.count("*")).first()
    if not n:
        return [np.zeros((0, 0), object)] * parts
    size = -(-longest // parts)
    seeds = [r.x for r in vectors.orderBy(F.col("id").asc_nulls_last(), "x").select("x").limit(entries).collect()]
    exact = exact_in_doubles(largest or 0.0, size, scale)
    start = _matrix(pa.array(seeds, pa.list_(pa.float64())), size * parts, exact, scale)
    books = [start[:, p * size:(p + 1) * size] for p in range(parts)]
    for _ in range(rounds):
        books = _round(vectors, books, exact, scale)
    return books


def exact_in_doubles(largest: float, size: int, scale: int = SCALE) -> bool:
    return 4.0 * (largest * scale + 1) * (largest * scale + 1) * max(1, size) < EXACT if largest < 2.0 ** 40 else False


def _round(vectors: DataFrame, books: list[np.ndarray], exact: bool, scale: int) -> list[np.ndarray]:
    parts, size = len(books), books[0].shape[1]
    k = len(books[0])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = [Book(b) for b in books]
        count = np.zeros((parts, k), np.int64)
        total = np.zeros((parts, k, size), object)
        total[:] = 0
        for batch in it:
            rows = _matrix(batch.column(0), size * parts, exact, scale)
            for p in range(parts if len(rows) else 0):
                mine = rows[:, p * size:(p + 1) * size]
                at, _ = search[p].nearest(mine)
                order = np.argsort(at, kind="stable")
                used, first = np.unique(at[order], return_index=True)
                count[p] += np.bincount(at, minlength=k)
                if size:
                    sums = np.add.reduceat(mine[order], first, axis=0)
                    total[p, used] += sums.astype(np.int64).astype(object) if exact else sums
        part, entry = np.nonzero(count)
        yield pa.RecordBatch.from_arrays([
            pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(count[part, entry], pa.int64()),
            pa.array([[str(v) for v in row] for row in total[part, entry]], pa.list_(pa.string()))], ["part", "entry", "n", "sums"])

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        n = int(rows["n"].sum())
        means = [str(sum(int(v) for v in column) // n) for column in zip(*rows["sums"])]
        return pd.DataFrame({"part": rows["part"].iloc[:1], "entry": rows["entry"].iloc[:1], "mean": [means]})

    sums = vectors.select("x").mapInArrow(run, "part int, entry int, n long, sums array<string>")
    new = [b.copy() for b in books]
    for row in sums.groupBy("part", "entry").applyInPandas(add, "part int, entry int, mean array<string>").collect():
        new[row.part][row.entry] = [int(v) for v in row["mean"]]
    return new


def assign(vectors: DataFrame, books: list[np.ndarray], scale: int = SCALE) -> DataFrame:
    """id, label, code (two or more hex digits for each part) and error (long; null beyond 64 bits) of ``kept_vectors`` rows."""
    parts, size = len(books), books[0].shape[1]
    digits = max(2, len(f"{max(0, len(books[0]) - 1):x}"))
    longest, largest = vectors.agg(F.max(F.size("x")), F.max(F.array_max(F.transform("x", F.abs)))).first()
    if longest is not None and longest > size * parts:
        raise ValueError(f"a vector of {longest} components; the codebooks have {size * parts}")
    span = max([largest or 0.0, *[float(max(abs(int(v)) for v in b.ravel()) // scale + 1) if b.size else 0.0 for b in books]])
    exact = exact_in_doubles(span, size, scale)
    books = [b.astype(np.float64 if exact else object) for b in books]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = [Book(b) for b in books]
        for batch in it:
            rows = _matrix(batch.column(2), size * parts, exact, scale)
            found = [search[p].nearest(rows[:, p * size:(p + 1) * size]) for p in range(parts)] if len(rows) else []
            codes = ["".join(f"{i:0{digits}x}" for i in row) for row in zip(*[f[0].tolist() for f in found])]
            errors = [int(sum(row)) for row in zip(*[f[1].tolist() for f in found])]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(codes, pa.string()), pa.array(
                [e if e <= LONG else None for e in errors], pa.int64())], ["id", "label", "code", "error"])

    kinds = [vectors.schema[c].dataType.simpleString() for c in ("id", "label")]
    return vectors.select("id", "label", "x").mapInArrow(run, f"id {kinds[0]}, label {kinds[1]}, code string, error long")


def digest(books: list[np.ndarray]) -> str:
    """SHA-256 of all components in decimal by part, entry and position, joined by commas."""
    text = ",".join(str(int(v)) for book in books for v in book.ravel())
    return hashlib.sha256(text.encode()).hexdigest()


def compress(vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding", label: str = "label",
             parts: int = 4, entries: int = 256, rounds: int = 4) -> DataFrame:
    """id, code, error, label_error, codebooks_sha256 of every complete, finite vector.

    Vectors that are null or hold a null or a non-finite component are left out. Repeated rows and ids are rows like any
    other; equal labels, nulls together, share label_error, which is null where a sum or an error of theirs is beyond 64
    bits. Components of any size are exact. An empty table, or one without a complete vector, gives no rows. Other columns
    are left alone.
    """
    A.ready(vectors.sparkSession)
    rows = kept_vectors(vectors, id_col, vector, label)
    books = train(rows, parts, entries, rounds)
    coded = cut(assign(rows, books).withColumn("label__", F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit(""))))
    total = F.sum(F.col("error").cast("decimal(38,0)"))
    sums = cut(coded.groupBy("label__").agg(
        F.when((F.count("error") == F.count("*")) & (total <= LONG), total.cast("long")).alias("label_error")))
    return lookup_join(coded, sums, "label__").select(
        F.col("id").alias(id_col), "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
