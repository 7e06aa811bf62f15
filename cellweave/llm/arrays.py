"""Array code shared by the operators: texts as byte buffers, words, rolling hashes, packed exchanges.

A batch of texts is one contiguous byte array plus offsets, so that tokenising and hashing cost a few array passes
instead of a Python step for each word. All hashes wrap at 64 bits.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.session import ship

#: rows of texts that come to a Python worker at once, where the session has Spark's own default of 10,000
BATCH_ROWS = 2048
#: bytes of text that one array step works on; single longer texts make a longer step
STEP_BYTES = 1 << 18
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)
#: primes just below 2^32, each with a base of its own
_FIELDS = ((4294967291, 2654435761), (4294967279, 3266489917))


def ready(spark: SparkSession) -> SparkSession:
    """Ship the package and keep the batches of whole texts small."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key, "10000") == "10000":
        spark.conf.set(key, str(BATCH_ROWS))
    return ship(spark)


def lean(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` over a task's batches, after which the worker gives back the memory that its allocators keep.

    Workers serve many tasks and stages; what one of them has freed would count against the executor as long as they live.
    """
    def task(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(it)
        finally:
            give_back()

    return task


def give_back() -> None:
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError, TypeError):  # only glibc has it
        pass


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = x ^ (x >> np.uint64(32))
    x = x * _MIX
    x = x ^ (x >> np.uint64(29))
    x = x * _ODD
    return x ^ (x >> np.uint64(32))


def power(base: np.uint64, n: int) -> np.uint64:
    return np.uint64(pow(int(base), n, 1 << 64))


def text_buffer(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and the n + 1 offsets of a text column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    if column.null_count:
        column = column.fill_null("" if not pa.types.is_binary(column.type) and not pa.types.is_large_binary(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    body = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)
    return body[at[0]:at[-1]], at - at[0]


def steps(offsets: np.ndarray, size: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of whole texts of about ``size`` bytes; a longer text stands alone."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + size, "right")) - 1)
        yield first, min(last, n)
        first = min(last, n)


def runs(mask: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of True that don't cross a text's boundary."""
    n = len(mask)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first, last = mask.copy(), mask.copy()
    first[1:] &= ~mask[:-1]
    last[:-1] &= ~mask[1:]
    inner = offsets[(offsets > 0) & (offsets < n)]
    first[inner] = mask[inner]
    last[inner - 1] = mask[inner - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def prefix_hash(data: np.ndarray, base: np.uint64 = _ODD) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums of byte x base^position, and powers of the base's inverse: a range's hash needs one look at each end."""
    n = len(data)
    ups = np.full(n, base, np.uint64)
    downs = np.full(n + 1, np.uint64(pow(int(base), -1, 1 << 64)), np.uint64)
    if n:
        ups[0] = 1
    downs[0] = 1
    ups, downs = np.multiply.accumulate(ups), np.multiply.accumulate(downs)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * ups, out=sums[1:])
    return sums, downs


def range_hash(prefix: tuple[np.ndarray, np.ndarray], starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of the bytes of each range; equal bytes give equal hashes wherever they stand."""
    sums, downs = prefix
    raw = (sums[ends] - sums[starts]) * downs[starts]
    return mix(raw + (ends - starts).astype(np.uint64) * _MIX)


def _modulo(x: np.ndarray, prime: int) -> np.ndarray:
    return x - x // np.uint64(prime) * np.uint64(prime)


def _field_powers(base: int, prime: int, n: int) -> np.ndarray:
    """base^0 .. base^(n - 1) modulo a prime below 2^32."""
    out = np.ones(1, np.uint64)
    while len(out) < n:
        out = np.concatenate([out, _modulo(out * np.uint64(pow(base, len(out), prime)), prime)])
    return out[:n]


_step_powers = lru_cache(maxsize=8)(_field_powers)


def word_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of the bytes of each range, from polynomials modulo two primes.

    Two different ranges of at most L bytes agree in both with a chance of about (L / 2^32)^2 over the choice of bases. (A
    polynomial modulo 2^64, as in ``range_hash``, has pairs of ranges that agree whatever its base.)
    """
    n = len(data)
    lengths = (ends - starts).astype(np.uint64)
    out = mix(lengths)
    for prime, base in _FIELDS:
        make, size = (_step_powers, STEP_BYTES + 1) if n <= STEP_BYTES else (_field_powers, n + 1)
        ups, downs = make(base, prime, size), make(pow(base, -1, prime), prime, size)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_modulo((data.astype(np.uint64) + np.uint64(1)) * ups[:n], prime), out=sums[1:])
        value = _modulo(_modulo(sums[ends] - sums[starts], prime) * downs[starts], prime)
        out = mix(out ^ value) if prime == _FIELDS[0][0] else mix(out + (value << np.uint64(32)) + value)
    return out


def gram_hash(data: np.ndarray, k: int) -> np.ndarray:
    """Hash of the ``k`` bytes from every position, by doubling; len(data) - k + 1 values."""
    n = len(data)
    if n < k:
        return np.zeros(0, np.uint64)
    part = mix(data.astype(np.uint64) + _ODD)
    size, base, out, done = 1, _ODD, None, 0
    rest = k
    while rest:
        if rest & 1:
            if out is None:
                out, done = part, size
            else:
                length = n - done - size + 1
                out = out[:length] * base + part[done:done + length]
                done += size
        rest >>= 1
        if rest:
            part = part[:-size] * base + part[size:]
            base = power(base, 2)
            size *= 2
    return mix(out)


def sliding(op: np.ufunc, x: np.ndarray, width: int) -> np.ndarray:
    """Minimum or maximum of every ``width`` neighbours."""
    size = 1
    while 2 * size <= width and len(x) > size:
        x = op(x[:-size], x[size:])
        size *= 2
    if size < width:
        x = op(x[:max(0, len(x) - (width - size))], x[width - size:])
    return x


def owner_of(offsets: np.ndarray, positions: np.ndarray) -> np.ndarray:
    """The text that each byte position is in."""
    return np.searchsorted(offsets, positions, "right") - 1


def buckets(spark: SparkSession) -> int:
    """Partitions of a packed exchange: the session's own setting, which the user fits to the data."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def packed(rows: np.ndarray, bucket: np.ndarray, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """The rows of each bucket together."""
    order = np.argsort(bucket, kind="stable")
    rows, bucket = rows[order], bucket[order]
    cuts = np.searchsorted(bucket, np.arange(n + 1))
    for b in np.flatnonzero(np.diff(cuts)):
        yield int(b), rows[cuts[b]:cuts[b + 1]]


def batches(rows: Iterable[tuple], schema: pa.Schema, size: int = 1 << 23) -> Iterator[pa.RecordBatch]:
    """Rows as record batches of about ``size`` bytes."""
    held, weight = [], 0
    for row in rows:
        held.append(row)
        weight += sum(len(x) if hasattr(x, "__len__") else 8 for x in row)
        if weight >= size:
            yield _batch(held, schema)
            held, weight = [], 0
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows), schema, strict=True)], schema=schema)


def by_bucket(df: DataFrame, n: int, column: str = "bucket") -> DataFrame:
    """Deal rows to ``n`` partitions by a bucket number that is already a hash."""
    return df.repartition(n, F.col(column))


def crc_fold(column: Column, folds: int) -> Column:
    """crc32 of a value's text modulo ``folds``: the fold of a row."""
    return F.crc32(column.cast("string").cast("binary")) % F.lit(folds)
