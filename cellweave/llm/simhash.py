"""SimHash near-duplicates by covering locality-sensitive hashing.

A covering family of bit masks turns the search for fingerprints within a Hamming radius r into exact lookups: each bit
position gets a non-zero label of r + 1 bits, and for each non-zero v of r + 1 bits, mask v keeps the positions whose
label has an odd number of ones in common with v. Up to r differing positions have labels that span at most r
dimensions, so some v is orthogonal to all of them: in table v the pair has equal keys. No pair within the radius is
lost, whatever the data.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweave.llm import arrays as A
from cellweave.llm.components import components
from cellweave.session import cut

SEED = 42
RADIUS = 2
#: distinct fingerprints of a key above which its group is split by a second family of masks
GROUP = 4096
_SPREAD = (np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").copy()
           .view(np.uint64).ravel())


def masks(positions: list[int], radius: int) -> list[int]:
    """Covering masks over some bit positions: labels 1, 2, ... are dealt in turn, so the masks are of even weight."""
    labels = {p: 1 + i % ((1 << (radius + 1)) - 1) for i, p in enumerate(positions)}
    return [sum(1 << p for p, u in labels.items() if bin(u & v).count("1") % 2) for v in range(1, 1 << (radius + 1))]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def text_shingles(data: np.ndarray, offsets: np.ndarray, shingle: int = 3, seed: int = SEED
                  ) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Ranges of texts (first, last), the XXH64 of their lower-cased word shingles in order, and how many each text has."""
    for first, last in A.steps(offsets):
        lo, at = offsets[first], offsets[first:last + 1] - offsets[first]
        body = A.LOWER[data[lo:lo + at[-1]]]
        starts, ends = A.runs(~A.SPACE[body], at)
        if not len(starts):
            yield first, last, np.zeros(0, np.uint64), np.zeros(last - first, np.int64)
            continue
        words = np.bincount(A.owner_of(at, starts), minlength=last - first)
        # words of a text moved together, one space between them
        sizes = ends - starts
        place = np.concatenate([[0], np.cumsum(sizes + 1)])
        keep = np.zeros(len(body) + 1, bool)
        keep[:-1] = ~A.SPACE[body]
        packed = np.full(place[-1], 32, np.uint8)
        spot = np.ones(place[-1], bool)
        spot[place[1:] - 1] = False
        packed[spot] = body[keep[:-1]]
        word = np.cumsum(words) - words
        count = np.where(words == 0, 0, np.maximum(words - shingle + 1, 1))
        begin = np.repeat(word - (np.cumsum(count) - count), count) + np.arange(count.sum())
        until = begin + np.minimum(np.repeat(words, count), shingle)
        raw, digest = packed.tobytes(), xxhash.xxh64_intdigest
        hashes = np.array([digest(raw[s:e], seed) for s, e in zip(place[begin].tolist(), (place[until] - 1).tolist())],
                          np.uint64)
        yield first, last, hashes, count


def text_fingerprints(data: np.ndarray, offsets: np.ndarray, shingle: int = 3, seed: int = SEED) -> np.ndarray:
    """64-bit fingerprints of lower-cased word shingles, each bit by majority over the shingles' XXH64."""
    out = np.zeros(len(offsets) - 1, np.uint64)
    for first, last, hashes, count in text_shingles(data, offsets, shingle, seed):
        out[first:last] = majority(hashes, count)
    return out


def majority(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A word per run of hashes: the bits set in over half of the run."""
    out = np.zeros(len(counts), np.uint64)
    full = np.flatnonzero(counts)
    if not len(full):
        return out
    first = (np.cumsum(counts) - counts)[full]
    # sums of at most 255 rows fit the byte lanes of a word
    parts = -(-counts[full] // 255)
    at = np.repeat(first - 255 * (np.cumsum(parts) - parts), parts) + 255 * np.arange(parts.sum())
    lanes = np.add.reduceat(_SPREAD[hashes.view(np.uint8).reshape(-1, 8)], at, axis=0)
    sums = np.add.reduceat(lanes.view(np.uint8).reshape(len(at), 64), np.cumsum(parts) - parts, axis=0, dtype=np.int64)
    bits = sums * 2 > counts[full][:, None]
    out[full] = np.packbits(bits, axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def fingerprints(docs: DataFrame, text: str = "text", shingle: int = 3, seed: int = SEED) -> DataFrame:
    """The rows of ``docs`` without ``text``, plus ``fp`` (long): the fingerprint of the whole text. Its own ``fp`` goes.

    Null, empty and blank texts get fingerprint zero; a text of fewer words than a shingle is one shingle.
    """
    A.ready(docs.sparkSession)
    rest = [c for c in docs.columns if c not in (text, "fp")]
    frame = docs.select(*rest, F.col(text).cast("string").alias("text__"))
    fields = ", ".join(f"`{c}` {frame.schema[c].dataType.simpleString()}" for c in rest)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            data, offsets = A.text_buffer(batch.column(len(rest)))
            fp = text_fingerprints(data, offsets, shingle, seed)
            yield pa.RecordBatch.from_arrays([*batch.columns[:len(rest)], pa.array(fp.view(np.int64))], [*rest, "fp"])

    return frame.mapInArrow(A.lean(run), f"{fields}, fp long" if rest else "fp long")


def group_stars(values: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of one group -> (value, smallest value of its component in the group) where these differ."""
    m = len(values)
    near = np.zeros((m, m), bool)
    for i in range(0, m, 512):
        near[i:i + 512] = np.bitwise_count(values[i:i + 512, None] ^ values[None, :]) <= radius
    label, fresh = np.arange(m), np.zeros(m, bool)
    for i in range(m):  # breadth-first from each value not reached yet
        if fresh[i]:
            continue
        edge = np.array([i])
        fresh[i] = True
        while len(edge):
            reach = near[edge].any(axis=0) & ~fresh
            edge = np.flatnonzero(reach)
            fresh |= reach
            label[edge] = i
    moved = np.flatnonzero(label != np.arange(m))
    return values[moved], values[label[moved]]


def links(found: DataFrame, radius: int = RADIUS, group: int = GROUP) -> DataFrame:
    """``found(fp)`` of distinct fingerprints -> edges ``(a, b)`` that connect exactly what links within the radius connect.

    The rows of a key lie in one group. A key with more than ``group`` fingerprints is split by covering masks over the
    bits that its own mask leaves open: the guarantee holds in it again, and a group can't exceed 2^(open bits) values.
    """
    spark = A.ready(found.sparkSession)
    first = masks(list(range(64)), radius)
    inner = [masks([p for p in range(64) if not m >> p & 1], radius) for m in first]
    keyed = found.select("fp", F.explode(F.array(*[
        F.struct(F.lit(v).alias("v"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("key"))
        for v, m in enumerate(first)])).alias("t")).select("fp", "t.v", "t.key")
    sizes = keyed.groupBy("v", "key").agg(F.count("*").alias("size")).filter("size > 1")
    second = F.element_at(F.array(*[F.array(*[F.lit(signed(m)) for m in row]) for row in inner]), F.col("v") + 1)
    shared = keyed.join(sizes, ["v", "key"])
    small = shared.filter(F.col("size") <= group).select("v", "key", F.lit(0).alias("w"), F.lit(0).cast("long").alias("sub"), "fp")
    large = shared.filter(F.col("size") > group).select("v", "key", "fp", F.posexplode(second).alias("w", "mask")).select(
        "v", "key", (F.col("w") + 1).alias("w"), F.col("fp").bitwiseAND(F.col("mask")).alias("sub"), "fp")
    n = A.buckets(spark)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in it if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held)
        keys = [table[c].to_numpy() for c in ("v", "key", "w", "sub")]
        fp = table["fp"].to_numpy()
        order = np.lexsort([fp, *keys[::-1]])
        fp = fp[order]
        changed = np.zeros(len(fp), bool)
        for k in keys:
            k = k[order]
            changed[1:] |= k[1:] != k[:-1]
        cuts = np.concatenate([[0], np.flatnonzero(changed), [len(fp)]])
        for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            if hi - lo > 1:
                b, a = group_stars(fp[lo:hi], radius)
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return small.union(large).repartition(n, "v", "key", "w", "sub").mapInArrow(A.lean(run), "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = 3, radius: int = RADIUS,
                    seed: int = SEED, group: int = GROUP) -> DataFrame:
    """Near-duplicate classes of whole texts: ``(id, fp, component)``, one row for each row of ``docs``.

    Two rows link if their fingerprints differ in at most ``radius`` bits; ``component`` is the smallest id reachable.
    Repeated rows and ids stay, in one class. A row with a null id takes part; its class has a null component only if
    no other id is in it. Null, empty and blank texts share fingerprint zero and link with one another. Columns
    other than the two named are not read. An empty table gives no rows.
    """
    rows = cut(fingerprints(docs.select(F.col(id_col).alias("id"), F.col(text).alias("text")), "text", shingle, seed))
    found = rows.groupBy("fp").agg(F.min("id").alias("least"))
    tops = components(links(found.select("fp"), radius, group))
    named = found.join(tops, found.fp == tops.node, "left").select("fp", "least", F.coalesce("component", "fp").alias("top"))
    best = named.groupBy("top").agg(F.min("least").alias("component"))
    classes = named.join(best, "top").select("fp", "component")
    return rows.join(classes, "fp").select("id", "fp", "component")
