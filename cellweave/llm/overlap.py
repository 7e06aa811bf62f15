"""Near-duplicate classes by the overlap of whole shingle sets: every pair of Jaccard similarity 4/5 or more links.

Two such texts differ in some ten of 64 SimHash bits, which covering masks can't reach (radius r takes 2^(r+1) - 1
tables). So fingerprints only find the closest pairs cheaply; all others are met by prefixes: if the shingles of all
sets are put into one order, sets of n and m shingles whose similarity is 4/5 or more share one among the first
n - ceil(4n/5) + 1 and m - ceil(4m/5) + 1. Any order will do; shingles that are frequent in a sample come last, so that
common lines stand in few prefixes.

A set's sketch is the parity of its shingles in some n to 2n bits, a 64th of the set. Sketches differ in no more bits
than the sets do in shingles, so a pair whose sketches differ too much can't link, and nearly all others do. The pairs
left are verified on the two whole sets. Each set is first held against one other only, the most similar; then what is
still open between different classes is verified, so whole sets travel about as often as there are sets, not pairs.

The first shingle that a pair shares decides: all that it shares must stand from there on in both, and of shingles that the
very same sets have, only the first is looked at. Large groups of near copies are linked to a few members first; then only
pairs of different classes are drawn.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellweave.llm import arrays as A
from cellweave.llm import simhash
from cellweave.llm.components import components
from cellweave.session import cut

SHINGLE = 5
#: frequent shingles are counted in one set of SHARE, or in about SAMPLE sets if these are more; so many are put last
SAMPLE, SHARE, COMMON = 20_000, 32, 1 << 17
#: members of a shingle above which they are linked to one of them before pairs are drawn
CROWD = 8
#: bits of the map of rows whose sets are wanted
BITS = 1 << 23


def _rows(docs: DataFrame, text: str, added: str, make, stays=None) -> DataFrame:
    """The rows without ``text``, plus what ``make`` derives from steps of texts, the columns ``added``. ``stays`` says
    which rows of a batch are taken."""
    A.ready(docs.sparkSession)
    rest = [c for c in docs.columns if c != text]
    frame = docs.select(*rest, F.col(text).cast("string").alias("text__"))
    fields = "".join(f"`{c}` {frame.schema[c].dataType.simpleString()}, " for c in rest)
    names = [*rest, *(x.split()[0] for x in added.split(", "))]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            batch = batch.filter(stays(batch)) if stays else batch
            data, offsets = A.text_buffer(batch.column(len(rest)))
            for first, last, hashes, count in simhash.text_shingles(data, offsets, SHINGLE):
                part = batch.slice(first, last - first)
                yield pa.RecordBatch.from_arrays([*part.columns[:len(rest)], *make(hashes, count)], names)

    return frame.mapInArrow(A.lean(run), fields + added)


def distinct_shingles(hashes: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct shingles of each text in ascending order, how many each has, and the hash of each set."""
    owner, values = np.repeat(np.arange(len(count)), count), hashes.view(np.int64)
    order = np.lexsort([values, owner])
    values, owner = values[order], owner[order]
    fresh = np.ones(len(values), bool)
    fresh[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    values, n = values[fresh], np.bincount(owner[fresh], minlength=len(count))
    at = np.concatenate([[0], np.cumsum(n)])
    node = np.array([xxhash.xxh3_64_intdigest(values[s:e].tobytes()) for s, e in zip(at[:-1], at[1:])], np.uint64)
    return values, n, node.view(np.int64)


def _lists(values: np.ndarray, n: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(values))


def parities(values: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sketches of the sets, as words of 64 bits: bit h modulo the size is the parity of the shingles h that fall on it.
    Sizes are powers of two, so the halves of a longer sketch fold into a shorter one by exclusive or."""
    words = 1 << np.ceil(np.log2(np.maximum(n, 64) / 64)).astype(np.int64)
    bits = np.repeat((np.cumsum(words) - words) << 6, n) + (values & (np.repeat(words << 6, n) - 1))
    parity = (np.bincount(bits, minlength=words.sum() << 6) & 1).astype(np.uint8)
    return np.packbits(parity, bitorder="little").view(np.int64), words


def sketch_gap(a: str, b: str) -> Column:
    """In how many bits two sketches differ, the longer one folded once if their sizes differ. Sets of similarity 4/5
    differ in size by less than a factor of two, so their sketches by one fold at most."""
    def folded(x: str, y: str) -> Column:
        half = (F.size(x) / 2).cast("int")
        return F.when(F.size(x) > F.size(y), F.zip_with(F.slice(x, F.lit(1), half), F.slice(x, half + 1, half), lambda u, v: u.bitwiseXOR(v))
                      ).otherwise(F.col(x))

    return F.aggregate(F.zip_with(folded(a, b), folded(b, a), lambda u, v: F.bit_count(u.bitwiseXOR(v))), F.lit(0), lambda s, x: s + x)


def shingle_sets(docs: DataFrame, text: str = "text", stays=None) -> DataFrame:
    """The rows without ``text``, plus the hash ``node`` of the text's set of shingles, and the set in ascending order. A
    text of fewer words than a shingle is one shingle."""

    def make(hashes: np.ndarray, count: np.ndarray) -> list[pa.Array]:
        values, n, node = distinct_shingles(hashes, count)
        return [pa.array(node), _lists(values, n)]

    return _rows(docs, text, "node long, shingles array<long>", make, stays)


def common_shingles(docs: DataFrame, text: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """Shingles that are frequent in a sample of the sets, ascending, and their counts in it."""
    share = min(SHARE, max(1, docs.count() // SAMPLE))
    sample = docs.select(text).filter(F.pmod(F.xxhash64(text), F.lit(share).cast("long")) == 0).distinct()
    seen = shingle_sets(sample, text).select(F.explode("shingles").alias("shingle")).groupBy("shingle").agg(
        F.count("*").alias("n")).filter("n > 1")
    top = seen.orderBy(F.desc("n"), "shingle").limit(COMMON).toArrow()
    values, counts = top["shingle"].to_numpy().astype(np.int64), top["n"].to_numpy().astype(np.int64)
    order = np.argsort(values)
    return values[order], counts[order]


def prefixes(docs: DataFrame, common: tuple[np.ndarray, np.ndarray], text: str = "text") -> DataFrame:
    """The rows without ``text``, plus ``node``, the fingerprint ``fp``, the number ``n`` of distinct shingles, their
    ``sketch``, and the first of them in the common order."""
    known, counts = common

    def make(hashes: np.ndarray, count: np.ndarray) -> list[pa.Array]:
        values, n, node = distinct_shingles(hashes, count)
        weight = np.zeros(len(values), np.int64)
        if len(known):
            at = np.minimum(np.searchsorted(known, values), len(known) - 1)
            weight = np.where(known[at] == values, counts[at], 0)
        owner = np.repeat(np.arange(len(n)), n)
        order = np.lexsort([values, weight, owner])
        size = np.where(n > 0, n - (4 * n + 4) // 5 + 1, 0)
        first = np.arange(len(values)) - np.repeat(np.cumsum(n) - n, n) < size[owner]
        fp = simhash.majority(hashes, count).view(np.int64)
        return [pa.array(node), pa.array(fp), pa.array(n.astype(np.int32)), _lists(*parities(values, n)), _lists(values[order][first], size)]

    return _rows(docs, text, "node long, fp long, n int, sketch array<long>, prefix array<long>", make)


def marks(wanted: DataFrame, row: str):
    """A test for batches whose first column is ``row``, a hash: true for the rows in ``wanted``, and for some others."""
    found = wanted.select(F.pmod(F.col(row), F.lit(BITS)).cast("int").alias("bit")).distinct().toArrow()["bit"].to_numpy()
    there = np.zeros(BITS, bool)
    there[found] = True
    bits = np.packbits(there)

    def stays(batch: pa.RecordBatch) -> pa.Array:
        at = batch.column(0).to_numpy() & (BITS - 1)
        return pa.array((bits[at >> 3] >> (7 - (at & 7)) & 1).astype(bool))

    return stays


def likely(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """``(a, b, gap)`` of the distinct pairs of nodes that may link by their sizes and sketches; of a linking pair none
    is lost."""
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct()
    left, right = (sketches.select(F.col("node").alias(c), F.col("n").alias(f"n_{c}"), F.col("sketch").alias(f"of_{c}")) for c in "ab")
    most = F.col("n_a") + F.col("n_b")
    sized = (5 * F.least("n_a", "n_b") >= 4 * F.greatest("n_a", "n_b"))
    met = pairs.join(left, "a").join(right, "b").filter(sized).select("a", "b", most.alias("most"), sketch_gap("of_a", "of_b").alias("gap"))
    # 9 |A and B| >= 4 (|A| + |B|) leaves at most a ninth of all members unshared
    return met.filter(9 * F.col("gap") <= F.col("most")).select("a", "b", "gap")


def verified(pairs: DataFrame, docs: DataFrame, rows: DataFrame, row: str, text: str) -> DataFrame:
    """The distinct pairs ``(a, b)`` of nodes whose sets have a Jaccard similarity of 4/5 or more. The sets are made again,
    of one row of ``docs`` for each node in a pair."""
    pairs = cut(pairs)
    leads = rows.groupBy("node").agg(F.min(row).alias(row))

    def ends(c: str) -> DataFrame:
        wanted = cut(leads.join(pairs.select(F.col(c).alias("node")).distinct(), "node"))
        whole = shingle_sets(docs.select(row, text), text, marks(wanted, row))
        return whole.join(wanted.select(row), row, "left_semi").dropDuplicates(["node"]).select(
            F.col("node").alias(c), F.col("shingles").alias(f"of_{c}"))

    shared = F.size(F.array_intersect("of_a", "of_b"))
    return cut(pairs.join(ends("a"), "a").join(ends("b"), "b").filter(9 * shared >= 4 * (F.size("of_a") + F.size("of_b"))).select("a", "b"))


def between(pairs: DataFrame, tops: DataFrame) -> DataFrame:
    """The pairs whose ends are in different components."""
    top_a, top_b = (tops.select(F.col("node").alias(c), F.col("component").alias(f"top_{c}")) for c in "ab")
    return pairs.join(top_a, "a", "left").join(top_b, "b", "left").filter(
        F.coalesce("top_a", "a") != F.coalesce("top_b", "b")).select(pairs.columns)


def best_each(pairs: DataFrame) -> DataFrame:
    """Of each node's smaller partners the most similar one by sketches."""
    return pairs.groupBy("b").agg(F.min(F.struct("gap", "a")).alias("best")).select("best.a", "b")


def close(sets: DataFrame, radius: int = simhash.RADIUS) -> DataFrame:
    """Candidate pairs of sets whose fingerprints are equal or link within the radius."""
    found = sets.groupBy("fp").agg(F.min("node").alias("least"))
    same = sets.select("fp", "node").distinct().join(found, "fp").select(F.col("least").alias("a"), F.col("node").alias("b"))
    edges = simhash.links(found.select("fp"), radius)
    ends = (found.select(F.col("fp").alias(f), F.col("least").alias(c)) for f, c in (("f", "x"), ("g", "y")))
    one, two = ends
    near = edges.select(F.col("a").alias("f"), F.col("b").alias("g")).join(one, "f").join(two, "g").select(
        F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    return same.union(near)


def leading(first: DataFrame) -> DataFrame:
    """``(shingle, members)`` of the shingles that several sets of ``first(node, place, shingle)`` have; of those that the
    very same sets have, only the first in the common order.

    The first shingle that a pair shares is the first of its kind, so no pair is lost. Members are compared by two words of
    exclusive ors; places in the least member tell the order, as they do in any other.
    """
    often = first.groupBy("shingle").agg(
        F.count("*").alias("members"), F.min("node").alias("least"), F.min_by("place", "node").alias("at"),
        F.bit_xor("node").alias("mark"), F.bit_xor(F.xxhash64("node")).alias("other")).filter("members > 1")
    return often.groupBy("members", "least", "mark", "other").agg(F.min_by("shingle", "at").alias("shingle")).select("shingle", "members")


def drawn(met: DataFrame, apart: Column | None = None) -> DataFrame:
    """Pairs ``(a, b)`` of the sets that share a shingle and that enough shingles are left to from their places on;
    ``apart`` is a test on columns of both sides.

    A linking pair is drawn at the first shingle that it shares: none before it is common to both, so all that are must stand
    from there on. At its other shingles the test may fail.
    """
    rest = [c for c in ("node", "n", "place", "top") if c in met.columns]
    a, b = (met.select("shingle", *[F.col(x).alias(f"{x}_{c}") for x in rest]) for c in "ab")
    left = F.least(F.col("n_a") - F.col("place_a"), F.col("n_b") - F.col("place_b"))
    pairs = a.join(b, "shingle").filter((F.col("node_a") < F.col("node_b")) & (9 * left >= 4 * (F.col("n_a") + F.col("n_b"))))
    return (pairs if apart is None else pairs.filter(apart)).select(F.col("node_a").alias("a"), F.col("node_b").alias("b"))


def settled(pairs: DataFrame, links: DataFrame | None, tops: DataFrame | None, docs: DataFrame, rows: DataFrame, row: str,
            text: str) -> tuple[DataFrame, DataFrame]:
    """``links`` with the components ``tops``, and enough of the ``pairs`` that link to connect what all of them connect. If
    pairs are many for their sets, of each set the most similar one is verified first, then what is still open."""
    n, sets = pairs.agg(F.count("*"), F.count_distinct("b")).first()
    for chosen in (best_each, None) if n > 2 * sets else (None,):
        left = pairs if tops is None else between(pairs, tops)
        found = verified(chosen(left) if chosen else left.select("a", "b"), docs, rows, row, text)
        links = found if links is None else links.union(found)
        tops = components(links)
    return links, tops


def near_duplicates(docs: DataFrame, row: str, text: str = "text") -> DataFrame:
    """The rows of ``docs`` without ``text``, plus ``component`` (long): equal for exactly the texts that links of Jaccard
    similarity 4/5 or more of their word shingles connect. ``row`` is a column with a hash of the row, equal for equal
    texts at most. Null, empty and blank texts have the empty set and form one class. Repeated rows are one set, in one
    class. An empty table gives no rows. Other columns are not read; those named ``node``, ``fp``, ``n``, ``sketch``,
    ``prefix`` or ``component`` are not allowed."""
    rows = cut(prefixes(docs, common_shingles(docs, text), text))
    some = rows.filter("n > 0")
    sets = cut(some.select("node", "n", "sketch", "prefix").dropDuplicates(["node"]))
    first, sketches = sets.select("node", "n", F.posexplode("prefix").alias("place", "shingle")), sets.select("node", "n", "sketch")
    met = cut(first.join(leading(first), "shingle"))
    # crowds, by size: sets of similar size are held against three of them, one with the fewest shingles before the crowd's
    crowd = met.filter(F.col("members") > CROWD).withColumn("size", F.floor(F.log("n") / F.log(F.lit(1.25))))
    heads = crowd.groupBy("shingle", "size").agg(F.array_distinct(F.array(
        F.min_by("node", "place"), F.min("node"), F.max("node"))).alias("heads"))
    led = crowd.join(heads, ["shingle", "size"]).select(F.explode("heads").alias("a"), F.col("node").alias("b"))
    near = cut(likely(close(some).union(led).union(drawn(met.filter(F.col("members") <= CROWD))), sketches))
    links, tops = settled(near, None, None, docs, some, row, text)
    # only pairs that these links leave in different classes are drawn from crowds
    named = met.filter(F.col("members") > CROWD).join(tops, "node", "left").withColumn("top", F.coalesce("component", "node"))
    far = cut(likely(drawn(named, F.col("top_a") != F.col("top_b")), sketches))
    tops = settled(far, links, tops, docs, some, row, text)[1]
    rest = [c for c in docs.columns if c != text]
    return rows.select(*rest, "node").join(tops, "node", "left").select(*rest, F.coalesce("component", "node").alias("component"))
