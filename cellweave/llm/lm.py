"""Stupid-backoff scores of whole documents from n-gram counts of the whole corpus.

A word's score is the relative frequency of the longest n-gram, up to three words, that ends in it and is seen at least
``least`` times; each step back multiplies by ``backoff``. (An n-gram seen once is seen here alone, so counting it as
evidence would score every text by itself.)

    S(w | u v) = c(u v w) / c(u v)                  if c(u v w) >= least
               = backoff * c(v w) / c(v)            if c(v w) >= least
               = backoff^2 * c(w) / N

The count tables are partitioned by hash. A block of documents is exploded into its distinct n-grams, with their counts
in the block; these meet the other blocks' by hash, are summed there, and each block gets its n-grams' totals back,
which it joins to its words and sums for each document. Words, bigrams and trigrams are counted apart, each by a hash of
64 bits of its own. A frequent n-gram is one row a block, not one an occurrence, so no partition is hot. A bucket is a
range of hashes, so that sorted keys lie close; they are stored as byte planes of their differences. The texts of a block
travel together and compressed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweave.llm import arrays as A

BACKOFF = 0.4
LEAST = 2
FINE = 1
_PACK = pa.schema([("block", pa.int32()), ("bucket", pa.int32()), ("kind", pa.int32()), ("body", pa.binary())])
_PACKED = "block int, bucket int, kind int, body binary"
#: bytes of text that a reading task gathers before it deals them to the blocks
DEAL_BYTES = 1 << 24
WORDS, PAIRS, TRIPLES = KINDS = 0, 1, 2


def planes(x: np.ndarray) -> bytes:
    """Numbers as byte planes, the highest first, without the planes that are zero throughout."""
    part = np.ascontiguousarray(x.astype(np.uint64)).view(np.uint8).reshape(-1, 8)
    used = max([1, *(k + 1 for k in range(8) if part[:, k].any())])
    return bytes([used]) + np.ascontiguousarray(part[:, :used].T).tobytes()


def unplaned(body: bytes, at: int, n: int) -> tuple[np.ndarray, int]:
    used = body[at]
    out = np.zeros((n, 8), np.uint8)
    out[:, :used] = np.frombuffer(body, np.uint8, used * n, at + 1).reshape(used, n).T
    return out.view(np.uint64).ravel(), at + 1 + used * n


def _request(keys: np.ndarray, counts: np.ndarray) -> bytes:
    return len(keys).to_bytes(8, "little") + planes(np.diff(keys, prepend=np.uint64(0))) + planes(counts)


def _requested(body: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = int.from_bytes(body[:8], "little")
    steps, at = unplaned(body, 8, n)
    return np.cumsum(steps, dtype=np.uint64), unplaned(body, at, n)[0]


def _bucket(keys: np.ndarray, n: int) -> np.ndarray:
    return ((keys >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


class Block:
    """The words of some texts, and the keys of the n-grams that end in each of them."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        words, owners = [np.zeros(0, np.uint64)], [np.zeros(0, np.int32)]
        for first, last in A.steps(offsets):
            at = offsets[first:last + 1] - offsets[first]
            body = A.LOWER[data[offsets[first]:offsets[last]]]
            starts, ends = A.runs(~A.SPACE[body], at)
            words.append(A.word_hash(body, starts, ends))
            owners.append((first + A.owner_of(at, starts)).astype(np.int32))
        self.word, self.owner = np.concatenate(words), np.concatenate(owners)
        n = len(self.word)
        #: words that stand before this one in its text: 0, 1, or more
        self.depth = np.zeros(n, np.int8)
        same = self.owner[1:] == self.owner[:-1]
        self.depth[1:] += same
        self.depth[2:] += same[1:] & same[:-1]
        pair = A.mix(self.word)
        pair[1:] += self.word[:-1] * np.uint64(0x9E3779B97F4A7C15)
        pair = A.mix(pair)
        triple = A.mix(pair)
        triple[2:] += self.word[:-2] * np.uint64(0x9E3779B97F4A7C15)
        triple = A.mix(triple)
        #: of each kind, the distinct keys and their counts, and where each word's key stands; 0 where it has none
        self.keys, self.counts, self.at = [], [], []
        for kind, full in ((WORDS, self.word), (PAIRS, pair), (TRIPLES, triple)):
            some = self.depth >= kind
            keys, at, counts = np.unique(full[some], return_inverse=True, return_counts=True)
            place = np.zeros(n, np.int32)
            place[some] = at
            self.keys.append(keys)
            self.counts.append(counts)
            self.at.append(place)
        self.word = None


def _deal(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with a block number -> (block, its rows of some batches as one compressed stream)."""
    options = pa.ipc.IpcWriteOptions(compression="zstd")

    def dealt(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held)
        for block, part in A.packed(np.arange(len(table)), table["block"].to_numpy(), int(pc.max(table["block"]).as_py()) + 1):
            sink = pa.BufferOutputStream()
            rows = table.drop_columns("block").take(part)
            with pa.ipc.new_stream(sink, rows.schema, options=options) as out:
                out.write_table(rows)
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["block", "rows"])

    held, size = [], 0
    for batch in it:
        if batch.num_rows:
            held.append(batch)
            size += batch.nbytes
        if size >= DEAL_BYTES:
            yield from dealt(held)
            held, size = [], 0
    if held:
        yield from dealt(held)


def _rows(table: pa.Table) -> pa.Table:
    return pa.concat_tables([pa.ipc.open_stream(x.as_buffer()).read_all() for c in table["rows"].chunks for x in c])


def _explode(n: int):
    def run(table: pa.Table) -> pa.Table:
        block = Block(*A.text_buffer(_rows(table)["text"]))
        number = table["block"][0].as_py()
        rows = []
        for kind, keys, counts in zip(KINDS, block.keys, block.counts):
            for b, part in A.packed(np.arange(len(keys)), _bucket(keys, n), n):
                rows.append((number, b, kind, _request(keys[part], counts[part])))
        return pa.Table.from_batches(list(A.batches(rows, _PACK)), _PACK)

    return run


def _count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Requests of all blocks for some buckets -> the totals, in each request's order."""
    held: dict[tuple[int, int], list[tuple[int, bytes]]] = {}
    for batch in it:
        for block, bucket, kind, body in zip(*(c.to_pylist() for c in batch.columns)):
            held.setdefault((bucket, kind), []).append((block, body))
    for (bucket, kind), asked in held.items():
        found = [_requested(body) for _, body in asked]
        keys, at = np.unique(np.concatenate([k for k, _ in found]), return_inverse=True)
        total = np.bincount(at, np.concatenate([c for _, c in found]).astype(np.float64)).astype(np.uint64)
        sizes = np.cumsum([0] + [len(k) for k, _ in found])
        rows = ((block, bucket, kind, planes(total[at[lo:hi]]))
                for (block, _), lo, hi in zip(asked, sizes[:-1], sizes[1:]))
        yield from A.batches(rows, _PACK)


def _score(n: int, names: list[str], total: int, backoff: float, least: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        left = _rows(left)
        block = Block(*A.text_buffer(left["text"]))
        totals = [np.zeros(len(keys), np.uint64) for keys in block.keys]
        place = {}
        for kind, keys in zip(KINDS, block.keys):
            for b, part in A.packed(np.arange(len(keys)), _bucket(keys, n), n):
                place[kind, b] = part
        for bucket, kind, body in zip(*(right[c].to_pylist() for c in ("bucket", "kind", "body"))):
            spot = place[kind, bucket]
            totals[kind][spot] = unplaned(body, 0, len(spot))[0]
        c1, c2, c3 = (total[at].astype(np.float64) if len(total) else np.zeros(len(at)) for total, at in zip(totals, block.at))
        before = lambda x: np.concatenate([[1.0], x[:-1]]) if len(x) else x
        by3 = (block.depth > 1) & (c3 >= least)
        by2 = (block.depth > 0) & (c2 >= least) & ~by3
        with np.errstate(divide="ignore", invalid="ignore"):
            value = np.select([by3, by2], [np.log(c3 / before(c2)), np.log(backoff * c2 / before(c1))],
                              np.log(backoff ** 2 * c1 / max(1, total)))
        size = left.num_rows
        count = np.bincount(block.owner, minlength=size)
        sums = np.bincount(block.owner, value, minlength=size).astype(np.float64)
        return pa.table([*[left[c] for c in names], pa.array(count), pa.array(sums)], [*names, "n_words", "log_score"])

    return run


def score(docs: DataFrame, keep: list[str], id_col: str = "doc_id", text: str = "text", backoff: float = BACKOFF,
          least: int = LEAST) -> DataFrame:
    """``keep`` plus n_words (long) and log_score (double), the sum of the words' log scores; counts are those of ``docs``.

    Words are runs of non-blank bytes, ASCII lower-cased, of the whole text; n-grams stay within a text. Null, empty and
    blank texts have no words and a sum of zero. Repeated rows count as often as they stand. An empty table gives no rows.
    """
    spark = A.ready(docs.sparkSession)
    parts = A.buckets(spark)
    n = FINE * parts
    value = F.col(f"`{text}`").cast("string")
    names = [f"keep_{i}" for i in range(len(keep))]
    dealt = docs.select(value.alias("text"), *[F.col(f"`{c}`").alias(k) for c, k in zip(keep, names)],
                        F.pmod(F.xxhash64(F.col(f"`{id_col}`").cast("string"), value), F.lit(n).cast("long")).cast("int").alias("block")) \
        .mapInArrow(_deal, "block int, rows binary")

    def words(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            data, offsets = A.text_buffer(batch.column(0))
            yield pa.RecordBatch.from_arrays([pa.array([len(A.runs(~A.SPACE[data], offsets)[0])])], ["n"])

    total = docs.select(value.alias("text")).mapInArrow(words, "n long").agg(F.sum("n")).first()[0] or 0
    asked = dealt.groupBy("block").applyInArrow(_explode(n), _PACKED)
    told = A.by_bucket(asked, parts).mapInArrow(_count, _PACKED)
    fields = "".join(f"`{k}` {docs.schema[c].dataType.simpleString()}, " for c, k in zip(keep, names))
    result = dealt.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(
        _score(n, names, total, backoff, least), f"{fields}n_words long, log_score double")
    return result.select(*[F.col(k).alias(c) for c, k in zip(keep, names)], "n_words", "log_score")
