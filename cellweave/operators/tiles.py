"""All-pairs products by square tiles.

Rows are hashed into blocks of bounded size, each packed into one row of a
checkpointed table whose partitions are groups of blocks. A tile is one pair of
blocks, a task the tiles of one pair of groups: a Cartesian join reads both groups
from the table, so every entry is shuffled and written once however many tiles it is
in. The block product is accumulated column chunk by column chunk with array code.
What leaves a tile is up to its consumer: pairs, a histogram, the best match per
row, a pruned graph; a task may fold what its tiles yield. The full set of pairs is
never shuffled unless pairs are the result.

A hot column is a dense column of each tile, never a group of its own; a hot row
adds at most one value per column to the tiles of its block.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweave.config import BLOCK_BYTES, BLOCK_ENTRIES, BLOCK_ROWS, GROUP_BYTES
from cellweave.operators.keys import dense_index, lookup_join
from cellweave.session import pin, ship

# Row statistics carried in a block header, in this order.
STATS = ("s1", "s2", "nnz", "whole")
# Columns per dense product, entries taken for a product, and the cost of one
# scattered product in products inside a matrix multiplication.
TUNING = (1024, 1_000_000, 64)
# Rows that a task holds before it folds them.
FOLD_ROWS = 1_000_000
# Columns between a block's first and last up to which their places are looked up in a table.
TABLE_COLUMNS = 1 << 24


@dataclass
class Tile:
    """One finished tile as its consumer sees it."""

    left: np.ndarray
    right: np.ndarray
    left_stats: np.ndarray
    right_stats: np.ndarray
    gram: np.ndarray
    support: np.ndarray | None
    diagonal: bool
    group: tuple[int, int] = (0, 0)  # the groups of blocks that the tile's task has
    memory: dict = field(default_factory=dict)  # what a consumer keeps from tile to tile of a task


def block_count(n_rows: int, parallelism: int, block_rows: int = BLOCK_ROWS) -> int:
    """Blocks that bound the tile and still give every core some tiles."""
    needed = math.ceil(max(n_rows, 1) / block_rows)
    useful = min(math.ceil(max(n_rows, 1) / 64), math.ceil(math.sqrt(8 * parallelism)))
    return max(needed, useful, 1)


def row_stats(expr: DataFrame, rows: DataFrame | None = None) -> DataFrame:
    """Per-row sums; ``rows`` adds the rows without entries."""
    stats = expr.groupBy("cell").agg(
        F.sum("value").alias("s1"), F.sum(F.col("value") * F.col("value")).alias("s2"),
        F.count("*").cast("double").alias("nnz"), F.sum(F.floor("value")).cast("double").alias("whole"))
    if rows is None:
        return stats
    return rows.select("cell").join(stats, "cell", "left").na.fill(0.0, list(STATS))


@dataclass
class TilePlan:
    """Blocks and tiles of a run that leaves tiles out.

    ``rows`` is (cell, block), ``tiles`` (block, other) in both directions; rows without a block are in no tile.
    """

    rows: DataFrame
    tiles: DataFrame
    n_blocks: int
    skipped: float


def rows_of_block(n_rows: int, entries: int, block_rows: int = BLOCK_ROWS) -> int:
    """``block_rows``, or fewer if so many rows hold more than ``BLOCK_ENTRIES`` entries on average."""
    return max(1, min(block_rows, BLOCK_ENTRIES * max(n_rows, 1) // max(entries, 1)))


def group_count(blocks: int, size: int, tasks: int) -> int:
    """Groups of blocks of which none exceeds ``GROUP_BYTES`` by far, and at least ``tasks`` if there are as many blocks."""
    return max(1, min(blocks, max(math.ceil(size / GROUP_BYTES), tasks)))


PACKED = "block int, ids array<long>, stats array<double>, genes array<long>, slots array<int>, vals array<double>"


def _pack(expr: DataFrame, stats: DataFrame, blocks: int, groups: int, hashed: bool = True) -> DataFrame:
    """One row for each block, its entries sorted by column; blocks by hash, or as they are given. Neighbouring blocks
    share one of ``groups`` partitions."""
    block = F.pmod(F.xxhash64("cell"), F.lit(blocks)).cast("int") if hashed else F.col("block")
    # a row for each statistic of a cell (kinds from 0 on), then one for each entry: plain columns cross to Python cheaply
    heads = stats.select(block.alias("block"), F.col("cell").cast("long").alias("cell"),
                         F.posexplode(F.array(*[F.col(s).cast("double") for s in STATS])).alias("kind", "value")).select(
        "block", F.col("kind").cast("byte").alias("kind"), F.lit(None).cast("long").alias("gene"), "cell", "value")
    entries = expr.select(block.alias("block"), F.lit(len(STATS)).cast("byte").alias("kind"), F.col("gene").cast("long").alias("gene"),
                          F.col("cell").cast("long").alias("cell"), F.col("value").cast("double").alias("value"))
    each = math.ceil(blocks / groups)
    # an entry without a row key, or of no row, is in no pair
    ranged = (heads.unionByName(entries).filter("cell IS NOT NULL").repartitionById(groups, F.floor(F.col("block") / each).cast("int"))
              .sortWithinPartitions("block", "kind", "gene", "cell"))

    def work(batches):
        for block_, parts in _runs(batches):
            kind, gene, cell, value = (np.concatenate([p.column(c).fill_null(0).to_numpy() for p in parts])
                                       for c in ("kind", "gene", "cell", "value"))
            n = int(np.searchsorted(kind, len(STATS)))
            ids = cell[:n // len(STATS)]
            slots = np.searchsorted(ids, cell[n:]).astype(np.int32)
            mine = np.isin(cell[n:], ids)
            yield pa.RecordBatch.from_arrays(
                [pa.array([block_], pa.int32()), *(_list(a) for a in (ids, value[:n], gene[n:][mine], slots[mine], value[n:][mine]))],
                ["block", "ids", "stats", "genes", "slots", "vals"])

    return pin(ranged.mapInArrow(work, PACKED))


def _list(values: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values))


def _runs(batches) -> Iterator[tuple[int, list[pa.RecordBatch]]]:
    """Batches sorted by their first column, in whole runs of its values."""
    current, held = None, []
    for batch in batches:
        block = batch.column(0).to_numpy()
        edges = np.flatnonzero(np.diff(block)) + 1
        for lo, hi in zip([0, *edges], [*edges, len(block)]):
            if hi == lo:
                continue
            if current is not None and block[lo] != current:
                yield current, held
                held = []
            current = int(block[lo])
            held.append(batch.slice(lo, hi - lo))
    if held:
        yield current, held


def _meet(left: DataFrame, right: DataFrame | None, others: DataFrame | None = None) -> DataFrame:
    """Every pair of packed blocks side by side, once per pair for one side; ``others`` are the (block, other) to meet.

    The Cartesian join reads a pair of partitions in each task and shuffles nothing.
    """
    symmetric = right is None
    right = left if right is None else right
    rows = right.select(*[F.col(c).alias(f"r_{c}") for c in right.columns])
    test = F.col("block") <= F.col("r_block") if symmetric else F.lit(True)
    names = left.columns
    if others is not None:
        met = others.filter("block <= other").groupBy("block").agg(F.collect_set("other").alias("_others"))
        left = left.join(F.broadcast(met), "block")
        test = test & F.array_contains("_others", F.col("r_block"))
    return left.hint("shuffle_replicate_nl").join(rows, test).select(*names, *rows.columns)


def _folded(batches: Iterator[pa.RecordBatch], fold) -> Iterator[pa.RecordBatch]:
    """What ``fold`` leaves of all batches of a task; it is applied again whenever the rows held have doubled."""
    held, size, least = [], 0, 0

    def one() -> pa.RecordBatch:
        columns = [np.concatenate([b.column(c).to_numpy(zero_copy_only=False) for b in held]) for c in held[0].schema.names]
        return fold(pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=held[0].schema.names))

    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size > max(FOLD_ROWS, 2 * least):
            held = [one()]
            size = least = held[0].num_rows
    if held:
        yield one()


def run_tiles(left: tuple[DataFrame, DataFrame], right: tuple[DataFrame, DataFrame] | None, n_left: int,
              n_right: int | None, consumer: Callable[[Tile], Iterator[pa.RecordBatch]], schema: str,
              support: bool = False, block_rows: int = BLOCK_ROWS, fold: Callable[[pa.RecordBatch], pa.RecordBatch] | None = None,
              tuning: tuple = TUNING, plan: TilePlan | None = None, entries: int | None = None) -> DataFrame:
    """Feed every tile of left x right (or of left x left, once per pair) to ``consumer``.

    ``left`` and ``right`` are (expr(cell, gene, value), stats) pairs; ``entries`` is the number of left entries, if it is
    known. ``fold`` reduces what the tiles of a task yield; null scores reach it as NaN. A ``plan`` for left x left gives the
    blocks and the tiles to feed.
    """
    spark = ship(left[0].sparkSession)
    cores = spark.sparkContext.defaultParallelism
    entries = left[0].count() if entries is None else entries
    nl = block_count(n_left, cores, rows_of_block(n_left, entries, block_rows)) if plan is None else plan.n_blocks
    symmetric = right is None
    if symmetric:
        gl = group_count(nl, 20 * entries, math.ceil(math.sqrt(16 * cores)))
        side = left if plan is None else [lookup_join(part, plan.rows, "cell", n_left) for part in left]
        met = _meet(_pack(*side, nl, gl, plan is None), None, None if plan is None else plan.tiles)
        each = [math.ceil(nl / gl)] * 2
    else:
        also = right[0].count()
        nr = block_count(n_right, cores, rows_of_block(n_right, also, block_rows))
        gl = group_count(nl, 20 * entries, 4 * cores)
        gr = group_count(nr, 20 * also, math.ceil(4 * cores / gl))
        met = _meet(_pack(*left, nl, gl), _pack(*right, nr, gr))
        each = [math.ceil(nl / gl), math.ceil(nr / gr)]

    def work(batches):
        found = (out for tile in _stream(batches, symmetric, support, tuning, each) for out in consumer(tile))
        yield from _folded(found, fold) if fold else found

    return met.mapInArrow(work, schema)


class _Side:
    """A block as it was packed; ``genes`` are its columns, ``count`` their numbers of entries."""

    def __init__(self, batch: pa.RecordBatch, row: int, prefix: str):
        self.block = batch.column(f"{prefix}block")[row].as_py()
        self.ids, stats, genes, self.slots, self.vals = (
            batch.column(f"{prefix}{c}")[row].values.to_numpy() for c in ("ids", "stats", "genes", "slots", "vals"))
        self.stats = stats.reshape(len(STATS), -1)
        self.first = np.flatnonzero(np.concatenate(([True], genes[1:] != genes[:-1]))) if len(genes) else np.zeros(0, np.int64)
        self.genes, self.count = genes[self.first], np.diff(np.append(self.first, len(genes)))
        self.table: np.ndarray | None = None

    def places(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where those of the ascending columns ``wanted`` that the block has are in it, and where they are in ``wanted``."""
        if not len(self.genes) or not len(wanted):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        low, high = self.genes[0], self.genes[-1]
        lo, hi = np.searchsorted(wanted, low), np.searchsorted(wanted, high, "right")
        if high - low < TABLE_COLUMNS:  # made once for all tiles that have the block on the left
            if self.table is None:
                self.table = np.full(high - low + 1, -1, np.int32)
                self.table[self.genes - low] = np.arange(len(self.genes), dtype=np.int32)
            at = self.table[wanted[lo:hi] - low]
        else:
            at = np.searchsorted(self.genes, wanted[lo:hi])
            at = np.where(self.genes[at] == wanted[lo:hi], at, -1)
        found = np.flatnonzero(at >= 0)
        return at[found].astype(np.int64), lo + found

    def entries(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place in ``at``, slot, value) of the entries of the block's columns ``at``, column by column."""
        count = self.count[at]
        which = np.repeat(self.first[at] - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
        return np.repeat(np.arange(len(at)), count), self.slots[which], self.vals[which]


class _Building:
    """The products of a tile."""

    def __init__(self, left: _Side, right: _Side, diagonal: bool, support: bool, tuning: tuple):
        self.chunk, self.buffer, self.sparse_cost = tuning
        self.diagonal = diagonal
        self.shape = (len(left.ids), len(right.ids))
        self.gram = np.zeros(self.shape)
        self.support = np.zeros(self.shape) if support else None
        if diagonal:
            parts, width = [(np.repeat(np.arange(len(left.genes)), left.count), left.slots, left.vals)], len(left.genes)
        else:
            mine, theirs = left.places(right.genes)
            parts, width = [left.entries(mine), right.entries(theirs)], len(mine)
        if not width:
            return
        ends = [np.cumsum(np.bincount(p[0], minlength=width)) for p in parts]
        total, first = sum(ends), 0
        while first < width:  # columns of at most so many entries at a time
            done = total[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(total, done + self.buffer, "right")))
            some = [tuple(c[(e[first - 1] if first else 0):e[last - 1]] for c in p) for p, e in zip(parts, ends)]
            some = [(column - first, slot, value) for column, slot, value in some]
            self._multiply(some[0], some[-1], last - first)
            first = last

    def _multiply(self, left, right, width):
        per_left, per_right = (np.bincount(p[0], minlength=width) for p in (left, right))
        if float(per_left @ per_right) * self.sparse_cost < float(self.gram.size) * width:
            return self._multiply_entries(left, right, per_right)
        for first in range(0, width, self.chunk):
            dense = []
            for column, slot, value in ((left,) if self.diagonal else (left, right)):
                a, b = np.searchsorted(column, [first, first + self.chunk])
                block = np.zeros((self.shape[len(dense)], self.chunk))
                block[slot[a:b], column[a:b] - first] = value[a:b]
                dense.append(block)
            self.gram += dense[0] @ dense[-1].T
            if self.support is not None:
                self.support += (dense[0] != 0).astype(np.float32) @ (dense[-1] != 0).astype(np.float32).T

    def _multiply_entries(self, left, right, per_right):
        """Products of the stored entries only, for columns that few rows share."""
        start = np.concatenate(([0], np.cumsum(per_right)))
        lens = per_right[left[0]]
        for lo in range(0, len(lens), 50_000):
            part = slice(lo, lo + 50_000)
            count = lens[part]
            base = np.concatenate(([0], np.cumsum(count)[:-1]))
            other = np.repeat(start[left[0][part]] - base, count) + np.arange(int(count.sum()))
            cell = np.repeat(left[1][part], count) * self.gram.shape[1] + right[1][other]
            np.add.at(self.gram.reshape(-1), cell, np.repeat(left[2][part], count) * right[2][other])
            if self.support is not None:
                np.add.at(self.support.reshape(-1), cell, 1.0)


def _stream(batches, symmetric, support, tuning, each):
    left, memory = None, {}
    for batch in batches:
        for row in range(batch.num_rows):
            block = batch.column("block")[row].as_py()
            if left is None or left.block != block:
                left = _Side(batch, row, "")
            diagonal = symmetric and batch.column("r_block")[row].as_py() == block
            right = left if diagonal else _Side(batch, row, "r_")
            made = _Building(left, right, diagonal, support, tuning)
            yield Tile(left.ids, right.ids, left.stats.copy(), right.stats.copy(), made.gram, made.support, diagonal,
                       (block // each[0], right.block // each[1]), memory)


# --- dense vectors ---------------------------------------------------------------------

def run_vector_tiles(points: DataFrame, n: int, consumer, schema: str, extra: str | None = None,
                     block_rows: int = BLOCK_ROWS, fold: Callable[[pa.RecordBatch], pa.RecordBatch] | None = None,
                     by_extra: bool = False) -> DataFrame:
    """Tiles over dense vectors ``points(id, z[, extra])``, each unordered pair once.

    ``consumer(ids_l, z_l, x_l, ids_r, z_r, x_r, diagonal)`` yields record batches; ``fold`` reduces those of a task.
    Blocks are made by hash or, with ``by_extra``, in the order of ``extra``: groups of blocks then hold few of its values.
    """
    spark = ship(points.sparkSession)
    cores = spark.sparkContext.defaultParallelism
    width = points.agg(F.max(F.size("z"))).first()[0] or 1
    blocks = block_count(n, cores, max(1, min(block_rows, BLOCK_BYTES // (8 * width))))
    groups = group_count(blocks, 8 * n * width, math.ceil(math.sqrt(16 * cores)))
    each = math.ceil(blocks / groups)
    fields = ["id", "z"] + ([extra] if extra else [])
    block = F.pmod(F.xxhash64("id"), F.lit(blocks))
    if by_extra:
        points = dense_index(points.select(*fields), [extra, "id"], "_place")
        block = F.least(F.floor(F.col("_place") * blocks / n), F.lit(blocks - 1))
    ranged = (points.select(block.cast("int").alias("block"), *fields)
              .repartitionById(groups, F.floor(F.col("block") / each).cast("int")).sortWithinPartitions("block", *fields))

    def pack(batches):
        for block, parts in _runs(batches):
            ids, x = (np.concatenate([p.column(c).to_numpy() for p in parts]) for c in ("id", extra or "id"))
            if any(p.column("z").null_count or (np.diff(p.column("z").value_lengths().to_numpy()) != 0).any() for p in parts):
                raise ValueError("vectors are null or differ in length")
            flat = np.concatenate([p.column("z").flatten().to_numpy() for p in parts])
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), _list(ids), _list(flat), _list(x)], ["block", "ids", "flat", "x"])

    kind = points.schema[extra or "id"].dataType.simpleString()
    packed = pin(ranged.mapInArrow(pack, f"block int, ids array<{points.schema['id'].dataType.simpleString()}>, flat array<double>, x array<{kind}>"))

    def side(batch, row, prefix):
        ids, flat, x = (batch.column(f"{prefix}{c}")[row].values.to_numpy() for c in ("ids", "flat", "x"))
        return ids, flat.reshape(len(ids), -1), x

    def tiles(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                left = side(batch, row, "")
                if batch.column("block")[row].as_py() == batch.column("r_block")[row].as_py():
                    yield from consumer(*left, *left, True)
                else:
                    yield from consumer(*left, *side(batch, row, "r_"), False)

    def work(batches):
        yield from _folded(tiles(batches), fold) if fold else tiles(batches)

    return _meet(packed, None).mapInArrow(work, schema)
