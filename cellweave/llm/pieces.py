"""SentencePiece encoding and decoding as the shortest path through a weighted transducer.

A model file is compiled into arcs: the normaliser rewrites spaces to the word mark and puts one in front, each piece
is an arc over its characters, and a character that no piece covers is an arc over its bytes. An input composed with
these arcs is a lattice of piece sequences; the encoding is its shortest path in the tropical semiring (costs add along
a path, the least path wins).

* Unigram models: an arc costs the negated score of its piece.
* BPE models: an arc may follow another at cost zero if the two pieces, merged by score, stay the same two pieces, and at
  infinite cost if not. A sequence is the model's merge result exactly if all its neighbours are such pairs, so the
  lattice has one path of finite cost. Pairs are compiled when first met.

Pieces never run across the start of a word mark after another character (checked when compiling); the lattice falls
into words there, and a word's path is found once per task, however often the word occurs.
"""

from __future__ import annotations

import math
import os
import struct
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.llm import arrays as A

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: words, and pairs, that a task remembers; it forgets all of them when there are more
REMEMBERED = 600_000
# fixed values of the model format: piece types and model types
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Number and value of each field of a protocol-buffer message."""
    def varint(i: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            value |= (data[i] & 127) << shift
            shift += 7
            i += 1
            if data[i - 1] < 128:
                return value, i

    i = 0
    while i < len(data):
        tag, i = varint(i)
        if tag & 7 == 0:
            value, i = varint(i)
        else:
            if tag & 7 == 2:
                size, i = varint(i)
            else:
                size = {1: 8, 5: 4}[tag & 7]
            value, i = data[i:i + size], i + size
        yield tag >> 3, value


class Transducer:
    """A compiled model. Raises ValueError for what it doesn't express: character maps and user-defined pieces."""

    def __init__(self, model: bytes):
        self.pieces: list[str] = []
        self.arcs: dict[str, int] = {}
        self.score: list[float] = []
        self.bytes: dict[int, int] = {}
        self.unknown, self.kind, self.prefix, self.squeeze = 0, UNIGRAM, True, True
        silent: set[int] = set()
        for field, value in _fields(model):
            if field == 1:
                piece = dict(_fields(value))
                text, kind, n = piece[1].decode(), piece.get(3, NORMAL), len(self.pieces)
                if kind in (USER, UNUSED):
                    raise ValueError(f"piece {text!r}: user-defined and unused pieces are not supported")
                self.pieces.append(text)
                self.score.append(struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0)
                if kind == BYTE:
                    self.bytes[int(text[3:5], 16)] = n
                elif kind == UNKNOWN:
                    self.unknown = n
                elif kind == CONTROL:
                    silent.add(n)
                else:
                    self.arcs[text] = n
            elif field == 2:
                self.kind = dict(_fields(value)).get(3, UNIGRAM)
            elif field == 3:
                spec = dict(_fields(value))
                if spec.get(2):
                    raise ValueError("models with a character map are not supported")
                self.prefix, self.squeeze = bool(spec.get(3, 1)), bool(spec.get(4, 1))
        if self.kind not in (UNIGRAM, BPE):
            raise ValueError("only unigram and BPE models are supported")
        self.apart = all(MARK not in p.lstrip(MARK) for p in self.arcs)
        self.worst = min(self.score, default=0.0) - 10.0
        out = [p.replace(MARK, " ").encode() for p in self.pieces]
        for value, n in self.bytes.items():
            out[n] = bytes([value])
        for n in silent:
            out[n] = b""
        out[self.unknown] = " ⁇ ".encode()
        self.output = pa.array(out, pa.binary())
        self.steps: dict[str, int] = {p[:k]: -1 for p in self.arcs for k in range(1, len(p))} | self.arcs
        self.words: dict[bytes, bytes] = {}
        self.old_words: dict[bytes, bytes] = {}
        self.pairs: dict[int, bool] = {}

    def merged(self, text: str) -> list[str]:
        """Characters merged pair by pair, best score first, leftmost among equals."""
        parts = list(text)
        while True:
            best, spot = -math.inf, -1
            for i in range(len(parts) - 1):
                n = self.arcs.get(parts[i] + parts[i + 1])
                if n is not None and self.score[n] > best:
                    best, spot = self.score[n], i
            if spot < 0:
                return parts
            parts[spot:spot + 2] = [parts[spot] + parts[spot + 1]]

    def follows(self, left: int, right: int) -> bool:
        """Do two pieces, given by number, stay apart when merged? Negative numbers stand for uncovered characters."""
        key = left << 32 | right & 0xFFFFFFFF
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) > REMEMBERED:
                self.pairs.clear()
            a, b = (self.pieces[n] if n >= 0 else chr(~n) for n in (left, right))
            known = self.pairs[key] = self.merged(a + b) == [a, b]
        return known

    def path(self, text: str) -> list[int]:
        """The least-cost sequence of arcs over ``text``: piece numbers, and ~code for a character without a piece."""
        arc, back = (self.merge_path if self.kind == BPE else self.score_path)(text)
        n, found = len(text), []
        while n:
            found.append(arc[n])
            n = back[n]
        return found[::-1]

    def score_path(self, text: str) -> tuple[list, list]:
        """Last arc, and where it starts, of the least-cost path to each position."""
        n = len(text)
        cost, arc, back = [math.inf] * (n + 1), [None] * (n + 1), [0] * (n + 1)
        cost[0], steps, score = 0.0, self.steps, self.score
        for start in range(n):
            for end in range(start + 1, n + 1):
                number = steps.get(text[start:end])
                if end == start + 1:
                    number = ~ord(text[start]) if number is None or number < 0 else number
                elif number is None:
                    break
                elif number < 0:
                    continue
                total = cost[start] - (self.worst if number < 0 else score[number])
                if total < cost[end]:
                    cost[end], arc[end], back[end] = total, number, start
        return arc, back

    def merge_path(self, text: str) -> tuple[list, list]:
        """As ``score_path`` where costs are zero or infinite: each position is reached at no cost in one way, or never."""
        n = len(text)
        arc, back = [None] * (n + 1), [0] * (n + 1)
        get, known, follows = self.steps.get, self.pairs.get, self.follows
        for start in range(n):
            left = arc[start]
            if left is None and start:
                continue
            for end in range(start + 1, n + 1):
                number = get(text[start:end])
                if end == start + 1:
                    if number is None or number < 0:
                        number = ~ord(text[start])
                elif number is None:
                    break
                elif number < 0:
                    continue
                if arc[end] is None:
                    if start:
                        free = known(left << 32 | number & 0xFFFFFFFF)
                        if not (follows(left, number) if free is None else free):
                            continue
                    arc[end], back[end] = number, start
        return arc, back

    def word(self, raw: bytes) -> bytes:
        """The piece numbers of a word, as 32-bit integers. Words that weren't asked for of late are forgotten."""
        found = self.old_words.get(raw)
        if found is None:
            ids = []
            for number in self.path(raw.decode().replace(" ", MARK)):
                if number >= 0:
                    ids.append(number)
                elif self.bytes:
                    ids.extend(self.bytes[b] for b in chr(~number).encode())
                else:
                    ids.append(self.unknown)
            found = array("i", ids).tobytes()
        if len(self.words) >= REMEMBERED // 2:
            self.old_words, self.words = self.words, {}
        self.words[raw] = found
        return found

    def normalise(self, texts: pa.Array) -> pa.Array:
        """Texts as the pieces see them, with spaces for word marks; null becomes empty."""
        texts = pc.replace_substring(pc.fill_null(texts, ""), MARK, " ")
        if self.squeeze:
            texts = pc.replace_substring_regex(pc.utf8_trim(texts, " "), " +", " ")
        if self.prefix:
            texts = pc.if_else(pc.equal(texts, ""), "", pc.binary_join_element_wise("", texts, " "))
        return texts

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Piece numbers of all texts in a row, and the n + 1 offsets of the texts."""
        data, offsets = A.text_buffer(self.normalise(texts))
        ids, counts = [np.zeros(0, np.int32)], np.zeros(len(offsets) - 1, np.int64)
        for first, last in A.steps(offsets, 1 << 22):
            body, at = data[offsets[first]:offsets[last]], offsets[first:last + 1] - offsets[first]
            begin = np.zeros(len(body), bool)
            if self.apart:
                begin[1:] = (body[1:] == 32) & (body[:-1] != 32)
            begin[at[:-1][at[:-1] < at[1:]]] = True
            starts = np.flatnonzero(begin)
            if not len(starts):
                continue
            words = pa.Array.from_buffers(pa.large_binary(), len(starts), [
                None, pa.py_buffer(np.append(starts, len(body)).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(body))])
            coded = words.dictionary_encode()
            found = [self.words.get(w) or self.word(w) for w in coded.dictionary.to_pylist()]
            sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
            flat = np.frombuffer(b"".join(found), np.int32)
            lists = pa.LargeListArray.from_arrays(np.concatenate([[0], np.cumsum(sizes)]), pa.array(flat))
            ids.append(lists.take(coded.indices).flatten().to_numpy())
            each = sizes[coded.indices.to_numpy()]
            counts[first:last] = np.bincount(A.owner_of(at, starts), each, minlength=last - first).astype(np.int64)
        return np.concatenate(ids), np.concatenate([[0], np.cumsum(counts)])

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all texts in a row and their offsets, the mark in front included."""
        out = self.output.take(pa.array(ids))
        data, at = A.text_buffer(out)
        return data, at[offsets]

    def strings(self, data: np.ndarray, offsets: np.ndarray) -> pa.Array:
        """Decoded texts without the mark in front; bytes that are no UTF-8 become replacement characters."""
        raw, mark = data.tobytes(), self.prefix
        return pa.array([raw[s + (mark and s < e and data[s] == 32):e].decode("utf-8", "replace")
                         for s, e in zip(offsets[:-1].tolist(), offsets[1:].tolist())], pa.string())


_COMPILED: dict[int, Transducer] = {}


def compiled(model: bytes) -> Transducer:
    """One transducer for each model and worker process; its words outlive a task."""
    key = hash(model)
    if key not in _COMPILED:
        _COMPILED[key] = Transducer(model)
    return _COMPILED[key]


def model_bytes(spark: SparkSession, path: str = MODEL) -> bytes:
    """A model file, from the driver's disk or from any store that Spark reads. Its size is that of a vocabulary."""
    if os.path.exists(path):
        with open(path, "rb") as file:
            return file.read()
    return bytes(spark.read.format("binaryFile").load(path).select("content").first()[0])


def encode(docs: DataFrame, model: str = MODEL, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` (default: every other column) plus ids (array<int>), n_ids (long) and round_trip (boolean).

    ``round_trip`` says that decoding the ids gives the normalised text again. Null and empty texts have no ids. The
    texts are whole; columns named ids, n_ids or round_trip are replaced.
    """
    spark = A.ready(docs.sparkSession)
    new = ["ids", "n_ids", "round_trip"]
    keep = [c for c in (docs.columns if keep is None else keep) if c not in new and (keep is not None or c != text)]
    content = spark.sparkContext.broadcast(model_bytes(spark, model))
    frame = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").cast("string").alias("text__"))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = compiled(content.value)
        for batch in it:
            texts = batch.column(len(keep))
            ids, at = machine.encode(texts)
            data, ends = machine.decode(ids, at)
            wanted, bounds = A.text_buffer(machine.normalise(texts))
            whole = np.array_equal(data, wanted) and np.array_equal(ends, bounds)
            same = np.ones(len(texts), bool) if whole else np.array([
                np.array_equal(data[ends[i]:ends[i + 1]], wanted[bounds[i]:bounds[i + 1]]) for i in range(len(texts))])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:len(keep)], pa.ListArray.from_arrays(at.astype(np.int32), pa.array(ids)), pa.array(np.diff(at)),
                 pa.array(same)], [*keep, *new])

    fields = "".join(f"`{c}` {frame.schema[c].dataType.simpleString()}, " for c in keep)
    return frame.mapInArrow(A.lean(run), f"{fields}ids array<int>, n_ids long, round_trip boolean")


def decode(rows: DataFrame, model: str = MODEL, ids: str = "ids") -> DataFrame:
    """``rows`` with ``text`` (string) in place of ``ids``. Null or empty ids give an empty text; ids outside the model raise."""
    spark = A.ready(rows.sparkSession)
    keep = [c for c in rows.columns if c not in (ids, "text")]
    content = spark.sparkContext.broadcast(model_bytes(spark, model))
    frame = rows.select(*[F.col(f"`{c}`") for c in keep], F.coalesce(F.col(f"`{ids}`").cast("array<int>"), F.array().cast("array<int>")).alias("ids__"))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = compiled(content.value)
        for batch in it:
            lists = batch.column(len(keep))
            at = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))]).astype(np.int64)
            texts = machine.strings(*machine.decode(lists.flatten().to_numpy(zero_copy_only=False), at))
            yield pa.RecordBatch.from_arrays([*batch.columns[:len(keep)], texts], [*keep, "text"])

    fields = "".join(f"`{c}` {frame.schema[c].dataType.simpleString()}, " for c in keep)
    return frame.mapInArrow(A.lean(run), f"{fields}text string")
