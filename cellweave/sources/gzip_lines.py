"""Lines of a gzip file of many members, read by as many tasks as the file has ranges: a Python data source.

    spark.dataSource.register(GzipLines)
    spark.read.format("gzip_lines").option("rangeBytes", 32 << 20).load("/data/matrix.mtx.gz")

A task owns the members that start in its range of bytes. Where the first of them starts is not written anywhere: bytes that look
like a header count only if all that follows inflates to the length and the checksum at its end. From there members follow
one another. As with split text files, a task that doesn't begin the file leaves out what precedes its first line break, and
reads on into the next member to end its last line. That member is inflated whole, so that a task vouches for the start of the
next one's work: a damaged or cut file raises, wherever the damage is. A file of one member is read by one task. The first
and the last member that a task deals with are inflated twice, so members should be smaller than ranges.

Paths are those that ``pyarrow.fs`` opens on the executors.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# First bytes of a member (two of the format, one of the method) and the bits of the next byte that must be zero.
HEADER, RESERVED = b"\x1f\x8b\x08", 0xE0
RANGE_BYTES = 32 << 20
CHUNK = 1 << 20
SCHEMA = "value string, start bigint"


@dataclass
class Range(InputPartition):
    start: int
    end: int


def opened(path: str) -> tuple[fs.FileSystem, str]:
    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri("file://" + path[5:] if path.startswith("file:/") and not path.startswith("file://") else path)
    return fs.LocalFileSystem(), path


class Members:
    """Members of an open gzip file."""

    def __init__(self, file: pa.NativeFile):
        self.file, self.size = file, file.size()

    def inflate(self, at: int) -> Iterator[bytes | int]:
        """The text of the member at ``at`` in pieces, then where it ends, padding of zeros included."""
        engine, offset = zlib.decompressobj(31), at
        while not engine.eof:
            body = engine.unconsumed_tail
            if not body:
                self.file.seek(offset)
                body = self.file.read(CHUNK)
                offset += len(body)
                if not body:
                    raise ValueError(f"the member at byte {at} is cut off")
            try:
                text = engine.decompress(body, CHUNK)
            except zlib.error as e:
                raise ValueError(f"no sound member at byte {at}: {e}") from e
            if text:
                yield text
        end = offset - len(engine.unused_data)
        while end < self.size:
            self.file.seek(end)
            rest = self.file.read(CHUNK)
            zeros = len(rest) - len(rest.lstrip(b"\0"))
            end += zeros
            if zeros < len(rest):
                break
        yield end

    def sound(self, at: int) -> bool:
        try:
            for _ in self.inflate(at):
                pass
        except ValueError:
            return False
        return True

    def first(self, start: int, end: int) -> int | None:
        """Where the first member that starts in [start, end) does so; byte 0 needs no proof."""
        if start == 0:
            return 0
        at = start
        while at < end:
            self.file.seek(at)
            body = self.file.read(min(CHUNK, end - at) + len(HEADER))
            found = body.find(HEADER)
            while found >= 0 and at + found < end:
                flags = body[found + 3:found + 4]
                if (not flags or not flags[0] & RESERVED) and self.sound(at + found):
                    return at + found
                found = body.find(HEADER, found + 1)
            at += max(1, len(body) - len(HEADER))
        return None

    def lines(self, start: int, end: int) -> Iterator[list[bytes]]:
        """The lines that the range owns, in groups."""
        at = self.first(start, end)
        if at is None:
            return
        begun = start == 0
        parts: list[bytes] = []
        while at < end and at < self.size:
            for piece in self.inflate(at):
                if isinstance(piece, int):
                    at = piece
                    continue
                cut = piece.rfind(b"\n") + 1
                if not cut:
                    parts.append(piece)
                    continue
                whole, parts = b"".join(parts) + piece[:cut], [piece[cut:]]
                if not begun:
                    whole, begun = whole[whole.find(b"\n") + 1:], True
                yield whole.splitlines()
        # the last line ends in a member of another range; the one next to this range is inflated to its end as a proof
        wanted, proof = begun, True
        while at < self.size and (wanted or proof):
            for piece in self.inflate(at):
                if isinstance(piece, int):
                    at = piece
                elif wanted:
                    cut = piece.find(b"\n") + 1
                    parts.append(piece[:cut] if cut else piece)
                    wanted = not cut
            proof = False
        held = b"".join(parts)
        if begun and held:
            yield held.splitlines()


class GzipReader(DataSourceReader):
    def __init__(self, path: str, size: int):
        self.path, self.size = path, size

    def partitions(self) -> list[Range]:
        system, path = opened(self.path)
        total = system.get_file_info(path).size
        if total is None:
            raise FileNotFoundError(self.path)
        return [Range(lo, min(total, lo + self.size)) for lo in range(0, total, self.size)] or [Range(0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        system, path = opened(self.path)
        with system.open_input_file(path) as file:
            for lines in Members(file).lines(partition.start, partition.end):
                text = pa.array([line.decode("utf-8", "replace") for line in lines], pa.string())
                yield pa.RecordBatch.from_arrays([text, pa.array([partition.start] * len(lines), pa.int64())], ["value", "start"])


class GzipLines(DataSource):
    """Option ``rangeBytes``: bytes of the file a task."""

    @classmethod
    def name(cls) -> str:
        return "gzip_lines"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> GzipReader:
        return GzipReader(self.options["path"], int(self.options.get("rangeBytes", self.options.get("rangebytes", RANGE_BYTES))))
