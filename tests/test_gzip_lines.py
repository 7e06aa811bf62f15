"""Gzip files split at their members, against the lines of the whole file."""

import gzip
import random

import pyarrow as pa
import pytest

from cellweave.sources import gzip_lines, readers
from cellweave.sources.gzip_lines import Members


def split_lines(body, step):
    ranges = [(lo, min(len(body), lo + step)) for lo in range(0, len(body), step)]
    return [line for lo, hi in ranges for some in Members(pa.BufferReader(body)).lines(lo, hi) for line in some]


def members(random_, text):
    body, at = b"", 0
    while at < len(text) or not body:
        size = random_.choice([0, 1, 7, 50, 200])
        body += gzip.compress(text[at:at + size])
        at += size
    return body


def some_text(random_):
    word = lambda: bytes(random_.choice(b"abc \xc3\xa9") for _ in range(random_.choice([0, 1, 5, 40])))
    text = b"".join(word() + random_.choice([b"\n", b"\r\n"]) for _ in range(random_.randint(0, 60)))
    return text + random_.choice([b"", b"last"])


@pytest.mark.parametrize("chunk", [5, 64, 1 << 20])
def test_every_split_gives_the_lines_of_the_file(monkeypatch, chunk):
    monkeypatch.setattr(gzip_lines, "CHUNK", chunk)
    random_ = random.Random(chunk)
    for _ in range(60):
        text = some_text(random_)
        body = members(random_, text) + bytes(random_.choice([0, 0, 9]))
        assert split_lines(body, random_.choice([1, 7, 30, 64, 1000])) == text.splitlines()


def test_damage_is_never_silent():
    random_ = random.Random(7)
    for _ in range(80):
        text = some_text(random_)
        body = members(random_, text)
        damaged = bytearray(body)
        damaged[random_.randrange(len(body))] ^= 1 << random_.randrange(8)
        for wrong in (bytes(damaged), body[:-3]):
            try:
                assert split_lines(wrong, random_.choice([7, 64])) == text.splitlines()   # a bit of a header's time
            except ValueError:
                pass


def test_header_bytes_inside_a_member_are_no_member():
    inner = gzip.compress(b"inner\n")
    text = b"".join(b"%d\n" % i + inner[:8] + b"\n" for i in range(50))
    body = gzip.compress(text, 0) + gzip.compress(b"end\n")
    assert split_lines(body, 16) == text.splitlines() + [b"end"]


def test_members_are_read_by_many_tasks(spark, tmp_path):
    path = tmp_path / "b.tsv.gz"
    path.write_bytes(b"".join(gzip.compress(b"".join(b"line %d\n" % (100 * k + i) for i in range(100))) for k in range(20)))
    lines = readers.text_lines(spark, str(path), 300)
    held = lines.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
    assert sum(held) == 2000 and sum(n > 0 for n in held) > 4
    found = readers.numbered_lines(spark, str(path), "n", 300).collect()
    assert sorted((r.n, r.value) for r in found) == [(i, f"line {i}") for i in range(2000)]


@pytest.mark.parametrize("body, match", [("2 2 3\n1 1 4\n2 2 5\n", "2 entries where"), ("2 2 1\n1 1 4\n2 2 5\n", "2 entries where"),
                                         ("2 2 1\n3 1 4\n", "outside"), ("2 2 1\nx y 4\n", "outside"), ("1 1 4\n1 1 4\n", "1 entries where"),
                                         ("some text\n", "dimensions")])
def test_miscounted_matrices_raise(spark, tmp_path, body, match):
    path = tmp_path / "matrix.mtx"
    path.write_text("%%MatrixMarket matrix coordinate real general\n" + body)
    with pytest.raises(ValueError, match=match):
        readers.read_mtx(spark, str(path))


def test_cut_matrix_raises(spark, tmp_path):
    path = tmp_path / "matrix.mtx.gz"
    path.write_bytes(gzip.compress(b"%%MatrixMarket\n2 2 2\n1 1 4\n2 2 5\n")[:-5])
    with pytest.raises(Exception, match="cut off"):
        readers.read_mtx(spark, str(path))
