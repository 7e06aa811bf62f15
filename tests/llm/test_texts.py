"""Language, toxicity, n-gram scores, pieces, repeated passages."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F

from cellweave.llm import arrays as A
from cellweave.llm import language, lm, pieces, substrings, toxicity
from cellweave.llm.suffixes import suffix_array
from tests.llm import reference as R

SF = "/root/testdata/sf0.01"


def test_hashes_depend_on_bytes_alone():
    x = np.random.default_rng(0).integers(0, 4, 1500).astype(np.uint8)
    for k in (1, 5, 96, 200):
        start = np.arange(len(x) - k + 1)
        for found in (A.gram_hash(x, k), A.range_hash(A.prefix_hash(x), start, start + k)):
            seen = {}
            for i, h in enumerate(found.tolist()):
                seen.setdefault(x[i:i + k].tobytes(), set()).add(h)
            assert all(len(v) == 1 for v in seen.values()) and len(set().union(*seen.values())) == len(seen)


def test_phrases_against_plain_parsing():
    rng = random.Random(3)
    known = {"a": "".join(rng.choice("abc ") for _ in range(300)).encode(), "b": "".join(rng.choice("bcd.") for _ in range(200)).encode()}
    parser = language.Parser(known)
    texts = ["".join(rng.choice("abcdz.") for _ in range(n)) for n in (0, 1, 5, 40, 1023, 1024, 1025, 3000)]
    bits = parser.entropy(*language.folded(pa.array(texts)))
    for i, t in enumerate(texts):
        for k, name in enumerate(parser.languages):
            n = R.phrases(t.encode(), known[name], language.BLOCK)
            assert bits[i, k] == pytest.approx(n * np.log2(len(known[name])) / max(1, len(t)))


def test_languages_of_held_out_texts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    fold = A.crc_fold(F.col("doc_id"), 4)
    found = language.predict(docs, language.fit(docs, learn=fold != 2)).filter(fold == 2).toPandas()
    assert len(found) > 200 and (found["lang"] == found["lang_pred"]).mean() > 0.97 and found["score"].between(0, 1).all()


def test_languages_of_odd_rows(spark):
    docs = spark.createDataFrame([(1, "the cat and the hat", "en", 1), (2, "der hund und die katze", "de", 2), (3, None, "en", 3), (4, "123 ..", None, 4),
                                  (None, "der hund", None, 5), (6, "", "fr", 6)], "doc_id long, text string, lang string, score int")
    model = language.fit(docs)
    found = {r.doc_id: (r.lang_pred, r.score) for r in language.predict(docs, model).collect()}
    assert set(model.texts) == {"en", "de"} and found[1][0] == "en" and found[2][0] == "de" and found[None][0] == "de"
    assert found[3] == found[4] == found[6] == ("und", 0.0)
    none = language.fit(docs.limit(0))
    assert {r.lang_pred for r in language.predict(docs, none).collect()} == {"und"}
    assert language.predict(docs.limit(0), model).count() == 0


def test_nonnegative_risk_finds_the_positive_feature():
    rng = np.random.default_rng(0)
    n = 2000
    positive = rng.random(n) < 0.2
    known = (positive & (rng.random(n) < 0.5)).astype(int)
    text = np.concatenate([np.flatnonzero(positive), np.arange(n)])
    feature = np.concatenate([np.zeros(positive.sum(), int), 1 + rng.integers(0, 5, n)])
    w, b = toxicity.nonnegative_pu(known, text, feature, 6, 0.2)
    score = np.bincount(text, w[feature], minlength=n) + b
    assert ((score > 0) == positive).mean() > 0.98


def test_toxicity_of_held_out_texts(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(docs, labels, learn=A.crc_fold(F.col("doc_id"), 5) != 0)
    rows = toxicity.score(docs.select("doc_id", "text"), model).join(labels, "doc_id").select("doc_id", "score", "toxic").toPandas()
    rows = rows[[zlib.crc32(str(i).encode()) % 5 == 0 for i in rows["doc_id"]]]
    said = rows["score"] >= 0.5
    assert said[rows["toxic"] == 1].mean() > 0.85 and said[rows["toxic"] == 0].mean() < 0.05


def test_toxicity_of_odd_rows(spark):
    docs = spark.createDataFrame([(1, "bad words here", "a"), (2, None, "b"), (None, "", "c"), (4, "good", "d"), (4, "good", "d")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(1, 1), (4, 0), (4, None), (None, 1)], "doc_id long, toxic int")
    found = toxicity.score(docs, toxicity.fit(docs, labels)).collect()
    assert len(found) == 5 and all(0 <= r.score <= 1 for r in found)
    assert len({r.score for r in found if not r.text}) == 1
    empty = toxicity.fit(docs.limit(0), labels.limit(0))
    assert {round(r.score, 6) for r in toxicity.score(docs, empty).collect()} == {0.1}
    assert toxicity.score(docs.limit(0), empty).count() == 0


def test_scores_of_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, 1), (2, "  ", 2), (3, "a", 3), (3, "a", 3), (None, "A b a b", 4)], "doc_id long, text string, block int")
    found = {(r.doc_id, r.block): (r.n_words, r.log_score) for r in lm.score(docs, ["doc_id", "block"]).collect()}
    assert found[1, 1] == (0, 0.0) and found[2, 2] == (0, 0.0)
    assert found[3, 3] == (1, pytest.approx(np.log(0.16 * 4 / 6)))
    # a, then b after a (2 of 4), a after b (once: back to unigram), b after a again; no trigram is seen twice
    want = np.log(0.16 * 4 / 6) + np.log(0.4 * 2 / 4) + np.log(0.16 * 4 / 6) + np.log(0.4 * 2 / 4)
    assert found[None, 4] == (4, pytest.approx(want))
    assert lm.score(docs.limit(0), ["doc_id"]).count() == 0


def test_suffix_arrays():
    rng = random.Random(0)
    for _ in range(1500):
        s = [rng.randint(0, rng.choice([1, 2, 5])) for _ in range(rng.randint(0, 40))]
        assert suffix_array(np.array(s, np.int64)).tolist() == sorted(range(len(s)), key=lambda i: s[i:])


def passages(seed=5):
    rng = random.Random(seed)

    def text(n, k):
        return "".join(rng.choice("ab é日 .x1"[:k]) for _ in range(n))

    shared = [text(rng.randint(150, 500), rng.choice([2, 5, 10])) for _ in range(12)]
    rows = [(i if i % 50 else None, "".join(text(rng.choice([0, 3, 50, 300]), 10) + rng.choice(shared)[:rng.choice([150, 199, 201, 500])]
                                            for _ in range(rng.randint(0, 4)))) for i in range(300)]
    rows += [(1000, "a" * 1000), (1001, "a" * 150), (1002, None), (1003, ""), (1003, ""), (1004, "q" * 199), (1005, "q" * 200),
             (1006, "z" * 250), (1006, "z" * 250), (1007, "abc" * 400)]
    return rows + [(2000 + i, text(30, 10) + shared[0] + shared[1] + text(30, 10)) for i in range(150)]


@pytest.mark.parametrize("batch, task, chunk, gram", [(16, 512, 8 << 20, 96), (1, 2, 2000, 96), (1, 1, 1, 150)])
def test_repeats_against_counting_all_strings(spark, monkeypatch, batch, task, chunk, gram):
    for name, value in (("HOT_BATCH", batch), ("HOT_TASK", task), ("CHUNK", chunk)):
        monkeypatch.setattr(substrings, name, value)
    rows = [(k, i, t) for k, (i, t) in enumerate(passages())]
    df = spark.createDataFrame(rows, "bucket long, doc_id long, text string")
    found = substrings.remove_repeats(df, ["bucket", "doc_id"], gram=gram).orderBy("bucket").collect()
    assert [(r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in found] == R.repeated([t for _, _, t in rows])


def test_repeats_of_documents(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    rows = df.toPandas()
    found = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in substrings.remove_repeats(df, ["doc_id"]).collect()}
    assert [found[i] for i in rows["doc_id"]] == R.repeated(rows["text"])
    assert substrings.remove_repeats(df.limit(0), ["doc_id"]).count() == 0


def test_kept_texts_are_whole_characters(spark):
    df = spark.createDataFrame([(1, "é" + "日" * 100 + "é"), (2, "ö" + "日" * 100 + "ü")], "doc_id long, text string")
    found = {r.doc_id: r.kept_text for r in substrings.remove_repeats(df, ["doc_id"], digest=False).collect()}
    assert found == {1: "éé", 2: "öü"}


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)


def test_pieces_are_those_of_the_library(library):
    rng = random.Random(1)
    odd = ["", " ", "  ", "a  b   c", "\n\n x\ty", " ▁ x", "日本語テキスト🎉 ok", "aaaa bbbb    ", "x" * 300, "é" * 50, "a" + " " * 40 + "b", "ffi ½ ①", "\x00\x01"]
    odd += ["".join(rng.choice(["a", "b", " ", "th", "e", "▁", "é", "0", "==", "\n", "日", " ", "ing"]) for _ in range(rng.randint(0, 60))) for _ in range(800)]
    machine = pieces.Transducer(open(pieces.MODEL, "rb").read())
    ids, at = machine.encode(pa.array(odd))
    want = library.encode(odd)
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == want
    assert machine.strings(*machine.decode(ids, at)).to_pylist() == library.decode(want)


def _message(*fields):
    """A protocol-buffer message of (number, bytes or int or float)."""
    import struct
    out = b""
    for number, value in fields:
        if isinstance(value, bytes):
            out += bytes([number << 3 | 2]) + _size(len(value)) + value
        elif isinstance(value, float):
            out += bytes([number << 3 | 5]) + struct.pack("<f", value)
        else:
            out += bytes([number << 3]) + _size(value)
    return out


def _size(n):
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def test_unigram_paths_are_the_best_of_all():
    from itertools import product
    scores = {"▁": -2.0, "a": -3.0, "b": -3.5, "ab": -4.0, "ba": -5.0, "▁a": -4.5, "aba": -8.0}
    fields = [(1, _message((1, b"<unk>"), (2, 0.0), (3, 2)))] + [(1, _message((1, p.encode()), (2, s))) for p, s in scores.items()]
    machine = pieces.Transducer(_message(*fields, (2, _message((3, 1))), (3, _message((1, b"identity"), (3, 1), (4, 1)))))
    for n in range(1, 7):
        for text in product("ab", repeat=n):
            whole = "▁" + "".join(text)
            best = {0: 0.0}
            for end in range(1, len(whole) + 1):
                best[end] = max(best[s] + scores[whole[s:end]] for s in range(end) if whole[s:end] in scores)
            found = machine.path(whole)
            assert sum(machine.score[k] for k in found) == pytest.approx(best[len(whole)])
            assert "".join(machine.pieces[k] for k in found) == whole


def test_pieces_round_trip(spark, library):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    coded = pieces.encode(docs.select("doc_id", "text", F.lit(1).alias("ids")))
    assert coded.columns == ["doc_id", "ids", "n_ids", "round_trip"]
    rows = {r.doc_id: r for r in coded.collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert all(r.round_trip and r.n_ids == len(r.ids) for r in rows.values())
    assert all(rows[i].ids == library.encode(texts[i]) for i in list(texts)[:150])
    assert {r.doc_id: r.text for r in pieces.decode(coded).collect()} == texts
    odd = spark.createDataFrame([(None, None), (1, ""), (1, "a")], "doc_id long, text string")
    assert sorted(r.n_ids for r in pieces.encode(odd).collect()) == [0, 0, 1]
    assert pieces.encode(odd.limit(0)).count() == 0
