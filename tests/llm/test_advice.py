"""Whole results where an operator once did less: against brute force."""

import collections
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cellweave.llm import arrays as A
from cellweave.llm import lm, maxscore
from tests.llm import reference as R

SF = "/root/testdata/sf0.01"


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text))
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))}


def jaccard_classes(texts):
    sets = [shingles(t) for t in texts]
    near = [(i, j) for j in range(len(sets)) for i in range(j) if 9 * len(sets[i] & sets[j]) >= 4 * (len(sets[i]) + len(sets[j]))]
    return near, R.components(len(texts), near)


def test_near_copies_of_jaccard_four_fifths_leave_one(spark):
    rng = random.Random(5)
    texts = []
    for _ in range(60):
        base = [rng.choice("abcdefghij") + str(rng.randrange(3000)) for _ in range(rng.randrange(3, 150))]
        texts.append(" ".join(base))
        for _ in range(rng.randrange(4)):
            copy = list(base)
            for _ in range(rng.randrange(4)):
                copy[rng.randrange(len(copy))] = f"new{rng.randrange(9999)}"
            texts.append(" ".join(copy))
    line = " ".join(f"line{k}" for k in range(12))
    texts += [f"{line} {rng.random()} {rng.random()}" for _ in range(40)] + [f"{line} {rng.randrange(9)}" for _ in range(40)]
    rng.shuffle(texts)
    near, top = jaccard_classes(texts)
    assert len(near) > 500 and len(set(top)) > 60
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = sorted(r.doc_id for r in corpus_pipeline.one_of_each(spark, docs, "").collect())
    assert kept == sorted(set(top))


def test_near_copies_of_given_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").orderBy("doc_id").collect() if r.text and r.text.strip(" \t\n\v\f\r")]
    _, top = jaccard_classes([t for _, t in rows])
    expected = {rows[t][0] for t in top}
    worded = docs.filter(docs.doc_id.isin([i for i, _ in rows]))
    assert {r.doc_id for r in corpus_pipeline.one_of_each(spark, worded, SF).select("doc_id").collect()} == expected


def test_an_id_on_texts_of_two_classes_keeps_both(spark):
    rows = [(2, "a b c d"), (2, "a b c d"), (2, "other words here now ok"), (3, "A b c D"), (4, "the third text stands alone"), (2, "")]
    kept = corpus_pipeline.one_of_each(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    assert sorted(map(tuple, kept.collect())) == [
        (2, ""), (2, "a b c d"), (2, "other words here now ok"), (4, "the third text stands alone")]


def plain_scores(texts):
    words = [t.split() for t in texts]
    c = [collections.Counter(tuple(w[i:i + k]) for w in words for i in range(len(w) - k + 1)) for k in (1, 2, 3)]
    total, out = sum(map(len, words)), []
    for w in words:
        x = 0.0
        for i in range(len(w)):
            if i > 1 and c[2][tuple(w[i - 2:i + 1])] > 1:
                x += math.log(c[2][tuple(w[i - 2:i + 1])] / c[1][tuple(w[i - 2:i])])
            elif i and c[1][tuple(w[i - 1:i + 1])] > 1:
                x += math.log(.4 * c[1][tuple(w[i - 1:i + 1])] / c[0][w[i - 1],])
            else:
                x += math.log(.16 * c[0][w[i],] / total)
        out.append(x)
    return out


def test_trigrams_that_share_24_bits_of_their_first_word_are_two(spark):
    names = [f"w{i}" for i in range(20_000)]
    data = np.frombuffer("".join(names).encode(), np.uint8)
    ends = np.cumsum([len(x) for x in names])
    cut = A.mix(A.range_hash(A.prefix_hash(data), ends - [len(x) for x in names], ends)) & np.uint64((1 << 24) - 1)
    seen, pairs = {}, []
    for name, bits in zip(names, cut.tolist()):
        if bits in seen:
            pairs.append((seen[bits], name))
        seen[bits] = name
    assert pairs
    texts = [f"{u} v w" for pair in pairs for u in pair] + ["v w", "", "u v w u v w", "one"]
    found = lm.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), ["doc_id"]).orderBy("doc_id").collect()
    assert [r.log_score for r in found] == pytest.approx(plain_scores(texts))


def test_top_k_keeps_finite_vectors_of_any_size(spark):
    rng = np.random.default_rng(7)
    rows = [(i, (rng.standard_normal(6) * 10.0 ** rng.choice([0, 3, 4, 5])).tolist()) for i in range(300)]
    rows += [(300, [20_000.0, 1.0]), (301, [1e8, 0.0, -1e-3]), (302, [2e7] * 6), (303, [2e7] * 5 + [2e7 + 1 / 256]), (304, []), (305, [float("inf")])]
    good = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if all(map(math.isfinite, v))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = collections.defaultdict(list)
    for r in maxscore.top_k(df, (F.col("id") % 10 == 0) & (F.col("id") != 0), 5, shard_rows=70, block=8).orderBy("query_id", "rank").collect():
        found[r.query_id].append((r.score, r.vec_id))
    asked = [(i, v) for i, v in good if i % 10 == 0 and i]
    for q, v in asked:
        best = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in good if i != q)[:5]
        assert found[q] == [(-s, i) for s, i in best]
    assert len(found) == len(asked)
    # a pair whose score doesn't fit a long is left out, others of the same rows stay
    large = spark.createDataFrame([(0, [1e30]), (1, [1.0]), (2, [2.0])], "vec_id long, embedding array<double>")
    kept = maxscore.top_k(large, F.col("id") == 1).collect()
    assert [(r.query_id, r.vec_id, r.score) for r in kept] == [(1, 2, 256 * 512)]


def test_words_whose_power_of_two_hash_agrees_stay_apart(spark):
    """A Thue-Morse word and its complement agree under every odd base modulo 2^64; they are two words all the same."""
    bits = [bin(i).count("1") & 1 for i in range(1024)]
    one, two = ("".join("ab"[b ^ turn] for b in bits) for turn in (0, 1))
    found = lm.score(spark.createDataFrame([(1, one), (2, two), (3, "")], "doc_id long, text string"), ["doc_id"]).orderBy("doc_id").collect()
    assert [(r.n_words, round(r.log_score, 6)) for r in found] == [(1, round(math.log(lm.BACKOFF ** 2 / 2), 6))] * 2 + [(0, 0.0)]


def test_word_hash_depends_on_the_bytes_alone():
    rng = np.random.default_rng(5)
    for size in (40, A.STEP_BYTES + 9):
        body = np.concatenate([np.zeros(size, np.uint8), rng.integers(0, 256, 40).astype(np.uint8)])
        body[:20] = body[-20:]
        starts, ends = np.array([0, size + 20, 0, 3, 7]), np.array([20, size + 40, 0, 3, 20])
        h = A.word_hash(body, starts, ends)
        assert h[0] == h[1] and h[2] == h[3] and len(set(h.tolist())) == 3
        assert h[4] == A.word_hash(body[7:20], np.array([0]), np.array([13]))[0]
