"""Vector codes and the divergence audit against plain versions."""

import collections
import hashlib
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellweave.llm import codebooks, divergence


def plain_codes(rows, parts=4, entries=256, rounds=4):
    """(id, code, error, label_error, digest) by comparing everything with everything, in Python integers."""
    kept = [(i, [math.floor(1024 * x) if abs(x) < 2**60 else int(x) * 1024 for x in v], lab) for i, v, lab in rows
            if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return []
    size = -(-max(len(v) for _, v, _ in kept) // parts)
    kept = [(i, v + [0] * (size * parts - len(v)), lab) for i, v, lab in kept]
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    books = [[r[1][p * size:(p + 1) * size] for r in first] for p in range(parts)]

    def best(book, x):
        return min((sum((a - b) ** 2 for a, b in zip(e, x)), j) for j, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            mine = collections.defaultdict(list)
            for _, v, _ in kept:
                x = v[p * size:(p + 1) * size]
                mine[best(books[p], x)[1]].append(x)
            books[p] = [[sum(c) // len(mine[j]) for c in zip(*mine[j])] if j in mine else e for j, e in enumerate(books[p])]
    text = ",".join(str(c) for b in books for e in b for c in e)
    out, sums = [], collections.Counter()
    for i, v, lab in kept:
        found = [best(books[p], v[p * size:(p + 1) * size]) for p in range(parts)]
        out.append((i, "".join(f"{j:02x}" for _, j in found), sum(d for d, _ in found), lab))
        sums[lab] += out[-1][2]
    digest = hashlib.sha256(text.encode()).hexdigest()
    fits = {lab: s if s < 2**63 and all(e < 2**63 for _, _, e, b in out if b == lab) else None for lab, s in sums.items()}
    return [(i, c, e if e < 2**63 else None, fits[lab], digest) for i, c, e, lab in out]


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("code", F.lit("x")).withColumn("error", F.lit(0))


def codes(df, **more):
    key = lambda r: (r[0] is None, r[0] or 0, *map(str, r[1:]))
    return sorted([tuple(r) for r in codebooks.compress(df, **more).collect()], key=key), key


@pytest.mark.parametrize("large", [1.0, 1e30, 1e307])
def test_codes_of_odd_vectors(spark, large):
    rng = np.random.default_rng(3)
    rows = [(i, (np.round(rng.standard_normal(8) * 4) / 4).tolist(), int(i % 3) if i % 5 else None) for i in range(120)]
    rows += [(7, rows[7][1], 1), (7, rows[7][1], 1), (None, [0.5] * 8, 2), (200, None, 1), (201, [float("nan")] * 8, 1), (202, [1.0, None], 1),
             (203, [float("inf")] * 8, 1), (204, [1.0, 2.0], 9), (205, [], 9), (206, [large, -large] * 4, 7), (-4, [0.25] * 7, 9)]
    found, key = codes(vectors(spark, rows).repartition(5), entries=16)
    assert found == sorted(plain_codes(rows, entries=16), key=key)


def test_codes_of_few_vectors(spark):
    for rows in ([], [(1, None, 1)], [(1, [1.0, 2.0, 3.0, 4.0], 1)], [(3, [], None), (4, [], None)]):
        found, key = codes(vectors(spark, rows))
        assert found == sorted(plain_codes(rows), key=key)


def test_search_walks_to_the_nearest_entry():
    rng = np.random.default_rng(5)
    for k, kind in [(1, float), (2, float), (7, object), (300, float)]:
        entries = rng.integers(-6, 7, (k, 3)).astype(kind)
        x = rng.integers(-9, 10, (500, 3)).astype(kind)
        at, dist = codebooks.Book(entries).nearest(x)
        apart = ((x[:, None, :] - entries[None]) ** 2).sum(axis=2).astype(float)
        assert (apart.argmin(axis=1) == at).all() and (apart.min(axis=1) == dist.astype(float)).all()


def test_search_skips_most_of_clustered_entries():
    rng = np.random.default_rng(6)
    entries = np.repeat(rng.integers(-10_000, 10_000, (32, 4)), 8, axis=0).astype(float) + rng.integers(-5, 6, (256, 4))
    book = codebooks.Book(entries)
    x = entries[rng.integers(0, 256, 2000)] + rng.integers(-5, 6, (2000, 4))
    book.entries = Counted(entries)
    book.nearest(x)
    assert Counted.taken < 0.4 * len(x) * 256


class Counted(np.ndarray):
    """Entries that count how many of them were fetched."""

    taken = 0

    def __new__(cls, rows):
        return np.asarray(rows).view(cls)

    def __getitem__(self, at):
        out = np.asarray(super().__getitem__(at))
        Counted.taken += len(out) if out.ndim == 2 else 0
        return out


def plain_audit(rows, min_docs=3, top=200):
    term = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    lower = {c: c + 32 for c in range(65, 91)}
    counts, docs = collections.defaultdict(collections.Counter), collections.defaultdict(collections.Counter)
    for lang, source, text in ((a or "", b or "", t or "") for a, b, t in rows):
        found = term.findall(text.translate(lower))
        counts[lang, source].update(found)
        docs[lang].update(set(found))
    kept = {lang: [t for t, n in c.items() if n >= min_docs] for lang, c in docs.items()}
    total = {lang: collections.Counter() for lang in kept}
    for (lang, _), c in counts.items():
        total[lang].update(c)

    def shares(lang, c):
        n = sum(c[t] for t in kept[lang]) + len(kept[lang])
        return {t: 1 + 10**9 * (c[t] + 1) // n for t in kept[lang]}

    out = []
    for (lang, source), c in counts.items():
        p, q = shares(lang, c), shares(lang, total[lang])
        pairs = []
        for (other_lang, other), d in counts.items():
            if other_lang == lang and other != source:
                r = shares(lang, d)
                pairs.append((other, sum((p[t] - r[t]) ** 2 // r[t] for t in p)))
        terms = [(t, (p[t] - q[t]) ** 2 // q[t]) for t in p if c[t] and p[t] > q[t]]
        for part, items, most in (("pair", pairs, len(pairs)), ("term", terms, top)):
            ranked = sorted(items, key=lambda x: (-x[1], x[0].encode()))[:most]
            out += [(lang, source, part, item, value, i) for i, (item, value) in enumerate(ranked, 1)]
    return sorted(out)


def test_audit_of_odd_documents(spark, monkeypatch):
    rng = random.Random(8)
    words = ["a", "B", "b", "ça", "Ça", "été", "x1y", "naïve", "𝒳", " ", "don't", "zz"] + [f"w{c}" for c in "abcdefghijk"]
    rows = [(rng.choice(["en", "de", None, ""]), rng.choice([None, "s", *"tuvwxyz"]), " ".join(rng.choices(words, k=rng.randrange(30)))) for _ in range(400)]
    rows += [("fr", "only", "un deux"), ("it", "p", None), ("it", "q", ""), ("it", "r", "rare"), ("en", "s", "Long " * 300_000)] + [("en", "hot", "a b a")] * 150
    df = spark.createDataFrame(rows, "lang string, source string, text string").withColumn("term", F.lit(1)).withColumn("n", F.lit(2)).repartition(7)
    assert sorted(map(tuple, divergence.audit(df, top=4).collect())) == plain_audit(rows, top=4)
    monkeypatch.setattr(divergence, "BLOCK", 3)
    monkeypatch.setattr(divergence, "CHUNK", 40)
    monkeypatch.setattr(divergence, "SLICE", 4)
    assert sorted(map(tuple, divergence.audit(df).collect())) == plain_audit(rows)
    assert divergence.audit(df.limit(0)).count() == 0
