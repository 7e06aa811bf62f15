"""SimHash, cap filters, components: against all pairs."""

import numpy as np
import pytest

from cellweave.llm import caps, overlap, simhash
from cellweave.llm.components import components
from tests.llm import reference as R

SF = "/root/testdata/sf0.01"


def test_components_of_chains_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(120)] + [(1000, 1000 + i) for i in range(1, 50)] + [(5, 5), (None, 3), (2 ** 63 - 1, -2 ** 63)]
    found = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(found[i] == 0 for i in range(121)) and all(found[1000 + i] == 1000 for i in range(50))
    assert found[2 ** 63 - 1] == -2 ** 63 and len(found) == 121 + 50 + 2
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_masks_cover_every_pair_within_the_radius():
    for radius in (1, 2, 3):
        masks = simhash.masks(list(range(24)), radius)
        assert len(masks) == 2 ** (radius + 1) - 1
        rng = np.random.default_rng(radius)
        for _ in range(500):
            flips = sum(1 << int(p) for p in rng.choice(24, radius, replace=False))
            assert any(not m & flips for m in masks)


def test_simhash_against_all_pairs(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = docs.toPandas()
    found = {r.id: (r.fp, r.component) for r in simhash.near_duplicates(docs).collect()}
    prints = np.array([R.fingerprint(t) for t in rows["text"]], np.uint64)
    ids = rows["doc_id"].tolist()
    assert [found[i][0] & (2 ** 64 - 1) for i in ids] == prints.tolist()
    near = [(i, int(j)) for i in range(len(ids)) for j in np.flatnonzero(np.bitwise_count(prints ^ prints[i]) <= 2)]
    top, least = R.components(len(ids), near), {}
    for i, t in zip(ids, top):
        least[t] = min(i, least.get(t, i))
    assert [found[i][1] for i in ids] == [least[t] for t in top]


@pytest.mark.parametrize("group", [4, 4096])
def test_dense_fingerprints_stay_connected_when_groups_are_split(spark, group):
    values = [int(v) for v in np.random.default_rng(1).choice(1 << 12, 300, replace=False)]
    edges = simhash.links(spark.createDataFrame([(v,) for v in values], "fp long"), 2, group).collect()
    place = {v: i for i, v in enumerate(sorted(values))}
    ours = R.components(len(values), [(place[e.a], place[e.b]) for e in edges])
    order = np.array(sorted(values), np.uint64)
    near = [(i, int(j)) for i in range(len(order)) for j in np.flatnonzero(np.bitwise_count(order ^ order[i]) <= 2)]
    assert ours == R.components(len(values), near)


def test_simhash_of_odd_rows(spark):
    rows = [(1, None, 0), (2, "", 1), (3, " \t\n", 2), (4, "one two", 3), (4, "one two", 4), (None, "ONE  two", 5), (None, "alone here " * 9, 6), (7, "x" * 300000, 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp int")
    found = simhash.near_duplicates(docs).collect()
    assert sorted((r.id if r.id is not None else -1, r.component if r.component is not None else -1) for r in found) == [
        (-1, -1), (-1, 4), (1, 1), (2, 1), (3, 1), (4, 4), (4, 4), (7, 7)]
    assert simhash.near_duplicates(docs.limit(0)).count() == 0
    assert simhash.fingerprints(docs).columns == ["doc_id", "fp"]


def vectors(seed=0):
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((6, 16))
    near = [base[i % 6] + rng.standard_normal(16) * [.05, .12, .2][i % 3] for i in range(400)]
    return [(i, v.tolist()) for i, v in enumerate([*near, *rng.standard_normal((200, 16))])]


@pytest.mark.parametrize("tile", [40, 1024])
def test_caps_against_all_pairs(spark, tile):
    rows = vectors()
    odd = [(1000, None), (1001, []), (1002, [0.0] * 16), (1003, [float("nan")] * 16), (1004, [1.0, None]), (None, [1.0] * 16),
           (1005, [3.0, 4.0]), (1006, [6.0, 8.0]), (1007, rows[0][1]), (1008, rows[0][1]), (1009, [float("inf"), 1.0])]
    df = spark.createDataFrame([(a, b, "x") for a, b in rows + odd], "vec_id long, embedding array<double>, uid string")
    found = {r.vec_id: r for r in caps.near_duplicates(df, tile=tile).collect()}
    assert len(found) == len(rows) + len(odd)
    checked = [*rows, odd[8], odd[9]]
    links, least = R.cosine_links([i for i, _ in checked], np.array([v for _, v in checked]))
    for (i, _), n, c in zip(checked, links, least):
        assert (found[i].n_links, found[i].component_id, found[i].kept) == (n, c, i == c)
    for i in (1000, 1001, 1002, 1003, 1004, 1009):
        assert (found[i].n_links, found[i].component_id, found[i].kept) == (0, i, True)
    assert (found[None].n_links, found[None].component_id, found[None].kept) == (0, None, False)
    assert (found[1006].n_links, found[1006].component_id) == (1, 1005)
    assert caps.near_duplicates(df.limit(0)).count() == 0


def test_pairs_at_the_threshold_share_a_filter():
    rng = np.random.default_rng(3)
    for n, d in ((2000, 64), (50_000, 64), (5000, 300), (300, 3)):
        code = caps.ProductCode(n, d)
        x = caps._unit(rng.standard_normal((1500, d)))
        z = rng.standard_normal((1500, d))
        z = caps._unit(z - (z * x).sum(axis=1, keepdims=True) * x)
        y = 0.95 * x + np.sqrt(1 - 0.95 ** 2) * z
        shared = set(zip(*(a.tolist() for a in code.decode(x)))) & set(zip(*(a.tolist() for a in code.decode(y))))
        assert len({row for row, _ in shared}) >= 0.998 * 1500


def test_floats_and_given_embeddings(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    found = caps.near_duplicates(df).toPandas().set_index("vec_id")
    rows = df.toPandas()
    links, least = R.cosine_links(rows["vec_id"].to_numpy(), np.stack(rows["embedding"]).astype(float))
    assert (found.loc[rows["vec_id"], "n_links"].to_numpy() == links).all()
    assert (found.loc[rows["vec_id"], "component_id"].to_numpy() == least).all()


def test_sketches_never_differ_in_more_bits_than_sets_in_shingles(spark):
    rng = np.random.default_rng(11)
    rows = []
    for n in (0, 1, 5, 63, 64, 65, 128, 129, 300, 1000, 5000):
        for drop in (0, 1, n // 12, n // 9, n // 5):
            a = np.unique(rng.integers(-2 ** 63, 2 ** 63, n))
            b = np.unique(np.concatenate([a[drop:], rng.integers(-2 ** 63, 2 ** 63, drop // 2)]))
            words, size = overlap.parities(np.concatenate([a, b]), np.array([len(a), len(b)]))
            assert (size * 64 >= [len(a), len(b)]).all() and size.sum() == len(words)
            rows.append((words[:size[0]].tolist(), words[size[0]:].tolist(), len(np.setxor1d(a, b))))
    pairs = spark.createDataFrame(rows, "x array<long>, y array<long>, apart int").select("*", overlap.sketch_gap("x", "y").alias("gap"))
    found = pairs.collect()
    assert all(r.gap <= r.apart and (r.gap - r.apart) % 2 == 0 for r in found)
    assert sum(r.gap >= 0.8 * r.apart for r in found) > 0.9 * len(found)


def test_overlap_of_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \t"), (4, "a b"), (4, "A b"), (5, "a b c d e f"), (6, "x " * 100_000), (7, "x " * 99_000)]
    docs = spark.createDataFrame(rows, "id long, text string")
    found = {}
    for r in overlap.near_duplicates(docs, "id").collect():
        found.setdefault(r.component, []).append(r.id)
    assert sorted(map(sorted, found.values())) == [[1, 2, 3], [4, 4], [5], [6, 7]]
    assert overlap.near_duplicates(docs.limit(0), "id").count() == 0


def test_a_crowd_of_near_copies_draws_few_pairs_and_loses_no_link(spark, monkeypatch):
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in range(150)]
    passage = [f"p{i}" for i in range(40)]
    texts = []
    for i in range(400):
        words = list(base)
        for at in rng.integers(0, 150, i % 9):
            words[at] = f"n{rng.integers(1 << 40)}"
        texts.append(words)
    texts += [[f"o{i}_{j}" for j in range(8)] + passage for i in range(60)]
    sets = [{tuple(words[k:k + 5]) for k in range(len(words) - 4)} for words in texts]
    least = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if least[i] != least[j] and 9 * both >= 4 * (len(sets[i]) + len(sets[j])):
                low, high = sorted((least[i], least[j]))
                least = [low if x == high else x for x in least]
    counts, plain = [], overlap.drawn

    def counted(*args):
        counts.append(plain(*args).count())
        return plain(*args)

    monkeypatch.setattr(overlap, "drawn", counted)
    docs = spark.createDataFrame([(i, " ".join(words)) for i, words in enumerate(texts)], "id long, text string")
    found = overlap.near_duplicates(docs, "id").toPandas()
    assert len(found) == len(texts)
    assert found.groupby("component")["id"].min().loc[found["component"]].tolist() == [least[i] for i in found["id"]]
    assert sum(counts) < 4 * len(texts)


def test_of_shingles_with_the_same_sets_the_first_leads(spark):
    rows = [(1, 0, 10), (1, 1, 11), (1, 2, 12), (2, 1, 10), (2, 2, 11), (2, 4, 12), (3, 0, 12), (4, 0, 13)]
    found = overlap.leading(spark.createDataFrame(rows, "node long, place int, shingle long")).collect()
    assert sorted((r.shingle, r.members) for r in found) == [(10, 2), (12, 3)]
