"""Mixing, top-k search, chats, the pipeline, and the queries with an SQL twin."""

import random
from functools import lru_cache

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cellweave.llm import arrays, chat, maxscore, mixing, queries
from tests import oracle

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_same_as_sql(spark, name):
    found = queries.QUERIES[name](spark, SF)
    expected = oracle.database(SF).sql(queries.ORACLES[name])
    names = {"BIGINT": "bigint", "DOUBLE": "double", "VARCHAR": "string", "INTEGER": "int"}
    assert {c: f.dataType.simpleString() for c, f in zip(found.columns, found.schema.fields)} == {
        c: names[str(t)] for c, t in zip(expected.columns, expected.types)}
    assert oracle.differences(found.toPandas(), expected.df()) is None


def test_mix_of_uneven_sources(spark):
    rows = [(i, "a", "w " * (1 + i % 7)) for i in range(3)] + [(100 + i, "b", "w " * (1 + i % 5)) for i in range(400)]
    rows += [(600 + i, None, "x y") for i in range(9)] + [(700, "e", None), (701, "e", " "), (100, "b", "w "), (100, "b", "w ")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumn("size", F.lit("clash")).repartition(7)
    found = mixing.mix(docs).toPandas()
    assert len(found) == len(rows) and found["size"].sum() == sum(len((t or "").split()) for *_, t in rows)
    assert found.groupby("source", dropna=False)["target"].first().sum() == pytest.approx(found["size"].sum())
    for _, g in found.groupby("source", dropna=False):
        assert g["size"].sum() == g["source_size"].iloc[0]
        assert g["taken"].sum() == int(g["target"].iloc[0] + 0.5) and (g["taken"] <= 3 * g["size"]).all()
        assert g["target"].iloc[0] <= 3 * g["source_size"].iloc[0]
    again = mixing.mix(docs.repartition(3)).toPandas()
    order = ["doc_id", "size", "taken"]
    assert found.sort_values(order)[order].to_numpy().tolist() == again.sort_values(order)[order].to_numpy().tolist()
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    words = mixed.select("source", F.size(F.filter(F.split(F.coalesce("text", F.lit("")), " "), lambda w: w != "")).alias("n")).groupBy("source").agg(F.sum("n")).collect()
    assert dict((r[0], r[1]) for r in words) == {k if k == k else None: int(g["taken"].sum()) for k, g in found.groupby("source", dropna=False)}
    assert mixing.mix(docs.limit(0)).count() == 0 and mixing.mixed_documents(docs.limit(0)).count() == 0


def test_top_k_of_ragged_sparse_vectors(spark):
    rng = np.random.default_rng(2)
    rows = [(i, (rng.standard_normal(rng.choice([3, 8, 9])) * (rng.random() < 0.9) * rng.integers(0, 2, 1)).tolist()) for i in range(600)]
    rows += [(50, [1.0] * 8), (None, [9.0] * 8), (900, None), (901, [float("nan")] * 8), (902, [None, 1.0]), (903, [1e30] * 8), (950, [])]
    df = spark.createDataFrame([(a, b, 0) for a, b in rows], "vec_id long, embedding array<double>, q int")
    good = [(i, np.floor(256 * np.array(v)).astype(int)) for i, v in rows if i is not None and v is not None and all(x is not None and abs(x) < 1e9 for x in v)]
    found = {}
    for r in maxscore.top_k(df, F.col("id") % 50 == 0, 5, shard_rows=100, block=4).orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    for q, v in good:
        if q % 50 or q == 50:
            continue
        scores = sorted((-int(v[:min(len(v), len(w))] @ w[:min(len(v), len(w))]), i) for i, w in good if i != q)[:5]
        assert found[q] == [(k + 1, i, -s) for k, (s, i) in enumerate(scores)]
    far = spark.createDataFrame([(0, [1e307, 1.0]), (1, [0.0, 2.0]), (2, [1e30, 0.0]), (50, [0.0, -1.0]), (51, [1e307, 1e307])], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in maxscore.top_k(far, F.col("id") % 50 == 0).orderBy("query_id", "rank").collect()] == [
        (0, 1, 1, 256 * 512), (0, 2, 50, -256 * 256), (50, 1, 2, 0), (50, 2, 0, -256 * 256), (50, 3, 1, -256 * 512)]
    few = df.filter("vec_id in (100, 101)")
    assert maxscore.top_k(few, F.col("id") % 50 == 0).count() == 1
    assert maxscore.top_k(df.limit(0), F.col("id") % 50 == 0).count() == 0


def least_cost(roles):
    @lru_cache(None)
    def go(i, state, inserted):
        best = 0 if i == len(roles) and state in chat.LAST else 10 ** 6
        if i < len(roles):
            for r in chat.ROLES:
                change = chat.RELABEL * (r != roles[i])
                if r in chat.NEXT[state]:
                    best = min(best, change + go(i + 1, chat._state(r), 0))
                if chat._state(r) == state:
                    best = min(best, change + chat.MERGE + go(i + 1, state, 0))
        if inserted < 3:
            best = min([best, *(chat.INSERT + go(i, chat._state(r), inserted + 1) for r in chat.NEXT[state])])
        return best

    return go(0, 0, 0)


def test_repairs_are_legal_and_least():
    rng = random.Random(2)
    for _ in range(1500):
        roles = [rng.choice([*chat.ROLES, None]) for _ in range(rng.randint(1, 7))]
        cost, state, actions = chat.repair(roles, 0, None)
        assert cost + chat._CLOSE[state][0] == least_cost(tuple(roles))
        out = []
        for inserted, merged, role in actions:
            out += inserted
            assert not merged or out[-1] == role
            out += [role] * (not merged)
        at = 0
        for role in [*out, *chat._CHAIN[state, chat._CLOSE[state][1]]]:
            assert role in chat.NEXT[at]
            at = chat._state(role)
        assert at in chat.LAST


def test_chats_in_segments_are_the_same(spark):
    rng = random.Random(4)
    rows = [(rng.choice([1, 2, None]), rng.choice([None, *range(60)]), rng.choice(["system", "User ", "assistant", "tool", None]), rng.choice([None, "", "a<|user|>b"]), 1) for _ in range(300)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, segment int")
    seen = []
    for size in (1000, 7, 1):
        whole = chat.format_chats(df, size).toPandas().sort_values("segment", na_position="first")
        seen.append({str(k): (g["cost"].sum(), g["n_turns"].sum(), "".join(g["text"])) for k, g in whole.groupby("conv_id", dropna=False)})
    assert [v[:2] for v in seen[0].values()] == [v[:2] for v in seen[1].values()] == [v[:2] for v in seen[2].values()]
    for conversations in seen:
        assert len(conversations) == 3
        for _, n, text in conversations.values():
            assert text.count("<|end|>") == n and text.endswith("<|end|>\n") and "a< |user| >b" in text
    assert chat.format_chats(df.limit(0)).count() == 0
    one = spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "assistant", "yes")], "conv_id long, turn long, role string, text string")
    assert chat.format_chats(one).first().text == "<|user|>\nhi<|end|>\n<|assistant|>\nyes<|end|>\n"


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [s for s, _ in corpus_pipeline.STAGES][-1].startswith("SentencePiece") and len(corpus_pipeline.STAGES) == 5
    kept = corpus_pipeline.one_of_each(spark, docs, SF)  # its rows are held against brute force in test_advice
    assert kept.columns == docs.columns and 500 < kept.count() < docs.count()
    final = corpus_pipeline.run(spark, SF)
    assert final.columns == ["doc_id", "lang", "source", "ids", "n_ids", "round_trip"]
    assert final.count() > 500 and final.filter("not round_trip").count() == 0


def test_pipeline_of_odd_rows(spark):
    rows = [(1, None, None, None, None), (None, "x", "en", "s", 1), (2, "", "fr", None, 0), (2, "a b c d", "en", "s", 7), (2, "a b c d", "en", "s", 7),
            (2, "other words here now ok", "en", "s", 7), (3, "A b c D", "de", "t", 7), (4, "q " * 500, "de", "t", 1000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("fp", F.lit("extra")).withColumn("size", F.lit(1))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "fp", "size"], name
    left = [(r.doc_id, r.text) for r in docs.collect()]
    assert (1, None) in left and (None, "x") in left and sum(i == 2 and bool(t) for i, t in left) == 2 and not any(i == 3 for i, _ in left)
    scored = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("score", F.lit(7.5))
    clean = corpus_pipeline.without_toxic(spark, scored, SF)
    assert clean.columns == scored.columns and {r.score for r in clean.collect()} == {7.5}
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0


def test_tasks_give_back_the_memory_that_they_have_freed():
    def resident():
        with open("/proc/self/statm") as f:
            return int(f.read().split()[1]) * 4096

    def work(batches):
        for batch in batches:
            many = [bytes(2000) for _ in range(60_000)]
            kept.append([bytes(2000) for _ in range(50)])  # holds the end of the heap, so that it can't shrink by itself
            del many
            held.append(resident())
            yield batch

    kept, held = [], []
    assert list(arrays.lean(work)(iter([1, 2]))) == [1, 2]
    assert resident() < max(held) - (60 << 20)


def test_a_task_that_is_left_early_or_fails_gives_back_too(monkeypatch):
    calls = []
    monkeypatch.setattr(arrays, "give_back", lambda: calls.append(1))
    early = arrays.lean(lambda it: (x for x in it))(iter([1, 2]))
    assert next(early) == 1
    early.close()
    with pytest.raises(ZeroDivisionError):
        list(arrays.lean(lambda it: (1 // x for x in it))(iter([0])))
    assert len(calls) == 2
