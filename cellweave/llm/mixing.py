"""Mixing sources to target weights at exact budgets, by one range sort and distributed prefix sums.

Rows get hash-random keys and are range-sorted by (source, key), so a source of any share spreads over as many
partitions as its rows need. Each partition keeps running sums; only its totals meet, one row for each partition and
source. A source's budget is then cut at the exact word, after as many whole epochs as it asks for.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellweave.llm import arrays as A
from cellweave.session import cut

#: a document is taken at most so many times
MOST = 3
WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def random_key(id_col: Column, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))))


def prefix_sums(df: DataFrame, group: str | None, order: list[Column], value: str) -> DataFrame:
    """``df`` plus ``before`` (long): the sum of ``value`` over the rows that come before in the group's order.

    The rows' order inside a group is that of ``order``; rows that agree in all of it may stand in either order.
    """
    spark = A.ready(df.sparkSession)
    names = df.columns
    keys = [F.col(group)] if group else []
    ranged = df.repartitionByRange(A.buckets(spark), *keys, *order).sortWithinPartitions(*keys, *order)
    g, v = names.index(group) if group else -1, names.index(value)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        last, carried = None, 0
        for batch in it:
            size = np.array(batch.column(v).to_pylist(), np.int64)
            key = batch.column(g).to_pylist() if group else [0] * len(size)
            start = np.array([i == 0 or key[i] != key[i - 1] for i in range(len(key))])
            total = np.cumsum(size) - size
            first = np.flatnonzero(start)
            base = np.repeat(total[first], np.diff(np.append(first, len(size))))
            running = total - base
            if len(key):
                if last is not None and last[0] == key[0]:
                    running[:first[1] if len(first) > 1 else len(running)] += carried
                last, carried = (key[-1],), int(running[-1] + size[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(key), part, np.int32)), pa.array(running)],
                                             [*names, "part__", "running__"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    sorted_rows = cut(ranged.mapInArrow(A.lean(run), f"{fields}, part__ int, running__ long"))
    group_key = F.col(group) if group else F.lit(0)
    totals = sorted_rows.groupBy("part__", group_key.alias("group__")).agg(F.sum(value).alias("total__"))
    window = Window.partitionBy("group__").orderBy("part__").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cut(totals.select(F.col("part__").alias("p__"), "group__", F.coalesce(F.sum("total__").over(window), F.lit(0)).alias("offset__")))
    return sorted_rows.join(offsets, (F.col("part__") == F.col("p__")) & group_key.eqNullSafe(F.col("group__"))).select(
        *names, (F.col("running__") + F.col("offset__")).alias("before"))


def targets(rows: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = MOST) -> DataFrame:
    """``rows(source, size)`` -> source, source_size, target: the share of all words that each source should get.

    Sources by code point, null last, weigh 1, 2, 3, repeating. A target stops at ``most`` times its source's size; what
    is above goes to the others by weight, until none is above. Sources are as many rows as there are, never collected.
    """
    sums = cut(rows.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("one", F.lit(1).cast("long")))
    ranked = prefix_sums(sums, None, [F.col("source").isNull(), F.col("source")], "one")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("before") % len(weights) + 1).cast("int"))
    table = cut(ranked.select("source", "source_size", weight.alias("weight")))
    cap = F.col("source_size") * most
    total = table.agg(F.sum("source_size")).first()[0] or 0
    level, capped = 0.0, -1
    while True:  # the level only rises, each round caps at least one source more
        full = cap <= F.col("weight") * F.lit(level) if capped >= 0 else F.lit(False)
        n, fixed, open_weight = table.agg(F.count_if(full), F.coalesce(F.sum(F.when(full, cap)), F.lit(0)),
                                          F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0))).first()
        if n == capped or not open_weight:
            break
        capped, level = n, (total - fixed) / open_weight
    goal = F.when(cap <= F.col("weight") * F.lit(level), cap.cast("double")).otherwise(F.col("weight") * F.lit(level))
    return table.select("source", "source_size", goal.alias("target"))


def mix(docs: DataFrame, seed: int = 7, weights: tuple[int, ...] = (1, 2, 3), most: int = MOST,
        carry: tuple[str, ...] = ()) -> DataFrame:
    """One row for each row of ``docs(doc_id, source, text)``: doc_id, source, size, source_size, target, taken, epochs
    (whole copies), and the columns of ``carry`` as carry__name.

    ``size`` is the number of words (null text: 0), ``taken`` the words that the mix takes of the row, repeats counted:
    ``epochs`` times the whole text plus, for the row at its source's cut, a part of it. Each source takes its target,
    rounded to a word. A null source is a source of its own; null and repeated ids are rows like any other; rows of no
    words take nothing (``epochs`` says how often they stand in the mix). An empty table gives no rows.
    """
    A.ready(docs.sparkSession)
    rows = docs.select("doc_id", F.col("source").cast("string").alias("source"), n_words(F.col("text")).alias("size"),
                       random_key(F.col("doc_id"), seed).alias("key__"), *[F.col(f"`{c}`").alias(f"carry__{c}") for c in carry])
    goals = targets(rows.select("source", "size"), weights, most)
    placed = prefix_sums(rows, "source", [F.col("key__"), F.col("doc_id"), F.col("size")], "size")
    goals = cut(goals.withColumnRenamed("source", "source__"))
    whole = F.col("source_size")
    budget = F.floor(F.col("target") + 0.5)
    turns = F.when(whole > 0, F.floor(budget / whole)).otherwise(1).cast("long")
    rest = F.when(whole > 0, budget - F.col("turns__") * whole).otherwise(0)
    part = F.least(F.greatest(F.col("rest__") - F.col("before"), F.lit(0)), F.col("size")).cast("long")
    joined = placed.join(goals, F.col("source").eqNullSafe(F.col("source__"))).withColumn("turns__", turns).withColumn("rest__", rest)
    once = ((F.col("before") < F.col("rest__")) & (F.col("before") + F.col("size") <= F.col("rest__"))).cast("long")
    return joined.select("doc_id", "source", "size", "source_size", "target",
                         (F.col("turns__") * F.col("size") + part).alias("taken"), (F.col("turns__") + once).alias("epochs"),
                         *[F.col(f"`carry__{c}`") for c in carry])


def first_words(docs: DataFrame, count: str, text: str = "text") -> DataFrame:
    """``docs`` with each text cut after its first ``count`` words."""
    names = docs.columns
    t, c = names.index(text), names.index(count)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            data, offsets = A.text_buffer(batch.column(t))
            _, ends = A.runs(~A.SPACE[data], offsets)
            owner = A.owner_of(offsets, ends - 1)
            first = np.searchsorted(owner, np.arange(batch.num_rows))
            raw = data.tobytes()
            cuts = [raw[offsets[i]:ends[first[i] + n - 1]].decode() if n else "" for i, n in enumerate(batch.column(c).to_pylist())]
            columns = list(batch.columns)
            columns[t] = pa.array(cuts, batch.schema.field(t).type)
            yield pa.RecordBatch.from_arrays(columns, names)

    return docs.mapInArrow(A.lean(run), docs.schema)


def mixed_documents(docs: DataFrame, seed: int = 7, weights: tuple[int, ...] = (1, 2, 3), most: int = MOST) -> DataFrame:
    """The mix itself, with the columns of ``docs``: whole texts once for each epoch, and the part at a source's cut.

    A row's ``n_chars``, if there is one, follows its text.
    """
    names = docs.columns
    rows = cut(mix(docs, seed, weights, most, carry=tuple(names)))
    back = [F.col(f"`carry__{c}`").alias(c) for c in names]
    whole = rows.filter("epochs > 0").withColumn("copy__", F.explode(F.sequence(F.lit(1), F.col("epochs").cast("int"))))
    part = first_words(rows.filter(F.col("taken") > F.col("epochs") * F.col("size")).select(
        *back, (F.col("taken") - F.col("epochs") * F.col("size")).alias("words__")), "words__")
    if "n_chars" in names:
        part = part.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return whole.select(*back).union(part.select(*[F.col(f"`{c}`") for c in names]))
