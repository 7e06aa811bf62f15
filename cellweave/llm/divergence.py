"""Source divergence audit: how each source's words differ from its language's and from those of every other source.

A count vectorizer for each language with a least document count and no bound on the vocabulary: documents become exact
sparse vectors of term counts, summed by group in the task that reads them. The vocabulary is a table, not a driver's
dictionary as in ml's CountVectorizer, since it grows with the text. Group sums are evaluated sparsely: a pair of sources
needs the terms that either of them has; all terms that neither has contribute one equal value each.

Pairs of sources are evaluated in tiles: sources are hashed into blocks, terms into chunks; a tile is two blocks and a
chunk. So no group grows with a hot term, a hot source or the number of sources, and what a tile sends is one row for
each of its pairs.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellweave.llm import arrays as A
from cellweave.session import cut

#: runs of ASCII letters and of the bytes of all other characters
_TERM = re.compile(rb"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
UNIT = 1_000_000_000
#: sources of one block, entries (source, term) of one chunk of terms, terms that a tile evaluates at once
BLOCK, CHUNK, SLICE = 32, 1 << 18, 1 << 13
#: entries that a task holds before it sends them
HELD = 1 << 18


def group_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), n_docs: sums of the documents' sparse vectors over each (lang, source).

    A task adds its documents' vectors up by group before anything is shuffled, and sends what it holds whenever that is
    ``HELD`` entries.
    """
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[str, str], Counter] = defaultdict(Counter)
        holders: dict[tuple[str, str], Counter] = defaultdict(Counter)
        size = 0
        for batch in it:
            for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                found = _TERM.findall(text.as_buffer().to_pybytes().lower())  # of bytes, lower() takes A-Z alone
                if found:
                    group = total[lang, source]
                    size -= len(group)
                    group.update(found)
                    size += len(group)
                    holders[lang, source].update(set(found))
                if size > HELD:
                    yield from _sums(total, holders)
                    size = 0
        yield from _sums(total, holders)

    return docs.select("lang", "source", F.col("text").cast("binary").alias("text")).mapInArrow(
        run, "lang string, source string, term string, n long, n_docs long").groupBy("lang", "source", "term").agg(
        F.sum("n").alias("n"), F.sum("n_docs").alias("n_docs"))


def _sums(total: dict, holders: dict) -> Iterator[pa.RecordBatch]:
    for (lang, source), counts in total.items():
        held = holders[lang, source]
        words = list(counts)
        yield pa.RecordBatch.from_arrays([
            pa.array([lang] * len(words), pa.string()), pa.array([source] * len(words), pa.string()),
            pa.array(words, pa.binary()).cast(pa.string()), pa.array([counts[w] for w in words], pa.int64()),
            pa.array([held[w] for w in words], pa.int64())], ["lang", "source", "term", "n", "n_docs"])
    total.clear()
    holders.clear()


def share(count: Column, size: Column, kept: Column) -> Column:
    """1 + floor(10^9 (count + 1) / (size + kept)), exact; 1 where there is no term at all."""
    whole = (size + kept).cast("decimal(20,0)")
    up = F.lit(UNIT).cast("decimal(10,0)") * (count + 1).cast("decimal(20,0)")
    return F.lit(1).cast("long") + F.when(whole > 0, F.call_function("div", up, whole)).otherwise(0)


def gap(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / q) of whole numbers up to 10^9 + 1."""
    return F.call_function("div", (p - q) * (p - q), q)


def audit(docs: DataFrame, min_docs: int = 3, top: int = 200) -> DataFrame:
    """lang, source, part, item, value, rank: part ``pair``, the divergence of each source from each other of its language,
    and part ``term``, the ``top`` terms that the source has more often than its language.

    ``docs(lang, source, text)``; nulls count as the empty string. A language keeps the terms that at least ``min_docs``
    of its documents hold. A group without any term (empty texts, or rare words only) has no ``term`` rows, but pairs like
    any other; without a kept term in its language their value is 0. The only source of a language has no pairs. Very long
    texts and repeated rows are documents like any other. An empty table gives no rows. Other columns are left alone.
    """
    spark = A.ready(docs.sparkSession)
    plain = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    counts = cut(group_counts(plain))
    vocabulary = counts.groupBy("lang", "term").agg(F.sum("n").alias("total"), F.sum("n_docs").alias("docs")).filter(
        F.col("docs") >= min_docs).drop("docs")
    kept = cut(counts.drop("n_docs").join(vocabulary, ["lang", "term"]))
    sizes = kept.groupBy("lang", "source").agg(F.sum("n").alias("size"))
    # a language's total of a term is on each of its rows; count it where the term's first source stands
    known = kept.groupBy("lang", "term").agg(F.first("total").alias("total")).groupBy("lang").agg(
        F.sum("total").alias("lang_size"), F.count("*").alias("kept"))
    groups = plain.select("lang", "source").distinct()
    blocks = groups.groupBy("lang").agg(F.ceil(F.count("*") / BLOCK).cast("long").alias("blocks"))
    zero = F.lit(0).cast("long")
    roster = cut(groups.join(sizes, ["lang", "source"], "left").join(known, "lang", "left").join(blocks, "lang").select(
        "lang", "source", *[F.coalesce(c, zero).alias(c) for c in ("size", "lang_size", "kept")], "blocks",
        F.pmod(F.xxhash64("source"), "blocks").alias("block")).withColumn("rest", share(zero, F.col("size"), F.col("kept"))))
    entries = cut(kept.join(roster, ["lang", "source"]).select(
        "lang", "source", "term", "kept", "blocks", "block", "rest", share(F.col("n"), F.col("size"), F.col("kept")).alias("p"),
        share(F.col("total"), F.col("lang_size"), F.col("kept")).alias("q")))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    over = entries.filter(F.col("p") > F.col("q")).select(
        "lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), gap(F.col("p"), F.col("q")).alias("value"))
    best = over.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    pairs = pair_values(entries, roster).withColumn("rank", F.row_number().over(order))
    return pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", "rank").union(
        best.select("lang", "source", "part", "item", "value", "rank"))


def pair_values(entries: DataFrame, roster: DataFrame) -> DataFrame:
    """lang, source, item, value of all ordered pairs of a language's sources."""
    chunks = max(1, -(-entries.count() // CHUNK))
    seats = roster.select("lang", "source", F.lit(None).cast("string").alias("term"), "rest", "kept", F.col("rest").alias("p"), "blocks",
                          "block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(chunks - 1).cast("long"))).alias("chunk"))
    rows = entries.select("lang", "source", "term", "rest", "kept", "p", "blocks", "block",
                          F.pmod(F.xxhash64("term"), F.lit(chunks).cast("long")).alias("chunk")).union(seats)
    met = rows.withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).select(
        "lang", "source", "term", "rest", "kept", "p", "block", "chunk", F.least("block", "with").alias("low"), F.greatest("block", "with").alias("high"))
    sums = met.groupBy("lang", "chunk", "low", "high").applyInPandas(
        tile, "lang string, source string, item string, part long, met long, rest long, item_rest long, kept long")
    total = sums.groupBy("lang", "source", "item").agg(
        F.sum("part").alias("part"), F.sum("met").alias("met"), *[F.first(c).alias(c) for c in ("rest", "item_rest", "kept")])
    neither = (F.col("kept") - F.col("met")) * gap(F.col("rest"), F.col("item_rest"))
    return total.select("lang", "source", "item", (F.col("part") + neither).alias("value"))


def tile(rows: pd.DataFrame) -> pd.DataFrame:
    """Sums over a chunk's terms for all ordered pairs between two blocks of sources, or inside one."""
    seat = rows["term"].isna().to_numpy()
    seats = rows[seat].reset_index(drop=True)
    number = {s: i for i, s in enumerate(seats["source"])}
    held = rows[~seat]
    term, found = pd.factorize(held["term"])
    who = held["source"].map(number).to_numpy(np.int64)
    share_of = held["p"].to_numpy(np.int64)
    n, rest = len(seats), seats["rest"].to_numpy(np.int64)
    order = np.argsort(term, kind="stable")
    term, who, share_of = term[order], who[order], share_of[order]
    part = np.zeros((n, n), np.int64)
    for low in range(0, len(found), SLICE):
        a, b = np.searchsorted(term, [low, low + SLICE])
        p = np.repeat(rest[:, None], min(SLICE, len(found) - low), axis=1)
        p[who[a:b], term[a:b] - low] = share_of[a:b]
        for i in range(n):
            off = p[i] - p
            part[i] += (off * off // p).sum(axis=1)
    block = seats["block"].to_numpy()
    apart = block[:, None] != block[None, :] if len(set(block)) > 1 or rows["low"].iloc[0] != rows["high"].iloc[0] else ~np.eye(n, dtype=bool)
    i, j = np.nonzero(apart)
    names = seats["source"].to_numpy(object)
    return pd.DataFrame({"lang": rows["lang"].iloc[0], "source": names[i], "item": names[j], "part": part[i, j], "met": len(found),
                         "rest": rest[i], "item_rest": rest[j], "kept": seats["kept"].to_numpy(np.int64)[i]})
