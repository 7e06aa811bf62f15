"""Thin registered queries of the operators: each applies one to its whole table and derives the digest columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.llm import arrays as A
from cellweave.llm import caps, chat, codebooks, divergence, language, lm, maxscore, mixing, pages, pieces, simhash, substrings, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(function):
    QUERIES[function.__name__] = lambda spark, folder: function(
        lambda table: A.ready(spark).read.parquet(f"{folder.rstrip('/')}/{table}.parquet"))
    return function


@query
def op10_simhash(table) -> DataFrame:
    """SimHash near-duplicate classes of all documents."""
    return simhash.near_duplicates(table("documents")).select(
        F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.col("component").alias("component_id"))


@query
def op9_toxicity(table) -> DataFrame:
    """Toxicity scores of all documents, learned from four of five folds."""
    docs = table("documents")
    model = toxicity.fit(docs, table("labels"), learn=A.crc_fold(F.col("doc_id"), 5) != 0)
    held_out = F.coalesce(A.crc_fold(F.col("doc_id"), 5) == 0, F.lit(False))
    return toxicity.score(docs.select("doc_id", "text"), model).select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query
def op6_sentencepiece(table) -> DataFrame:
    """Piece numbers of all documents' whole texts, each decoded again."""
    return pieces.encode(table("documents"), keep=["doc_id"])


@query
def op5_mixing(table) -> DataFrame:
    """What a mix at weights 1, 2, 3 takes of each document."""
    return mixing.mix(table("documents")).drop("source", "epochs")


@query
def op1_language(table) -> DataFrame:
    """Languages of all documents, learned from three of four folds."""
    docs = table("documents")
    fold = A.crc_fold(F.col("doc_id"), 4)
    return language.predict(docs.select("doc_id", F.coalesce(fold == 2, F.lit(False)).alias("held_out"), "text"),
                            language.fit(docs, learn=fold != 2))


@query
def op2_backoff(table) -> DataFrame:
    """Stupid-backoff scores of all documents under the counts of all documents."""
    return lm.score(table("documents"), ["doc_id"]).select(
        "doc_id", "n_words", (F.round("log_score", 6) + F.lit(0.0)).alias("log_score"),
        (F.round(F.when(F.col("n_words") > 0, F.col("log_score") / F.col("n_words")), 6) + F.lit(0.0)).alias("mean_log_score"))


ORACLES["op2_backoff"] = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id,
                  regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
t AS (SELECT r, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS i FROM d),
g AS (SELECT r, w, lag(w) OVER (PARTITION BY r ORDER BY i) AS v, lag(w, 2) OVER (PARTITION BY r ORDER BY i) AS u FROM t),
c1 AS (SELECT w, count(*) AS n FROM g GROUP BY w),
c2 AS (SELECT v, w, count(*) AS n FROM g WHERE v IS NOT NULL GROUP BY v, w),
c3 AS (SELECT u, v, w, count(*) AS n FROM g WHERE u IS NOT NULL GROUP BY u, v, w),
s AS (SELECT g.r, CASE WHEN c3.n >= 2 THEN ln(c3.n / p2.n) WHEN c2.n >= 2 THEN ln(0.4 * c2.n / p1.n)
                       ELSE ln(0.4 * 0.4 * c1.n / (SELECT count(*) FROM g)) END AS x
      FROM g JOIN c1 ON g.w = c1.w LEFT JOIN c2 ON g.v = c2.v AND g.w = c2.w LEFT JOIN c3 ON g.u = c3.u AND g.v = c3.v AND g.w = c3.w
      LEFT JOIN c1 p1 ON p1.w = g.v LEFT JOIN c2 p2 ON p2.v = g.u AND p2.w = g.v),
a AS (SELECT r, count(*) AS n, sum(x) AS x FROM s GROUP BY r)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_words, round(coalesce(x, 0), 6) + 0.0 AS log_score,
       round(CASE WHEN n > 0 THEN x / n END, 6) + 0.0 AS mean_log_score
FROM d LEFT JOIN a USING (r)"""


@query
def op4_chat(table) -> DataFrame:
    """All conversations, repaired and rendered."""
    return chat.format_chats(table("conversations"))


@query
def op3_caps(table) -> DataFrame:
    """Links, classes and representatives of near-duplicate embeddings."""
    return caps.near_duplicates(table("embeddings"))


@query
def op7_substrings(table) -> DataFrame:
    """What is left of every document without its repeated 200-byte strings."""
    return substrings.remove_repeats(table("documents"), ["doc_id"])


@query
def op8_maxscore(table) -> DataFrame:
    """The five highest integer inner products of every fiftieth embedding."""
    return maxscore.top_k(table("embeddings"), F.col("id") % 50 == 0, 5)


ORACLES["op8_maxscore"] = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id, CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda p: p[1] * p[2])) AS BIGINT) AS score
      FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5"""


ORACLES["op5_mixing"] = r"""
WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
                  md5(concat('7:', coalesce(CAST(doc_id AS VARCHAR), ''))) AS k FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS weight, 3 * source_size AS cap FROM s),
c AS (SELECT *, cap / weight AS ratio,
             sum(cap) OVER (ORDER BY cap / weight, source) - cap AS caps,
             sum(weight) OVER (ORDER BY cap / weight, source) - weight AS weights FROM w),
l AS (SELECT (t.size - c.caps) / (t.weight - c.weights) AS level
      FROM c, (SELECT sum(source_size) AS size, sum(weight) AS weight FROM w) t
      WHERE (t.size - c.caps) / (t.weight - c.weights) < c.ratio ORDER BY c.ratio, c.source LIMIT 1),
g AS (SELECT source, source_size,
             CASE WHEN cap <= weight * coalesce((SELECT level FROM l), 1e300) THEN CAST(cap AS DOUBLE)
                  ELSE CAST(weight * (SELECT level FROM l) AS DOUBLE) END AS target FROM w),
b AS (SELECT d.doc_id, d.size, g.source_size, g.target, CAST(floor(g.target + 0.5) AS BIGINT) AS budget,
             sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id, d.size
                               ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - d.size AS before
      FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target,
       CAST(CASE WHEN source_size = 0 THEN 0 ELSE budget // source_size * size
            + least(greatest(budget % source_size - before, 0), size) END AS BIGINT) AS taken
FROM b"""


@query
def op11_html(table) -> DataFrame:
    """The main text of every page."""
    return pages.extract(table("pages"))


@query
def op12_codes(table) -> DataFrame:
    """Codes of all embeddings under codebooks trained on all of them."""
    return codebooks.compress(table("embeddings"))


def _codes_sql(parts: int = 4, entries: int = 256, rounds: int = 4) -> str:
    """The rounds one after another; parts are DOUBLE lists, whose whole-number dot products are exact."""
    steps = [f"""
r AS (SELECT vec_id, label, row_number() OVER () AS r, [CAST(floor({codebooks.SCALE} * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS x
      FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
z AS (SELECT CAST(ceil(max(len(x)) / {parts}) AS BIGINT) AS size FROM r),
v AS MATERIALIZED (SELECT r, p, [CAST(coalesce(x[p * size + i], 0) AS DOUBLE) FOR i IN range(1, size + 1)] AS x
      FROM r, z, (SELECT unnest(range({parts})) AS p)),
b0 AS MATERIALIZED (SELECT p, e, x FROM (SELECT r, row_number() OVER (ORDER BY vec_id NULLS LAST, x) - 1 AS e FROM r) JOIN v USING (r) WHERE e < {entries})"""]
    for i in range(rounds + 1):
        steps.append(f"""
a{i} AS MATERIALIZED (SELECT r, p, min(struct_pack(d := list_dot_product(x, x) - 2 * list_dot_product(x, y) + yy, e := e)) AS best
      FROM (SELECT v.r, p, v.x, b.e, b.x AS y, list_dot_product(b.x, b.x) AS yy FROM v JOIN b{i} b USING (p)) GROUP BY r, p)""")
        if i < rounds:
            steps.append(f"""
m{i} AS (SELECT p, e, list(mean ORDER BY i) AS x
      FROM (SELECT p, e, i, CAST((s - ((s % n) + n) % n) // n AS DOUBLE) AS mean
            FROM (SELECT p, best.e AS e, i, CAST(sum(CAST(v.x[i] AS BIGINT)) AS BIGINT) AS s, count(*) AS n
                  FROM a{i} JOIN v USING (r, p), z, unnest(range(1, size + 1)) AS t(i) GROUP BY ALL)) GROUP BY p, e),
b{i + 1} AS MATERIALIZED (SELECT p, e, coalesce(m.x, b.x) AS x FROM b{i} b LEFT JOIN m{i} m USING (p, e))""")
    steps.append(f"""
h AS (SELECT sha256(string_agg(CAST(CAST(x[i] AS BIGINT) AS VARCHAR), ',' ORDER BY p, e, i)) AS books FROM b{rounds}, z, unnest(range(1, size + 1)) AS t(i)),
c AS (SELECT r, string_agg(printf('%02x', best.e), '' ORDER BY p) AS code, CAST(sum(best.d) AS BIGINT) AS error FROM a{rounds} GROUP BY r)""")
    return "WITH" + ",".join(steps) + """
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, books AS codebooks_sha256 FROM c JOIN r USING (r), h"""


ORACLES["op12_codes"] = _codes_sql()


@query
def op13_divergence(table) -> DataFrame:
    """How the sources of each language differ from it and from each other."""
    return divergence.audit(table("documents"))


ORACLES["op13_divergence"] = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM documents),
c AS MATERIALIZED (SELECT lang, source, term, count(*) AS n, count(DISTINCT r) AS docs FROM (SELECT r, lang, source, unnest(ws) AS term FROM d) GROUP BY ALL),
v AS MATERIALIZED (SELECT lang, term, CAST(sum(n) AS BIGINT) AS total FROM c GROUP BY ALL HAVING sum(docs) >= 3),
k AS (SELECT lang, count(*) AS kept, CAST(sum(total) AS BIGINT) AS lang_size FROM v GROUP BY lang),
g AS (SELECT lang, source, CAST(coalesce(sum(n) FILTER (WHERE total IS NOT NULL), 0) AS BIGINT) AS size
      FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN c USING (lang, source) LEFT JOIN v USING (lang, term) GROUP BY ALL),
p AS MATERIALIZED (SELECT g.lang, g.source, v.term, coalesce(c.n, 0) AS n, 1 + 1000000000 * (coalesce(c.n, 0) + 1) // (size + kept) AS p,
                          1 + 1000000000 * (total + 1) // (lang_size + kept) AS q
                   FROM g JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = v.term),
f AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
      FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
x AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0) AS value
      FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
      UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM x) WHERE part = 'pair' OR rank <= 200"""
