"""Language identification by cross-parsing entropy.

For each language, a suffix automaton of labelled text holds all its substrings. A text is parsed against a language by
longest matches: walk the automaton as far as it goes, then start a new phrase. Text of the same language needs few
phrases; phrases x log2(length of the labelled text) / length of the text estimates its cross entropy in bits a byte,
and the language with the least wins.

The automata are fitted on a bounded sample: ``budget`` bytes for a language, in windows of at most ``window`` bytes
from rows chosen by a hash of the id. Texts are parsed whole, in blocks of ``BLOCK`` bytes whatever their length (a
phrase never runs across a block's end), so that the blocks of many texts walk their automata in step.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellweave.llm import arrays as A

BUDGET = 1 << 16
WINDOW = 1 << 12
BLOCK = 1024
LANGUAGES = 256
SHARPNESS = 6.0
UNDETERMINED = "und"

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[:128] = 46  # other ASCII counts as one punctuation mark
_FOLD[[9, 10, 11, 12, 13, 32]] = 32
_FOLD[48:58] = 48
_FOLD[97:123] = np.arange(97, 123)


def folded(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased bytes with digits, blanks and ASCII punctuation each reduced to one mark, and offsets."""
    data, offsets = A.text_buffer(pc.utf8_lower(pc.fill_null(texts, "")))
    return _FOLD[data], offsets


def suffix_automaton(text: bytes) -> list[dict[int, int]]:
    """Transitions of the minimal automaton of all substrings; state 0 is the start."""
    steps: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in text:
        new = len(steps)
        steps.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in steps[p]:
            steps[p][c] = new
            p = link[p]
        if p >= 0:
            q = steps[p][c]
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                clone = len(steps)
                steps.append(dict(steps[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and steps[p].get(c) == q:
                    steps[p][c] = clone
                    p = link[p]
                link[q] = link[new] = clone
        last = new
    return steps


def parse_table(text: bytes, symbols: np.ndarray, n_symbols: int) -> np.ndarray:
    """The automaton as one array: entry (state, symbol) is twice the next state's row, plus one where a phrase ends."""
    steps = suffix_automaton(bytes(symbols[np.frombuffer(text, np.uint8)]))
    start = np.full(n_symbols, 1, np.int32)
    for c, to in steps[0].items():
        start[c] = 2 * to * n_symbols
    table = np.tile(start | 1, len(steps))
    rows = np.repeat(np.arange(len(steps)), [len(s) for s in steps])
    symbol = np.fromiter((c for s in steps for c in s), np.int64, len(rows))
    target = np.fromiter((t for s in steps for t in s.values()), np.int64, len(rows))
    table[rows * n_symbols + symbol] = 2 * target * n_symbols
    return table


class Parser:
    """Parse tables of all languages over one symbol table; bytes that no language has seen match nothing."""

    def __init__(self, texts: dict[str, bytes]):
        self.languages = sorted(texts)
        seen = np.unique(np.frombuffer(b"".join(texts.values()), np.uint8))
        self.symbols = np.zeros(256, np.uint8)
        self.symbols[seen] = 1 + np.arange(len(seen))
        self.tables = [parse_table(texts[name], self.symbols, len(seen) + 1) for name in self.languages]
        self.bits = [np.log2(max(2, len(texts[name]))) for name in self.languages]

    def entropy(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Bits a byte of each text (rows) against each language (columns); empty texts have zeros."""
        n = len(offsets) - 1
        out = np.zeros((n, len(self.languages)))
        for first, last in A.steps(offsets, 1 << 20):
            body = self.symbols[data[offsets[first]:offsets[last]]]
            size = np.diff(offsets[first:last + 1])
            parts = -(-size // BLOCK)
            owner = np.repeat(np.arange(last - first), parts)
            within = (np.arange(len(owner)) - np.repeat(np.cumsum(parts) - parts, parts)) * BLOCK
            length = np.minimum(size[owner] - within, BLOCK)
            order = np.argsort(-length, kind="stable")
            begin = (offsets[first:last] - offsets[first])[owner][order] + within[order]
            length = length[order]
            longest = int(length[0]) if len(length) else 0
            live = np.searchsorted(-length, -np.arange(longest), "left")  # blocks longer than t
            grid = body[np.minimum(begin[None, :] + np.arange(longest)[:, None], max(0, len(body) - 1))]
            for k, table in enumerate(self.tables):
                at, ended = np.zeros(len(begin), np.int32), np.ones(len(begin), np.int32)
                for t in range(longest):
                    m = live[t]
                    now = table[(at[:m] >> 1) + grid[t, :m]]
                    ended[:m] += now & 1
                    at[:m] = now
                phrases = np.bincount(owner[order], ended, minlength=last - first)
                out[first:last, k] = phrases * self.bits[k] / np.maximum(1, size)
        return out


@dataclass(frozen=True)
class LanguageModel:
    """Labelled text of each language, folded."""

    texts: dict[str, bytes]


_PARSERS: dict[int, Parser] = {}


def _parser(texts: dict[str, bytes]) -> Parser:
    """Built once for each model and worker process."""
    key = hash(tuple(sorted(texts.items())))
    if key not in _PARSERS:
        _PARSERS.clear()
        _PARSERS[key] = Parser(texts)
    return _PARSERS[key]


def fit(docs: DataFrame, learn: Column | None = None, budget: int = BUDGET, window: int = WINDOW) -> LanguageModel:
    """Learn from ``docs(doc_id, text, lang)`` where ``learn`` holds and neither text nor lang is null.

    Raises ValueError for more than ``LANGUAGES`` labels. Without labelled text the model has no language.
    """
    A.ready(docs.sparkSession)
    rows = docs.filter(F.lit(True) if learn is None else learn).select(
        F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"), F.xxhash64("doc_id").alias("draw")).filter(
        F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.octet_length("text") > 0))
    usable = F.least(F.octet_length("text"), F.lit(window)).cast("long")
    sizes = rows.groupBy("lang").agg(F.sum(usable).alias("size")).limit(LANGUAGES + 1).collect()
    if len(sizes) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    if not sizes:
        return LanguageModel({})
    share = F.create_map(*[F.lit(x) for r in sizes for x in (r["lang"], int(min(1.0, 2 * budget / r["size"]) * (1 << 31)))])
    sample = rows.filter(F.pmod("draw", F.lit(1 << 31)) < share[F.col("lang")]).select(
        "lang", "draw", F.substring(F.col("text"), 1, window).alias("text")).toPandas().sort_values(["lang", "draw", "text"])
    texts = {}
    for lang, group in sample.groupby("lang"):
        data, offsets = folded(pa.array(group["text"].tolist(), pa.string()))
        pool = b"".join(data[s:min(e, s + window)].tobytes() for s, e in zip(offsets[:-1], offsets[1:]))
        if pool:
            texts[str(lang)] = pool[:budget]
    return LanguageModel(texts)


def predict(docs: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """``docs`` without ``text``, plus lang_pred (string) and score (double, 0 to 1), from the whole text alone.

    ``und`` with score 0 if the text is null, has no letter, or nothing was learned. ``score`` weighs the winner's
    entropy against the others'. Ties go to the first language by name. Columns lang_pred and score are replaced.
    """
    A.ready(docs.sparkSession)
    rest = [c for c in docs.columns if c not in (text, "lang_pred", "score")]
    frame = docs.select(*[F.col(f"`{c}`") for c in rest], F.col(f"`{text}`").cast("string").alias("text__"))
    known = model.texts

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = _parser(known) if known else None
        for batch in it:
            texts = batch.column(len(rest))
            letters = pc.fill_null(pc.match_substring_regex(texts, r"\p{L}"), False).to_numpy(zero_copy_only=False)
            if parser:
                bits = parser.entropy(*folded(texts))
                best = bits.argmin(axis=1)
                weight = np.exp(SHARPNESS * (bits.min(axis=1, keepdims=True) - bits))
                score = np.where(letters, 1 / weight.sum(axis=1), 0.0)
                names = np.where(letters, np.array(parser.languages, object)[best], UNDETERMINED)
            else:
                score, names = np.zeros(batch.num_rows), np.full(batch.num_rows, UNDETERMINED, object)
            yield pa.RecordBatch.from_arrays([*batch.columns[:len(rest)], pa.array(names, pa.string()), pa.array(score)],
                                             [*rest, "lang_pred", "score"])

    fields = "".join(f"`{c}` {frame.schema[c].dataType.simpleString()}, " for c in rest)
    return frame.mapInArrow(run, f"{fields}lang_pred string, score double")
