"""Removal of long repeated byte strings across documents, by suffix arrays.

A byte goes if a string of ``length`` bytes that covers it starts anywhere else too. No task sees all text; the work is
cut so that the strings that could be equal meet.

1. Anchors. The start of each ``length``-byte string is owned by the least hashed ``GRAM``-byte gram in the string. Equal
   strings have equal owners at equal distances, so only starts with equal anchors can repeat. An anchor's window is the
   text from its first owned start to the end of the last owned string.
2. Anchors meet by hash. An anchor seen once settles its starts: they are unique. Windows that are equal as a whole settle
   theirs: all repeat. What is left are windows that share an anchor and differ somewhere, at the ends of copied
   passages; of equal ones among them, one goes on.
3. These windows' text meets by anchor. Texts become phrases whose ends depend on the bytes before alone; the suffix
   array of all phrases of a task (:mod:`cellweave.llm.suffixes`) puts starts with a common continuation side by side, and
   a start repeats if a neighbour's string of ``length`` bytes has the same hash.
4. An anchor that is frequent has its windows spread over all tasks, by their own hash. Starts there that met no equal
   meet once more, by the hash of their string.

The text is dealt out once, by document, and serves both the windows and the final cut. Rows of equal id and text are
documents of their own that repeat one another.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweave.llm import arrays as A
from cellweave.llm.suffixes import suffix_array

LENGTH = 200
GRAM = 96
#: windows of an anchor in one batch, and in one task, from which they are spread
HOT_BATCH, HOT_TASK = 16, 512
#: bytes of window text that one suffix array covers, and of text whose anchors are packed together: bounds on memory
CHUNK, PACK = 2 << 20, 4 << 20
#: packed rows go to this many times as many buckets as there are partitions, so that buckets even out
FINE = 2

NORMAL, SPREAD, MARKER = 0, 1, 2
REPEATED, OPEN, BOTH = 1, 2, 3
_ANCHOR = np.dtype([("anchor", "<u8"), ("window", "<u8"), ("uid", "<i8"), ("at", "<u4"), ("low", "u1"), ("high", "u1"), ("kind", "u1")])
_FLAG = np.dtype([("anchor", "<u8"), ("uid", "<i8"), ("at", "<u4"), ("low", "u1"), ("high", "u1"), ("state", "u1"), ("spread", "u1")])
_WINDOW = np.dtype([("anchor", "<u8"), ("uid", "<i8"), ("first", "<u4"), ("size", "<u2"), ("starts", "u1"), ("known", "u1"), ("spread", "u1")])
_SPAN = np.dtype([("uid", "<i8"), ("first", "<u4"), ("last", "<u4")])
_LOOSE = np.dtype([("string", "<u8"), ("uid", "<i8"), ("at", "<u4"), ("known", "u1")])
_PACK = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("body", pa.binary())])
_PACKED = "bucket int, kind int, body binary"
SPANS, WINDOWS, LOOSE = 0, 1, 2


def _spot(x: np.ndarray, n: int) -> np.ndarray:
    return (A.mix(x.view(np.uint64)) >> np.uint64(33)).astype(np.int64) % n


def anchors(data: np.ndarray, offsets: np.ndarray, uid: np.ndarray, length: int, gram: int) -> Iterator[np.ndarray]:
    """The anchors of each text with the range of starts they own."""
    width = length - gram + 1
    low32 = np.uint64(0xFFFFFFFF)
    for first, last in A.steps(offsets, 1 << 18):
        at = offsets[first:last + 1] - offsets[first]
        body = data[offsets[first]:offsets[last]]
        if len(body) < length:
            continue
        grams = A.gram_hash(body, gram)
        least = A.sliding(np.minimum, (grams & ~low32) | np.arange(len(grams), dtype=np.uint64), width)
        sound = np.zeros(len(least) + 1, np.int32)  # starts whose string ends inside their text
        long_ = np.flatnonzero(np.diff(at) >= length)
        np.add.at(sound, at[long_], 1)
        np.add.at(sound, at[long_ + 1] - length + 1, -1)
        starts = np.flatnonzero(np.cumsum(sound[:-1]))
        if not len(starts):
            continue
        owner = (least[starts] & low32).astype(np.int64)
        begin = np.ones(len(starts), bool)
        begin[1:] = (owner[1:] != owner[:-1]) | (starts[1:] != starts[:-1] + 1)
        run = np.flatnonzero(begin)
        lo, hi = starts[run], starts[np.append(run[1:], len(starts)) - 1]
        owner = owner[run]
        text = A.owner_of(at, owner)
        out = np.zeros(len(run), _ANCHOR)
        out["anchor"] = grams[owner]
        out["high"], out["low"] = owner - lo, owner - hi
        out["window"] = A.mix(A.range_hash(A.prefix_hash(body), lo, hi + length) + out["high"].astype(np.uint64))
        out["uid"] = uid[first:last][text]
        out["at"] = owner - at[text]
        yield out


def _groups(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by keys, the first position of each group, and the group of each position."""
    order = np.lexsort(keys[::-1])
    change = np.ones(len(order), bool)
    if len(order):
        change[1:] = False
        for k in keys:
            k = k[order]
            change[1:] |= k[1:] != k[:-1]
    return order, np.flatnonzero(change), np.cumsum(change) - 1


def _find(n: int, length: int, gram: int):
    """Batches of (uid, text) -> anchors packed by bucket."""
    def pack(found: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        rows = np.concatenate(found)
        order, start, group = _groups(rows["anchor"], rows["window"])
        anchor = rows["anchor"][order][start]
        _, kind, count = np.unique(anchor, return_inverse=True, return_counts=True)
        hot = count[kind] > HOT_BATCH
        rows["kind"][order] = np.where(hot[group], SPREAD, NORMAL)
        marks = np.zeros(len(np.unique(anchor[hot])), _ANCHOR)
        marks["anchor"], marks["kind"] = np.unique(anchor[hot]), MARKER
        rows = np.concatenate([rows, marks])
        key = np.where(rows["kind"] == SPREAD, rows["anchor"] ^ rows["window"], rows["anchor"])
        yield from A.batches(((b, 0, part.tobytes()) for b, part in A.packed(rows, _spot(key, n), n)), _PACK)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            data, offsets = A.text_buffer(batch.column(1))
            uid = batch.column(0).to_numpy()
            for first, last in A.steps(offsets, PACK):
                found = list(anchors(data, offsets[first:last + 1], uid[first:last], length, gram))
                if found:
                    yield from pack(found)

    return run


def _bodies(it: Iterator[pa.RecordBatch], dtype: np.dtype) -> np.ndarray:
    parts = [np.frombuffer(x, dtype) for batch in it for x in batch.column(batch.schema.get_field_index("body")).to_pylist()]
    return np.concatenate(parts) if parts else np.zeros(0, dtype)


def _classify(n: int):
    """Anchors of some buckets -> flags of those that aren't unique, packed by document bucket."""
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = _bodies(it, _ANCHOR)
        if not len(rows):
            return
        # rows spread here for a frequent anchor don't mix with those that are here for their anchor
        order, start, group = _groups(rows["anchor"], (rows["kind"] == SPREAD).astype(np.uint8), rows["window"])
        rows = rows[order]
        size = np.diff(np.append(start, len(rows)))
        head = rows[start]
        real = head["kind"] != MARKER
        side = head["anchor"] * np.uint64(2) + (head["kind"] == SPREAD)
        _, of = np.unique(side, return_inverse=True)
        windows = np.bincount(of, real)[of]
        marked = np.bincount(of, ~real)[of] > 0
        frequent = (head["kind"] == SPREAD) | marked | (windows > HOT_TASK)
        mixed = (windows > 1) | frequent
        state = np.where(size > 1, REPEATED, np.where(mixed, OPEN, 0))
        flags = np.zeros(len(rows), _FLAG)
        for name in ("anchor", "uid", "at", "low", "high"):
            flags[name] = rows[name]
        flags["state"], flags["spread"] = state[group], frequent[group]
        chosen = start[(size > 1) & mixed]  # one of equal windows stands for all in the next meeting
        flags["state"][chosen] = BOTH
        flags = flags[(flags["state"] > 0) & (rows["kind"] != MARKER)]
        yield from A.batches(((b, 0, part.tobytes()) for b, part in A.packed(flags, flags["uid"] % n, n)), _PACK)

    return run


def _merged(uid: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Ranges of starts, joined where they touch."""
    order = np.lexsort([first, uid])
    uid, first, last = uid[order], first[order].astype(np.int64), last[order].astype(np.int64)
    if not len(uid):
        return np.zeros(0, _SPAN)
    _, group = np.unique(uid, return_inverse=True)
    reach = np.maximum.accumulate(last + group * (1 << 33)) - group * (1 << 33)
    begin = np.ones(len(uid), bool)
    begin[1:] = (uid[1:] != uid[:-1]) | (first[1:] > reach[:-1] + 1)
    start = np.flatnonzero(begin)
    out = np.zeros(len(start), _SPAN)
    out["uid"], out["first"], out["last"] = uid[start], first[start], reach[np.append(start[1:], len(uid)) - 1]
    return out


def _spans(rows: np.ndarray, n: int) -> Iterator[tuple[int, int, bytes]]:
    for b, part in A.packed(rows, rows["uid"] % n, n):
        yield b, SPANS, part.tobytes()


def _pick(n: int, length: int):
    """Texts and flags of one document bucket -> settled ranges, and the windows' text for the suffix arrays."""
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        flags = _bodies(iter(right.to_batches()), _FLAG)
        out: list[tuple[int, int, bytes]] = []
        if len(flags):
            lo, hi = flags["at"].astype(np.int64) - flags["high"], flags["at"].astype(np.int64) - flags["low"]
            done = (flags["state"] & 1) == 1
            out += _spans(_merged(flags["uid"][done], lo[done], hi[done]), n)
            open_ = flags["state"] >= OPEN
            flags, lo, hi = flags[open_], lo[open_], hi[open_]
        if len(flags):
            data, offsets = A.text_buffer(left["text"])
            uid, where = np.unique(left["uid"].to_numpy(), return_index=True)
            text = where[np.searchsorted(uid, flags["uid"])]
            order, start, _ = _groups(text, flags["at"])  # rows of equal id and text carry the same flags
            pick = order[start]
            flags, lo, hi, text = flags[pick], lo[pick], hi[pick], text[pick]
            begin, end = offsets[text] + lo, offsets[text] + hi + length
            rows = np.zeros(len(flags), _WINDOW)
            rows["anchor"], rows["uid"], rows["spread"] = flags["anchor"], flags["uid"], flags["spread"]
            rows["first"], rows["size"], rows["starts"] = lo, end - begin, hi - lo
            rows["known"] = flags["state"] == BOTH
            raw = data.tobytes()
            own = np.array([int.from_bytes(hashlib.blake2b(raw[s:e], digest_size=8).digest(), "little")
                            for s, e in zip(begin.tolist(), end.tolist())], np.uint64)
            bucket = _spot(np.where(rows["spread"] > 0, own, rows["anchor"]), n)
            for b, part in A.packed(np.arange(len(rows)), bucket, n):
                body = b"".join([raw[begin[i]:end[i]] for i in part.tolist()])
                out.append((b, WINDOWS, len(part).to_bytes(8, "little") + rows[part].tobytes() + body))
        return pa.Table.from_batches(list(A.batches(out, _PACK)), _PACK)

    return run


_BREAK = np.ones(256, bool)
_BREAK[65:91] = _BREAK[97:123] = _BREAK[128:224] = False


def repeats(data: np.ndarray, offsets: np.ndarray, starts: np.ndarray, owner: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Which of ``starts`` (positions in the windows ``owner``) begin a string that another start begins too, and its hash.

    A phrase ends behind a break byte after a word whose hash is divisible by four. A start's continuation is the bytes up
    to the first such end that the bytes from the start on decide, then whole phrases; sorted by that, equal strings
    are neighbours, as phrases are ranked by their bytes and none begins another.
    """
    prefix = A.prefix_hash(data)
    string = A.range_hash(prefix, starts, starts + length)
    breaks = _BREAK[data]
    word_from, word_to = A.runs(~breaks, offsets)
    n_bytes = len(data)
    inside = np.zeros(n_bytes + 1, bool)
    inside[offsets[1:]] = True
    full = (word_to < n_bytes) & ~inside[word_to]  # the break byte is in the window too
    word_from, word_to = word_from[full], word_to[full]
    ends = (A.range_hash(prefix, word_from, word_to) & np.uint64(3)) == 0
    word_from, cut = word_from[ends], word_to[ends] + 1
    bounds = np.unique(np.concatenate([offsets[:-1][np.diff(offsets) > 0], cut[~inside[cut]]]))
    if not len(bounds):
        return np.zeros(len(starts), bool), string
    after = np.append(bounds[1:], n_bytes)
    phrases = pa.Array.from_buffers(pa.large_binary(), len(bounds), [
        None, pa.py_buffer(np.append(bounds, n_bytes).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))])
    coded = phrases.dictionary_encode()
    rank = np.empty(len(coded.dictionary), np.int64)
    rank[pc.array_sort_indices(coded.dictionary).to_numpy()] = np.arange(len(rank))
    symbol = rank[coded.indices.to_numpy()] + 1
    # a window's end is a symbol below all others
    closing = inside[after]
    slot = np.arange(len(bounds)) + np.concatenate([[0], np.cumsum(closing)[:-1]])
    line = np.zeros(len(bounds) + int(closing.sum()), np.int64)
    line[slot] = symbol
    order = suffix_array(line)
    height = np.empty(len(line), np.int64)
    height[order] = np.arange(len(line))
    # the first phrase end that depends on nothing before the start
    next_word = np.searchsorted(word_from, starts, "right")
    next_cut = np.append(cut, n_bytes + length)[np.minimum(next_word, len(cut))]
    reach = np.minimum(next_cut, starts + length)
    at = np.minimum(np.searchsorted(bounds, reach), len(bounds) - 1)
    rest = np.where(next_cut < starts + length, height[slot[at]], -1)
    lead = A.range_hash(prefix, starts, reach)
    by = np.lexsort([string, rest, lead])
    same = np.zeros(len(starts), bool)
    equal = (string[by][1:] == string[by][:-1]) & (lead[by][1:] == lead[by][:-1])
    same[by[1:]] |= equal
    same[by[:-1]] |= equal
    return same, string


def _settle(rows: np.ndarray, body: np.ndarray, at: np.ndarray, length: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Ranges of starts that repeat, and starts of spread windows that are still open, of one chunk of windows."""
    raw = body.tobytes()
    seen: dict[tuple[int, bytes], int] = {}
    lead = np.empty(len(rows), np.int64)
    for k, (a, s, e) in enumerate(zip(rows["anchor"].tolist(), at[:-1].tolist(), at[1:].tolist())):
        lead[k] = seen.setdefault((a, raw[s:e]), k)
    copies = np.bincount(lead, minlength=len(rows))
    known = np.zeros(len(rows), bool)
    np.logical_or.at(known, lead, rows["known"] > 0)
    known |= copies > 1
    first = np.flatnonzero(lead == np.arange(len(rows)))
    each = rows["starts"][first].astype(np.int64) + 1
    owner = np.repeat(first, each)
    shift = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
    # equal windows are in the text once
    sizes = np.diff(at)[first]
    fresh = np.concatenate([[0], np.cumsum(sizes)])
    spot = np.repeat(at[:-1][first] - fresh[:-1], sizes) + np.arange(fresh[-1])
    same, string = repeats(body[spot], fresh, np.repeat(fresh[:-1], each) + shift, owner, length)
    same |= known[owner]
    spans, loose = [], []
    members, lo = np.flatnonzero(known[lead]), rows["first"].astype(np.int64)
    if len(members):
        spans.append(_merged(rows["uid"][members], lo[members], lo[members] + rows["starts"][members]))
    hit = same & ~known[owner]
    if hit.any():
        spans.append(_merged(rows["uid"][owner[hit]], lo[owner[hit]] + shift[hit], lo[owner[hit]] + shift[hit]))
    spread = rows["spread"][owner] > 0
    if spread.any():
        out = np.zeros(int(spread.sum()), _LOOSE)
        out["string"], out["uid"], out["known"] = string[spread], rows["uid"][owner[spread]], same[spread]
        out["at"] = lo[owner[spread]] + shift[spread]
        order, start, _ = _groups(out["string"])
        out = out[order]
        keep = out["known"] == 0
        keep[start] = True
        loose.append(out[keep])
    return spans, loose


def _sort(n: int, length: int):
    """Windows' text -> ranges of starts that repeat, and open starts of spread windows; settled ranges pass."""
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heads, texts = [], []
        for batch in it:
            passing = batch.filter(pc.equal(batch.column(1), SPANS))
            if passing.num_rows:
                yield passing
            for kind, body in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                if kind == WINDOWS:
                    count = int.from_bytes(body[:8], "little")
                    heads.append(np.frombuffer(body, _WINDOW, count, 8))
                    texts.append(np.frombuffer(body, np.uint8, -1, 8 + count * _WINDOW.itemsize))
        if not heads:
            return
        rows, body = np.concatenate(heads), np.concatenate(texts)
        at = np.concatenate([[0], np.cumsum(rows["size"].astype(np.int64))])
        order = np.argsort(rows["anchor"], kind="stable")
        weight = np.cumsum(rows["size"][order].astype(np.int64))
        change = np.flatnonzero(np.diff(rows["anchor"][order])) + 1
        cuts, last = [0], 0
        for c in change.tolist():  # windows of an anchor stay together; a frequent one's are spread already
            if weight[c - 1] - last >= CHUNK:
                cuts.append(c)
                last = weight[c - 1]
        for lo, hi in zip(cuts, [*cuts[1:], len(order)]):
            pick = order[lo:hi]
            sizes = rows["size"][pick].astype(np.int64)
            ends = np.concatenate([[0], np.cumsum(sizes)])
            spot = np.repeat(at[pick] - ends[:-1], sizes) + np.arange(ends[-1])
            spans, loose = _settle(rows[pick], body[spot], ends, length)
            for part in spans:
                yield from A.batches(_spans(part, n), _PACK)
            for part in loose:
                yield from A.batches(((b, LOOSE, x.tobytes()) for b, x in A.packed(part, _spot(part["string"], n), n)), _PACK)

    return run


def _meet(n: int):
    """Open starts of spread windows -> those whose string is there twice; settled ranges pass."""
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = []
        for batch in it:
            passing = batch.filter(pc.equal(batch.column(1), SPANS))
            if passing.num_rows:
                yield passing
            parts += [np.frombuffer(b, _LOOSE) for k, b in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()) if k == LOOSE]
        if not parts:
            return
        rows = np.concatenate(parts)
        order, start, group = _groups(rows["string"])
        rows = rows[order]
        twice = np.diff(np.append(start, len(rows)))[group] > 1
        hit = rows[twice & (rows["known"] == 0)]
        yield from A.batches(_spans(_merged(hit["uid"], hit["at"], hit["at"]), n), _PACK)

    return run


def _cut(names: list[str], length: int, digest: bool):
    """Texts and ranges of one document bucket -> the result rows."""
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        spans = _bodies(iter(right.to_batches()), _SPAN)
        spans = _merged(spans["uid"], spans["first"], spans["last"] + np.uint32(length - 1))
        data, offsets = A.text_buffer(left["text"])
        uid = left["uid"].to_numpy()
        low, high = np.searchsorted(spans["uid"], uid), np.searchsorted(spans["uid"], uid, "right")
        raw = data.tobytes()
        removed, runs, kept = np.zeros(len(uid), np.int64), (high - low).astype(np.int64), []
        for k in range(len(uid)):
            s, e = int(offsets[k]), int(offsets[k + 1])
            if low[k] == high[k]:
                kept.append(raw[s:e])
                continue
            parts, at, lost = [], s, 0
            for a, b in zip(spans["first"][low[k]:high[k]].tolist(), spans["last"][low[k]:high[k]].tolist()):
                a, b = s + a, s + b + 1
                if not digest:  # characters that a run's ends would split stay
                    while a < b and raw[a] & 0xC0 == 0x80:
                        a += 1
                    while b > a and b < e and raw[b] & 0xC0 == 0x80:
                        b -= 1
                parts.append(raw[at:a])
                at, lost = b, lost + b - a
            parts.append(raw[at:e])
            removed[k] = lost
            kept.append(b"".join(parts))
        rest = [hashlib.sha256(x).hexdigest() for x in kept] if digest else [x.decode() for x in kept]
        return pa.table([*[left[c] for c in names], pa.array(np.diff(offsets)), pa.array(removed), pa.array(runs), pa.array(rest, pa.string())],
                        [*names, "n_bytes", "n_removed", "n_spans", "kept"])

    return run


def remove_repeats(docs: DataFrame, keep: list[str], id_col: str = "doc_id", text: str = "text", length: int = LENGTH,
                   gram: int = GRAM, digest: bool = True) -> DataFrame:
    """Each row's ``keep`` columns plus n_bytes, n_removed, n_spans (long) and what is left of its text.

    With ``digest`` that is kept_sha256, the lower-case hex digest of the remaining bytes; without, kept_text, for which
    each removed run gives up the characters it would split. Texts are their whole UTF-8 bytes, null is empty; strings are
    judged on the input. Ids may be null or repeat. Texts shorter than ``length`` lose nothing, and of equal texts of at
    least ``length`` bytes nothing stays. An empty table gives no rows.
    """
    if not 0 < gram <= length <= gram + 254:
        raise ValueError("gram must be positive, and length at most 254 above it")
    spark = A.ready(docs.sparkSession)
    parts = A.buckets(spark)
    n = FINE * parts
    value = F.col(f"`{text}`").cast("string")
    uid = F.xxhash64(F.col(f"`{id_col}`").cast("string"), value).alias("uid")
    names = [f"keep_{i}" for i in range(len(keep))]
    dealt = docs.select(uid, value.alias("text"), *[F.col(f"`{c}`").alias(k) for c, k in zip(keep, names)]).withColumn(
        "bucket", F.pmod("uid", F.lit(n).cast("long")).cast("int"))
    met = docs.select(uid, value.alias("text")).mapInArrow(A.lean(_find(n, length, gram)), _PACKED)
    flags = A.by_bucket(met, parts).mapInArrow(A.lean(_classify(n)), _PACKED)
    picked = dealt.groupBy("bucket").cogroup(flags.groupBy("bucket")).applyInArrow(_pick(n, length), _PACKED)
    sorted_ = A.by_bucket(picked, parts).mapInArrow(A.lean(_sort(n, length)), _PACKED)
    spans = A.by_bucket(sorted_, parts).mapInArrow(A.lean(_meet(n)), _PACKED)
    fields = "".join(f"`{k}` {docs.schema[c].dataType.simpleString()}, " for c, k in zip(keep, names))
    result = dealt.groupBy("bucket").cogroup(spans.groupBy("bucket")).applyInArrow(
        _cut(names, length, digest), f"{fields}n_bytes long, n_removed long, n_spans long, kept string")
    return result.select(*[F.col(k).alias(c) for c, k in zip(keep, names)], "n_bytes", "n_removed", "n_spans",
                         F.col("kept").alias("kept_sha256" if digest else "kept_text"))
