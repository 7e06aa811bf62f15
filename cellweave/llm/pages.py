"""Main text of web pages by nearest-URL page differencing.

Pages of one host are put in the order of their URL paths; each page is compared with the neighbour whose path is
nearest. Both pages are lines of text, aligned by a longest common subsequence, and shared lines go.

Differencing alone doesn't give main texts: menus and adverts that change from page to page are never shared, and
paragraphs that two articles share would go. So element marks come first (``markup``): named furniture goes, and where a
page marks its article, all outside goes and the article's paragraphs stay. Differencing decides about the rest: the lines
of pages that mark no article, and loose lines in marked articles.

Only line hashes travel, and only of pages that have such a line and of their two neighbours. A host of any share spreads
over range partitions; positions are distributed prefix sums.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweave.llm import arrays as A
from cellweave.llm import markup
from cellweave.llm.mixing import prefix_sums
from cellweave.session import cut

#: a neighbour that shares at least this part of the lines of both pages is a copy; it doesn't tell what its site repeats
COPY = 0.8
_URL = re.compile(r"^\s*(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#\s]+)([^?#\s]*)")


def place(url: str | None) -> tuple[str | None, str]:
    """Host and path of a URL, the path with numbers padded so that it sorts by them; (None, '') without a host."""
    found = _URL.match(url or "")
    if not found:
        return None, ""
    path = re.sub(r"(?:/index)?\.(?:html?|php|aspx?)$|/+$", "", found[2].lower())
    return found[1].lower().removeprefix("www."), re.sub(r"\d+", lambda d: d[0].zfill(20), path)


def kept_zones(marked: int) -> range:
    return {2: range(markup.ARTICLE_LOOSE, 6), 1: range(markup.MAIN_LOOSE, 6)}.get(marked, range(markup.OUTSIDE, 6))


def lines(html: str | None) -> tuple[list[str], list[int], list[int]]:
    """All lines of a page, which of them may be main text, and which of those differencing decides."""
    found, marked = markup.blocks(html)
    zones = kept_zones(marked)
    kept = [i for i, (_, zone) in enumerate(found) if zone in zones]
    return [t for t, _ in found], kept, [i for i in kept if found[i][1] not in (markup.MAIN_PARAGRAPH, markup.ARTICLE_PARAGRAPH)]


def nearness(path: str, other: str) -> tuple[int, int, int]:
    """Orders paths by how far they are from ``path``: segments shared from the front, length, gap of the last number."""
    a, b = path.split("/"), other.split("/")
    shared = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    numbers = [int((re.findall(r"\d+", p) or ["0"])[-1]) for p in (path, other)]
    return -shared, abs(len(a) - len(b)), abs(numbers[0] - numbers[1])


def shared_lines(a: list[int], b: list[int], stored: int = 1 << 22) -> list[int]:
    """Positions in ``a`` of one longest common subsequence of both.

    Rows of the table are bit vectors; about ``stored`` bytes of them are held at once, the others are made again from
    every k-th.
    """
    if not a or not b:
        return []
    width, full = len(b), (1 << len(b)) - 1
    where: dict[int, int] = {}
    for j, x in enumerate(b):
        where[x] = where.get(x, 0) | 1 << j

    def after(row: int, x: int) -> int:
        met = row & where.get(x, 0)
        return ((row + met) | (row - met)) & full

    gap = max(1, -(-len(a) * (width // 8 + 32) // stored))
    marks, row = [full], full
    for i, x in enumerate(a, 1):
        row = after(row, x)
        if i % gap == 0:
            marks.append(row)
    found: list[int] = []
    i, j = len(a), width
    rows: list[int] = []
    base = -1
    while i and j:
        low = (i - 1) // gap * gap  # rows low .. low + gap are at hand
        if low != base:
            base, rows = low, [marks[low // gap]]
            for x in a[low:min(low + gap, len(a))]:
                rows.append(after(rows[-1], x))
        if rows[i - base] >> (j - 1) & 1:
            j -= 1
            continue
        i -= 1
        if i and not (rows[i - base] if i >= base else marks[i // gap]) >> (j - 1) & 1:
            continue
        found.append(i)
        j -= 1
    return found[::-1]


def verdict(mine: tuple[str, list[int], list[int]], others: list[tuple[str, list[int]]]) -> list[int]:
    """The lines of a page (path, hashes, open lines) that go: those shared with the nearest neighbour that isn't a copy."""
    path, hashes, opened = mine
    for _, other in sorted(others, key=lambda o: nearness(path, o[0])):
        shared = shared_lines(hashes, other)
        if len(shared) < COPY * max(len(hashes), len(other)):
            return sorted(set(shared) & set(opened))
    return []


def _hash(line: str) -> int:
    return xxhash.xxh3_64_intdigest(line.encode("utf-8", "surrogatepass")) - (1 << 63)


def extract(pages: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """``keep`` (page_id, url) of each row of ``pages(page_id, url, html)``, then text and n_chars (long, code points).

    The text is the page's article: blocks in page order, joined by two newlines. Furniture that elements or their class,
    id or role name goes (menus, headers, footers, side bars, notices, adverts, forms, comments, hidden elements), as do
    scripts, styles and markup; headings in an article's own header stay. A page with an article element is that article,
    one with a main element that; any other page is all its lines but those shared with its nearest page. White space is
    what str.split takes for it, br counts as white space. Null, empty or unreadable html gives an empty text. Rows
    without a host in their URL, alone on their host, or with only copies next to them, are compared with none. Repeated
    rows (same page_id, url and html) get the same text and aren't each other's neighbour. Other columns are left alone,
    ``text`` and ``n_chars`` are always the results. An empty table gives no rows.
    """
    A.ready(pages.sparkSession)
    keep = ["page_id", "url"] if keep is None else keep
    key = ["id__", "url__", "html__"]
    marked = pages.select(F.col("page_id").alias("id__"), F.col("url").cast("string").alias("url__"), F.xxhash64("html").alias("html__"), "html")

    def read(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            where = [place(u) for u in batch.column(1).to_pylist()]
            hashes, opened = [], []
            for html in batch.column(3):
                found, _, maybe = lines(html.as_py())
                hashes.append([_hash(t) for t in found])
                opened.append(maybe)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array([h for h, _ in where], pa.string()), pa.array([p for _, p in where], pa.string()),
                 pa.array(hashes, pa.list_(pa.int64())), pa.array(opened, pa.list_(pa.int32()))],
                [*key, "host", "path", "hashes", "opened"])

    id_type = marked.schema["id__"].dataType.simpleString()
    schema = f"id__ {id_type}, url__ string, html__ bigint, host string, path string, hashes array<bigint>, opened array<int>"
    found = cut(marked.mapInArrow(read, schema).filter("host IS NOT NULL").dropDuplicates(key))
    placed = cut(prefix_sums(found.select(*key, "host", "path", F.lit(1).cast("long").alias("one")), "host",
                             [F.col("path"), *[F.col(k) for k in key]], "one").select(*key, "host", "before"))
    sited = found.join(placed.drop("host"), on=_same(found, placed, key)).select(
        *[found[k] for k in key], "host", "path", "hashes", "opened", "before")
    asking = sited.filter(F.size("opened") > 0).select(
        *key, F.col("host").alias("host__"), F.col("path").alias("path__"), F.col("hashes").alias("hashes__"), "opened", "before",
        F.explode(F.array(F.col("before") - 1, F.col("before") + 1)).alias("next__"))
    beside = sited.select("host", "path", "hashes", F.col("before").alias("at"))
    near = asking.join(beside, (F.col("host__") == F.col("host")) & (F.col("next__") == F.col("at"))).groupBy("host__", "before").agg(
        *[F.first(c).alias(c) for c in (*key, "path__", "hashes__", "opened")], F.collect_list(F.struct("at", "path", "hashes")).alias("others"))

    def judge(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            gone = []
            for row in batch.select(["path__", "hashes__", "opened", "others"]).to_pylist():
                others = sorted(row["others"], key=lambda o: o["at"])
                gone.append(verdict((row["path__"], row["hashes__"], row["opened"]), [(o["path"], o["hashes"]) for o in others]))
            yield pa.RecordBatch.from_arrays([*batch.select(key).columns, pa.array(gone, pa.list_(pa.int32()))], [*key, "gone__"])

    verdicts = cut(near.select(*key, "path__", "hashes__", "opened", "others").mapInArrow(
        judge, f"id__ {id_type}, url__ string, html__ bigint, gone__ array<int>").filter(F.size("gone__") > 0))
    wide = pages.select(*[F.col(f"`{c}`").alias(f"k{i}__") for i, c in enumerate(keep)], *[
        c.alias(f"{k}p") for c, k in zip((F.col("page_id"), F.col("url").cast("string"), F.xxhash64("html")), key)], "html")
    told = wide.join(verdicts, [F.col(f"{k}p").eqNullSafe(F.col(k)) for k in key], "left").select(
        *[f"k{i}__" for i in range(len(keep))], "html", "gone__")

    def render(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            texts = []
            for html, gone in zip(batch.column(len(keep)), batch.column(len(keep) + 1)):
                all_lines, kept, _ = lines(html.as_py())
                out = set(gone.as_py() or ())
                texts.append("\n\n".join(all_lines[i] for i in kept if i not in out))
            yield pa.RecordBatch.from_arrays([*batch.columns[:len(keep)], pa.array(texts, pa.string()),
                                              pa.array([len(t) for t in texts], pa.int64())],
                                             [*batch.schema.names[:len(keep)], "text__", "n_chars__"])

    fields = ", ".join(f"k{i}__ {told.schema[i].dataType.simpleString()}" for i in range(len(keep)))
    done = told.mapInArrow(render, f"{fields + ', ' if fields else ''}text__ string, n_chars__ bigint")
    return done.select(*[F.col(f"k{i}__").alias(c) for i, c in enumerate(keep)], F.col("text__").alias("text"),
                       F.col("n_chars__").alias("n_chars"))


def _same(left: DataFrame, right: DataFrame, key: list[str]):
    condition = left[key[0]].eqNullSafe(right[key[0]])
    for k in key[1:]:
        condition &= left[k].eqNullSafe(right[k])
    return condition
