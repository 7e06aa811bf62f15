"""Main texts of pages: markup, alignment, differencing of unmarked pages, odd rows."""

import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cellweave.llm import markup, pages

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body class="no-sidebar">
<header><h1>Site</h1></header><nav><ul><li><a href="/x">x</a></ul></nav><!-- ad --><div class="ad">buy</div><div id="cookie-notice">ok?</div>
<article><header><h1>Head &amp; tail</h1><p>by me</p></header><p><b>one
 two<br>three<p>four &copy; &lt;5&gt;</p><div class="comments"><p>first!</p></div><form><p>name</p></form><aside>more</aside>
<ul><li>a<li>b</ul><footer>tags</footer></article><div class="sidebar">side</div><footer>&copy; us</footer></body>"""


def brute(a, b):
    """Length of the longest common subsequence."""
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(new[-1], row[j + 1]))
        row = new
    return row[-1]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 5), max_size=40), st.lists(st.integers(0, 5), max_size=40), st.sampled_from([1, 64, 1 << 20]))
def test_alignment_is_a_longest_common_subsequence(a, b, stored):
    found = pages.shared_lines(a, b, stored)
    assert len(found) == brute(a, b) and found == sorted(set(found))
    rest = iter(b)
    assert all(any(a[i] == y for y in rest) for i in found)


def test_article_without_its_furniture():
    found, marked = markup.blocks(PAGE)
    assert marked == 2
    assert [t for t, z in found if z in pages.kept_zones(marked)] == ["Head & tail", "one two three", "four © <5>", "a", "b"]


def test_broken_markup():
    assert markup.blocks(None) == ([], 0) and markup.blocks("") == ([], 0)
    assert markup.blocks("a < b &amp c") == ([("a < b & c", 1)], 0)
    assert markup.blocks("<p>a<p class='x>y'>b</div></p><b>c<script>d") == ([("a", 1), ("b", 1), ("c", 1)], 0)
    assert markup.blocks("<article><p>a</b>&am")[0] == [("a&am", 5)]
    assert markup.blocks("<form><div class='menu'><article><p>a</article>b</div>") == ([("a", 5), ("b", 0)], 2)


def test_url_places():
    assert pages.place("https://www.A.example/b/7.html?x=1#y") == ("a.example", "/b/" + "7".zfill(20))
    assert pages.place("//a.example:80/B/") == ("a.example:80", "/b") and pages.place("nothing") == pages.place(None) == (None, "")


def unmarked(number, body, extra=""):
    return f"<html><body><div>Welcome to the site</div>{extra}<div><p>{body}</p><p>more of {number}</p></div><div>Terms of use</div></body></html>"


def plain(rows):
    """Every row's text with all pages of a host in one list."""
    sites = {}
    for page_id, url, html in rows:
        host, path = pages.place(url)
        if host:
            sites.setdefault(host, set()).add((path, page_id is not None, page_id or 0, url, html))
    out = []
    for page_id, url, html in rows:
        lines, kept, opened = pages.lines(html)
        host, path = pages.place(url)
        gone = []
        if host and opened:
            order = sorted(sites[host], key=lambda r: (r[0], r[1], r[2], r[3]))
            at = order.index((path, page_id is not None, page_id or 0, url, html))
            near = [(order[i][0], pages.lines(order[i][4])[0]) for i in (at - 1, at + 1) if 0 <= i < len(order)]
            gone = pages.verdict((path, lines, opened), near)
        out.append((page_id, url, "\n\n".join(lines[i] for i in kept if i not in gone)))
    return out


def test_differencing_of_unmarked_pages(spark):
    rng = random.Random(4)
    rows = [(i, f"http://h{'' if i % 3 else i % 7}.example/n/{rng.randrange(900)}", unmarked(i, f"text {i}", f"<div>part {i % 2}</div>")) for i in range(300)]
    rows += [(400 + i, f"https://m.example/{i}", PAGE.replace("four", str(i // 2))) for i in range(6)]
    rows += [(500, "http://copies.example/1", unmarked(1, "same")), (501, "http://copies.example/2", unmarked(1, "same"))]
    rows += [(502, "http://alone.example/1", unmarked(2, "x")), (503, None, unmarked(3, "y")), (504, "http://h.example/z", None),
             (None, "http://h.example/n/5", unmarked(9, "null id")), (505, "http://h.example/long/1", unmarked(5, "w " * 200_000)),
             (506, "http://r.example/1", unmarked(6, "z")), (506, "http://r.example/1", unmarked(6, "z")), (507, "http://r.example/2", unmarked(7, "q"))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("mine")).withColumn("host", F.lit(1)).withColumn("n_chars", F.lit(0))
    found = pages.extract(df.repartition(6))
    assert found.columns == ["page_id", "url", "text", "n_chars"]
    got = found.collect()
    assert all(r.n_chars == len(r.text) for r in got)
    key = lambda r: (r[0] is None, r[0] or 0, str(r[1]), r[2])
    assert sorted([(r.page_id, r.url, r.text) for r in got], key=key) == sorted(plain(rows), key=key)
    texts = {r.page_id: r.text for r in got}
    assert sum("Welcome" in texts[i] or "Terms" in texts[i] for i in range(300)) == 0 and all(f"text {i}" in texts[i] for i in range(300))
    assert "Welcome" in texts[500] and "Welcome" in texts[502] and texts[504] == "" and "Welcome" not in texts[506]
    assert texts[400] == "Head & tail\n\none two three\n\n0 © <5>\n\na\n\nb" == texts[401]
    assert pages.extract(df.limit(0)).count() == 0
    assert pages.extract(df.filter("page_id = 400"), ["host", "page_id"]).columns == ["host", "page_id", "text", "n_chars"]
