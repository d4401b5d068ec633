import html
import os
import random
import re
import time

import numpy as np
import pytest
from helpers import SF

from tidewatch.llm import html_text as H


def text(page):
    return H.main_text(H.page_lines(page))


@pytest.mark.parametrize(
    "page,want",
    [
        ("", ""),
        ("plain  text &amp; more", "plain text & more"),
        ("<nav>n</nav><article><h1>T</h1><p>a<br>b <b>c</b>d<p>e</article><footer>f</footer>", "T\n\na b cd\n\ne"),
        ("<body><div class='menu'>m</div><div>one<div>two</div>three</div><!-- c --><script>x<p>y</script></body>", "one\n\ntwo\n\nthree"),
        ("<article>a<div id='comments'><p>c</p></div>b<aside>s</aside></article>after", "a\n\nb"),
        ("<p>a<p class='ad'>buy<p>b", "a\n\nb"),
        ("<div class='ad'>never closed<article><p>x</p></article>", "x"),
        ("<form>f<input></form><p>1 &lt; 2 &copy;&nbsp;x</p><style>p{}</style>", "1 < 2 © x"),
        ("<div style='display: none'>h</div><p hidden>i</p><p>j", "j"),
        ("<main><ul><li>x<li>y</ul></main>", "x\n\ny"),
        ("a < b <unfinished", "a < b <unfinished"),
        ("<script>never closed <p>x", ""),
    ],
)
def test_blocks(page, want):
    assert text(page) == want


def test_common_lines_is_a_longest_common_subsequence():
    rng = random.Random(1)
    for _ in range(1000):
        a, b = [[rng.randint(0, 5) for _ in range(rng.randint(0, 9))] for _ in range(2)]
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a)):
            for j in range(len(b)):
                table[i + 1][j + 1] = table[i][j] + 1 if a[i] == b[j] else max(table[i][j + 1], table[i + 1][j])
        c = H.common_lines(np.array(a, int), np.array(b, int))
        it = iter(b)
        assert len(c) == table[-1][-1] and c == sorted(set(c)) and all(any(a[i] == y for y in it) for i in c)


def test_query_gives_the_articles(spark):
    rows = H.op5_html_text(spark, SF).collect()
    pages = {r["page_id"]: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    assert len(rows) == len(pages)
    for r in rows:
        article = re.search("<article>(.*)</article>", pages[r["page_id"]]["html"], re.S)[1]
        blocks = [" ".join(html.unescape(re.sub("<[^>]*>", "", x.replace("<br>", " "))).split()) for x in re.split("</?(?:p|h1)>", article)]
        assert r["text"] == "\n\n".join(filter(None, blocks)) and r["n_chars"] == len(r["text"]) and r["url"] == pages[r["page_id"]]["url"]


def test_shared_lines_go_and_copies_stay(spark):
    site = "<div>Menu one</div><div>{}</div><div>Subscribe now to our letter</div>"
    own = ["A long first text that only this page has, of some length.", "Another text, which is the only one of its kind on this site.", "A third page's text, again unlike all the others here."]
    rows = [(k, f"http://h.com/p/{k}", site.format(t)) for k, t in enumerate(own)]
    rows += [(7, "http://copy.com/a", "<div>same text here</div>"), (8, "http://copy.com/b", "<div>same text here</div>"), (9, None, None), (10, "http://alone.com/", "<div>x</div>"), (10, "http://alone.com/", "<div>x</div>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    got = sorted((r["page_id"], r["text"]) for r in H.extract(df).collect())
    assert got == [*enumerate(own), (7, "same text here"), (8, "same text here"), (9, ""), (10, "x"), (10, "x")]
    assert H.extract(df.limit(0)).count() == 0


def test_neighbours_across_ranges(spark):
    """With as many ranges as pages every pair is across an end."""
    spark.conf.set("spark.sql.shuffle.partitions", "12")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = [(k, f"http://h.com/p/{k}", f"<div>Header of the site</div><div>Own words of page number {k}, and then some more of them {k * 7}</div>") for k in range(9)]
        got = {r["page_id"]: r["text"] for r in H.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert all(t.startswith("Own words") for t in got.values()) and len(got) == 9


def extracted(spark, rows):
    return {r["page_id"]: r["text"] for r in H.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}


def test_differencing_decides_in_and_beside_articles(spark):
    own = [f"Own words of page number {k}, and then some more of them {k * 7}" for k in range(4)]
    inside = extracted(spark, [(k, f"http://h.com/p/{k}", f"<nav>n</nav><article><p>Licence of the site</p><p>{t}</p></article>") for k, t in enumerate(own)])
    assert inside == dict(enumerate(own))
    beside = extracted(spark, [(k, f"http://h.com/p/{k}", f"<div>Notice</div><article>Teaser {k}</article><div>{t}</div>") for k, t in enumerate(own)])
    assert beside == {k: f"Teaser {k}\n\n{t}" for k, t in enumerate(own)}
    copies = extracted(spark, [(k, f"http://h.com/p/{k}", f"<article><p>{own[0]}</p><p>{own[1]}</p><p>{k}</p></article>") for k in range(2)])
    assert copies == {k: f"{own[0]}\n\n{own[1]}\n\n{k}" for k in range(2)}


def test_dropped_lines_and_copies_do_not_stop_differencing(spark):
    own = [f"Own words of page number {k}, and more {k * 7}" for k in range(4)]
    menu = "<nav>" + "<li>A long menu item that all pages of this site have</li>" * 5 + "</nav>"
    short = extracted(spark, [(k, f"http://h.com/p/{k}", f"{menu}<div>Header of the site</div><div>{t}</div>") for k, t in enumerate(own)])
    assert short == dict(enumerate(own))
    pages = [(f"/a/{k}", t) for k, t in enumerate(own)] + [("/a/1/print", own[1] + "</div><div>Print view")]
    printed = extracted(spark, [(k, f"http://h.com{path}", f"<div>Header of the site</div><div>{t}</div>") for k, (path, t) in enumerate(pages)])
    assert printed == {**dict(enumerate(own)), 4: own[1] + "\n\nPrint view"}


@pytest.mark.parametrize("page", ["<div " * 200_000, "<a " * 330_000, "<div>x</span></p>" * 60_000, "<a>" * 80_000 + "<p>x</p>" * 80_000, '<a ">" ' * 140_000, "<script " * 120_000 + ">", "<!-- " * 200_000, "<div class='ad'>" * 60_000 + "<main>x</main>" * 60_000])
def test_broken_long_pages_take_linear_time(page):
    began = time.process_time()
    H.page_lines(page)
    assert time.process_time() - began < 8 * max(1, len(page) / 1e6)


def brute_text(pages):
    """Pairing and deletion by comparing all pages of a host, on lines that markup leaves undecided."""
    lines = {k: [t for t, d, _ in H.page_lines(p) if not d] for k, _, p in pages}

    def lcs(a, b):
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a)):
            for j in range(len(b)):
                table[i + 1][j + 1] = table[i][j] + 1 if a[i] == b[j] else max(table[i][j + 1], table[i + 1][j])
        return table[-1][-1]

    out = {}
    for k, url, _ in pages:
        path = url.split("/", 3)[3]
        near = [(len(os.path.commonprefix([path, u.split("/", 3)[3]])), j) for j, u, _ in pages if j != k and u.split("/")[2] == url.split("/")[2]]
        best = max((n for n, _ in near), default=None)
        out[k] = {len(lines[k]) - lcs(lines[k], lines[j]) for n, j in near if n == best} or {len(lines[k])}
    return lines, out


def test_pairing_and_deletion_against_brute_force(spark):
    rng = random.Random(8)
    rows = []
    for k in range(60):
        host, path = rng.choice(["a.com", "b.com"]), "/".join(rng.choice("xyz") for _ in range(3)) + f"/{k}"
        top = [f"Header line {rng.randint(0, 2)}", f"Menu {path[0]}"]
        own = [f"Own words of page {k}, line {i}, which are longer than all the rest of it taken together" for i in range(rng.randint(1, 3))]
        rows.append((k, f"http://{host}/{path}", "".join(f"<div>{t}</div>" for t in [*top, *own, f"Footer of {host}"])))
    lines, left = brute_text(rows)
    for k, t in extracted(spark, rows).items():
        stay = t.split("\n\n") if t else []
        it = iter(lines[k])
        assert all(any(x == y for y in it) for x in stay) and len(stay) in left[k]
        assert [x for x in stay if x.startswith("Own")] == [x for x in lines[k] if x.startswith("Own")]


def test_markup_without_names(spark):
    """Pages of plain divs: what a site repeats goes by differencing alone."""
    rows = [(k, f"http://h.com/n/{k}", f"<div>Site name</div><div>Home</div><div><h1>Title {k}</h1><p>Body of page {k}, {'and more ' * 5}{k}</p></div><div>Imprint</div>") for k in range(12)]
    got = extracted(spark, rows)
    assert got == {k: f"Title {k}\n\nBody of page {k}, {'and more ' * 5}{k}" for k in range(12)}


def test_null_and_empty_are_apart(spark):
    rows = [(1, None, "<p>x</p>"), (2, "<p>x</p>", None), (3, "", "<p>x</p>"), (4, None, None)]
    assert extracted(spark, rows) == {1: "x", 2: "", 3: "x", 4: ""}
