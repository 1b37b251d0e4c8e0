import time

import numpy as np
import pyarrow as pa
import pytest
from llm_rows import SF_DIR, shipped  # noqa: F401

from sealdex.llm import page_text
from sealdex.llm.page_text import common_beginning, lines_of, main_texts, shared_lines
from sealdex.llm.queries import QUERIES

SCHEMA = "page_id long, url string, html string, text string, range int"

PAGE = """<!DOCTYPE html><html><head><title>T &amp; x</title><style>p{}</style></head><body class="home">
<header><h1>Site</h1></header><nav><ul><li><a href="/a">Menu</a></ul></nav>
<aside>side</aside><div class="cookie-notice">We use cookies</div><!-- no <p>comment</p> -->
<article><header><h1>Main  title</h1></header><p>First &eacute;&#233; &lt;b&gt;<b>bold</b>
text<p>Second<br>line<script>var a = "</p>";</script><ul><li>one<li>two</ul>
<div class="ad">Buy</div><form><input value="x">Sign up</form><section id="comments"><p>Nice!</p></section><p>Last</article>
<footer>&copy; Site</footer></body></html>"""


def texts(spark, rows):
    got = main_texts(spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)).collect()
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
    return {r.page_id: r.text for r in got}


def test_markup():
    assert [t for t, _ in lines_of(PAGE)] == ["Main title", "First éé <b>bold text", "Second", "line", "one", "two", "Last"]


def test_marks_that_tell_of_something_else():
    text = lambda source: [t for t, _ in lines_of(source)]
    for name in ("body", "main", "article", "html"):
        for mark in ("has-sidebar", "no-sidebar", "with-related", "legal", "home sidebar"):
            assert text(f'<{name} class="{mark}"><p>Text</p></{name}>') == ["Text"]
    assert text('<div class="has-sidebar">Text</div><div id="layout-no-sidebar">more</div>') == ["Text", "more"]
    assert text('<div class="x site-footer">a</div><div class="main_nav">b</div><div class="sidebar-left">c</div><p>Text') == ["Text"]


def test_marked_elements_that_are_not_closed():
    text = lambda source: [t for t, _ in lines_of(source)]
    assert text('<div><p class="promo">Buy<p>One<p>Two</div>') == ["One", "Two"]
    assert text('<div><p class="promo">Buy<br>now<div>One</div><p>Two</div>') == ["One", "Two"]
    assert text('<ul><li class="share">Share<p>it</p><li>One<li>Two</ul>') == ["One", "Two"]
    assert text('<ul><li class="share">Share<ul><li>a<li>b</ul><li>One</ul>') == ["One"]


def test_subsequence_against_brute_force():
    draw = np.random.default_rng(2)
    for _ in range(300):
        a, b = draw.integers(0, 5, draw.integers(0, 14)), draw.integers(0, 5, draw.integers(0, 14))
        table = np.zeros((len(a) + 1, len(b) + 1), int)
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1, j + 1] = table[i, j] + 1 if x == y else max(table[i, j + 1], table[i + 1, j])
        own = a[shared_lines(a, b)]
        assert len(own) == table[-1, -1]
        rest = iter(b)
        assert all(any(x == y for y in rest) for x in own)


def test_shared_lines_of_plain_pages_go(shipped):
    plain = "<div>Our site</div><p>Body {0} a</p><p>Body {0} b</p><div>Imprint of all</div>"
    rows = [(i, f"http://h.example/x/{i}", plain.format(i)) for i in range(8)]
    rows += [(90, "http://alone.example/x", plain.format(9)), (91, None, plain.format(9)), (92, "nonsense", None), (93, "http://h.example/zz", "")]
    rows += [(94, "http://twice.example/x", plain.format(5)), (94, "http://twice.example/x", plain.format(5)), (None, "http://q.example/", "<p>a<")]
    got = texts(shipped, rows)
    assert all(got[i] == f"Body {i} a\nBody {i} b" for i in range(8))
    whole = "Our site\nBody {0} a\nBody {0} b\nImprint of all"
    assert got[90] == got[91] == whole.format(9) and got[94] == whole.format(5) and got[92] == got[93] == "" and got[None] in ("a", "a<")


def test_copies_lose_the_lines_of_one_other_page(shipped):
    """Runs of copies, within a range and across many: each copy gets the same text, as the first and last do."""
    plain = "<div>Our site</div><p>Body {0}</p><div>Imprint</div>"
    rows = [(0, "http://h.example/a", plain.format(0)), (900, "http://h.example/c", plain.format(900))]
    rows += [(i, f"http://h.example/b?id={i}", plain.format("same")) for i in range(1, 300)]
    rows += [(1000 + i, f"http://k.example/{i:03}", plain.format("all")) for i in range(100)] + [(1100, "http://k.example/z", plain.format("z"))]
    rows += [(2000 + i, f"http://only.example/{i:03}", plain.format("only")) for i in range(100)]
    got = texts(shipped, rows)
    assert {got[i] for i in range(1, 300)} == {"Body same"} and got[0] == "Body 0" and got[900] == "Body 900"
    assert {got[1000 + i] for i in range(100)} == {"Body all"} and got[1100] == "Body z"
    assert {got[2000 + i] for i in range(100)} == {"Our site\nBody only\nImprint"}


def test_articles_printed_twice_stay(shipped):
    page = "<div>Our site</div><article><p>The same article</p></article>"
    assert texts(shipped, [(1, "http://h.example/a", page + "<i>x</i>"), (2, "http://h.example/b", page)])[2] == "The same article"


def test_query_against_every_pair(shipped):
    """Brute force: sort a host's pages, take the nearer neighbour."""
    pages = [(r.url, r.page_id, r.html) for r in shipped.read.parquet(f"{SF_DIR}/pages.parquet").collect()]
    split = lambda u: (u.split("://")[1].split("/")[0].split("?")[0].lower(), "/" + "/".join(u.split("://")[1].split("/")[1:]).split("?")[0].split("#")[0])
    order = sorted((*split(u), i, h) for u, i, h in pages)
    want = {}
    for k, (host, path, i, source) in enumerate(order):
        near = [x for x in (order[k - 1] if k else None, order[k + 1] if k + 1 < len(order) else None) if x and x[0] == host and lines_of(x[3]) != lines_of(source)]
        own = lines_of(source)
        gone = np.zeros(len(own), bool)
        if near:
            other = max(near, key=lambda x: common_beginning(path, x[1]))
            number = {t: n for n, t in enumerate({t for t, _ in own + lines_of(other[3])})}
            gone = shared_lines(np.array([number[t] for t, _ in own], int), np.array([number[t] for t, _ in lines_of(other[3])], int))
        want[i] = "\n".join(t for (t, s), g in zip(own, gone, strict=True) if s == 2 or not g)
    got = {r.page_id: r.text for r in QUERIES["op1_page_text"](shipped, SF_DIR).collect()}
    assert got == want


def test_no_rows(shipped):
    assert texts(shipped, []) == {}


@pytest.mark.parametrize(
    "page",
    ["<a " * 1_000_000, "<a '>' " * 300_000, '<a ">' * 400_000 + "'", "<div>" * 200_000 + "</x>" * 200_000,
     "<p class=ad><td>" + "<div>" * 200_000, "<canvas/>" * 200_000, "<a " + "b" * 2_000_000 + ">", "<!" * 1_000_000, "< " * 1_000_000 + ">"],
)
def test_hostile_pages_take_time_in_proportion(page):
    start = time.process_time()
    page_text.lines_of(page)
    assert time.process_time() - start < 20


@pytest.mark.parametrize("name, kept", [("search results", 1), ("legal-text", 1), ("share-price", 1), ("comments-policy", 1), ("alert-box", 1), ("ad", 0), ("ad-slot", 0), ("site-footer", 0), ("cookie-banner main", 0)])
def test_marks_are_whole_tokens(name, kept):
    assert len(page_text.lines_of(f'<div class="{name}">words</div>')) == kept


def test_text_that_only_looks_like_tags():
    lines = page_text.lines_of("<p>a < b and c <d e=\"f'> g</p><p title='it's'>h</p> <3 <")
    assert [t for t, _ in lines][0].startswith("a < b and c") and lines[-1][0].endswith("<3 <")


def test_few_pages_are_held_as_values_at_once():
    """An Arrow batch holds thousands of pages: they are read slice by slice, and texts go as they are made."""
    n = 2_000
    rows = [{"range": 0, "ghost": False, "host": "h", "path": f"/{i:05}", "page_id": i, "url": f"http://h/{i:05}", "lines": [f"line {i}"], "states": [2], "hashes": [i]} for i in range(n)]
    batch = pa.RecordBatch.from_pylist(rows, page_text._LINES_ARROW)
    out = [b.num_rows for b in page_text._paired({})(iter([batch]))]
    assert sum(out) == n and max(out) <= 256
    pages = pa.RecordBatch.from_pylist([{k: r[k] for k in ("host", "path", "page_id", "url")} | {"html": "<p>a"} for r in rows])
    assert max(b.num_rows for b in page_text._parsed([], True)(iter([pages]))) <= 256


def test_pages_are_read_and_their_ends_found_in_one_step():
    """Two steps of a task in Python are two workers, each with the memory of one."""
    page = pa.RecordBatch.from_pylist([{"host": "h", "path": "/a", "page_id": 1, "url": "u", "html": "<p>a"}])
    assert [r["what"] for b in page_text._parsed_ends([])(iter([page])) for r in b.to_pylist()] == [0, 2]
