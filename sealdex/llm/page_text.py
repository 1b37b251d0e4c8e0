"""Main text of web pages by nearest-URL page differencing.

Pages of a host are put in the order of their URL paths, and a page is paired
with the neighbour whose path shares the longest beginning with its own. Their
text lines are aligned by longest common subsequence, and lines they share are
template, not content: they are deleted.

Differencing alone deletes an article that is printed twice and keeps an advert
that changes with every page. Markup that leaves no doubt settles those lines
first: what stands in menus, page headers and footers, sidebars, notices,
adverts, forms, scripts, styles or reader comments goes, and what else stands
in an article or main element stays, shared or not.

Cases: null or empty html gives an empty text. A page alone on its host has no
neighbour and loses no line by differencing. Unclosed, cut or stray tags do not
fail. Nothing is learnt from a neighbour of the very same lines, as a repeated
row is: a run of such copies is one page, paired with the nearest different page
of the host, so all copies lose the same lines. An empty table gives no rows; pages
without a URL are paired with nothing.
"""

from __future__ import annotations

import hashlib
import html
import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sealdex.session import scratch_path

_BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section select summary table "
    "tbody td textarea tfoot th thead title tr ul video".split()
)
#: Elements whose content is never read.
_RAW = frozenset("script style noscript template iframe svg math object canvas textarea title".split())
#: Elements that are not the article, wherever they stand.
_OTHER = frozenset("nav aside footer form button select dialog menu head".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_ARTICLE = frozenset(["article", "main"])
#: Elements that hold the article: a mark tells what stands in or beside it, not that it goes.
_WHOLE = _ARTICLE | {"html", "body"}
#: Blocks that end an element of these kinds which was not closed, if they stand in the same of the other blocks.
_PARAGRAPH_ENDS = frozenset(
    "address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr li main menu nav ol p pre section summary table ul".split()
)
_ENDED_BY = {"p": _PARAGRAPH_ENDS, "li": frozenset(["li"]), "dd": frozenset(["dd", "dt"]), "dt": frozenset(["dd", "dt"])}
#: Words of class, id and role that say the same: as a whole token, before or behind words of place.
_MARKS = re.compile(
    r"(?<![^\s])(?:(?:site|page|main|top|bottom|left|right|primary|secondary|global|post|entry|article|blog)[-_])*+(?:ads?|advert\w*+|banner|sponsor\w*+|promo\w*+|nav|navbar|navigation|menu\w*+|breadcrumbs?|sidebar|side-bar|aside|comments?|commentlist|disqus|replies|"
    r"cookies?|consent|gdpr|notices?|alert|popup|modal|newsletter|subscribe|share|sharing|social|related|recommend\w*+|footer|masthead|site-header|page-header|"
    r"login|toolbar|widget|pagination|skip-link|contentinfo|complementary|hidden|legal|disclaimer)"
    r"(?:[-_](?:area|banner|bar|block|buttons?|container|form|inner|items?|left|links?|list|menu|nav|notice|overlay|panel|posts?|right|section|slot|unit|widget|wrapper|\d+))*+(?!\S)",
    re.I,
)
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>", re.S)
#: The same where quotes do not match up: a tag ends at the next >.
_LOOSE_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>", re.S)
_TAG_START = re.compile(r"<(?=[a-zA-Z!?]|/[a-zA-Z])")
_ATTRIBUTE = re.compile(r"""(?<![\w:-])([\w:-]++)\s*+=\s*+(?:"([^"]*)"|'([^']*)'|([^\s"'>]++))""")
_SPACE = re.compile(r"\s+")
_CLOSE = {name: re.compile(rf"</{name}\s*>", re.I) for name in _RAW}

DROPPED, OPEN, ARTICLE = 0, 1, 2


class _Open:
    """Elements that are open, with the places of each name: no search goes through all of them."""

    def __init__(self):
        self.stack: list[tuple[str, int]] = []
        self.places: dict[str, list[int]] = {}
        #: Places of blocks that an unclosed paragraph or item below them survives.
        self.walls: list[int] = []

    def push(self, name: str, state: int) -> None:
        place = len(self.stack)
        self.stack.append((name, state))
        self.places.setdefault(name, []).append(place)
        if name in _OTHER or name in _BLOCKS and name not in ("div", "address", "p"):
            self.walls.append(place)

    def last(self, name: str) -> int:
        return (self.places.get(name) or [-1])[-1]

    def close(self, place: int) -> int:
        """Close the element at a place and all in it; the state before it."""
        state = self.stack[place][1]
        while len(self.stack) > place:
            name, _ = self.stack.pop()
            self.places[name].pop()
            if self.walls and self.walls[-1] == len(self.stack):
                self.walls.pop()
        return state

    def inside(self, names: frozenset[str]) -> bool:
        return any(self.places.get(n) for n in names)


def _tags(source: str) -> Iterator[tuple[str, re.Match | None]]:
    """Text and the tag behind it, in one pass.

    A tag whose quotes do not match up costs one look at the rest of the page; from
    there on tags end at the next >. What has no > behind it is text.
    """
    last, place, text_from, tag = source.rfind(">"), 0, 0, _TAG
    while True:
        start = _TAG_START.search(source, place)
        at = start.start() if start else len(source)
        comment = source.startswith("<!--", at)
        if not start or (at > last and not comment):
            yield source[text_from:], None
            return
        found = tag.match(source, at)
        if not found and tag is _TAG:
            tag = _LOOSE_TAG
            found = tag.match(source, at)
        if not found:
            place = at + 1
            continue
        skip = yield source[text_from:at], found
        place = text_from = found.end() if skip is None else skip
        if skip is not None:
            yield "", None


def lines_of(source: str) -> list[tuple[str, int]]:
    """Text blocks of a page in order, each with what its markup says: dropped, open or article.

    Time and memory grow with the page, whatever stands in it.
    """
    out: list[tuple[str, int]] = []
    open_ = _Open()
    state, parts = OPEN, []

    def flush() -> None:
        if parts:
            text = _SPACE.sub(" ", html.unescape("".join(parts))).strip()
            parts.clear()
            if text and state != DROPPED:
                out.append((text, state))

    tags = _tags(source)
    for text, m in tags:
        parts.append(text)
        if m is None or m[2] is None:
            continue
        name = m[2].lower()
        if m[1]:
            if name in _BLOCKS or name in _OTHER:
                flush()
            if open_.last(name) >= 0:
                state = open_.close(open_.last(name))
            continue
        if name in _BLOCKS or name in _OTHER:
            flush()
            while True:
                ended = max((open_.last(k) for k, by in _ENDED_BY.items() if name in by), default=-1)
                if ended < 0 or (open_.walls and ended < open_.walls[-1]):
                    break
                state = open_.close(ended)
        closed = m[3].rstrip().endswith("/")
        if name in _RAW:
            if not closed:
                end = _CLOSE[name].search(source, m.end())
                tags.send(end.end() if end else len(source))
            continue
        if name in _VOID or closed or name in ("p", "li", "b", "i", "span", "a"):
            if not m[3] or not _other(name, m[3]) or name in _VOID:
                continue
        elif name not in _OTHER and name not in _BLOCKS and not m[3]:
            continue
        open_.push(name, state)
        if state != DROPPED:
            page_header = name == "header" and not open_.inside(_ARTICLE)
            if name in _OTHER or page_header or (m[3] and _other(name, m[3])):
                state = DROPPED
            elif name in _ARTICLE:
                state = ARTICLE
    flush()
    return out


def _other(name: str, attributes: str) -> bool:
    for key, *values in _ATTRIBUTE.findall(attributes):
        if key.lower() == "role" and "search" in values:
            return True
        if name not in _WHOLE and key.lower() in ("class", "id", "role", "aria-label") and _MARKS.search("".join(values)):
            return True
        if key.lower() == "style" and re.search(r"display\s*:\s*none", "".join(values), re.I):
            return True
    return bool(re.search(r"\bhidden\b", _ATTRIBUTE.sub("", attributes), re.I))


def shared_lines(own: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Which of ``own`` stand in a longest common subsequence of both (hashes of lines)."""
    mask = np.zeros(len(own), bool)
    low, high = 0, min(len(own), len(other))
    while low < high and own[low] == other[low]:
        low += 1
    tail = 0
    while tail < high - low and own[-1 - tail] == other[-1 - tail]:
        tail += 1
    mask[:low] = True
    mask[len(own) - tail :] = True
    a, b = own[low : len(own) - tail], other[low : len(other) - tail]
    # Lines that the other page has nowhere cannot be shared.
    at, bt = np.flatnonzero(np.isin(a, b)), np.flatnonzero(np.isin(b, a))
    if not len(at):
        return mask
    for i in _subsequence(a[at], b[bt]):
        mask[low + at[i]] = True
    return mask


def _subsequence(a: np.ndarray, b: np.ndarray) -> list[int]:
    """Places in ``a`` of a longest common subsequence, in space of one row (Hirschberg)."""
    if not len(a) or not len(b):
        return []
    if len(a) == 1:
        return [0] if (b == a[0]).any() else []
    half = len(a) // 2
    head, tail = _lengths(a[:half], b), _lengths(a[half:][::-1], b[::-1])[::-1]
    cut = int((head + tail).argmax())
    return _subsequence(a[:half], b[:cut]) + [half + i for i in _subsequence(a[half:], b[cut:])]


def _lengths(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Lengths of the longest common subsequence of ``a`` and every beginning of ``b``."""
    row = np.zeros(len(b) + 1, np.int64)
    for x in a:
        row[1:] = np.maximum(row[1:], row[:-1] + (b == x))
        row = np.maximum.accumulate(row)
    return row


def common_beginning(left: str, right: str) -> int:
    n = 0
    for a, b in zip(left, right, strict=False):
        if a != b:
            break
        n += 1
    return n


#: Ranges of (host, path, id) for each shuffle partition, and keys drawn for each range.
RANGES_EACH = 3
DRAWN_EACH = 16

_KEY = "host string, path string, page_id long"
_LINES = f"range int, ghost boolean, {_KEY}, url string, lines array<string>, states array<byte>, hashes array<long>"
_LINES_ARROW = pa.schema(
    [("range", pa.int32()), ("ghost", pa.bool_()), ("host", pa.string()), ("path", pa.string()), ("page_id", pa.int64()), ("url", pa.string()),
     ("lines", pa.list_(pa.string())), ("states", pa.list_(pa.int8())), ("hashes", pa.list_(pa.int64()))]
)
_LEAST = -(1 << 63)
#: Pages turned into Python values at once: an Arrow batch holds thousands, whatever their size.
_ROWS_AT_ONCE = 128


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for low in range(0, batch.num_rows, _ROWS_AT_ONCE):
            yield from batch.slice(low, _ROWS_AT_ONCE).to_pylist()


def _hash(line: str) -> int:
    return int.from_bytes(hashlib.blake2b(line.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def _key(host: str | None, path: str, page: int | None) -> tuple[str, str, int]:
    return host or "", path, _LEAST if page is None else page


def _parsed(bounds: list[tuple[str, str, int]], with_text: bool):
    """Lines of the pages, and the range of keys each page lies in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for row in _rows(batches):
            found = lines_of(row["html"]) if row["html"] else []
            out.append(
                {k: row[k] for k in ("host", "path", "page_id", "url")}
                | {"range": bisect_right(bounds, _key(row["host"], row["path"], row["page_id"])), "ghost": False, "hashes": [_hash(t) for t, _ in found]}
                | ({"lines": [t for t, _ in found], "states": [s for _, s in found]} if with_text else {})
            )
            if len(out) == _ROWS_AT_ONCE:
                yield pa.RecordBatch.from_pylist(out, _LINES_ARROW)
                out = []
        yield pa.RecordBatch.from_pylist(out, _LINES_ARROW)

    return run


def _parsed_ends(bounds: list[tuple[str, str, int]]):
    """Both in one worker: each further step of a task holds a worker of its own."""
    parsed = _parsed(bounds, False)
    return lambda batches: _ends(parsed(batches))


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each range the first and last page, and the first and last that differ from these in host or lines."""
    ends: dict[int, list[dict | None]] = {}
    for row in _rows(batches):
        own = ends.setdefault(row["range"], [None] * 4)
        for at, sign in ((0, -1), (2, 1)):
            most, other = own[at : at + 2]
            beyond = lambda x: x is None or (_order(row) > _order(x)) - (_order(row) < _order(x)) == sign  # noqa: B023, E731
            if beyond(most):
                own[at : at + 2] = [row, most if most and not _alike(row, most) else other]
            elif not _alike(row, most) and beyond(other):
                own[at + 1] = row
    out = [row | {"what": what} for own in ends.values() for what, row in enumerate(own) if row]
    yield pa.RecordBatch.from_pylist(out, _LINES_ARROW.append(pa.field("what", pa.int32())))


def _order(row: dict) -> tuple:
    return (*_key(row["host"], row["path"], row["page_id"]), row["url"] or "", row["hashes"])


def _alike(a: dict, b: dict) -> bool:
    return a["host"] is not None and a["host"] == b["host"] and a["hashes"] == b["hashes"]


def _around(ends: list[dict]) -> tuple[list[tuple[int, int, int]], dict[int, list]]:
    """Ghosts (range, range and kind of the end it is), and of each range the paths by which its first and last run are judged.

    ``ends`` has the ranges' ends in order, a digest for the lines. A run that
    goes on in other ranges is judged by its pages nearest to its two borders.
    """
    pages: dict[int, dict[int, dict]] = {}
    for e in ends:
        pages.setdefault(e["range"], {})[e["what"]] = e
    order = sorted(pages)
    ghosts, judged = [], {r: [None, None] for r in order}
    joined = [k + 1 < len(order) and _alike(pages[order[k]][2], pages[order[k + 1]][0]) for k in range(len(order))]
    k = 0
    while k + 1 < len(order):
        # A border, or all borders that one run crosses.
        last = k + 1
        if joined[k]:
            while 3 not in pages[order[last]] and joined[last]:
                last += 1
            paths = (pages[order[k]][2]["path"], pages[order[last]][0]["path"])
            judged[order[k]][1] = judged[order[last]][0] = paths
            for at in range(k + 1, last):
                judged[order[at]] = [paths, paths]
            # Different pages before and after the run, which may fill the first or the last range.
            before = (order[k], 3) if 3 in pages[order[k]] else (order[k - 1], 2) if k else None
            after = (order[last], 1) if 1 in pages[order[last]] else (order[last + 1], 0) if last + 1 < len(order) else None
            ghosts += [(order[at], *before) for at in range(k + 1, last + 1) if before]
            ghosts += [(order[at], *after) for at in range(k, last) if after]
        else:
            ghosts += [(order[last], order[k], 2), (order[k], order[last], 0)]
        k = last
    for r in order:
        # A range that is one run is judged alike at both ends.
        if 3 not in pages[r]:
            both = judged[r][0] or judged[r][1]
            judged[r] = [both, both]
    return ghosts, {r: v for r, v in judged.items() if v != [None, None]}


def _other_page(own: dict, before: dict | None, after: dict | None, paths: tuple[str, str]) -> dict | None:
    """The neighbour with the longer common path; the one before on a tie."""
    near = [(x, common_beginning(path, x["path"])) for x, path in zip((before, after), paths, strict=True) if x and x["host"] == own["host"] and own["host"] is not None]
    return max(near, key=lambda x: x[1])[0] if near else None


def _paired(judged: dict[int, list]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Texts of pages that come in key order, range by range; ghosts are only neighbours."""
        # The page before the copies at hand, the first of them, and what the texts of all of them need.
        before = first = None
        copies: list[tuple] = []
        head = True
        out: list[tuple] = []

        def done(after):
            if not copies:
                return
            own = judged.get(first["range"], (None, None))
            tail = after is None or after["ghost"]
            paths = (head and own[0]) or (tail and own[1]) or (copies[0][2], copies[-1][2])
            other = _other_page(first, before, after, paths)
            shared = shared_lines(np.array(first["hashes"], np.int64), np.array(other["hashes"], np.int64)) if other else [False] * len(first["lines"])
            for page, url, _, states in copies:
                text = "\n".join(t for t, state, gone in zip(first["lines"], states, shared, strict=True) if state == ARTICLE or not gone)
                out.append((page, url, text, len(text)))
                if len(out) == _ROWS_AT_ONCE:
                    yield packed()

        def packed():
            columns = list(zip(*out, strict=True)) or [()] * 4
            out.clear()
            kinds = (pa.int64(), pa.string(), pa.string(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["page_id", "url", "text", "n_chars"])

        for row in _rows(batches):
            fresh = first is not None and row["range"] != first["range"]
            if first is None or fresh or first["ghost"] or row["ghost"] or not _alike(row, first):
                yield from done(None if fresh else row)
                head = first is None or fresh or (first["ghost"] and not copies and head)
                before, first, copies = (None if fresh else first), row, []
            if not row["ghost"]:
                states = first["states"] if row["states"] == first["states"] else row["states"]
                copies.append((row["page_id"], row["url"], row["path"], states))
        yield from done(None)
        yield packed()

    return run


def main_texts(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every row of ``pages``.

    Pages are dealt out by ranges of (host, path, id), so a host of any size is
    many tasks. A range gets the nearest different pages before and after it as
    ghosts: two pages a range, found by an aggregate.
    """
    spark = pages.sparkSession
    url = F.col(url_col)
    host = F.lower(F.regexp_extract(url, r"^[a-zA-Z][\w+.-]*://(?:[^/?#@]*@)?([^/?#]*)", 1))
    raw = pages.select(
        F.when(host != "", host).alias("host"),
        F.coalesce(F.regexp_extract(url, r"^[a-zA-Z][\w+.-]*://[^/?#]*([^?#]*)", 1), F.lit("")).alias("path"),
        F.col(id_col).cast("long").alias("page_id"),
        url.alias("url"),
        F.col(html_col).alias("html"),
    )
    ranges = RANGES_EACH * int(spark.conf.get("spark.sql.shuffle.partitions"))
    drawn = raw.select("host", "path", "page_id").orderBy(F.xxhash64("page_id", "path"), "page_id", "path").limit(DRAWN_EACH * ranges).collect()
    keys = sorted(_key(*r) for r in drawn)
    bounds = sorted({keys[i * len(keys) // ranges] for i in range(1, ranges)}) if keys else []

    light = raw.mapInArrow(_parsed_ends(bounds), f"{_LINES}, what int")
    ends = light.groupBy("range").applyInArrow(lambda t: pa.Table.from_batches(_ends(t.drop_columns("what").to_batches())), f"{_LINES}, what int")
    path = scratch_path(spark, "page-ranges")
    ends.write.parquet(path)
    ends = spark.read.schema(ends.schema).parquet(path)
    # The driver sees four paths and digests a range.
    digest = F.md5(F.concat_ws(",", F.col("hashes").cast("array<string>"))).alias("hashes")
    around, judged = _around([r.asDict() for r in ends.select("range", "what", "host", "path", digest).collect()])
    at = spark.createDataFrame(around, "for int, range int, what int")
    ghosts = ends.join(at, ["range", "what"]).select(F.col("for").alias("range"), F.lit(True).alias("ghost"), *_LINES_ARROW.names[2:])
    together = raw.mapInArrow(_parsed(bounds, True), _LINES).unionByName(ghosts)
    ordered = together.repartition("range").sortWithinPartitions("range", "host", "path", "page_id", "ghost", "url", "hashes")
    return ordered.mapInArrow(_paired(judged), "page_id long, url string, text string, n_chars long")
