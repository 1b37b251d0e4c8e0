import math
import random
import re
from collections import Counter, defaultdict

import pytest
from llm_rows import SF_DIR, odd_rows, shipped  # noqa: F401

from sealdex.llm.mixing import mixed, mixed_rows
from sealdex.llm.queries import QUERIES

SCHEMA = "doc_id long, text string, source string, size string, target int"


def check(got, rows):
    size, most = defaultdict(int), defaultdict(int)
    for _, text, source in rows:
        n = len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
        size[source] += n
        most[source] = max(most[source], n)
    names = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(names)}
    total, full = sum(size.values()), {}
    while True:
        left = [s for s in names if s not in full]
        rest = total - sum(full.values())
        share = {s: rest * weight[s] / sum(weight[x] for x in left) for s in left}
        over = [s for s in left if share[s] > 3 * size[s]]
        if not over:
            break
        full |= {s: 3 * size[s] for s in over}
    target = full | share
    taken = defaultdict(int)
    assert len(got) == len(rows)
    for r in got:
        assert r.source_size == size[r.source] and r.target == pytest.approx(target[r.source], rel=1e-9, abs=1e-9)
        assert 0 <= r.taken <= 3 * r.size and r.taken == r.copies * r.size
        taken[r.source] += r.taken
    for s in names:
        assert abs(taken[s] - target[s]) <= most[s] + 1


def test_odd_rows(shipped, odd_rows):
    names = ["a", "b", None, "é", "Z", ""]
    rows = [(i, t, names[k % 6]) for k, (i, t) in enumerate(odd_rows)]
    docs = shipped.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    check(mixed(docs).collect(), rows)


def test_hot_sizes_and_reruns(shipped):
    rows = [(i, "a b c" if i % 3 else "a " * (i % 40), "hot" if i % 2 else f"s{i % 7}") for i in range(4000)]
    docs = shipped.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    first = mixed(docs).collect()
    check(first, rows)
    again = mixed(docs.repartition(5)).collect()
    assert sorted(first) == sorted(again)


def test_query(shipped):
    rows = [(r.doc_id, r.text, r.source) for r in shipped.read.parquet(f"{SF_DIR}/documents.parquet").collect()]
    check(QUERIES["op10_mixing"](shipped, SF_DIR).collect(), rows)


def test_rates_follow_the_optimality_condition(shipped):
    """Log rates are proportional to size within a source: rows of one size share a rate, larger
    ones are taken more often where the target exceeds the source, and less where it falls short.
    Dealing every document the same rate, target over size of the source, fails this."""
    draw = random.Random(2)
    sizes = [5, 20, 60]
    rows = [(i, "w " * draw.choice(sizes), s) for i, s in enumerate(["big", "small"] * 6000)] + [(20_000 + i, "w " * 20, "small") for i in range(3000)]
    got = mixed(shipped.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)).collect()
    check(got, rows)
    for source in ("big", "small"):
        mean = {n: sum(r.copies for r in got if (r.source, r.size) == (source, n)) / sum((r.source, r.size) == (source, n) for r in got) for n in sizes}
        per_word = [math.log(mean[n]) / n for n in sizes]
        assert max(per_word) - min(per_word) < 0.15 * abs(per_word[2]) + 0.002 and abs(mean[60] - mean[5]) > 0.1


def test_one_id_and_text_in_two_sources(shipped):
    """Each source reaches its own target, and a rerun takes the same rows."""
    rows = [(i % 10, "word " * (1 + i % 10), s) for s in ("a", "b") for i in range(20)]
    docs = shipped.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    target = {r.source: r.target for r in mixed(docs).collect()}

    def taken(frame):
        got = mixed_rows(frame)
        assert got.columns == docs.columns
        return sorted(tuple(r) for r in got.collect())

    first = taken(docs)
    for s in ("a", "b"):
        assert abs(sum(len(r[1].split()) for r in first if r[2] == s) - target[s]) <= 10 + 1
    assert taken(docs.repartition(7)) == first
    assert max(first.count(r) for r in first) <= 3 * 2


def test_rows_equal_the_report(shipped, odd_rows):
    names = ["a", "b", None]
    docs = shipped.createDataFrame([(i, t, names[k % 3], "x", 1) for k, (i, t) in enumerate(odd_rows)] + [(99, "same words here", "hot", "y", 2)] * 400, SCHEMA)
    report = Counter()
    for r in mixed(docs).collect():
        report[r.doc_id, r.source, r.size] += r.copies
    rows = Counter((r.doc_id, r.source, len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))) for r in mixed_rows(docs).collect())
    assert rows == +report


def test_no_rows_and_no_words(shipped):
    assert mixed(shipped.createDataFrame([], SCHEMA)).count() == 0
    for r in mixed(shipped.createDataFrame([(1, None, "a", "x", 1), (2, " ", None, "x", 1)], SCHEMA)).collect():
        assert (r.size, r.target, r.taken) == (0, 0.0, 0)
