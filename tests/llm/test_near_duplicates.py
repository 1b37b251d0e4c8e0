import random
import re
from itertools import combinations

import numpy as np
from compare import compare, connect
from llm_rows import SF_DIR, odd_rows, shipped  # noqa: F401

from sealdex.llm import near_duplicates as nd
from sealdex.llm.queries import ORACLES, QUERIES

SCHEMA = "doc_id long, text string"


def brute(rows):
    sets = {}
    for i, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.setdefault(i, []).append(frozenset(tuple(words[k : k + 5]) for k in range(max(len(words) - 4, 1))) if words else frozenset())
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in combinations(sorted(sets), 2):
        for x in sets[a]:
            for y in sets[b]:
                if x and y and 100 * len(x & y) >= 85 * len(x | y):
                    p, q = sorted((find(a), find(b)))
                    root[q] = p
    return {i: ({len(s) for s in sets[i]}, find(i)) for i in sets}


def check(df, rows):
    want = brute([r for r in rows if r[0] is not None])
    got = df.collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
            continue
        sizes, root = want[r.doc_id]
        assert r.n_shingles in sizes and r.component_id == root and r.kept == (root == r.doc_id), r


def test_odd_rows(shipped, odd_rows):
    docs = shipped.createDataFrame([(i, t, "x", 1) for i, t in odd_rows], SCHEMA + ", kept string, component_id int")
    check(nd.near_duplicate_groups(docs), odd_rows)


def test_chains_and_families(shipped):
    """Families whose far members are linked only through others, and one that links with nothing."""
    draw, rows = random.Random(3), []
    for family in range(4):
        words = [f"w{draw.randrange(10**6)}" for _ in range(200)]
        for _ in range(25):
            rows.append((len(rows), " ".join(words)))
            for _ in range(draw.randrange(1, 4 if family else 9)):
                words[draw.randrange(200)] = f"w{draw.randrange(10**6)}"
    draw.shuffle(rows)
    check(nd.near_duplicate_groups(shipped.createDataFrame(rows, SCHEMA)), rows)


def test_query_equals_brute_force(shipped):
    rows = [(r.doc_id, r.text) for r in shipped.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect()]
    check(QUERIES["op3_near_duplicates"](shipped, SF_DIR), rows)


def test_short_texts_share_no_bucket_by_chance():
    values = np.random.default_rng(4).integers(0, 2**63, 5000, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    own = nd.registers(values, np.arange(5000))
    assert own.min() > 0 and own.max() < nd._SCALE_TOP
    for band in range(nd.REGISTERS // nd.BAND_ROWS):
        assert len(np.unique(own[:, nd.BAND_ROWS * band : nd.BAND_ROWS * (band + 1)], axis=0)) > 4990


def test_smallest_sets_that_can_link(shipped):
    """Six shingles in seven are 85.7 %: linked; five in six are not; equal short texts are one class."""
    words = [f"w{i}" for i in range(40)]
    rows = [(n, " ".join(words[:n])) for n in (1, 3, 5, 8, 9, 10, 11, 12)]
    rows += [(100 + i, f"short text {i % 40}") for i in range(80)]
    check(nd.near_duplicate_groups(shipped.createDataFrame(rows, SCHEMA)), rows)


def test_no_rows(shipped):
    assert nd.near_duplicate_groups(shipped.createDataFrame([], SCHEMA)).count() == 0


def test_registers_merge_and_follow_similarity():
    draw = np.random.default_rng(1)
    both, left, right = (draw.integers(0, 2**63, n, dtype=np.uint64) for n in (4000, 500, 500))
    a, b = np.concatenate([both, left]), np.concatenate([both, right])
    ra, rb = nd.registers(a, np.array([0])), nd.registers(b, np.array([0]))
    assert (nd.merge(ra, rb) == nd.registers(np.concatenate([a, right]), np.array([0]))).all()
    assert abs((ra == rb).mean() - 0.8) < 0.12


def test_sql(shipped):
    matches, _, _, difference = compare(shipped, connect(SF_DIR), SF_DIR, QUERIES["op3_near_duplicates"], ORACLES["op3_near_duplicates"])
    assert matches, difference
