import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from compare import compare, connect
from llm_rows import SF_DIR, odd_rows, prose, shipped  # noqa: F401

from sealdex.llm import repeats
from sealdex.llm.queries import ORACLES, QUERIES

SCHEMA = "doc_id long, text string, n_bytes string, begin int"


def brute(rows, length=200):
    bodies = [(i, (t or "").encode()) for i, t in rows]
    seen = {}
    for _, body in bodies:
        for k in range(len(body) - length + 1):
            piece = body[k : k + length]
            seen[piece] = seen.get(piece, 0) + 1
    out = []
    for i, body in bodies:
        gone = np.zeros(len(body) + 1, np.int32)
        for k in range(len(body) - length + 1):
            if seen[body[k : k + length]] > 1:
                gone[k] += 1
                gone[k + length] -= 1
        mask = np.cumsum(gone)[: len(body)] > 0
        kept = bytes(np.frombuffer(body, np.uint8)[~mask])
        out.append((i, len(body), int(mask.sum()), int((np.diff(np.r_[0, mask.astype(int)]) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def check(spark, rows, **options):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    got = sorted(map(tuple, repeats.without_repeats(df, **options).collect()), key=str)
    assert got == sorted(brute(rows, options.get("length", 200)), key=str)


def test_odd_rows(shipped, odd_rows):
    check(shipped, odd_rows)


def mosaic(seed, docs=60):
    """Texts of shared and own passages that overlap, repeat inside a text, or are nearly as long as needed."""
    draw = random.Random(seed)
    shared = [prose(draw, draw.choice([20, 30, 31, 32, 33, 60, 200])) for _ in range(12)]
    rows = []
    for i in range(docs):
        parts = []
        for _ in range(draw.randrange(6)):
            passage = draw.choice(shared)
            cut = draw.randrange(len(passage))
            parts.append(draw.choice([passage, passage[cut:], passage[:cut], prose(draw, 15), "ab" * 150, "é" * 120]))
        rows.append((i, " ".join(parts)))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_mosaics(shipped, seed):
    check(shipped, mosaic(seed))


def test_one_anchor_in_many_shards(shipped, monkeypatch):
    monkeypatch.setattr(repeats, "TOGETHER", 5)
    monkeypatch.setattr(repeats, "SHARD_BYTES", 3000)
    monkeypatch.setattr(repeats, "MERGED_WINDOWS", 2000)
    draw = random.Random(9)
    line = prose(draw, 40)
    rows = [(i, prose(draw, 8) + draw.choice([" so ", " as it ", "."]) + line + draw.choice([" and", ". The", ""]) + prose(draw, 8)) for i in range(80)]
    check(shipped, rows + mosaic(4, 20))


def test_other_lengths(shipped):
    check(shipped, mosaic(3, 30), length=50, piece=16)


def test_suffix_order_and_common_prefixes():
    draw = np.random.default_rng(3)
    for n in (1, 2, 9, 60, 300):
        data = draw.integers(97, 99, n).astype(np.uint8)
        body = bytes(data)
        order = repeats.suffix_order(data, 10**6)
        assert order.tolist() == sorted(range(n), key=lambda i: body[i:])
        shared = repeats.common_prefixes(data, order, np.array([0, n]), 10**3)
        for a, b in zip(order, order[1:], strict=False):
            k = 0
            while k < n - max(a, b) and body[a + k] == body[b + k]:
                k += 1
            assert shared[b] == k


@pytest.mark.parametrize("seed", range(6))
def test_families_that_differ_beyond_the_sorted_depth(seed):
    """Contexts that agree in 257 to 330 bytes: ties of the order, which must not lend their height to other suffixes."""
    draw, length = random.Random(seed), 200
    letters = lambda n: bytes(draw.choice(b"abc") for _ in range(n))
    bodies = []
    for _ in range(10):
        passage = letters(draw.randrange(257, 331))
        bodies += [letters(draw.randrange(40)) + passage + letters(draw.randrange(20, 60)) for _ in range(4)]
    bodies += [letters(400) for _ in range(20)]
    draw.shuffle(bodies)
    bounds = np.r_[0, np.cumsum([len(b) for b in bodies])]
    windows = {(i, k): b[k : k + length] for i, b in enumerate(bodies) for k in range(len(b) - length + 1)}
    counts = Counter(windows.values())
    want = sorted(bounds[i] + k for (i, k), w in windows.items() if counts[w] > 1)
    assert np.flatnonzero(repeats.repeated_windows(np.frombuffer(b"".join(bodies), np.uint8), bounds, length)).tolist() == want


def test_query(shipped):
    rows = [(r.doc_id, r.text) for r in shipped.read.parquet(f"{SF_DIR}/documents.parquet").collect()]
    assert sorted(map(tuple, QUERIES["op8_repeats"](shipped, SF_DIR).collect())) == sorted(brute(rows))


def test_no_rows(shipped):
    assert repeats.without_repeats(shipped.createDataFrame([], SCHEMA)).count() == 0


def test_sql(shipped):
    matches, _, _, difference = compare(shipped, connect(SF_DIR), SF_DIR, QUERIES["op8_repeats"], ORACLES["op8_repeats"])
    assert matches, difference
