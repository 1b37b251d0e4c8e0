import hashlib
import math
import random
from fractions import Fraction

import numpy as np
import pytest
from compare import compare, connect
from llm_rows import SF_DIR, shipped  # noqa: F401

from sealdex.llm import clustering
from sealdex.llm.clustering import Pivots, clusters, nearest
from sealdex.llm.queries import ORACLES, QUERIES


def brute(rows):
    """Lloyd's rounds on whole numbers, every distance computed."""
    kept = []
    for i, v in rows:
        if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v):
            kept.append((i, [math.floor(Fraction(x) * 64) for x in v]))
    named = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)
    cents = [v for _, v in named[:16]]
    if not cents:
        return []

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c)), k) for k, c in enumerate(cents)) for _, v in kept]

    for _ in range(3):
        at, new = assign(), []
        for k, c in enumerate(cents):
            own = [v for (_, v), (_, n) in zip(kept, at) if n == k]
            new.append([sum(col) // len(own) for col in zip(*own)] if own else c)
        cents = new
    at = assign()
    inertia = sum(d for d, _ in at)
    fits = lambda x: x if x < 1 << 63 else None
    some_lost = any(d >= 1 << 63 for d, _ in at)
    out = []
    for (i, _), (d, k) in zip(kept, at):
        own = [e for e, n in at if n == k]
        lost = any(e >= 1 << 63 for e in own)
        name = hashlib.sha256(",".join(map(str, cents[k])).encode()).hexdigest()
        out.append((i, k, fits(d), None if lost else fits(sum(own)), None if some_lost else fits(inertia), name))
    return out


def check(spark, rows, kind="float"):
    names = f"label int, vec_id long, embedding array<{kind}>, near string, cluster string, pos int"
    frame = spark.createDataFrame([(1, i, v, "x", "y", 2) for i, v in rows], names)
    got = [tuple(r) for r in clusters(frame).collect()]
    rows = [(i, None if v is None else [None if x is None else float(np.float32(x)) if kind == "float" else x for x in v]) for i, v in rows]
    assert sorted(got, key=repr) == sorted(brute(rows), key=repr)
    return got


def vectors(n, spread, seed=1, groups=20):
    draw = random.Random(seed)
    middle = [[draw.gauss(0, 1) for _ in range(64)] for _ in range(groups)]
    return [[x + draw.gauss(0, spread) for x in draw.choice(middle)] for _ in range(n)]


def test_grouped_vectors(shipped):
    check(shipped, list(enumerate(vectors(400, 0.1))))


def test_odd_rows(shipped):
    rows = list(enumerate(vectors(60, 0.3)))
    rows += [(100, None), (101, [1.0] * 63), (102, []), (103, [None] + [1.0] * 63), (104, [math.nan] + [0.0] * 63), (105, [math.inf] + [0.0] * 63), (106, [1.0] * 65)]
    rows += [(7, rows[7][1]), (7, rows[8][1]), (None, rows[9][1]), (None, [0.0] * 64), (107, [-0.0] * 64), (108, [1e-30] * 64), (109, [-1e-30] * 64)]
    check(shipped, rows)


def test_ties_and_equal_vectors(shipped):
    rows = [(i, [float((i >> (j % 4)) & 1) for j in range(64)]) for i in range(64)] + [(100 + i, [0.5] * 64) for i in range(30)]
    got = check(shipped, rows)
    assert len({r[1] for r in got}) < 16
    check(shipped, [(i, [2.0] * 64) for i in range(40)])


def test_few_and_no_rows(shipped):
    check(shipped, list(enumerate(vectors(5, 0.3))))
    check(shipped, [(3, [1.0] * 64)])
    assert check(shipped, []) == [] and check(shipped, [(1, None), (None, [1.0] * 64)]) == []


@pytest.mark.parametrize("size", [1e4, 3e6, 1e12, 1e30])
def test_large_components(shipped, size):
    """Beyond 53 bits, beyond 64 bits, and distances that no longer fit."""
    check(shipped, [(i, [x * (size if i % 3 == 0 else 1.0) for x in v]) for i, v in enumerate(vectors(50, 0.2))], "double")


def test_components_whose_scaled_value_overflows(shipped):
    check(shipped, [(i, [x * (1e307 if i == 5 else 1.0) for x in v]) for i, v in enumerate(vectors(30, 0.2))], "double")


def test_bounds_are_below_and_spare_distances():
    rows = np.floor(np.array(vectors(3000, 0.05)) * 64)
    cents = rows[::190].astype(int).tolist()
    pivots = Pivots([list(map(int, r)) for r in rows[1:200]])
    low = pivots.bounds(pivots.distances(rows), np.array(cents, float))
    true = np.sqrt(((rows[:, None] - np.array(cents)[None]) ** 2).sum(2))
    assert (low <= true).all() and low.max() > 0
    cluster, distance, taken = nearest(rows, pivots.distances(rows), cents, pivots)
    assert (cluster == (true**2).round().argmin(1)).all() and (distance == (true**2).round().min(1)).all()
    assert taken < 0.7 * true.size


def test_query(shipped):
    rows = [(r.vec_id, r.embedding) for r in shipped.read.parquet(f"{SF_DIR}/embeddings.parquet").collect()]
    assert sorted(tuple(r) for r in QUERIES["op13_clusters"](shipped, SF_DIR).collect()) == sorted(brute(rows))


def test_sql(shipped):
    matches, _, _, difference = compare(shipped, connect(SF_DIR), SF_DIR, QUERIES["op13_clusters"], ORACLES["op13_clusters"])
    assert matches, difference
