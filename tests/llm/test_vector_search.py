import math

import numpy as np
import pytest
from compare import compare, connect
from llm_rows import SF_DIR, shipped  # noqa: F401
from pyspark.sql import functions as F

from sealdex.llm import vector_search as vs
from sealdex.llm.queries import ORACLES, QUERIES

SCHEMA = "vec_id long, embedding array<float>, score string"


def brute(rows, wanted, k=10):
    sound = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for at, (q, own) in enumerate(sound):
        if wanted(q):
            scores = sorted((-sum(a * b for a, b in zip(own, v, strict=True)), i) for other, (i, v) in enumerate(sound) if other != at and len(v) == len(own))
            out += [(q, rank, i, -s) for rank, (s, i) in enumerate(scores[:k], 1)]
    return sorted(out)


def run(spark, rows, every=3, k=10):
    df = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)
    return sorted(tuple(r) for r in vs.exact_top_k(df, F.col("vec_id") % every == 0, k).collect())


@pytest.mark.parametrize("size", [1.0, 1e5])
def test_odd_rows(shipped, size):
    draw = np.random.default_rng(4)
    rows = [(i, [float(np.float32(x * size)) for x in draw.normal(size=5)]) for i in range(60)]
    rows += [(3, None), (60, [1.0, None, 1.0, 1.0, 1.0]), (63, [float("nan")] * 5), (66, [float("inf")] + [0.0] * 4), (None, rows[0][1])]
    rows += [rows[5], rows[6], (99, [1.0, 2.0]), (102, []), (105, [0.0] * 5), (106, rows[9][1]), (107, rows[9][1])]
    assert run(shipped, rows) == brute(rows, lambda i: i % 3 == 0)


def test_blocks_of_queries(shipped, monkeypatch):
    monkeypatch.setattr(vs, "QUERY_BLOCK", 7)
    draw = np.random.default_rng(5)
    rows = [(i, [float(x) for x in draw.integers(-2, 3, 4)]) for i in range(90)]
    assert run(shipped, rows) == brute(rows, lambda i: i % 3 == 0)


def test_query(shipped):
    rows = [(r.vec_id, r.embedding) for r in shipped.read.parquet(f"{SF_DIR}/embeddings.parquet").collect()]
    assert sorted(tuple(r) for r in QUERIES["op9_vector_search"](shipped, SF_DIR).collect()) == brute(rows, lambda i: i % 100 == 0)


def test_bounds_spare_candidates():
    draw = np.random.default_rng(6)
    centres = draw.normal(0, 4000, (40, 8))
    vectors = (centres[draw.integers(0, 40, 4000)] + draw.normal(0, 60, (4000, 8))).astype(np.int64)
    vectors = (vectors / np.linalg.norm(vectors, axis=1)[:, None] * 8000).astype(np.int64)
    near = vs._distances(vectors.astype(float), vs.choose_pivots(vectors[:400].astype(float)))
    block = vs._Block(np.arange(20), np.arange(20), vectors[:20], near[:20], 10)
    block.search(np.arange(4000), np.arange(4000), vectors, near)
    assert block.evaluated < 0.5 * 20 * 4000


def test_no_rows(shipped):
    assert run(shipped, []) == run(shipped, [(1, [1.0])]) == run(shipped, [(3, [1.0])]) == []


def test_rows_of_one_id_stand_for_themselves(shipped):
    """Only a query's own row is no candidate; repeated ids are candidates and queries each by itself."""
    rows = [(3, [1.0, 0.0]), (3, [0.5, 0.0]), (1, [1.0, 1.0]), (1, [0.9, 0.0]), (1, [1.0, 1.0])]
    got = run(shipped, rows)
    assert got == brute(rows, lambda i: i % 3 == 0) and len(got) == 8
    assert [i for _, rank, i, _ in got if rank <= 3].count(1) == 5


def test_sql(shipped):
    matches, _, _, difference = compare(shipped, connect(SF_DIR), SF_DIR, QUERIES["op9_vector_search"], ORACLES["op9_vector_search"])
    assert matches, difference
