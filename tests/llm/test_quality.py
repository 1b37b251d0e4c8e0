import zlib

import numpy as np
import pytest
from llm_rows import odd_rows, shipped  # noqa: F401

from sealdex.llm import quality
from sealdex.llm.queries import QUERIES

SF_DIR = "/root/testdata/sf0.01"


def test_held_out_documents(shipped):
    labels = {r.doc_id: r.quality for r in shipped.read.parquet(f"{SF_DIR}/labels.parquet").collect()}
    got = QUERIES["op6_quality"](shipped, SF_DIR).collect()
    right = [r.predicted == labels[r.doc_id] for r in got if r.held_out and r.doc_id in labels]
    assert len(right) > 50 and np.mean(right) > 0.95
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5)


def test_odd_rows_and_inputs_of_a_score(shipped, odd_rows):
    docs = shipped.createDataFrame([(i, t, "x") for i, t in odd_rows], "doc_id long, text string, score string")
    labels = shipped.createDataFrame([(i, i % 2) for i in range(12)] + [(3, 0), (None, 1), (5, None)], "doc_id long, quality int")
    model = quality.train(docs, labels)
    got = quality.scored(docs, model).collect()
    assert len(got) == len(odd_rows) and all(0 <= r.score <= 1 for r in got)
    scores = {r.doc_id: r.score for r in got}
    assert scores[5] == pytest.approx(scores[6], abs=1e-6) and scores[0] == pytest.approx(scores[1], abs=1e-6)


@pytest.mark.parametrize(("labels", "score"), [([], 0.5), ([(0, 1), (2, 1)], 0.75)])
def test_nothing_to_tell_apart(shipped, labels, score):
    docs = shipped.createDataFrame([(0, "a"), (1, None), (2, "c")], "doc_id long, text string")
    labels = [(i, q) for i, q in labels if zlib.crc32(str(i).encode()) % 3 != 1]
    model = quality.train(docs, shipped.createDataFrame(labels, "doc_id long, quality int"))
    want = score if not labels else (len(labels) + 1) / (len(labels) + 2)
    assert {r.score for r in quality.scored(docs, model).collect()} == {want}


def test_attention_finds_the_telling_passage():
    draw = np.random.default_rng(0)
    x, of, labels = [], [0], []
    for i in range(300):
        bag = draw.normal(0, 1, (draw.integers(1, 9), 6))
        if i % 2:
            bag[draw.integers(len(bag)), 0] = 6
        x.append(bag), of.append(of[-1] + len(bag)), labels.append(i % 2)
    x, of, labels = np.concatenate(x), np.array(of), np.array(labels)
    assert ((quality.fit(x, of, labels).score(x, of) > 0.5) == labels).mean() > 0.95


def test_no_rows(shipped):
    none = shipped.createDataFrame([], "doc_id long, text string")
    assert quality.scored(none, quality.train(none, shipped.createDataFrame([], "doc_id long, quality int"))).count() == 0
