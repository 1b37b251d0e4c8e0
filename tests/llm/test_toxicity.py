import random
import zlib

import numpy as np
import pytest
from llm_rows import SF_DIR, odd_rows, prose, shipped  # noqa: F401

from sealdex.llm import toxicity
from sealdex.llm.queries import QUERIES
from sealdex.llm.toxicity import HELD_OUT, ORDERS, Constant, Model, fit, scored, train

STEMS = ("zorgel", "quib", "véjut", "грубо")


def _buckets(text):
    """The plain statement: distinct n-grams of code points, hashed as the operator hashes their bytes."""
    text, out = (text or "").lower(), set()
    for n in ORDERS:
        for i in range(len(text) - n + 1):
            gram = np.frombuffer(text[i : i + n].encode(), np.uint8)
            prefix = toxicity.prefix_hashes(gram)
            out.add(int(toxicity.span_hashes(prefix, np.array([0]), np.array([len(gram)]))[0] >> np.uint64(44)))
    return out


def _held(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 5 == HELD_OUT


@pytest.fixture(scope="module")
def labelled():
    draw = random.Random(3)
    docs, labels = [], []
    for i in range(500):
        words, toxic = prose(draw, draw.randrange(5, 200)).split(), int(draw.random() < 0.3)
        for _ in range(draw.randrange(1, 4) * toxic):
            words.insert(draw.randrange(len(words) + 1), draw.choice(STEMS) + draw.choice(["a", "en", "o", "um"]))
        docs.append((i, " ".join(words)))
        labels.append((i, 1 - toxic if _held(i) else toxic, toxic))
    return docs, labels


def _frames(spark, docs, labels):
    names = "doc_id long, text string, toxic string, label string, bucket string, id string"
    return spark.createDataFrame([(*d, "x", "y", "z", "w") for d in docs], names), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_planted_stems_are_learnt_and_held_out_labels_are_not(shipped, labelled):
    """The labels of the held-out fold are turned round: learning from them would show."""
    docs, labels = labelled
    frame, marks = _frames(shipped, docs, [x[:2] for x in labels])
    got = {r.doc_id: r for r in scored(frame, train(frame, marks)).collect()}
    truth = {i: t for i, _, t in labels}
    assert {i: r.held_out for i, r in got.items()} == {i: _held(i) for i in truth}
    wrong = [i for i, r in got.items() if r.held_out and r.predicted != truth[i]]
    assert len(wrong) <= 3
    only = scored(frame, train(frame, marks.where("crc32(cast(cast(doc_id AS string) AS binary)) % 5 != 0")))
    assert sorted(only.collect()) == sorted(got.values())


def test_scores_equal_the_plain_statement(shipped, labelled, odd_rows):
    docs, labels = labelled
    model = train(*_frames(shipped, docs, [(i, t) for i, _, t in labels]))
    assert isinstance(model, Model)
    added = dict(zip(model.buckets.tolist(), model.added.tolist()))
    rows = [(i, t) for i, t in odd_rows if t is None or len(t) < 50_000] + [(90, docs[0][1] + " quibum"), (91, "ab"), (92, "QUIB")]
    got = scored(shipped.createDataFrame(rows, "doc_id long, text string"), model).collect()
    assert len(got) == len(rows)
    expected = sorted((str(i), 1 / (1 + np.exp(-model.bias - sum(added.get(b, 0.0) for b in _buckets(t))))) for i, t in rows)
    for (i, e), r in zip(expected, sorted(got, key=lambda r: (str(r.doc_id), r.score))):
        assert str(r.doc_id) == i and r.score == pytest.approx(e, abs=1e-9) and r.predicted == int(r.score >= 0.5)


def test_a_text_longer_than_a_piece(shipped, monkeypatch):
    """Pieces of any size give the features of the whole text, whatever character the cut falls into."""
    text = ("é中🙂ab zorgel " * 40).lower()
    place = np.arange(1 << toxicity.BUCKET_BITS)
    data = np.frombuffer(text.encode(), np.uint8)
    whole = _buckets(text)
    for size in (7, 64, 1 << 20):
        monkeypatch.setattr(toxicity, "SLICE_BYTES", size)
        assert set(toxicity._marked(data, np.array([0, len(data)]), place, len(place))[1].tolist()) == whole


def test_very_long_text(shipped):
    model = Model(np.array(sorted(_buckets("zorgel"))), np.ones(len(_buckets("zorgel"))), -2.0)
    rows = [(1, "ab " * 3_000_000 + "zorgel"), (2, "ab " * 3_000_000)]
    got = {r.doc_id: r.predicted for r in scored(shipped.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    assert got == {1: 1, 2: 0}


def test_ratios_scale_the_features():
    """One step of the fit moves a weight by its ratio's sign; a feature of ratio 0 never moves."""
    rows, features = np.array([0, 0, 1, 1, 2, 3]), np.array([0, 2, 0, 1, 1, 2])
    weights, _ = fit(rows, features, np.array([1.0, 1.0, 0.0, 0.0]), np.array([1.2, -0.5, 0.0]))
    assert weights[0] > 0 and weights[1] > 0 and weights[2] == 0


@pytest.mark.parametrize("labels, value", [([], 0.5), ([(1, 1), (2, 1)], 0.75), ([(1, 0), (2, None), (None, 1), (3, 1), (3, 0)], 1 / 3)])
def test_nothing_to_tell_apart(shipped, labels, value):
    docs, marks = _frames(shipped, [(1, "abc def"), (2, None), (3, "xyz")], labels)
    model = train(docs, marks)
    assert isinstance(model, Constant) and model.value == pytest.approx(value)
    assert [r.score for r in scored(docs, model).collect()] == [pytest.approx(value)] * 3
    assert scored(docs.limit(0), model).count() == 0


def test_texts_without_features(shipped):
    docs, marks = _frames(shipped, [(1, ""), (2, None), (3, "x"), (4, "y")], [(1, 0), (2, 1), (3, 0), (4, 1)])
    assert train(docs, marks).value == pytest.approx(2 / 3) or isinstance(train(docs, marks), Constant)


def test_query(shipped):
    got = QUERIES["op12_toxicity"](shipped, SF_DIR).collect()
    docs = shipped.read.parquet(f"{SF_DIR}/documents.parquet")
    assert sorted(r.doc_id for r in got) == sorted(r.doc_id for r in docs.collect())
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) and r.held_out == _held(r.doc_id) for r in got)


def test_held_out_labels_of_the_larger_table(shipped):
    """Ranks held-out labels of sf0.01 far better than chance; its labels are noisy (README)."""
    larger = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.toxic for r in shipped.read.parquet(f"{larger}/labels.parquet").collect()}
    got = [(r.score, labels[r.doc_id]) for r in QUERIES["op12_toxicity"](shipped, larger).collect() if r.held_out and r.doc_id in labels]
    toxic, clean = [s for s, y in got if y], [s for s, y in got if not y]
    above = sum((a > b) + (a == b) / 2 for a in toxic for b in clean) / (len(toxic) * len(clean))
    assert above >= 0.85 and sum(s >= 0.5 for s in clean) <= 0.05 * len(clean)
