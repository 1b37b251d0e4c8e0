import re
import zlib
from collections import Counter

import corpus_pipeline
import numpy as np
from llm_rows import SF_DIR, odd_rows, shipped  # noqa: F401
from test_near_duplicates import brute as brute_groups
from tokenizers import Tokenizer

from sealdex.llm.queries import VOCABULARY


def brute_stage(name, before, after, labels, items):
    """What each stage must do to the documents it was given."""
    ids = [r["doc_id"] for r in before]
    kept = [r["doc_id"] for r in after]
    whole = {(r["doc_id"], r["text"], r["source"], r["lang"], r["n_chars"]) for r in before}
    assert {(r["doc_id"], r["text"], r["source"], r["lang"], r["n_chars"]) for r in after} <= whole
    if name != "mixing":
        assert len(set(kept)) == len(kept)
    if name == "quality":
        good = [i for i in ids if labels.get(i) == 1]
        bad = [i for i in ids if labels.get(i) == 0]
        assert len(set(good) & set(kept)) >= 0.97 * len(good) and len(set(bad) & set(kept)) <= 0.1 * len(bad)
    if name == "near_duplicates":
        root = brute_groups([(r["doc_id"], r["text"]) for r in before])
        assert set(kept) == {i for i, (_, smallest) in root.items() if i == smallest}
    if name == "decontamination":
        holds, near = set(), set()
        for r in before:
            words = r["text"].split()
            text, folded = " ".join(words), {tuple(w.lower().strip(".,") for w in words[k : k + 4]) for k in range(len(words))}
            for item in items:
                if len(item.split()) >= 5 and " ".join(item.split()) in text:
                    holds.add(r["doc_id"])
                own = [w.lower().strip(".,") for w in item.split()]
                if any(tuple(own[k : k + 4]) in folded for k in range(len(own) - 3)):
                    near.add(r["doc_id"])
        assert not holds & set(kept) and set(ids) - near <= set(kept)
    if name == "mixing":
        names = sorted({r["source"] for r in before}, key=lambda s: (s is None, s or ""))
        size = {s: sum(len(words_of(r["text"])) for r in before if r["source"] == s) for s in names}
        target = water_levels(names, size)
        for s in names:
            taken = sum(len(words_of(r["text"])) for r in after if r["source"] == s)
            assert abs(taken - target[s]) <= max(len(words_of(r["text"])) for r in before if r["source"] == s) + 1
        assert max(Counter(kept).values()) <= 3


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def water_levels(names, size):
    """Shares by weight 1, 2, 3, none above three times its source."""
    weight, full = {s: (1, 2, 3)[i % 3] for i, s in enumerate(names)}, {}
    while True:
        left = [s for s in names if s not in full]
        rest = sum(size.values()) - sum(full.values())
        share = {s: rest * weight[s] / sum(weight[x] for x in left) for s in left}
        over = [s for s in left if share[s] > 3 * size[s]]
        if not over:
            return full | share
        full |= {s: 3 * size[s] for s in over}


def test_stages(shipped):
    docs = shipped.read.parquet(f"{SF_DIR}/documents.parquet")
    labels = {r.doc_id: r.quality for r in shipped.read.parquet(f"{SF_DIR}/labels.parquet").collect()}
    items = [r.text for r in shipped.read.parquet(f"{SF_DIR}/benchmark.parquet").collect() if r.text]
    rows = [r.asDict() for r in docs.collect()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(shipped, docs, SF_DIR)
        assert set(docs.columns) == set(rows[0])
        after = [r.asDict() for r in docs.collect()]
        brute_stage(name, rows, after, labels, items)
        rows, docs = after, shipped.createDataFrame(after, docs.schema)
    digest = sorted(corpus_pipeline.STAGES[-1][1](shipped, docs, SF_DIR).collect(), key=lambda r: r.start)
    library, start = Tokenizer.from_file(VOCABULARY), 0
    for row, got in zip(sorted(rows, key=lambda r: r["doc_id"]), digest, strict=True):
        ids = np.array([*library.encode(row["text"], add_special_tokens=False).ids, 1], "<u4")
        assert (got.doc_id, got.start, got.n_tokens, got.ids_crc32) == (row["doc_id"], start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_odd_rows_and_extra_columns(shipped, odd_rows):
    rows = [(i, t, "en", "s", 1, "x", 2) for i, t in odd_rows]
    docs = shipped.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, draw string, copies int")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(shipped, docs, SF_DIR)
        assert out.columns == docs.columns
        out.collect()
    near = corpus_pipeline.near_duplicates(shipped, docs, SF_DIR).collect()
    kept = [r.doc_id for r in near]
    assert kept.count(5) == 1 and 6 not in kept and 7 not in kept and 8 not in kept and kept.count(None) == 1 and {0, 1, 2, 3, 4, 9, 10, 11, 12, 13, 14} <= set(kept)
    assert corpus_pipeline.token_files(shipped, docs, SF_DIR).count() == len(rows)


def test_empty_documents(shipped):
    docs = shipped.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(shipped, docs, SF_DIR).count() == 0
