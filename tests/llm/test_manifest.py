import hashlib
import zlib
from collections import defaultdict

import pytest
from compare import compare, connect
from llm_rows import SF_DIR, odd_rows, shipped  # noqa: F401
from pyspark.sql import functions as F

from sealdex.llm.manifest import backward, digest, folded, forward, levels_of, manifest, without_line_ends
from sealdex.llm.queries import ORACLES, QUERIES

SCHEMA = "doc_id long, text string, source string, lang string, n_chars long"
MORE = "tree string, pos int, digest string, block int, epoch string"


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(doc_id, text, source, lang, n_chars):
    return H(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)])


def tree(nodes):
    """Root, and for each node its list of (before, behind) siblings, level by level."""
    paths, at, level = [[] for _ in nodes], list(range(len(nodes))), list(nodes)
    while len(level) > 1:
        runs = [level[i : i + 3] for i in range(0, len(level), 3)]
        for k, place in enumerate(at):
            run = runs[place // 3]
            paths[k].append((run[: place % 3], run[place % 3 + 1 :]))
        at, level = [p // 3 for p in at], [H(*r) for r in runs]
    return level[0], paths


def brute(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[r[2]].append((r[0] is not None, r[0] or 0, leaf(*r), r))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: tree([x[2] for x in sorted(groups[s], key=lambda x: x[:3])]) for s in names}
    root, tops = tree([trees[s][0] for s in names])
    out = []
    for s, top in zip(names, tops):
        for (_, _, own, r), path in zip(sorted(groups[s], key=lambda x: x[:3]), trees[s][1]):
            path = path + top
            start = own
            if r[0] is not None and r[1] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0:
                start = leaf(r[0], r[1].replace("\n", ""), *r[2:])
            now = start
            for before, behind in path:
                now = H(*before, now, *behind)
            out.append((r[0], own, trees[s][0], root, H(*[d for p in path for side in p for d in side]), now, now == root))
    return out


def rows_of(spark, rows, stride=1):
    frame = spark.createDataFrame([(*r, "a", 1, "b", 2, "c") for r in rows], f"{SCHEMA}, {MORE}")
    return manifest(frame, without_line_ends(frame), stride)


def check(spark, rows, stride=1):
    got = rows_of(spark, rows, stride)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof", "proof_sha256", "folded_root", "verified"]
    got = got.collect()
    assert sorted((tuple(r[:4]) + tuple(r[5:]) for r in got), key=repr) == sorted(brute(rows), key=repr)
    for r in got:
        assert folded(r.leaf, r.proof) == r.root
        assert H(r.proof.replace(",", "").replace(";", "")) == r.proof_sha256
    return got


def docs(n, sources, text="a line\nof {}\n"):
    return [(i, text.format(i), sources[i * i % len(sources)], ["en", None][i % 2], i) for i in range(n)]


@pytest.mark.parametrize("n, stride", [(1, 1), (3, 1), (10, 1), (28, 1), (4, 2), (9, 2), (82, 2)])
def test_one_source_of_every_shape(shipped, n, stride):
    check(shipped, docs(n, ["s"]), stride)


def test_many_sources_one_of_them_hot(shipped):
    names = ["hot"] * 40 + [None, "", "é", "z", "Z", "\U0001f642", "￿", *[f"s{i}" for i in range(30)]]
    rows = docs(400, names)
    assert [r.verified for r in check(shipped, rows, 2)].count(False) > 50
    check(shipped, rows, 6)


def test_odd_rows(shipped, odd_rows):
    rows = [(i, t, ["a", None][k % 2], None if k % 3 else "en", None if k % 4 else k) for k, (i, t) in enumerate(odd_rows)]
    check(shipped, rows + rows[:5] + [(None, None, None, None, None)] * 2 + [(20, "\n\n", "a", "x", 0), (21, "\r\n", "b", "", -5)])


def test_repeated_rows_are_dealt_over_ranges(shipped):
    rows = [(7, "same\n", "s", "en", 5)] * 300 + docs(50, ["s", "t"])
    check(shipped, rows, 2)


def test_a_very_long_text(shipped):
    check(shipped, [(1, "long\n" * 4_000_000, "s", "en", 1), (2, "short", "s", "en", 1)])


def test_no_rows(shipped):
    assert rows_of(shipped, []).collect() == []


def test_any_partitioning_gives_the_same(shipped):
    frame = shipped.createDataFrame(docs(500, ["a", "b", "a"]), SCHEMA)
    assert sorted(manifest(frame.repartition(13)).collect()) == sorted(manifest(frame.coalesce(1)).collect())
    assert all(r.verified for r in manifest(frame).collect())


def test_a_changed_field_breaks_the_proof(shipped):
    frame = shipped.createDataFrame(docs(30, ["a", "b"]), SCHEMA)
    changed = F.when(F.col("doc_id") == 7, F.lit("other"))
    assert [r.doc_id for r in manifest(frame, changed).collect() if not r.verified] == [7]


def test_messages_arrive_in_the_order_of_labels():
    for n in (1, 2, 3, 5, 9, 11, 27):
        nodes = [digest(str(i)) for i in range(n)]
        levels = levels_of(n, 6)
        top, children = forward(nodes, levels)
        assert list(children) == sorted(children) and top == tree(nodes)[0]
        assert all(folded(d, p) == top for d, p in zip(nodes, backward(children, levels, "")))
    # A block of one node in a larger tree is digested at every level.
    assert forward(["ab"], 2)[0] == digest(digest("ab"))


def test_query(shipped):
    rows = [tuple(r) for r in shipped.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text", "source", "lang", "n_chars").collect()]
    got = QUERIES["op11_manifest"](shipped, SF_DIR).collect()
    assert sorted(map(tuple, got)) == sorted(brute(rows))


def test_sql(shipped):
    matches, _, _, difference = compare(shipped, connect(SF_DIR), SF_DIR, QUERIES["op11_manifest"], ORACLES["op11_manifest"])
    assert matches, difference
