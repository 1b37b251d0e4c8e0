"""Commits, merged runs, sketches, lost blocks, and streams that end."""

import json
import os
import random

import pytest
from conftest import SECRETS, make_people
from pyspark.sql import functions as F
from test_index import _inverted, _random_docs, new_store, postings_of, rows_of

from sealdex.functions import crypto
from sealdex.operators import sketch
from sealdex.operators.index import SealedIndex
from sealdex.operators.index_store import Run, merged_number
from sealdex.operators.ledger import KEPT_COMMITS, Ledger, Piece
from sealdex.plans.people import PEOPLE, people_rules
from sealdex.plans.vault import Vault
from sealdex.session import scratch_path
from sealdex.sources.records import record_lines
from sealdex.streaming.ingest import END_LINE, NUMBERED_ORDER, ingest_stream, run_to_end, stream_file_lines


def test_commits_show_all_or_nothing(spark):
    root = scratch_path(spark, "ledger")
    writer, reader = Ledger(spark, root), Ledger(spark, root)
    writer.put(Piece("a", 1, 1))
    with reader.pinned():
        with writer.together():
            writer.put(Piece("a", 1, (1 << 40) | 1, {"k": [1]}))
            writer.note("x", {"y": 2})
            assert reader.pieces("a") == [Piece("a", 1, 1)] and writer.fact("x") == {"y": 2}
        assert reader.pieces("a") == [Piece("a", 1, 1)] and reader.fact("x") is None
    assert reader.pieces("a") == [Piece("a", 1, (1 << 40) | 1, {"k": [1]})]
    with pytest.raises(KeyError), writer.together():
        writer.drop("a", [1])
        raise KeyError
    assert len(writer.pieces("a")) == len(reader.pieces("a")) == 1
    for i in range(KEPT_COMMITS + 5):
        writer.note("i", i)
    assert reader.fact("i") == KEPT_COMMITS + 4 and len(writer._versions()) == KEPT_COMMITS


def test_two_writers_do_not_overwrite_each_other(spark, monkeypatch):
    root = scratch_path(spark, "ledger")
    one, two = Ledger(spark, root), Ledger(spark, root)
    one.note("a", 1)
    held = two._versions()
    one.note("a", 2)
    monkeypatch.setattr(two, "_versions", lambda: held)
    with pytest.raises(RuntimeError, match="another writer"):
        two.note("a", 3)
    assert one.fact("a") == 2


def test_full_levels_are_merged_at_once(spark, monkeypatch):
    """Fan-out 2: the fourth batch, the run of level 0 before it and that of level 1 become one run in one merge."""
    docs = _random_docs(80, 5, 12)
    items = list(docs.items())
    index = SealedIndex(new_store(spark), SECRETS.writer(), fan_out=2)
    merged = []
    merge = index.merge
    monkeypatch.setattr(index, "merge", lambda runs: (merged.append([r.level for r in runs]), merge(runs))[1])
    for i in range(4):
        index.upsert(rows_of(spark, dict(items[i::4])))
    assert [sorted(levels) for levels in merged] == [[0, 0], [0, 0, 1]]
    assert index.store.runs() == [Run(merged_number(2, [4]), 2, (1, 2, 3, 4))]
    found = postings_of(index.lookup(list(_inverted(docs))))
    assert {w: sorted(u) for w, u in found.items()} == {w: sorted(u) for w, u in _inverted(docs).items()}


def test_merged_batches_equal_one_batch(spark):
    """Fan-out 3, nine batches: one run of level 2, a hot word split over blocks; later batches go on from its revisions."""
    docs = _random_docs(360, 11, 25)
    items = list(docs.items())
    store = new_store(spark)
    index = SealedIndex(store, SECRETS.writer(), block_size=8, split_above=40, fan_out=3)
    parts = [dict(items[i::9]) for i in range(9)]
    for part in parts:
        index.upsert(rows_of(spark, part))
    assert [(r.level, r.covers) for r in store.runs()] == [(2, tuple(range(1, 10)))]
    reader = SealedIndex(store, SECRETS.reader())
    want = _inverted(docs)
    got = postings_of(reader.lookup(list(want)))
    assert {w: sorted(u) for w, u in got.items()} == {w: sorted(u) for w, u in want.items()}
    assert store.row_counts().first().chain_rows == sum(-(-len(u) // 8) for u in want.values())
    revisions = {bytes(r.token): r.revision for r in store.entries().collect()}
    for word in want:
        assert revisions[crypto.mac(SECRETS.reader().token_key(), word.encode())] == sum(word in _inverted(p) for p in parts) - 1
    with pytest.raises(ValueError, match="part of run"):
        index.upsert(rows_of(spark, parts[0]), 3)
    report = index.upsert(rows_of(spark, {b"document-x": ["all", "fresh"]}))
    assert report.batch == 10 and [r.covers for r in store.runs()][0] == (10,)
    token = crypto.mac(SECRETS.reader().token_key(), b"all")
    assert max(r.revision for r in store.entries().where(F.col("token") == F.lit(token)).collect()) == 9
    left = store.tidy()
    assert left > 0 and store.tidy() == 0 or left == 0
    assert len(postings_of(reader.lookup(["all"]))["all"]) == 361


def test_a_batch_inside_a_run_may_run_again(spark):
    rows = make_people(60)
    vault = Vault(spark, scratch_path(spark, "runs"), PEOPLE)
    parts = [spark.createDataFrame(rows[i::3], PEOPLE.schema()) for i in range(3)]
    for part in parts:
        vault.ingest(part, SECRETS)
    SealedIndex(vault.index_store, SECRETS.writer()).merge(vault.index_store.runs())
    assert vault.index_store.runs() == [Run(merged_number(1, [3]), 1, (1, 2, 3))]
    vault.ingest(spark.createDataFrame(rows[:5], PEOPLE.schema()), SECRETS, batch=2)
    assert vault.index_store.runs() == [Run(merged_number(1, [3]), 1, (1, 2, 3))]
    keys = vault.user_keys(SECRETS, people_rules()["SuperAdmin"])
    words = ["country=france", "country=spain", "country=germany"]
    found = vault.search(words, SECRETS.reader(), keys, True)
    want = sorted(r[6] for r in rows[0::3] + rows[:5] + rows[2::3])
    assert sorted(r.employeeNumber for r in found.records.collect()) == want
    assert vault.ingest(parts[0], SECRETS).batch == 4


def test_sketches_never_rule_out_what_is_stored(spark):
    draw = random.Random(4)
    tokens = [draw.randbytes(32) for _ in range(9000)]
    folder = scratch_path(spark, "sketch")
    for name, part, slots in (("a", tokens[:3000], 2), ("b", tokens[3000:3100], 1)):
        frame = crypto.local_frame(spark, [(t,) for t in part], {"token": __import__("pyarrow").binary()})
        sketch.built(frame, slots).write.parquet(f"{folder}/{name}")
    assert sketch.slots_for(3000) == 2 and sketch.slots_for(0) == 1
    frame = crypto.local_frame(spark, [(t,) for t in tokens], {"token": __import__("pyarrow").binary()})
    got = [bytes(r.token) for r in sketch.possible(frame, {2: [f"{folder}/a"], 1: [f"{folder}/b"]}).collect()]
    assert len(got) == len(set(got)) and set(tokens[:3100]) <= set(got)
    assert len(got) - 3100 < 5900 * 0.02


def test_new_words_look_nothing_up(spark, monkeypatch):
    store = new_store(spark)
    index = SealedIndex(store, SECRETS.writer())
    index.upsert(rows_of(spark, {b"document-1": ["old", "shared"]}))
    asked = []
    fetch = store.get_entries
    monkeypatch.setattr(store, "get_entries", lambda keys, before=None: (asked.append(keys.count()), fetch(keys, before))[1])
    index.upsert(rows_of(spark, {b"document-2": ["brand", "new"]}))
    assert asked == []
    index.upsert(rows_of(spark, {b"document-3": ["shared", "newer"]}))
    assert asked == [1]


@pytest.mark.parametrize("words, disjunction", [(["all"], False), (["all", "rare"], False), (["rare", "all"], True)])
def test_a_lost_block_fails_every_kind_of_search(spark, words, disjunction):
    """Also where only some blocks of a word are fetched, and none but the lost one held the ids."""
    from sealdex.operators.boolean import find
    from sealdex.operators.index import chain_keys

    docs = {b"document%04d" % i: ["all"] + ["rare"] * (i % 50 == 0) for i in range(400)}
    store = new_store(spark)
    SealedIndex(store, SECRETS.writer(), block_size=4).upsert(rows_of(spark, docs))
    reader = SealedIndex(store, SECRETS.reader())
    assert find(reader, words, disjunction).count() == (400 if "rare" not in words or disjunction else 8)
    tokens = {bytes(r.token) for r in chain_keys(reader.find_words(["rare"] if "rare" in words else ["all"]).entries, False).collect()}
    chain = store.chain()
    store.chain = lambda: chain.where(F.col("token") != F.lit(min(tokens)))
    with pytest.raises(Exception, match="lost posting blocks"):
        find(reader, words, disjunction).collect()
    store.chain = lambda: chain.unionByName(chain.where(F.col("token") == F.lit(min(tokens))))
    with pytest.raises(Exception, match="lost posting blocks"):
        find(reader, words, disjunction).collect()


def test_empty_blocks_are_stored(spark):
    """Blocks that no id's hash names exist all the same, so a reader misses none."""
    docs = {b"document%04d" % i: ["many"] for i in range(64)}
    store = new_store(spark)
    SealedIndex(store, SECRETS.writer(), block_size=1).upsert(rows_of(spark, docs))
    assert store.row_counts().first().chain_rows == 64
    assert len(postings_of(SealedIndex(store, SECRETS.reader()).lookup(["many"]))["many"]) == 64


def _numbered(spark, folder, rows, ages, end_at):
    """Files of five lines; the end line stands before line ``end_at``; ``ages`` orders their arrival."""
    lines = [r.value for r in record_lines(spark.createDataFrame(rows, PEOPLE.schema()), PEOPLE).collect()]
    lines.insert(end_at, END_LINE)
    os.makedirs(folder)
    for number, at in enumerate(range(0, len(lines), 5)):
        path = f"{folder}/part-{number}.txt"
        with open(path, "w") as f:
            f.write("\n".join([*lines[at : at + 5], "no record"]) + "\n")
        os.utime(path, (1_700_000_000 + ages[number % len(ages)],) * 2)


@pytest.mark.parametrize("files, ages", [(1, [3, 2, 1, 0]), (2, [2, 0, 3, 1]), (None, [1, 1, 1, 1]), (1, [0, 0, 0, 0])])
def test_the_end_holds_in_any_order_of_arrival(spark, tmp_path, files, ages):
    rows = make_people(18)
    _numbered(spark, tmp_path / "in", rows, ages, 8)
    vault, progress = Vault(spark, scratch_path(spark, "ends"), PEOPLE), scratch_path(spark, "progress")
    keys = vault.user_keys(SECRETS, people_rules()["SuperAdmin"])

    def run(taken=True):
        lines = stream_file_lines(spark, str(tmp_path / "in"), files, number=r"part-(\d+)")
        query, state = ingest_stream(vault, lines, SECRETS, progress, NUMBERED_ORDER, available_now=True)
        if taken:
            return run_to_end(query, state)
        query.awaitTermination()
        return state

    def held():
        return sorted(r.employeeNumber for r in vault.open_all(keys).collect())

    first = run(taken=False)
    assert first.ended and held() == [r[6] for r in rows[:8]]
    # The caller went away before it saw the end: a new run is still at that end.
    again = run()
    assert again.ended and again.batches == [] and held() == [r[6] for r in rows[:8]]
    words = ["country=france", "country=spain", "country=germany"]
    assert vault.search(words, SECRETS.reader(), keys, True).counts().first().found == 8
    assert vault.rejected(SECRETS).count() == 1
    later = run()
    assert not later.ended and held() == sorted(r[6] for r in rows)
    assert vault.search(words, SECRETS.reader(), keys, True).counts().first().found == 18
    assert vault.rejected(SECRETS).count() == 4


def test_the_state_is_small_and_readable(spark):
    vault = Vault(spark, scratch_path(spark, "state"), PEOPLE)
    vault.ingest(spark.createDataFrame(make_people(3), PEOPLE.schema()), SECRETS)
    from sealdex.session import read_file

    last = max(vault.ledger._versions())
    said = json.loads(read_file(spark, f"{vault.root}/ledger/v{last:010d}"))
    assert {p["table"] for p in said["pieces"]} == {"records", "gen=0/entry", "gen=0/chain", "gen=0/sketch"}


def test_key_epochs_never_hold_too_much(spark, tmp_path, monkeypatch):
    """A stream rolls over to new epochs; a batch too large for one is refused and leaves no trace."""
    from sealdex.plans import vault as plans_vault

    monkeypatch.setattr(plans_vault, "EPOCH_RECORDS", 10)
    rows = make_people(14)
    _numbered(spark, tmp_path / "in", rows, [0, 1, 2], 14)
    vault = Vault(spark, scratch_path(spark, "epochs"), PEOPLE)
    lines = stream_file_lines(spark, str(tmp_path / "in"), 1, number=r"part-(\d+)")
    state = run_to_end(*ingest_stream(vault, lines, SECRETS, scratch_path(spark, "progress"), NUMBERED_ORDER, available_now=True))
    assert state.ended and state.records == 14
    epochs = {f["epoch"] for n, f in vault.ledger.state().facts.items() if n.startswith("stages/")}
    assert epochs == {"stream", "stream~1"} and all(vault.epoch_records(e) <= 10 for e in epochs)
    keys = vault.user_keys(SECRETS, people_rules()["SuperAdmin"])
    assert sorted(r.employeeNumber for r in vault.open_all(keys).collect()) == [r[6] for r in rows]
    with pytest.raises(ValueError, match="records in key epoch"):
        vault.ingest(spark.createDataFrame(rows, PEOPLE.schema()), SECRETS, batch=50)
    assert vault.open_all(keys).count() == 14 and 50 not in vault.records.batches()
    vault.ingest(spark.createDataFrame(rows[:6], PEOPLE.schema()), SECRETS, epoch="named")
    with pytest.raises(ValueError, match="epoch named"):
        vault.ingest(spark.createDataFrame(rows[:6], PEOPLE.schema()), SECRETS, epoch="named")
