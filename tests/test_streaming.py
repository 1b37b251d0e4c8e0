import time

import pytest
from conftest import SECRETS, make_people
from pyspark.sql import functions as F

from sealdex.plans.people import PEOPLE, people_rules
from sealdex.plans.vault import Vault
from sealdex.session import scratch_path
from sealdex.sources.records import record_lines
from sealdex.streaming.ingest import (
    END_LINE, FILE_ORDER, TOPIC_ORDER, before_end, ingest_stream, progress_counters, run_to_end, stream_file_lines,
)


def _lines(spark, rows):
    return [r.value for r in record_lines(spark.createDataFrame(rows, PEOPLE.schema()), PEOPLE).collect()]


def _drain(spark, vault, folder, checkpoint, **options):
    query, state = ingest_stream(
        vault, stream_file_lines(spark, str(folder), 1), SECRETS, checkpoint, available_now=True, **options
    )
    run_to_end(query, state)
    return query, state


def test_restart_adds_nothing_and_new_files_are_picked_up(spark, tmp_path):
    rows = make_people(30)
    lines = _lines(spark, rows)
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "1.txt").write_text("\n".join(lines[:10]) + "\n")
    (folder / "2.txt").write_text("\n\n".join(lines[10:20]) + "\n")
    vault = Vault(spark, scratch_path(spark, "stream"), PEOPLE)
    checkpoint = scratch_path(spark, "progress")
    query, state = _drain(spark, vault, folder, checkpoint)
    assert state.records == 20 and state.batches == [1, 2]
    assert sum(n for _, n in progress_counters(query)) == 29
    assert _drain(spark, vault, folder, checkpoint)[1].records == 0
    (folder / "3.txt").write_text("\n".join(lines[20:]) + "\n")
    assert _drain(spark, vault, folder, checkpoint)[1].batches == [3]

    keys = vault.user_keys(SECRETS, people_rules()["SuperAdmin"])
    assert sorted(r.employeeNumber for r in vault.open_all(keys).collect()) == [r[6] for r in rows]
    found = vault.search(["country=france"], SECRETS.reader(), keys).counts().first()
    assert (found.found, found.opened) == (10, 10)


def test_replayed_micro_batch_replaces_itself(spark, tmp_path):
    """A batch that failed after writing runs again under the same number."""
    rows = make_people(12)
    lines = _lines(spark, rows)
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "1.txt").write_text("\n".join(lines) + "\n")
    vault = Vault(spark, scratch_path(spark, "replay"), PEOPLE)
    for attempt in range(2):
        _drain(spark, vault, folder, scratch_path(spark, f"progress{attempt}"))
    keys = vault.user_keys(SECRETS, people_rules()["SuperAdmin"])
    assert vault.open_all(keys).count() == 12
    assert vault.search(["country=spain"], SECRETS.reader(), keys).counts().first().found == 4


def test_stream_stops_at_the_end_line(spark, tmp_path):
    rows = make_people(20)
    lines = _lines(spark, rows)
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "1.txt").write_text("\n".join([*lines[:8], END_LINE, *lines[8:12]]) + "\n")
    time.sleep(1.1)
    (folder / "2.txt").write_text("\n".join(lines[12:]) + "\n")
    vault = Vault(spark, scratch_path(spark, "end"), PEOPLE)
    query, state = ingest_stream(
        vault, stream_file_lines(spark, str(folder), 1), SECRETS, scratch_path(spark, "progress"), interval="1 second"
    )
    run_to_end(query, state)
    assert state.ended and state.records == 8 and not query.isActive
    keys = vault.user_keys(SECRETS, people_rules()["SuperAdmin"])
    assert sorted(r.employeeNumber for r in vault.open_all(keys).collect()) == [r[6] for r in rows[:8]]


def test_cut_of_ordered_files(spark):
    rows = [
        (2, "b", 0, "late"), (2, "a", 0, "first"), (2, "a", 64, END_LINE), (2, "a", 32, "second"), (2, "a", 96, "third"),
        (1, "z", 0, "older"), (3, "A", 0, "newer"),
    ]
    batch = spark.createDataFrame(rows, "modified long, path string, block long, value string")
    kept, ended = before_end(batch, FILE_ORDER)
    assert sorted(r.value for r in kept.collect()) == ["first", "older", "second"] and ended
    kept, ended = before_end(batch.where(F.col("value") != END_LINE), FILE_ORDER)
    assert kept.count() == 6 and not ended


@pytest.mark.parametrize("files", [None, 1])
def test_end_is_the_same_for_any_batch_size(spark, tmp_path, files):
    """The older file is the later one by name; what follows the end in later batches is left to a later run."""
    rows = make_people(18)
    lines = _lines(spark, rows)
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "2.txt").write_text("\n".join([*lines[:8], "no record", END_LINE]) + "\n")
    time.sleep(1.1)
    (folder / "1.txt").write_text("\n".join(lines[8:]) + "\n")
    vault, progress = Vault(spark, scratch_path(spark, "sizes"), PEOPLE), scratch_path(spark, "progress")

    def run():
        query, state = ingest_stream(vault, stream_file_lines(spark, str(folder), files), SECRETS, progress, available_now=True)
        return run_to_end(query, state)

    state = run()
    assert (state.ended, state.records, state.rejected) == (True, 8, 1)
    assert [r.value for r in vault.rejected(SECRETS).collect()] == ["no record"]
    if files:
        later = run()
        assert (later.ended, later.records) == (False, 10)


def test_cut_of_topic_partitions(spark):
    rows = [(0, 5, "x5"), (0, 6, END_LINE), (0, 7, "x7"), (1, 9, "y9"), (1, 2, "y2"), (2, 1, END_LINE), (2, 0, "z0")]
    batch = spark.createDataFrame(rows, "partition int, offset long, value string")
    kept, ended = before_end(batch, TOPIC_ORDER)
    assert sorted(r.value for r in kept.collect()) == ["x5", "y2", "y9", "z0"] and ended


def test_batch_with_the_end_line_is_indexed_once(spark, tmp_path, monkeypatch):
    lines = _lines(spark, make_people(12))
    (tmp_path / "1.txt").write_text("\n".join([*lines[:8], END_LINE, *lines[8:]]) + "\n")
    indexed = []
    index = Vault._index_batch
    monkeypatch.setattr(Vault, "_index_batch", lambda vault, batch, *more: indexed.append(batch) or index(vault, batch, *more))
    vault = Vault(spark, scratch_path(spark, "once"), PEOPLE)
    _, state = _drain(spark, vault, tmp_path, scratch_path(spark, "progress"))
    assert (state.ended, state.records, indexed) == (True, 8, [1])
    keys = vault.user_keys(SECRETS, people_rules()["SuperAdmin"])
    assert vault.search(["country=spain"], SECRETS.reader(), keys).counts().first().found == 3
