import json

import pytest
from conftest import SECRETS, make_people
from pyspark.sql import functions as F

from sealdex.operators import sealing
from sealdex.operators.keyring import keyring_for
from sealdex.operators.sinks import write_clear_lines
from sealdex.plans.people import COUNTRY, DEPARTMENT, PEOPLE, PEOPLE_POLICY, people_rules
from sealdex.plans.vault import Secrets, Vault
from sealdex.session import scratch_path
from sealdex.sources.records import record_lines

PARTS = {"hr": ("phone", "email", "employeeNumber"), "marketing": ("region",), "security": ("security",)}


def _keys(vault, user):
    return vault.user_keys(SECRETS, people_rules()[user], user)


def _expected(people, country, *parts):
    shown = {"firstName", "lastName", "country"}.union(*(PARTS[p] for p in parts))
    rows = [dict(zip(PEOPLE.fields, r)) for r in people if country is None or r[4] in country]
    return sorted(tuple(r[c] if c in shown else None for c in PEOPLE.fields) for r in rows)


def _got(df):
    return sorted(tuple(r[c] for c in PEOPLE.fields) for r in df.collect())


def _sort(rows):
    return sorted(rows, key=str)


@pytest.mark.parametrize(
    "user, country, parts",
    [
        ("Alice", ["France"], ["marketing"]),
        ("Bob", ["Spain"], ["hr"]),
        ("Charlie", ["France"], ["hr"]),
        ("SuperAdmin", None, ["marketing", "hr", "security"]),
        ("Mallory", [], []),
    ],
)
def test_example_users_open_their_rows_and_columns(people, people_vault, user, country, parts):
    opened = people_vault.open_all(_keys(people_vault, user))
    rows = [tuple(r[c] for c in PEOPLE.fields) for r in opened.collect()]
    want = _expected(people, country, *parts) if country != [] else []
    assert _sort(rows) == _sort(want)


def test_more_policies(people, people_vault):
    allow = PEOPLE_POLICY.allow
    gateless = people_vault.user_keys(SECRETS, allow(["Security"], COUNTRY.values))
    assert people_vault.open_all(gateless).count() == 0
    both = people_vault.user_keys(SECRETS, allow(["HR", "Security"], ["Germany"]))
    rows = [tuple(r[c] for c in PEOPLE.fields) for r in people_vault.open_all(both).collect()]
    assert _sort(rows) == _sort(_expected(people, ["Germany"], "hr", "security"))
    nested = DEPARTMENT.attribute("Marketing") & (COUNTRY.attribute("Spain") | COUNTRY.attribute("France"))
    rows = people_vault.open_all(people_vault.user_keys(SECRETS, nested)).collect()
    assert {r.country for r in rows} == {"Spain", "France"} and all(r.phone is None for r in rows)


SEARCHES = [
    (["country=FRANCE"], False, "Alice", lambda r: r[4] == "France", lambda r: True),
    (["country=Spain"], False, "Alice", lambda r: r[4] == "Spain", lambda r: False),
    (["country=Spain"], False, "Bob", lambda r: r[4] == "Spain", lambda r: True),
    (["Douglas"], False, "SuperAdmin", lambda r: "Douglas" in r[:2], lambda r: True),
    (["douglas"], False, "Alice", lambda r: "Douglas" in r[:2], lambda r: r[4] == "France"),
    (["last=Douglas", "country=France"], False, "SuperAdmin", lambda r: r[1] == "Douglas" and r[4] == "France", lambda r: True),
    (["first=Douglas", "last=Douglas"], False, "SuperAdmin", lambda r: r[0] == r[1] == "Douglas", lambda r: True),
    (["first=Douglas", "last=Douglas"], True, "SuperAdmin", lambda r: "Douglas" in r[:2], lambda r: True),
    (["douglas", "country=france", "country=spain"], True, "SuperAdmin",
     lambda r: "Douglas" in r[:2] or r[4] != "Germany", lambda r: True),
    (["douglas", "nobody-has-this"], False, "SuperAdmin", lambda r: False, lambda r: True),
    (["douglas", "nobody-has-this"], True, "SuperAdmin", lambda r: "Douglas" in r[:2], lambda r: True),
    (["nobody-has-this"], False, "SuperAdmin", lambda r: False, lambda r: True),
    (["élan3", "ÉLAN3", "country=Germany"], False, "SuperAdmin", lambda r: r[0] == "Élan3" and r[4] == "Germany", lambda r: True),
]


@pytest.mark.parametrize("words, disjunction, user, hit, allowed", SEARCHES)
def test_searches(people, people_vault, words, disjunction, user, hit, allowed):
    result = people_vault.search(words, SECRETS.reader(), _keys(people_vault, user), disjunction)
    hits = [r for r in people if hit(r)]
    opened = [r for r in hits if allowed(r)]
    counts = result.counts().first()
    assert (counts.found, counts.opened) == (len(hits), len(opened))
    assert sorted((r.firstName, r.lastName, r.country) for r in result.records.collect()) == sorted(
        (r[0], r[1], r[4]) for r in opened
    )


def test_keyring_unlocked_once_serves_searches_and_scans(people, people_vault):
    ring = people_vault.unlock(_keys(people_vault, "Bob"))
    spanish = sum(r[4] == "Spain" for r in people)
    assert people_vault.open_all(ring).count() == spanish
    counts = people_vault.search(["country=spain"], SECRETS.reader(), ring).counts().first()
    assert (counts.found, counts.opened) == (spanish, spanish)


def test_wrong_search_key_finds_nothing(people_vault):
    other = Secrets(SECRETS.master, b"another", SECRETS.word).reader()
    assert people_vault.search(["Douglas"], other, _keys(people_vault, "SuperAdmin")).counts().first().found == 0


def test_clear_lines_leave_closed_columns_out(spark, people, people_vault):
    path = scratch_path(spark, "clear")
    write_clear_lines(people_vault.open_all(_keys(people_vault, "Alice")), PEOPLE, path)
    lines = [json.loads(r.value) for r in spark.read.text(path).collect()]
    assert len(lines) == sum(r[4] == "France" for r in people)
    assert all(set(line) == {"firstName", "lastName", "country", "region"} for line in lines)


def test_moved_and_damaged_parts_stay_closed(people, people_vault):
    ring = keyring_for(_keys(people_vault, "SuperAdmin"), people_vault.records.headers(), PEOPLE)
    stored = people_vault.records.read()
    moved = stored.withColumn("pos", F.col("pos") + 1)
    assert sealing.open_records(moved, ring, PEOPLE).count() == 0
    cut = F.expr("substring(hr, 1, length(hr) - 1)")
    damaged = sealing.open_records(stored.withColumn("hr", cut), ring, PEOPLE)
    rows = damaged.collect()
    assert len(rows) == len(people)
    assert all(r.phone is None and r.region is not None and r.security is not None for r in rows)


def test_closed_parts_are_not_read(people_vault):
    plan = people_vault.open_all(_keys(people_vault, "Alice"))._jdf.queryExecution().toString()
    scans = [line for line in plan.splitlines() if "FileScan parquet" in line and "ReadSchema" in line]
    assert scans and all("security:binary" not in s and "hr:binary" not in s for s in scans)
    assert any("marketing:binary" in s and "PartitionFilters: [class_token" in s.replace("isnotnull(class_token", "class_token") for s in scans)


def test_record_size_is_predicted(spark, people, people_vault):
    size = sealing.sealed_size(PEOPLE.part_names())
    stored = people_vault.records.read().agg(F.sum(size)).first()[0]
    clear = spark.createDataFrame(people, PEOPLE.schema())
    assert clear.agg(F.sum(sealing.planned_size(PEOPLE))).first()[0] == stored


def test_batches_add_up_and_reindex_rebuilds(spark):
    rows = make_people(60)
    vault = Vault(spark, scratch_path(spark, "batches"), PEOPLE)
    for part in (rows[:25], rows[25:40], rows[40:]):
        vault.ingest(spark.createDataFrame(part, PEOPLE.schema()), SECRETS)
    keys = _keys(vault, "SuperAdmin")
    words = ["country=france", "douglas"]

    def found():
        return sorted(r.employeeNumber for r in vault.search(words, SECRETS.reader(), keys, True).records.collect())

    want = sorted(r[6] for r in rows if r[4] == "France" or "Douglas" in r[:2])
    assert found() == want
    distinct = {w for r in rows for w in (r[0].lower(), r[1].lower(), f"first={r[0].lower()}",
                                          f"last={r[1].lower()}", f"country={r[4].lower()}")}
    assert vault.index_store.row_counts().first().entries == len(distinct)
    vault.index_store.truncate()
    assert tuple(vault.index_store.row_counts().first()) == (0, 0)
    assert found() == []
    vault.reindex(SECRETS)
    assert found() == want


def test_a_covered_batch_may_run_again(spark):
    rows = make_people(40)
    vault = Vault(spark, scratch_path(spark, "covered"), PEOPLE)
    parts = [spark.createDataFrame(p, PEOPLE.schema()) for p in (rows[:20], rows[20:])]
    for number, part in enumerate(parts, 1):
        vault.ingest(part, SECRETS, batch=number)
    vault.reindex(SECRETS)
    keys = _keys(vault, "SuperAdmin")
    for number, part in enumerate(parts, 1):
        vault.ingest(part, SECRETS, batch=number)
        found = vault.search(["country=france", "country=spain", "country=germany"], SECRETS.reader(), keys, True).counts().first()
        assert tuple(found) == (40, 40)
    assert vault.ingest(parts[0], SECRETS).batch == 3
    assert tuple(vault.search(["country=france"], SECRETS.reader(), keys).counts().first()) == (14 + 7, 14 + 7)


def test_bad_lines_are_kept(spark):
    rows = make_people(20)
    good = [r.value for r in record_lines(spark.createDataFrame(rows, PEOPLE.schema()), PEOPLE).collect()]
    lines = spark.createDataFrame([(v,) for v in [*good, "{", "plain", good[0][:-5], '{"firstName":"x"}']], "value string")
    vault = Vault(spark, scratch_path(spark, "bad"), PEOPLE)
    report = vault.ingest_lines(lines, SECRETS)
    assert (report.records, report.rejected) == (20, 4)
    kept = {(r.batch, r.value) for r in vault.rejected(SECRETS).collect()}
    assert kept == {(1, "{"), (1, "plain"), (1, good[0][:-5]), (1, '{"firstName":"x"}')}
    stored = spark.read.parquet(f"{vault.root}/quarantine").collect()
    assert not any(b"plain" in bytes(r.sealed) for r in stored)


def test_ingesting_a_batch_again_replaces_it(spark):
    rows = make_people(30)
    vault = Vault(spark, scratch_path(spark, "again"), PEOPLE)
    df = spark.createDataFrame(rows, PEOPLE.schema())
    for _ in range(2):
        vault.ingest(df, SECRETS, batch=1)
    keys = _keys(vault, "SuperAdmin")
    assert vault.open_all(keys).count() == 30
    assert vault.search(["country=spain"], SECRETS.reader(), keys).counts().first().found == 10


def test_drop_indexes_forgets_earlier_words(spark):
    vault = Vault(spark, scratch_path(spark, "drop"), PEOPLE)
    rows = make_people(12)
    vault.ingest(spark.createDataFrame(rows[:6], PEOPLE.schema()), SECRETS)
    vault.ingest(spark.createDataFrame(rows[6:], PEOPLE.schema()), SECRETS, drop_indexes=True)
    keys = _keys(vault, "SuperAdmin")
    found = vault.search(["country=france"], SECRETS.reader(), keys)
    assert sorted(r.employeeNumber for r in found.records.collect()) == [r[6] for r in rows[6:] if r[4] == "France"]
    assert vault.open_all(keys).count() == 12


def test_lines_in_strict_mode(spark):
    vault = Vault(spark, scratch_path(spark, "strict"), PEOPLE)
    good = record_lines(spark.createDataFrame(make_people(3), PEOPLE.schema()), PEOPLE)
    bad = good.unionByName(spark.createDataFrame([("{",)], "value string"))
    assert vault.ingest_lines(bad, SECRETS).records == 3
    with pytest.raises(Exception, match="bad record"):
        vault.ingest_lines(bad, SECRETS, strict=True)


def test_unknown_row_value_cannot_be_sealed(spark):
    vault = Vault(spark, scratch_path(spark, "unknown"), PEOPLE)
    row = list(make_people(1)[0])
    row[4] = "Atlantis"
    with pytest.raises(Exception, match="no seal class for Atlantis"):
        vault.ingest(spark.createDataFrame([tuple(row)], PEOPLE.schema()), SECRETS)
