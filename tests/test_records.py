import glob
import os
import random

import pytest
from conftest import SECRETS, make_people
from pyspark.sql import functions as F

from sealdex.operators import layout, metrics, record_store, sealing
from sealdex.plans.people import PEOPLE, people_rules
from sealdex.plans.vault import Vault
from sealdex.session import scratch_path
from sealdex.sources.lines import read_lines, union_lines, without_blank
from sealdex.sources.records import parse_records, record_lines, rejected_lines
from sealdex.sources.topics import publish_lines, read_topic_lines, topic_options, topic_set


def _scanned_files(df):
    """Files the record scan of a finished plan opened."""
    df.collect()

    def walk(node):
        name = node.nodeName()
        if name.startswith("Scan parquet"):
            files = node.metrics().get("numFiles")
            has_parts = "class_token" in node.simpleString(10_000)
            return [files.get().value()] if has_parts else []
        if name == "AdaptiveSparkPlan":
            return walk(node.executedPlan())
        if "QueryStage" in name:
            return walk(node.plan())
        children = node.children()
        return [n for i in range(children.size()) for n in walk(children.apply(i))]

    return walk(df._jdf.queryExecution().executedPlan())


def test_search_opens_only_the_files_that_hold_hits(spark):
    rows = make_people(120)
    vault = Vault(spark, scratch_path(spark, "files"), PEOPLE)
    vault.ingest(spark.createDataFrame(rows, PEOPLE.schema()).repartition(12), SECRETS)
    keys = vault.user_keys(SECRETS, people_rules()["SuperAdmin"])
    result = vault.search([f"first={rows[5][0].lower()}", "last=" + rows[5][1].lower()], SECRETS.reader(), keys)
    hit_files = result.hits.select("file").distinct().count()
    opened = vault.records.read_selected(result.hits)
    (files,) = _scanned_files(opened)
    written = glob.glob(f"{vault.records.root}/records/batch=1/class_token=*/part-*.parquet")
    assert 0 < files <= hit_files * 3 < len(written)
    assert opened.count() == result.hits.count()


def test_search_lists_only_the_batches_that_hold_hits(spark):
    rows = make_people(40)
    here = [r for r in rows if r[0] == rows[5][0]]
    vault = Vault(spark, scratch_path(spark, "batches"), PEOPLE)
    for some in (here, [r for r in rows if r not in here]):
        vault.ingest(spark.createDataFrame(some, PEOPLE.schema()), SECRETS)
    keys = vault.user_keys(SECRETS, people_rules()["SuperAdmin"])
    result = vault.search([f"first={rows[5][0].lower()}"], SECRETS.reader(), keys)
    paths = [p for p in vault.records.read_selected(result.hits).inputFiles() if "/records/" in p]
    assert paths and all("/batch=1/" in p for p in paths)
    assert result.counts().first().found == len(here) < len(rows)


@pytest.mark.parametrize("looked_up", [64, 0])
def test_records_are_sorted_by_folder_before_they_are_sealed(spark, monkeypatch, looked_up):
    """What is sorted carries no ciphertext and, where classes are few, no keys; the writer sorts nothing again."""
    monkeypatch.setattr(sealing, "LOOKED_UP_CLASSES", looked_up)
    vault = Vault(spark, scratch_path(spark, "sorted"), PEOPLE)
    plans = []
    append = vault.records.append
    monkeypatch.setattr(vault.records, "append", lambda sealed, *a, **b: (plans.append(sealed), append(sealed, *a, **b)))
    vault.ingest(spark.createDataFrame(make_people(30), PEOPLE.schema()), SECRETS)
    plan = plans[0]._jdf.queryExecution().optimizedPlan()
    assert plan.outputOrdering().head().child().name() == "class_token"
    assert not plans[0]._jdf.schema().apply("class_token").nullable()
    (line,) = [x for x in plan.toString().split("\n") if "Sort [" in x]
    below = plan.toString().split(line)[1]
    assert "aes" not in below.lower() and ("key_common" in below.split("\n")[1]) == (not looked_up)
    keys = vault.user_keys(SECRETS, people_rules()["SuperAdmin"])
    opened = vault.open_all(keys).select(*PEOPLE.fields).collect()
    assert sorted(map(tuple, opened)) == sorted(make_people(30))


@pytest.mark.parametrize("most,strategy", [(10, "sortmergejoin"), (500_000, "broadcasthashjoin")])
def test_counted_hits_travel_to_the_records(spark, monkeypatch, most, strategy):
    """However small the session's broadcast threshold is; too many hits meet the records by shuffle."""
    monkeypatch.setattr(record_store, "FEW_HITS", most)
    rows = make_people(60)
    vault = Vault(spark, scratch_path(spark, "hits"), PEOPLE)
    vault.ingest(spark.createDataFrame(rows, PEOPLE.schema()), SECRETS)
    hits = vault.find(["country=France"], SECRETS.reader()).cache()
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        chosen = vault.records.read_selected(hits)
        assert strategy in chosen._jdf.queryExecution().executedPlan().toString().lower()
        assert chosen.count() == sum(r[4] == "France" for r in rows)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        hits.unpersist()


def test_records_roll_to_new_files_by_size(spark):
    rows = make_people(3000)
    root = scratch_path(spark, "roll")
    vault = Vault(spark, root, PEOPLE)
    wide = spark.createDataFrame(rows, PEOPLE.schema()).coalesce(1).withColumn("region", F.repeat("region", 300))
    vault.ingest(wide, SECRETS, max_file_mb=1)
    files = glob.glob(f"{root}/store/records/batch=1/class_token=*/part-*.parquet")
    classes = glob.glob(f"{root}/store/records/batch=1/class_token=*")
    assert len(classes) == 3 and len(files) > len(classes)
    keys = vault.user_keys(SECRETS, people_rules()["SuperAdmin"])
    assert vault.open_all(keys).count() == 3000
    assert vault.search(["douglas"], SECRETS.reader(), keys).counts().first().opened == sum("Douglas" in r[:2] for r in rows)


def test_unreadable_files_are_skipped_when_tolerated(spark):
    root = scratch_path(spark, "broken")
    vault = Vault(spark, root, PEOPLE)
    rows = make_people(60)
    vault.ingest(spark.createDataFrame(rows, PEOPLE.schema()).repartition(4), SECRETS)
    keys = vault.user_keys(SECRETS, people_rules()["SuperAdmin"])
    victim = sorted(glob.glob(f"{root}/store/records/batch=1/class_token=*/part-*.parquet"))[0]
    lost = spark.read.parquet(victim).count()
    with open(victim, "r+b") as f:
        f.truncate(os.path.getsize(victim) // 2)
    os.remove(os.path.join(os.path.dirname(victim), f".{os.path.basename(victim)}.crc"))
    with pytest.raises(Exception):
        vault.open_all(keys).collect()
    tolerant = Vault(spark, root, PEOPLE, tolerant=True)
    assert len(tolerant.open_all(keys).collect()) == 60 - lost


def _positions(spark, seed, n=400):
    rng = random.Random(seed)
    rows = [("hot" if rng.random() < 0.7 else f"f{rng.randint(0, 3)}", p, rng.randint(1, 50)) for p in rng.sample(range(5000), n)]
    return spark.createDataFrame(rows, "file string, pos long, size long"), rows


@pytest.mark.parametrize("span", [1, 7, 256, 1 << 20])
def test_running_offsets_equal_a_plain_loop(spark, span):
    df, rows = _positions(spark, 1)
    got = {(r.file, r.pos): r.offset for r in layout.running_offsets(df, "file", "pos", "size", span).collect()}
    want, total = {}, {}
    for f, p, s in sorted(rows):
        want[f, p] = total.get(f, 0)
        total[f] = want[f, p] + s
    assert got == want


@pytest.mark.parametrize("span", [1, 7, 256, 1 << 20])
def test_gaps_equal_a_plain_loop(spark, span):
    df, rows = _positions(spark, 2)
    got = {(r.file, r.pos): r.gap for r in layout.hit_gaps(df, "file", "pos", "size", span).collect()}
    want, end = {}, {}
    for f, p, s in sorted(rows):
        want[f, p] = p - end.get(f, 0)
        end[f] = p + s
    assert got == want


def test_positions_are_listed_in_order_and_in_bounded_chunks(spark):
    df, rows = _positions(spark, 3)
    listed = layout.positions_per_file(df, span=100).collect()
    assert all(len(r.positions) <= 100 and r.positions == sorted(r.positions) for r in listed)
    got = sorted((r.file, p) for r in listed for p in r.positions)
    assert got == sorted((f, p) for f, p, _ in rows)


def test_roll_buckets(spark):
    df = spark.createDataFrame([(0,), (99,), (100,), (250,)], "o long")
    assert [r.b for r in df.select(layout.roll_bucket(F.col("o"), 100).alias("b")).collect()] == [0, 0, 1, 2]


def test_lines_of_files_and_flat_folders(spark, tmp_path):
    folder = tmp_path / "in"
    (folder / "deeper").mkdir(parents=True)
    (folder / "a.txt").write_text("1\n2\n")
    (folder / "b.txt").write_text("3\n")
    (folder / "deeper" / "c.txt").write_text("not read\n")
    (tmp_path / "single.txt").write_text("4\n\n  \n")
    lines = read_lines(spark, [str(folder), str(tmp_path / "single.txt")])
    assert sorted(r.value for r in lines.collect()) == ["", "  ", "1", "2", "3", "4"]
    assert without_blank(union_lines([lines, lines])).count() == 8
    with pytest.raises(ValueError):
        read_lines(spark, [])


def test_unreadable_inputs_are_skipped_when_tolerated(spark, tmp_path):
    import gzip

    (tmp_path / "a.txt").write_text("1\n2\n")
    whole = gzip.compress(b"".join(b"%d\n" % i for i in range(5000)))
    (tmp_path / "b.txt.gz").write_bytes(whole[: len(whole) // 2])
    with pytest.raises(Exception):
        read_lines(spark, str(tmp_path)).collect()
    assert {"1", "2"} <= {r.value for r in read_lines(spark, str(tmp_path), tolerant=True).collect()}


def test_bad_lines_are_set_aside_with_a_reason(spark):
    good = record_lines(spark.createDataFrame(make_people(2), PEOPLE.schema()), PEOPLE)
    text = good.first().value
    bad = {
        "": "missing firstName",
        "{": "malformed",
        text.replace('"country":"France"', '"country":"Atlantis"'): "unknown Country Atlantis",
        text.replace('"email"', '"mail"'): "missing email",
        "[1]": None,
    }
    lines = good.unionByName(spark.createDataFrame([(b,) for b in bad], "value string"))
    assert parse_records(lines, PEOPLE).count() == 2
    faults = {r.value: r.fault for r in rejected_lines(lines, PEOPLE).collect()}
    assert set(faults) == set(bad) and all(faults[v] == f for v, f in bad.items() if f)


def test_topic_options():
    assert topic_set(["b", "a", "b"], "c") == ["a", "b", "c"]
    assert topic_set([], "only") == ["only"]
    with pytest.raises(ValueError):
        topic_set([], None)
    options = topic_options("h:9092", ["t2"], "t1", max_lines_per_batch=100, **{"kafka.security.protocol": "SSL"})
    assert options == {
        "kafka.bootstrap.servers": "h:9092",
        "subscribe": "t1,t2",
        "startingOffsets": "earliest",
        "maxOffsetsPerTrigger": "100",
        "kafka.security.protocol": "SSL",
    }


def test_topics_need_the_connector(spark):
    """Without the connector jar both ends fail by name, not in some other way."""
    with pytest.raises(Exception, match="(?i)kafka"):
        read_topic_lines(spark, topic_options("h:9092", ["t"]))
    with pytest.raises(Exception, match="(?i)kafka"):
        publish_lines(spark.createDataFrame([("x",)], "value string"), "h:9092", "t")


def test_counter_and_stage_metrics(spark):
    df, seen = metrics.counted(spark.range(25))
    df.write.format("noop").mode("overwrite").save()
    assert seen.get["rows"] == 25
    rows = [("total", 1, 900), ("total", 1, 100), ("index", 2, 301), ("index", 2, 200), ("write", 3, 250)]
    timings = spark.createDataFrame(rows, "stage string, events long, micros long")
    got = {r.stage: (r.events, r.micros, r.mean_micros, r.share) for r in
           metrics.stage_shares(metrics.stage_totals(timings), "total").collect()}
    assert got == {"total": (2, 1000, 500, 100.0), "index": (4, 501, 125, 50.1), "write": (3, 250, 83, 25.0)}


def test_ingest_times_its_stages(people_vault):
    totals = metrics.stage_totals(people_vault.clock.timings()).collect()
    assert {r.stage for r in totals} >= {"headers", "records", "index"}


def test_record_ids_beyond_a_million_tasks(spark):
    from sealdex.functions.uid import file_name, partition_of

    numbers = [0, 7, 999_999, 1_000_000, 1_000_001, 10_000_000]
    names = [r.f for r in spark.createDataFrame([(n,) for n in numbers], "n int").select(file_name(3, F.col("n")).alias("f")).collect()]
    assert len(set(names)) == len(numbers) and [partition_of(n) for n in names] == numbers and names[1] == "0000000003-000007"
