"""Every operator as a query over the test tables, through the full sealed path.

Vaults and indexes are built once per session and data folder, then shared by
the queries that only read them. Each has its oracle in :mod:`oracle`.
"""

from __future__ import annotations

import contextlib
import copy
from collections.abc import Callable
from functools import reduce

import pyarrow as pa
from pyspark.errors import SparkRuntimeException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sealdex.functions.crypto import as_key, local_frame, utf8
from sealdex.functions.terms import fold_query
from sealdex.functions.uid import uid_bytes, uid_file, uid_pos, uid_text
from sealdex.operators import layout, metrics, sealing
from sealdex.operators import postings as P
from sealdex.operators.boolean import find
from sealdex.operators.index import FoundWords, SealedIndex, chain_keys, open_entries, word_token
from sealdex.operators.index_store import ParquetIndexStore, current_revisions
from sealdex.operators.keyring import keyring_for, seal_classes
from sealdex.operators.sinks import write_clear_lines
from sealdex.plans import tables as tb
from sealdex.plans.vault import Secrets, Vault
from sealdex.session import delete_path, list_names, scratch_path, staged, write_file
from sealdex.sources.lines import listed_files, outcome_of, read_lines, union_lines
from sealdex.sources.records import parse_records, record_lines, rejected_lines
from sealdex.streaming.ingest import END_LINE, NUMBERED_ORDER, ingest_stream, run_to_end, stream_file_lines

Query = Callable[[SparkSession, str], DataFrame]

# Keys of the demonstration vaults. Real vaults use Secrets.draw().
DEMO = Secrets(master=b"demo master key", search=b"demo search key", word=b"demo word key")

ROLL_BYTES = 1 << 16

# Most folders of a table that is staged by a column.
STAGED_SLOTS = 256

QUERIES: dict[str, Query] = {}
_BUILT: dict[tuple[str, str, str], object] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def _once(spark: SparkSession, sf_dir: str, name: str, build: Callable[[], object]):
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _BUILT:
        _BUILT[key] = build()
    return _BUILT[key]


# --- shared vaults and indexes ---------------------------------------------------


def _written_lines(spark: SparkSession, lines: DataFrame, name: str) -> str:
    path = scratch_path(spark, name)
    lines.select("value").write.text(path)
    return path


def _new_directory_vault(spark: SparkSession, sf_dir: str) -> Vault:
    path = _written_lines(spark, record_lines(tb.directory(spark, sf_dir), tb.DIRECTORY), "directory-lines")
    vault = Vault(spark, scratch_path(spark, "directory"), tb.DIRECTORY)
    vault.ingest_lines(read_lines(spark, path), DEMO)
    return vault


def directory_vault(spark: SparkSession, sf_dir: str) -> Vault:
    return _once(spark, sf_dir, "directory", lambda: _new_directory_vault(spark, sf_dir))


def orders_vault(spark: SparkSession, sf_dir: str) -> Vault:
    def build() -> Vault:
        vault = Vault(spark, scratch_path(spark, "orders"), tb.ORDER_RECORDS)
        vault.ingest(tb.order_records(spark, sf_dir), DEMO, max_file_mb=64)
        return vault

    return _once(spark, sf_dir, "orders", build)


def document_index(spark: SparkSession, sf_dir: str) -> SealedIndex:
    def build() -> SealedIndex:
        store = ParquetIndexStore(spark, scratch_path(spark, "documents"))
        store.create()
        SealedIndex(store, DEMO.writer()).upsert(tb.document_words(spark, sf_dir))
        return SealedIndex(store, DEMO.reader())

    return _once(spark, sf_dir, "documents", build)


def _user(vault: Vault, name: str) -> DataFrame:
    return vault.user_keys(DEMO, tb.region_rules()[name], name)


def _typed_directory(opened: DataFrame) -> DataFrame:
    return opened.select(
        F.col("custkey").cast("bigint").alias("custkey"),
        "name",
        "region",
        "segment",
        "nation",
        F.col("acctbal").cast("double").alias("acctbal"),
    )


def _search(spark, sf_dir, words, disjunction=False, user="super") -> DataFrame:
    vault = directory_vault(spark, sf_dir)
    found = vault.search(words, DEMO.reader(), _user(vault, user), disjunction)
    return _typed_directory(found.records)


def _open_all(spark, sf_dir, user) -> DataFrame:
    vault = directory_vault(spark, sf_dir)
    return _typed_directory(vault.open_all(_user(vault, user)))


def _found_documents(spark, sf_dir, words, disjunction=False) -> DataFrame:
    ids = find(document_index(spark, sf_dir), words, disjunction)
    return ids.select(uid_pos(F.col("uid")).alias("doc_id"))


# --- index words and postings ------------------------------------------------------


@query
def index_terms(spark, sf_dir):
    people = tb.directory(spark, sf_dir)
    return people.select("custkey", F.explode(tb.DIRECTORY.index.column()).alias("term"))


@query
def postings_by_word(spark, sf_dir):
    people = tb.directory(spark, sf_dir)
    rows = people.select(
        uid_bytes(F.lit("directory"), F.col("custkey")).alias("uid"),
        tb.DIRECTORY.index.column().alias("words"),
    )
    return P.word_counts(P.explode_words(rows))


@query
def posting_blocks(spark, sf_dir):
    """Blocked postings of the documents, read back through the sealed chain."""
    index = document_index(spark, sf_dir)
    return _all_postings(index, _word_keys(index, tb.document_words(spark, sf_dir))).groupBy("word").agg(
        F.count(F.lit(1)).alias("n"),
        F.min(uid_pos(F.col("uid"))).alias("first_doc"),
        F.max(uid_pos(F.col("uid"))).alias("last_doc"),
    )


def _staged_by(df: DataFrame, column: str, name: str) -> DataFrame:
    """Like :func:`staged`, in folders by the column's hash: :func:`_having` reads one of them."""
    return staged(df.withColumn("slot", _slot(F.col(column))), name, "slot")


def _having(stored: DataFrame, column: str, value) -> DataFrame:
    typed = F.lit(value).cast(stored.schema[column].dataType)
    return stored.where((F.col("slot") == _slot(typed)) & F.col(column).eqNullSafe(typed)).drop("slot")


def _slot(column: Column) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(STAGED_SLOTS)).cast("int")


def _word_keys(index: SealedIndex, docs: DataFrame) -> DataFrame:
    """(word, token) of every word of the documents, worked out once."""
    words = P.record_words(docs).select("word").distinct()
    return staged(words.withColumn("token", word_token(index.secrets, F.col("word"))), "word-keys")


def _all_postings(index: SealedIndex, keys: DataFrame) -> DataFrame:
    entries = open_entries(index.store.get_entries(keys), index.secrets)
    return index.postings(FoundWords(entries))


# --- keyword search ------------------------------------------------------------------


@query
def search_bare(spark, sf_dir):
    return _search(spark, sf_dir, ["Nation_12"])


@query
def search_scoped(spark, sf_dir):
    return _search(spark, sf_dir, ["nation=NATION_7"])


@query
def search_and(spark, sf_dir):
    return _search(spark, sf_dir, ["region=ASIA", "segment=building"])


@query
def search_and_none(spark, sf_dir):
    return _search(spark, sf_dir, ["region=asia", "nation=nation_3"])


@query
def search_and_unknown(spark, sf_dir):
    return _search(spark, sf_dir, ["region=asia", "nation=atlantis"])


@query
def search_or(spark, sf_dir):
    return _search(spark, sf_dir, ["nation=nation_2", "nation=nation_8"], disjunction=True)


@query
def search_or_overlap(spark, sf_dir):
    return _search(spark, sf_dir, ["region=asia", "segment=building"], disjunction=True)


@query
def search_or_unknown(spark, sf_dir):
    return _search(spark, sf_dir, ["nation=nation_14", "nation=atlantis"], disjunction=True)


@query
def doc_search_word(spark, sf_dir):
    return _found_documents(spark, sf_dir, ["THE"])


@query
def doc_search_and(spark, sf_dir):
    return _found_documents(spark, sf_dir, ["the", "in", "that"])


@query
def doc_search_or(spark, sf_dir):
    return _found_documents(spark, sf_dir, ["the,", "with", "des"], disjunction=True)


@query
def order_search(spark, sf_dir):
    vault = orders_vault(spark, sf_dir)
    found = vault.search(["month=1997-05", "status=f"], DEMO.reader(), _user(vault, "super"))
    return _typed_orders(found.records)


# --- the index as a table ----------------------------------------------------------------


@query
def index_sizes(spark, sf_dir):
    index = document_index(spark, sf_dir)
    entries = index.store.entries()
    opened = open_entries(entries.select("token", "revision", "sealed"), index.secrets)
    postings = opened.agg(F.sum("n").alias("postings"))
    return index.store.row_counts().select("entries", "chain_rows", postings.scalar().alias("postings"))


@query
def index_incremental(spark, sf_dir):
    """One batch per language: each word's postings, and how often it was touched."""
    store = ParquetIndexStore(spark, scratch_path(spark, "incremental"))
    store.create()
    index = SealedIndex(store, DEMO.writer())
    docs = staged(tb.document_words(spark, sf_dir), "document-words")
    for row in docs.select("lang").distinct().orderBy("lang").collect():
        index.upsert(docs.where(F.col("lang") == row["lang"]))
    keys = _word_keys(index, docs)
    opened = open_entries(store.get_entries(keys), index.secrets)
    return opened.groupBy("word").agg(F.sum("n").alias("n"), F.max("revision").alias("revision"))


LEVEL_FAN_OUT = 4


@query
def index_levels(spark, sf_dir):
    """A batch per source, merged four at a time: each word's postings and how often it was touched,
    and of how many runs a lookup reads."""
    store = ParquetIndexStore(spark, scratch_path(spark, "levels"))
    store.create()
    index = SealedIndex(store, DEMO.writer(), fan_out=LEVEL_FAN_OUT)
    docs = _staged_by(tb.document_words(spark, sf_dir), "source", "document-words")
    for row in docs.select("source").distinct().orderBy("source").collect():
        index.upsert(_having(docs, "source", row["source"]))
    keys = _word_keys(index, docs)
    revisions = open_entries(store.get_entries(keys), index.secrets).groupBy("word").agg(F.max("revision").alias("revision"))
    counts = _all_postings(index, keys).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counts.join(revisions, "word").select("word", "n", "revision", F.lit(len(store.runs())).alias("runs"))


@query
def index_lost_block(spark, sf_dir):
    """Documents a search finds, and what it says once one posting block is gone."""
    index = document_index(spark, sf_dir)
    words = ["the", "in"]
    found = find(index, words, disjunction=True).agg(F.count(F.lit(1)).alias("found"))
    lost = chain_keys(index.find_words(words).entries, spread=False).agg(F.min("token")).first()[0]
    chain = index.store.chain().where(F.col("token") != F.lit(bytes(lost)))
    poorer = copy.copy(index.store)
    poorer.chain = lambda: chain
    try:
        outcome = str(find(SealedIndex(poorer, DEMO.reader()), words, disjunction=True).count())
    except SparkRuntimeException as failure:
        outcome = "refused" if "lost posting blocks" in str(failure) else str(failure)
    return found.select("found", F.lit(outcome).alias("without_a_block"))


@query
def replay_snapshot(spark, sf_dir):
    """Records of two regions that searches open: before a batch is replaced, with a result from
    before that is read after it, after it, and after another replacement that broke off."""
    people = staged(tb.directory(spark, sf_dir), "people")
    vault = Vault(spark, scratch_path(spark, "replaced"), tb.DIRECTORY)
    keys = _user(vault, "super")

    def searched() -> DataFrame:
        return vault.search(["region=asia", "region=europe"], DEMO.reader(), keys, disjunction=True).records

    def counted(step: str, rows: DataFrame) -> DataFrame:
        return staged(rows.groupBy("region").agg(F.count(F.lit(1)).alias("n")).select(F.lit(step).alias("step"), "region", "n"), "replaced")

    vault.ingest(people, DEMO, batch=1)
    keys = vault.unlock(_user(vault, "super"))
    early = searched()
    steps = [counted("before", early)]
    vault.ingest(people.where(F.col("region") != "ASIA"), DEMO, batch=1)
    steps += [counted("read late", early), counted("replaced", searched())]

    def broken(*_, **__):
        raise InterruptedError("between records and entries")

    write, vault.index_store.append_entries = vault.index_store.append_entries, broken
    with contextlib.suppress(InterruptedError):
        vault.ingest(people.where(F.col("region") == "ASIA"), DEMO, batch=1)
    vault.index_store.append_entries = write
    steps.append(counted("broken off", searched()))
    return reduce(lambda a, b: a.unionByName(b), steps)


@query
def entry_conditional_upsert(spark, sf_dir):
    """Four conditional upserts, and how many words each applied or refused."""
    index = document_index(spark, sf_dir)
    store = ParquetIndexStore(spark, scratch_path(spark, "conditional"))
    store.create()
    docs = tb.document_words(spark, sf_dir).select("lang", F.explode(F.array_distinct("words")).alias("word"))
    # A word is one row, which says in what languages it is: no attempt has to find its distinct words again.
    spoken = docs.groupBy("word").agg(*[F.max(F.col("lang") == lang).alias(lang) for lang in ("en", "fr", "de")])
    words = staged(spoken.select(word_token(index.secrets, F.col("word")).alias("token"), "en", "fr", "de"), "lang-words")

    def attempt(name: str, rows: DataFrame, revision: int) -> DataFrame:
        rows = rows.select("token", F.lit(revision).alias("revision"), F.col("token").alias("sealed"))
        flags = store.upsert_entries(rows, store.next_batch())
        return flags.agg(
            F.count_if("applied").alias("applied"), F.count_if(~F.col("applied")).alias("refused")
        ).select(F.lit(name).alias("attempt"), "applied", "refused")

    english, french = words.where("en"), words.where("fr")
    steps = [
        attempt("insert english", english, 0),
        attempt("insert all", words, 0),
        attempt("update french", french, 1),
        attempt("update french or german", words.where("fr OR de"), 1),
        attempt("skip a revision", words, 3),
    ]
    return reduce(lambda a, b: a.unionByName(b), steps)


@query
def index_stale_writer(spark, sf_dir):
    """Words a writer proposes against an old state: how many were refused, proposed again, and all found after."""
    store = ParquetIndexStore(spark, scratch_path(spark, "stale"))
    store.create()
    index = SealedIndex(store, DEMO.writer())
    docs = staged(tb.document_words(spark, sf_dir), "document-words")
    of = {lang: docs.where(F.col("lang") == lang) for lang in ("en", "fr", "de")}
    index.upsert(of["en"])
    seen = staged(current_revisions(store.entries()), "seen-revisions")
    index.upsert(of["fr"])
    report = index.upsert(of["de"], base=seen)
    keys = _word_keys(index, docs)
    found = _all_postings(index, keys).agg(F.count(F.lit(1)).alias("postings"))
    return found.select(F.lit(report.words).cast("bigint").alias("proposed"), F.lit(report.conflicts).cast("bigint").alias("refused"), "postings")


@query
def key_lengths(spark, sf_dir):
    """Texts of any length as 32-byte keys."""
    text = F.concat("c_name", F.repeat("c_mktsegment", (F.col("c_custkey") % 4).cast("int")))
    rows = tb.table(spark, sf_dir, "customer")
    return rows.select("c_custkey", F.hex(as_key(utf8(text))).alias("key"))


@query
def index_truncate_rebuild(spark, sf_dir):
    vault = _new_directory_vault(spark, sf_dir)

    def state(step: str) -> DataFrame:
        # Staged, because the store moves on before the result is read.
        counts = vault.index_store.row_counts()
        return staged(counts.select(F.lit(step).alias("step"), "entries", "chain_rows"), "index-state")

    built = state("built")
    vault.index_store.truncate()
    empty = state("truncated")
    vault.reindex(DEMO)
    return built.unionByName(empty).unionByName(state("rebuilt"))


@query
def token_dictionary(spark, sf_dir):
    """Table key of every document word, with its posting count."""
    secrets = DEMO.reader().secrets(spark)
    counts = P.word_counts(P.explode_words(tb.document_words(spark, sf_dir)))
    return counts.select(F.base64(word_token(secrets, F.col("word"))).alias("token"), "n")


# --- opening -----------------------------------------------------------------------------


@query
def open_all_super(spark, sf_dir):
    return _open_all(spark, sf_dir, "super")


@query
def open_all_marketing(spark, sf_dir):
    return _open_all(spark, sf_dir, "asia_marketing")


@query
def open_all_hr(spark, sf_dir):
    return _open_all(spark, sf_dir, "europe_hr")


@query
def open_hr_and_security(spark, sf_dir):
    return _open_all(spark, sf_dir, "hr_and_security")


@query
def open_nested_policy(spark, sf_dir):
    return _open_all(spark, sf_dir, "nested")


@query
def open_no_access(spark, sf_dir):
    """Rows opened without a fitting key, and with one that opens no gate part."""
    nobody = _open_all(spark, sf_dir, "nobody").agg(F.count(F.lit(1)).alias("nobody"))
    gateless = _open_all(spark, sf_dir, "security_only").agg(F.count(F.lit(1)).alias("n"))
    return nobody.select("nobody", gateless.scalar().alias("security_only"))


def _typed_orders(opened: DataFrame) -> DataFrame:
    return opened.select(
        F.col("orderkey").cast("bigint").alias("orderkey"),
        F.col("custkey").cast("bigint").alias("custkey"),
        "region",
        "status",
        "priority",
        "urgency",
        F.col("orderdate").cast("timestamp_ntz").alias("orderdate"),
        F.col("totalprice").cast("double").alias("totalprice"),
    )


@query
def open_orders(spark, sf_dir):
    vault = orders_vault(spark, sf_dir)
    return _typed_orders(vault.open_all(_user(vault, "nested")))


@query
def search_then_open(spark, sf_dir):
    return _search(spark, sf_dir, ["segment=building"], user="asia_marketing")


@query
def search_found_opened(spark, sf_dir):
    vault = directory_vault(spark, sf_dir)
    keys = _user(vault, "asia_marketing")

    def counts(words: list[str]) -> DataFrame:
        result = vault.search(words, DEMO.reader(), keys).counts()
        return result.select(F.lit(" ".join(fold_query(words))).alias("words"), "found", "opened")

    asked = (["region=asia"], ["region=europe"], ["segment=building"])
    return reduce(lambda a, b: a.unionByName(b), [counts(w) for w in asked])


@query
def tamper_rejected(spark, sf_dir):
    """Records opened as stored, moved to another id, and with two parts swapped."""
    vault = directory_vault(spark, sf_dir)
    keyring = keyring_for(_user(vault, "super"), vault.records.headers(), vault.spec)
    stored = vault.records.read()
    moved = stored.withColumn("pos", F.col("pos") + 1)
    swapped = stored.withColumns({"marketing": F.col("hr"), "hr": F.col("marketing")})

    def opened(records: DataFrame) -> DataFrame:
        return sealing.open_records(records, keyring, vault.spec)

    intact = opened(stored).agg(F.count(F.lit(1)).alias("intact"))
    rows_moved = opened(moved).agg(F.count(F.lit(1)).alias("n"))
    parts_swapped = opened(swapped).agg((F.count("segment") + F.count("nation")).alias("n"))
    return intact.select(
        "intact",
        rows_moved.scalar().alias("moved_opened"),
        parts_swapped.scalar().alias("swapped_parts_opened"),
    )


@query
def access_matrix(spark, sf_dir):
    """Records each user opens, by region and part."""
    vault = directory_vault(spark, sf_dir)
    shown = {"common": "name", "marketing": "segment", "hr": "nation", "security": "acctbal"}

    def row(user: str) -> DataFrame:
        opened = vault.open_all(_user(vault, user))
        counts = opened.groupBy("region").agg(*[F.count(c).alias(p) for p, c in shown.items()])
        return counts.unpivot("region", list(shown), "part", "n").select(
            F.lit(user).alias("user"), "part", "region", "n"
        )

    matrix = reduce(lambda a, b: a.unionByName(b), [row(u) for u in tb.region_rules()])
    return matrix.where(F.col("n") > 0)


@query
def part_attributes(spark, sf_dir):
    """Attribute set every record's parts are sealed under, with their counts."""
    people = tb.directory(spark, sf_dir)
    sets = [
        F.struct(
            F.lit(p.name).alias("part"),
            F.array_join(tb.REGION_POLICY.part_attributes(F.col("region"), p.audience), " ").alias("attributes"),
        )
        for p in tb.DIRECTORY.parts
    ]
    rows = people.select(F.inline(F.array(*sets)))
    return rows.groupBy("part", "attributes").agg(F.count(F.lit(1)).alias("n"))


@query
def axis_usage(spark, sf_dir):
    """Values of both policy axes, with the records of each row value."""
    used = tb.directory(spark, sf_dir).groupBy("region").agg(F.count(F.lit(1)).alias("n"))
    axes = tb.REGION_POLICY.axes(spark)
    on_rows = (F.col("axis") == tb.REGIONS.name) & (F.col("value") == F.col("region"))
    return axes.join(used, on_rows, "left").select("axis", "value", F.coalesce("n", F.lit(0)).alias("n"))


@query
def clear_json_lines(spark, sf_dir):
    """Opened records written as JSON lines, read again."""
    vault = directory_vault(spark, sf_dir)
    path = scratch_path(spark, "clear")
    write_clear_lines(vault.open_all(_user(vault, "europe_hr")), vault.spec, path)
    return _typed_directory(spark.read.schema(tb.DIRECTORY.schema()).json(path))


# --- ids, positions, sizes ---------------------------------------------------------------


@query
def uid_codec(spark, sf_dir):
    orders = tb.table(spark, sf_dir, "orders")
    uid = uid_bytes(F.col("o_orderpriority"), F.col("o_orderkey"))
    return orders.select(uid.alias("uid")).select(
        F.hex("uid").alias("uid"),
        uid_file(F.col("uid")).alias("file"),
        uid_pos(F.col("uid")).alias("pos"),
        uid_text(uid_file(F.col("uid")), uid_pos(F.col("uid"))).alias("text"),
    )


@query
def positions_per_file(spark, sf_dir):
    orders = tb.table(spark, sf_dir, "orders")
    uid = uid_bytes(F.col("o_orderpriority"), F.col("o_orderkey"))
    ids = orders.select(uid.alias("uid")).select(
        uid_file(F.col("uid")).alias("file"), uid_pos(F.col("uid")).alias("pos")
    )
    listed = layout.positions_per_file(ids)
    return listed.select("file", "chunk", F.array_join("positions", ",").alias("positions"))


def _sized_directory(spark, sf_dir) -> DataFrame:
    people = tb.directory(spark, sf_dir)
    return people.select("custkey", "region", "segment", sealing.planned_size(tb.DIRECTORY).alias("size"))


def _offsets(spark, sf_dir) -> DataFrame:
    return layout.running_offsets(_sized_directory(spark, sf_dir), "region", "custkey", "size", span=512)


@query
def record_offsets(spark, sf_dir):
    return _offsets(spark, sf_dir).select("region", "custkey", "size", "offset")


@query
def roll_buckets(spark, sf_dir):
    bucket = layout.roll_bucket(F.col("offset"), ROLL_BYTES).alias("bucket")
    return _offsets(spark, sf_dir).groupBy("region", bucket).agg(
        F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"), F.min("custkey").alias("first_custkey")
    )


@query
def hit_gaps(spark, sf_dir):
    hits = _offsets(spark, sf_dir).where(F.col("segment") == "BUILDING")
    return layout.hit_gaps(hits, "region", "offset", "size", span=ROLL_BYTES).select("region", "custkey", "gap")


@query
def sealed_sizes(spark, sf_dir):
    """Stored size of the sealed records of each region, as the writer sees it."""
    vault = directory_vault(spark, sf_dir)
    classes = seal_classes(spark, vault.spec, DEMO.master, "1").select("class_token", "region")
    size = sealing.sealed_size(vault.spec.part_names())
    return (
        vault.records.read()
        .groupBy("class_token")
        .agg(F.count(F.lit(1)).alias("n"), F.sum(size).alias("bytes"))
        .join(classes, "class_token")
        .select("region", "n", "bytes")
    )


# --- sources and streams ----------------------------------------------------------------------


def _mixed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.to_json(F.struct(*[F.col(n).cast("string").alias(n) for n in tb.DIRECTORY.fields]))
    nameless = [F.col(n).cast("string").alias(n) for n in tb.DIRECTORY.fields if n != "name"]
    value = (
        F.when(F.col("nation") == "NATION_12", F.substring(line, 1, 20))
        .when(F.col("nation") == "NATION_7", F.lit(""))
        .when(F.col("nation") == "NATION_3", F.regexp_replace(line, '"EUROPE"', '"ATLANTIS"'))
        .when(F.col("segment") == "MACHINERY", F.to_json(F.struct(*nameless)))
        .otherwise(line)
    )
    return staged(tb.directory(spark, sf_dir).select(value.alias("value")), "mixed-lines")


@query
def quarantine_split(spark, sf_dir):
    """Good lines, and why the others were set aside."""
    lines = _mixed_lines(spark, sf_dir)
    good = parse_records(lines, tb.DIRECTORY).agg(F.count(F.lit(1)).alias("n"))
    bad = rejected_lines(lines, tb.DIRECTORY).groupBy("fault").agg(F.count(F.lit(1)).alias("n"))
    return good.select(F.lit("good").alias("outcome"), "n").unionByName(bad.withColumnRenamed("fault", "outcome"))


@query
def ingest_quarantine(spark, sf_dir):
    """What a vault holds after an ingest of mixed lines: records opened, and lines set aside by fault."""
    vault = Vault(spark, scratch_path(spark, "mixed"), tb.DIRECTORY)
    vault.ingest_lines(_mixed_lines(spark, sf_dir), DEMO)
    good = vault.open_all(_user(vault, "super")).agg(F.count(F.lit(1)).alias("n"))
    bad = vault.rejected(DEMO).groupBy("fault").agg(F.count(F.lit(1)).alias("n"))
    return good.select(F.lit("good").alias("outcome"), "n").unionByName(bad.withColumnRenamed("fault", "outcome"))


@query
def reindex_then_replay(spark, sf_dir):
    """A search after two batches, a rebuilt index, and the first batch run again."""
    people = staged(tb.directory(spark, sf_dir), "people")
    halves = [people.where(F.pmod(F.xxhash64("custkey"), F.lit(2)) == k) for k in (0, 1)]
    vault = Vault(spark, scratch_path(spark, "replay"), tb.DIRECTORY)
    for number, half in enumerate(halves, 1):
        vault.ingest(half, DEMO, batch=number)
    vault.reindex(DEMO)
    vault.ingest(halves[0], DEMO, batch=1)
    return _typed_directory(vault.search(["region=asia"], DEMO.reader(), _user(vault, "super")).records)


@query
def multi_input_union(spark, sf_dir):
    """Lines of two folders and of one folder given twice, as one input."""
    def named(name: str, key: str, label: str) -> DataFrame:
        rows = tb.table(spark, sf_dir, name)
        return rows.select(F.concat_ws(" ", F.lit(name), F.col(key).cast("string"), F.col(label)).alias("value"))

    customers = _written_lines(spark, named("customer", "c_custkey", "c_name"), "customer-lines")
    suppliers = _written_lines(spark, named("supplier", "s_suppkey", "s_name"), "supplier-lines")
    both = read_lines(spark, [customers, suppliers])
    return union_lines([both, read_lines(spark, suppliers)]).groupBy("value").agg(F.count(F.lit(1)).alias("n"))


@query
def input_reconciliation(spark, sf_dir):
    """What a tolerant read made of each file: customers in a file per segment, one of which vanishes
    after it was listed, and one more that is no archive though its name says so."""
    root = scratch_path(spark, "segments")
    rows = tb.table(spark, sf_dir, "customer").repartition("c_mktsegment")
    rows.select("c_mktsegment", F.col("c_name").alias("value")).write.partitionBy("c_mktsegment").text(root)
    write_file(spark, f"{root}/c_mktsegment=archive/part.gz", "no archive")
    folders = [f"{root}/{name}" for name in list_names(spark, f"{root}/c_mktsegment=*")]
    listed = listed_files(spark, folders)
    lines = read_lines(spark, folders, tolerant=True)
    (gone,) = [f for f in folders if f.endswith("=FURNITURE")]
    for name in list_names(spark, f"{gone}/part-*"):
        delete_path(spark, f"{gone}/{name}")
    files = outcome_of(listed, lines, listed_files(spark, [f for f in folders if f != gone]))
    label = F.regexp_extract("path", "c_mktsegment=([^/]+)/", 1).alias("segment")
    return staged(files.groupBy(label, "outcome").agg(F.sum("lines").alias("lines")), "reconciled")


def _typed_events(opened: DataFrame) -> DataFrame:
    return opened.select(
        F.col("event_id").cast("bigint").alias("event_id"),
        F.col("ts").cast("timestamp_ntz").alias("ts"),
        F.col("user_id").cast("bigint").alias("user_id"),
        "type",
        F.col("value").cast("double").alias("value"),
    )


def _event_keys(vault: Vault) -> DataFrame:
    rule = tb.EVENT_POLICY.allow(tb.DEPARTMENTS.values, tb.EVENT_TYPES.values)
    return vault.user_keys(DEMO, rule)


def streamed_events_vault(spark: SparkSession, sf_dir: str) -> Vault:
    """Event lines in many files, ingested by a stream of several micro-batches."""

    def build() -> Vault:
        lines = record_lines(tb.event_records(spark, sf_dir).repartition(6), tb.EVENT_RECORDS)
        path = _written_lines(spark, lines, "event-lines")
        vault = Vault(spark, scratch_path(spark, "events"), tb.EVENT_RECORDS)
        started = ingest_stream(
            vault,
            stream_file_lines(spark, path, max_files_per_batch=3),
            DEMO,
            scratch_path(spark, "events-progress"),
            available_now=True,
        )
        run_to_end(*started)
        return vault

    return _once(spark, sf_dir, "events", build)


@query
def stream_ingest_equals_batch(spark, sf_dir):
    vault = streamed_events_vault(spark, sf_dir)
    return _typed_events(vault.open_all(_event_keys(vault)))


@query
def stream_index_search(spark, sf_dir):
    """Search over an index that grew by micro-batches."""
    vault = streamed_events_vault(spark, sf_dir)
    words = ["type=click", "type=purchase"]
    found = vault.search(words, DEMO.reader(), _event_keys(vault), disjunction=True)
    return _typed_events(found.records)


def _ended_events(spark, sf_dir) -> str:
    """Event lines in four numbered files, with an end line halfway; the files' ages are in no order."""
    events = tb.event_records(spark, sf_dir)
    half = tb.table(spark, sf_dir, "events").agg(F.floor((F.max("event_id") + 1) / 2).alias("half"))
    place = F.col("event_id").cast("double")
    ordered = events.select(place.alias("place"), F.to_json(F.struct(*events.columns)).alias("value"))
    end = half.select((F.col("half") - 0.5).alias("place"), F.lit(END_LINE).alias("value"))
    blank = half.select((F.col("half") - 0.75).alias("place"), F.lit("  ").alias("value"))
    lines = ordered.unionByName(end).unionByName(blank).repartitionByRange(4, "place").sortWithinPartitions("place")
    return _written_lines(spark, lines, "event-lines-with-end")


def _run_ended(vault: Vault, path: str, progress: str, files: int) -> None:
    lines = stream_file_lines(vault.spark, path, files, number=r"part-(\d+)")
    run_to_end(*ingest_stream(vault, lines, DEMO, progress, NUMBERED_ORDER, available_now=True))


@query
def stream_sentinel(spark, sf_dir):
    """Events streamed with an end line halfway, a file a batch in whatever order: the first half remains."""
    vault = Vault(spark, scratch_path(spark, "ended-events"), tb.EVENT_RECORDS)
    _run_ended(vault, _ended_events(spark, sf_dir), scratch_path(spark, "ended-progress"), 1)
    return _typed_events(vault.open_all(_event_keys(vault)))


@query
def stream_restarts(spark, sf_dir):
    """Records of three runs of one stream: drained, polled until the end line came, and drained with nothing left."""
    path, progress = scratch_path(spark, "growing"), scratch_path(spark, "growing-progress")
    events = tb.event_records(spark, sf_dir)
    half = tb.table(spark, sf_dir, "events").agg(F.floor((F.max("event_id") + 1) / 2)).scalar()
    vault = Vault(spark, scratch_path(spark, "growing-events"), tb.EVENT_RECORDS)
    early = F.col("event_id").cast("double") < half
    records: list[tuple[int, int]] = []

    def run(**options) -> None:
        started = ingest_stream(vault, stream_file_lines(spark, path), DEMO, progress, **options)
        records.append((len(records) + 1, run_to_end(*started).records))

    record_lines(events.where(early).repartition(2), tb.EVENT_RECORDS).write.text(path)
    run(available_now=True)
    record_lines(events.where(~early).repartition(2), tb.EVENT_RECORDS).write.mode("append").text(path)
    # Later than all lines by its file's age.
    spark.createDataFrame([(END_LINE,)], "value string").coalesce(1).write.mode("append").text(path)
    run(interval="1 second")
    run(available_now=True)
    return local_frame(spark, records, {"run": pa.int32(), "records": pa.int64()})


@query
def stream_behind_the_end(spark, sf_dir):
    """All events after a second run, and which of them the first run, up to the end line, had."""
    vault = Vault(spark, scratch_path(spark, "resumed-events"), tb.EVENT_RECORDS)
    path, progress = _ended_events(spark, sf_dir), scratch_path(spark, "resumed-progress")
    _run_ended(vault, path, progress, 3)
    first = staged(vault.open_all(_event_keys(vault)).select("event_id"), "first-run").withColumn("early", F.lit(True))
    _run_ended(vault, path, progress, 3)
    events = _typed_events(vault.open_all(_event_keys(vault)))
    early = first.select(F.col("event_id").cast("bigint").alias("event_id"), "early")
    return events.join(early, "event_id", "left").withColumn("early", F.coalesce("early", F.lit(False)))


# --- metrics -------------------------------------------------------------------------------------


@query
def vault_stages(spark, sf_dir):
    """Stages of a vault's own streamed ingest: batches, records, and whether their times and shares add up."""
    vault = streamed_events_vault(spark, sf_dir)
    shares = metrics.stage_shares(metrics.stage_totals(vault.stages()), whole="total")
    batches = vault.stages().groupBy("stage").agg(F.count(F.lit(1)).alias("batches"))
    sound = (F.col("micros") > 0) & (F.col("mean_micros") >= 0) & F.col("share").between(0, 100)
    joined = shares.join(batches, "stage").where(F.col("stage") != "headers")
    return joined.select("stage", "batches", "events", sound.alias("sound"))


@query
def stage_metrics(spark, sf_dir):
    """Event types taken as stages: events, time, mean, and share of one stage."""
    events = tb.table(spark, sf_dir, "events").select(
        F.col("event_type").alias("stage"),
        F.lit(1).alias("events"),
        F.floor(F.col("value") * 1000).cast("bigint").alias("micros"),
    )
    return metrics.stage_shares(metrics.stage_totals(events), whole="view")
