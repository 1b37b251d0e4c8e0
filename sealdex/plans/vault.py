"""The jobs a user runs: ingest, search, open everything, re-index."""

from __future__ import annotations

import os
from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from sealdex.functions.crypto import local_frame
from sealdex.functions.policy import Rule
from sealdex.functions.uid import assign_uids, uid_file, uid_pos
from sealdex.operators import sealing
from sealdex.operators.boolean import find
from sealdex.operators.index import FAN_OUT, ReaderKeys, SealedIndex, UpsertReport, WriterKeys
from sealdex.operators.index_store import SPECIAL, IndexStore, ParquetIndexStore, Run, merged_number
from sealdex.operators.keyring import Keyring, issue_user_keys, keyring_for, seal_classes, seal_headers
from sealdex.operators.layout import rows_per_file
from sealdex.operators.ledger import BATCH_BITS, Ledger, Piece
from sealdex.operators.metrics import StageClock
from sealdex.operators.record_store import RecordStore
from sealdex.operators.sealing import LINE_BODY, LINE_CLASS, PLACE
from sealdex.operators.specs import RecordSpec
from sealdex.session import staged
from sealdex.sources.records import FAULT, LINE, judged_lines


# Batches of lines that waited behind the end of a stream count from here, apart from all others.
WAITED = SPECIAL

# Records of one key epoch up to which derived 96-bit nonces hardly ever meet.
EPOCH_RECORDS = 1 << 32


@dataclass(frozen=True)
class Secrets:
    """All key material of a vault. ``search`` alone goes to searching users."""

    master: bytes
    search: bytes
    word: bytes

    @staticmethod
    def draw() -> Secrets:
        return Secrets(os.urandom(32), os.urandom(32), os.urandom(32))

    def reader(self) -> ReaderKeys:
        return ReaderKeys(self.search)

    def writer(self) -> WriterKeys:
        return WriterKeys(self.search, self.word)


@dataclass(frozen=True)
class IngestReport:
    batch: int
    records: int
    index: UpsertReport
    rejected: int = 0
    waiting: int = 0


@dataclass(frozen=True)
class SearchResult:
    hits: DataFrame
    records: DataFrame

    def counts(self) -> DataFrame:
        """One row: records found in the index, and those this user could open."""
        # Opened records are some of the hits, each once: two counts, no join.
        opened = self.records.agg(F.count(F.lit(1)).alias("opened"))
        return self.hits.agg(F.count(F.lit(1)).alias("found")).select("found", opened.scalar().alias("opened"))


def _run_of(batches: list[int]) -> Run:
    level = 1
    while FAN_OUT**level < len(batches):
        level += 1
    return Run(merged_number(level, batches), level, tuple(batches))


class Vault:
    """Sealed records of one kind, with their keyword index."""

    def __init__(self, spark: SparkSession, root: str, spec: RecordSpec,
                 index_store: IndexStore | None = None, tolerant: bool = False):
        self.spark = spark
        self.spec = spec
        self.root = root.rstrip("/")
        self.ledger = Ledger(spark, f"{self.root}/ledger")
        self.records = RecordStore(spark, f"{self.root}/store", spec.part_names(), tolerant, self.ledger)
        self.index_store = index_store or ParquetIndexStore(spark, f"{self.root}/index", ledger=self.ledger)
        self.index_store.create()
        self.clock = StageClock(spark)

    # --- writing ---

    def ingest(self, records: DataFrame, secrets: Secrets, batch: int | None = None,
               epoch: str | None = None, drop_indexes: bool = False,
               max_file_mb: int | None = None) -> IngestReport:
        """Seal records, append them, then index what was written.

        Records, quarantine and index become visible in one commit. Each batch is
        its own key epoch unless one is named; what would take an epoch beyond
        ``EPOCH_RECORDS`` is an error, and not committed. Re-running a batch number replaces that batch at the
        commit; readers go on with the old one until then.
        """
        return self._ingest(records, secrets, batch, epoch, drop_indexes, max_file_mb)

    def ingest_lines(self, lines: DataFrame, secrets: Secrets, strict: bool = False, **options) -> IngestReport:
        """Like :meth:`ingest`, for JSON lines. Each line is parsed once: those that are
        no records are sealed in the same pass into the batch's quarantine and
        counted; see :meth:`rejected`."""
        judged = judged_lines(lines, self.spec, strict)
        bad = F.when(F.col(FAULT).isNotNull(), F.lit(sealing.REJECTED))
        return self._ingest(self._as_lines(judged, bad), secrets, **options)

    def _as_lines(self, judged: DataFrame, line_class: Column) -> DataFrame:
        body = sealing.line_body(F.col(LINE), F.col(FAULT))
        more = [PLACE] if PLACE in judged.columns else []
        return judged.select(*self.spec.fields, *more, line_class.alias(LINE_CLASS), body.alias(LINE_BODY))

    def _ingest(self, rows: DataFrame, secrets: Secrets, batch: int | None = None, epoch: str | None = None,
                drop_indexes: bool = False, max_file_mb: int | None = None,
                again: Callable[[], DataFrame | None] | None = None, **info) -> IngestReport:
        """``again``: asked once the rows are written; rows that it gives are written in their place."""
        with self.ledger.together():
            begun = self.clock.mark()
            if drop_indexes:
                self.index_store.truncate()
            if batch is None:
                batch = max(self.records.next_batch(), self.index_store.next_batch())
            epoch = str(batch) if epoch is None else epoch
            classes = self._classes(secrets, epoch)
            good, bad, waiting = self._append(rows, classes, secrets, batch, max_file_mb, **info)
            rows = None if again is None else again()
            if rows is not None:
                good, bad, waiting = self._append(rows, classes, secrets, batch, max_file_mb, **info)
            if good + self.epoch_records(epoch, batch) > EPOCH_RECORDS:
                # Nothing was committed: what was sealed is in no table that anyone reads.
                raise ValueError(f"more than {EPOCH_RECORDS} records in key epoch {epoch}: split batch {batch} or name another epoch")
            self._set_aside(batch, bad)
            with self.clock.stage("index"):
                report = self._index_batch(batch, classes, secrets)
            # Part of the commit: a batch that runs again replaces its figures too.
            self.ledger.note(f"stages/{batch}", {"epoch": epoch, "records": good, "lines": good + bad + waiting, "micros": self.clock.since(begun)})
        return IngestReport(batch, good, report, bad, waiting)

    def epoch_records(self, epoch: str, but: int | None = None) -> int:
        """Records that committed batches, one left out, sealed in a key epoch."""
        facts = self.ledger.state().facts
        said = (f for n, f in facts.items() if n.startswith("stages/") and n != f"stages/{but}")
        return sum(f["records"] for f in said if f["epoch"] == epoch)

    def stages(self) -> DataFrame:
        """(batch, stage, events, micros) of every committed ingest, by batch or stream: what each
        stage took, and ``total`` for the whole; events are the records."""
        rows = []
        for name, said in self.ledger.state().facts.items():
            if name.startswith("stages/"):
                rows += [(int(name[7:]), stage, said["records"], micros) for stage, micros in said["micros"].items()]
        schema = {"batch": pa.int64(), "stage": pa.string(), "events": pa.int64(), "micros": pa.int64()}
        return local_frame(self.spark, rows, schema)

    def _classes(self, secrets: Secrets, epoch: str) -> DataFrame:
        """Class keys of an epoch, whose wrapped form is written before its first records."""
        if not self.records.has_headers(epoch):
            with self.clock.stage("headers"):
                headers = seal_headers(self.spark, self.spec, secrets.master, epoch)
                self.records.append_headers(headers, epoch)
        return seal_classes(self.spark, self.spec, secrets.master, epoch)

    def _append(self, rows: DataFrame, classes: DataFrame, secrets: Secrets, batch: int, max_file_mb: int | None,
                **info) -> tuple[int, int, int]:
        """Seal and write rows in one pass: how many records, bad lines and waiting lines."""
        most = 0
        if max_file_mb is not None:
            most = rows_per_file(rows, sealing.planned_size(self.spec), max_file_mb << 20)
        line_class = F.col(LINE_CLASS) if LINE_CLASS in rows.columns else F.lit(None).cast("string")
        seen = Observation()
        counts = {"good": line_class.isNull(), "bad": line_class == sealing.REJECTED, "waiting": line_class == sealing.WAITING}
        numbered = assign_uids(rows, batch).observe(seen, *[F.count_if(c).alias(n) for n, c in counts.items()])
        sealed = sealing.seal_records(numbered, self.spec, classes, secrets.writer().secrets(self.spark))
        with self.clock.stage("records"):
            self.records.append(sealed, batch, most, **info)
        return tuple(seen.get[n] for n in counts)

    def _set_aside(self, batch: int, bad: int) -> None:
        """Keep a batch's bad lines in a table of their own, sealed as they are."""
        root = f"{self.root}/quarantine"
        if not bad:
            self.ledger.drop("quarantine", [batch])
            return
        folder = self.ledger.new_folder(root, batch)
        lines = self.records.read_lines(sealing.REJECTED, [batch]).select(F.col(sealing.SEALED_LINE).alias("sealed"))
        lines.write.parquet(f"{root}/batch={folder}")
        self.ledger.put(Piece("quarantine", batch, folder))

    def rejected(self, secrets: Secrets) -> DataFrame:
        """(batch, value, fault) of every line set aside."""
        root, pieces = f"{self.root}/quarantine", self.ledger.pieces("quarantine")
        if not pieces:
            return self.spark.createDataFrame([], "batch long, value string, fault string")
        stored = self.spark.read.schema("sealed binary, batch long").option("basePath", root)
        rows = stored.parquet(*[f"{root}/batch={p.folder}" for p in pieces])
        batch = F.col("batch").bitwiseAND(F.lit((1 << BATCH_BITS) - 1)).alias("batch")
        lines = rows.select(batch, F.col("sealed").alias(sealing.SEALED_LINE))
        return sealing.open_lines(lines, secrets.writer().secrets(self.spark), "batch")

    def reindex(self, secrets: Secrets) -> UpsertReport:
        """Build the index again from the sealed records alone, as one run.

        Searches go on with the old index until the new one is complete. A batch
        that runs again later has the run that holds it rebuilt.
        """
        with self.ledger.together():
            store = self.index_store.begin()
            covers = self.records.batches()
            report = self._index(store, covers, self.records.headers(), secrets, None if len(covers) < 2 else _run_of(covers))
            store.publish()
        return report

    def _index_batch(self, batch: int, classes: DataFrame, secrets: Secrets) -> UpsertReport:
        """Index a batch that was written, with all others of its run if it was merged into one."""
        run = SealedIndex(self.index_store, secrets.reader()).run_of(batch)
        if run is None or run.number == batch:
            return self._index(self.index_store, [batch], classes, secrets)
        return self._index(self.index_store, list(run.covers), self.records.headers(), secrets, run)

    def _index(self, store: IndexStore, batches: list[int], classes: DataFrame, secrets: Secrets,
               run: Run | None = None) -> UpsertReport:
        writer = secrets.writer()
        tokens = classes.select("class_token").distinct()
        rows = sealing.open_terms(self.records.read(batches), tokens, writer.secrets(self.spark))
        number = max(batches, default=1) if run is None else run.number
        return SealedIndex(store, writer).upsert(rows, number, run=run)

    def tidy(self) -> int:
        """Delete what no reader can still be using: folders that the last commits do not name."""
        gone = self.records.tidy()
        return gone + (self.index_store.tidy() if hasattr(self.index_store, "tidy") else 0)

    # --- reading ---

    def user_keys(self, secrets: Secrets, rule: Rule, user: str = "user") -> DataFrame:
        return issue_user_keys(self.spark, self.spec.policy, secrets.master, {user: rule})

    def unlock(self, user_keys: DataFrame) -> Keyring:
        """Unwrap a user's keyring once, for several searches or scans.

        It covers the key epochs present now; unlock again after a new one.
        """
        return keyring_for(user_keys, self.records.headers(), self.spec)

    def _keyring(self, keys: DataFrame | Keyring) -> Keyring:
        return keys if isinstance(keys, Keyring) else self.unlock(keys)

    def find(self, words, keys: ReaderKeys, disjunction: bool = False) -> DataFrame:
        """(file, pos) of the matching records, without opening any."""
        ids = find(SealedIndex(self.index_store, keys), words, disjunction)
        return ids.select(uid_file(F.col("uid")).alias("file"), uid_pos(F.col("uid")).alias("pos"))

    def search(self, words, keys: ReaderKeys, user_keys: DataFrame | Keyring,
               disjunction: bool = False) -> SearchResult:
        """Matching records, as far as the user's keys open them."""
        with self.ledger.pinned():
            with self.clock.stage("find"):
                hits = staged(self.find(words, keys, disjunction), "hits")
            with self.clock.stage("choose files"):
                chosen = self.records.read_selected(hits)
            return SearchResult(hits, sealing.open_records(chosen, self._keyring(user_keys), self.spec))

    def open_all(self, user_keys: DataFrame | Keyring) -> DataFrame:
        """Every record the user's keys open, without the index."""
        return sealing.open_records(self.records.read(), self._keyring(user_keys), self.spec)
