"""The sealed keyword index: build, grow and look up.

An entry row seals (word key, batch, blocks, postings) under the entry key; a
chain row seals one block of record ids under its word's key. Chain tokens are
``HMAC(word key, batch, block)``, so a reader who opened the entries of a word
computes all its chain tokens at once, in parallel, with no pointer to follow.
"""

from __future__ import annotations

from collections.abc import Callable
from contextlib import nullcontext
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sealdex.functions import crypto
from sealdex.functions.crypto import SecretRow, long_bytes, utf8
from sealdex.functions.terms import fold_query
from sealdex.operators import postings as P
from sealdex.operators.bounds import rows_if_few
from sealdex.operators.index_store import IndexStore, Run, Seal, current_revisions, flag_applicable, merged_number
from sealdex.operators.postings import BLOCK_RUN
from sealdex.session import side_by_side, staging

# Entries of one query the driver may hold (words of the query times batches).
FEW_ENTRIES = 10_000

# Most word-and-batch places, and most record ids, to pick single blocks by.
FEW_PLACES = 256
FEW_UIDS = 10_000

FIELD_BYTES = 32

# So many runs of a level become one of the next: a lookup meets fewer than
# FAN_OUT runs a level, and a posting is moved once a level.
FAN_OUT = 8

# About what a record id takes in a block, and what a table row takes besides.
POSTING_BYTES = 12
ROW_BYTES = 130


@dataclass(frozen=True)
class ReaderKeys:
    """Search side: finds and opens entries, and with them the word keys."""

    search: bytes

    def token_key(self) -> bytes:
        return crypto.derive(self.search, "sealdex word token")

    def entry_key(self) -> bytes:
        return crypto.derive(self.search, "sealdex entry value")

    def secrets(self, spark: SparkSession) -> SecretRow:
        return SecretRow(spark, {"token": self.token_key(), "entry": self.entry_key()})


@dataclass(frozen=True)
class WriterKeys(ReaderKeys):
    """Adds the key that word keys are derived from; it stays with writers."""

    word: bytes

    def secrets(self, spark: SparkSession) -> SecretRow:
        return SecretRow(
            spark,
            {
                "token": self.token_key(),
                "entry": self.entry_key(),
                "word": crypto.derive(self.word, "sealdex word key"),
                "nonce": crypto.derive(self.word, "sealdex nonce"),
                "terms": crypto.derive(self.word, "sealdex record terms"),
                "bad": crypto.derive(self.word, "quarantine"),
            },
        )


def word_token(secrets: SecretRow, word: Column) -> Column:
    return secrets.hmac("token", utf8(word))


# --- entry values --------------------------------------------------------------


def pack_entry(word_key: Column, batch: Column, blocks: Column, n: Column) -> Column:
    """Two 32-byte fields: the word key, and where its posting blocks are."""
    where = F.concat(long_bytes(batch), long_bytes(blocks), long_bytes(n))
    return F.concat(word_key, F.call_function("rpad", where, F.lit(FIELD_BYTES), F.lit(b"\x00")))


def unpack_entry(value: Column) -> list[Column]:
    def number(i: int) -> Column:
        at = FIELD_BYTES + 1 + 8 * i
        return F.conv(F.hex(F.substring(value, at, 8)), 16, 10).cast("bigint")

    return [
        F.substring(value, 1, FIELD_BYTES).alias("word_key"),
        number(0).alias("batch"),
        number(1).alias("blocks"),
        number(2).alias("n"),
    ]


def _entry_binding(token: Column, revision: Column) -> Column:
    return F.concat(token, long_bytes(revision.cast("bigint")))


def seal_entries(rows: DataFrame, secrets: SecretRow, batch: int) -> DataFrame:
    """(token, revision, sealed) from (token, revision, blocks, n)."""
    word_key = secrets.hmac("word", F.col("token"))
    value = pack_entry(word_key, F.lit(batch).cast("bigint"), F.col("blocks"), F.col("n"))
    bound = _entry_binding(F.col("token"), F.col("revision"))
    nonce = crypto.nonce_from(secrets.hmac("nonce", F.concat(bound, F.col("value"))))
    sealed = crypto.seal(F.col("value"), secrets.key("entry"), nonce, bound)
    return rows.select("token", "revision", value.alias("value")).select(
        "token", "revision", sealed.alias("sealed")
    )


def open_entries(rows: DataFrame, secrets: SecretRow) -> DataFrame:
    bound = _entry_binding(F.col("token"), F.col("revision"))
    value = crypto.open_or_fail(F.col("sealed"), secrets.key("entry"), bound)
    kept = [c for c in rows.columns if c not in ("sealed", "batch", "shard", "token")]
    opened = rows.select(*kept, value.alias("value"))
    return opened.select(*kept, *unpack_entry(F.col("value")))


# --- chain rows ----------------------------------------------------------------


def _chain_token(pads: Column, batch: Column, block: Column) -> Column:
    message = F.concat(long_bytes(batch), long_bytes(block))
    return crypto.hmac_padded(pads.getField("inner"), pads.getField("outer"), message)


def place_blocks(blocks: DataFrame, secrets: SecretRow, batch: int, token: Column | None = None) -> DataFrame:
    """(token, of, body) from (word, block, body): ``of`` is the word's token, which is ``token`` where it is known."""
    of = word_token(secrets, F.col("word")) if token is None else token
    keyed = blocks.select(of.alias("of"), "block", "body")
    keyed = keyed.select("of", "block", "body", crypto.hmac_pads(secrets.hmac("word", F.col("of"))).alias("pads"))
    return keyed.select(_chain_token(F.col("pads"), F.lit(batch).cast("bigint"), F.col("block")).alias("token"), "of", "body")


def seal_blocks(placed: DataFrame, secrets: SecretRow) -> DataFrame:
    """(token, sealed) of placed blocks."""
    keyed = placed.select("token", secrets.hmac("word", F.col("of")).alias("word_key"), utf8(F.col("body")).alias("body"))
    nonce = crypto.nonce_from(secrets.hmac("nonce", F.concat("token", "body")))
    sealed = crypto.seal(F.col("body"), F.col("word_key"), nonce, F.col("token"))
    return keyed.select("token", sealed.alias("sealed"))


def all_found(rows: DataFrame, keys: DataFrame) -> Column:
    """True, or the plan fails: whether ``rows`` are the chain rows of all ``keys``, each once.

    Compares the count and the combined hash of the tokens, two aggregates over
    the token column alone. Chain rows are bound to their tokens, so a row that
    was lost, doubled or put in another's place shows.
    """
    marks = [F.count(F.lit(1)).alias("n"), F.coalesce(F.bit_xor(F.xxhash64("token")), F.lit(0)).alias("all")]
    asked, found = keys.agg(F.struct(*marks).alias("s")).scalar(), rows.agg(F.struct(*marks).alias("s")).scalar()
    return F.when(asked == found, F.lit(True)).otherwise(_lost("boolean"))


def _lost(kind: str) -> Column:
    return F.raise_error(F.lit("the index has lost posting blocks: rebuild it from the records")).cast(kind)


def whole_chain(chain: DataFrame, keys: DataFrame) -> DataFrame:
    """The chain rows of many ``keys``, or the plan fails: each must be there, once.

    Says what :func:`all_found` says, row by row where the rows meet their keys, so
    that keys which are costly to compute are computed once. The failure is in the
    value itself: a filter beside later ones would let the join drop lost rows first.
    """
    copies = F.count(F.lit(1)).over(Window.partitionBy("token"))
    met = keys.join(chain.select("token", "sealed", copies.alias("copies")), "token", "left")
    sealed = F.when(F.col("copies") == 1, F.col("sealed")).otherwise(_lost("binary"))
    return met.withColumn("sealed", sealed).drop("copies")


def open_bodies(rows: DataFrame) -> DataFrame:
    """(word, body) from chain rows joined with their word and word key."""
    body = crypto.open_or_fail(F.col("sealed"), F.col("word_key"), F.col("token"))
    return rows.select("word", F.decode(body, "UTF-8").alias("body"))


def open_blocks(rows: DataFrame) -> DataFrame:
    """(word, uid) from chain rows joined with their word and word key."""
    return P.unpack_uids(open_bodies(rows))


def chain_keys(entries: DataFrame, spread: bool) -> DataFrame:
    """All chain tokens of the given entries: (word, word_key, token).

    Block numbers come from two nested ranges so that no row ever holds more
    than a run of them; ``spread`` puts the runs of a frequent word on many tasks.
    Words of one run stay where they are.
    """
    entries = entries.select("word", "word_key", "batch", "blocks")
    zero, last = F.lit(0).cast("bigint"), F.col("blocks") - 1
    pads = crypto.hmac_pads(F.col("word_key")).alias("pads")
    # Numbers are exploded as expressions: the optimizer would test a column's size first, where the
    # entries are read, and open each once more for it.
    if spread:
        # One run in place, or none; entries are tested for more in a scan of their own.
        only = F.when(F.col("blocks") <= BLOCK_RUN, F.sequence(zero, last))
        few = entries.select("word", "word_key", pads, "batch", F.explode(only).alias("block"))
        entries = entries.where(F.col("blocks") > BLOCK_RUN)
    firsts = F.explode(F.sequence(zero, last, F.lit(BLOCK_RUN).cast("bigint"))).alias("first")
    runs = entries.select("*", firsts)
    if spread:
        runs = runs.repartition("word", "batch", "first")
    own = F.sequence("first", F.least(F.col("first") + (BLOCK_RUN - 1), last))
    blocks = runs.select("word", "word_key", pads, "batch", F.explode(own).alias("block"))
    return _placed_keys(few.unionByName(blocks) if spread else blocks)


def chain_keys_within(entries: DataFrame, places: list[tuple[str, int, int]], uids: DataFrame) -> DataFrame:
    """Chain tokens of only those blocks that can hold one of ``uids``.

    An id's hash names its block for any block count, so a frequent word is
    looked up in as many blocks as there are ids, not in all it has.
    """
    each = F.array(
        *[
            F.struct(F.lit(w).alias("word"), F.lit(b).cast("bigint").alias("batch"), F.lit(n).cast("bigint").alias("blocks"))
            for w, b, n in places
        ]
    )
    wanted = uids.select("uid", F.inline(each)).select(
        "word", "batch", P.block_of(F.col("uid"), F.col("blocks")).alias("block")
    )
    keys = entries.select("word", "batch", "word_key", crypto.hmac_pads(F.col("word_key")).alias("pads"))
    return _placed_keys(wanted.distinct().join(F.broadcast(keys), ["word", "batch"]))


def _placed_keys(blocks: DataFrame) -> DataFrame:
    token = _chain_token(F.col("pads"), F.col("batch"), F.col("block"))
    return blocks.select("word", "word_key", token.alias("token"))


# --- the index -----------------------------------------------------------------


@dataclass(frozen=True)
class UpsertReport:
    batch: int
    words: int
    postings: int
    conflicts: int


@dataclass(frozen=True)
class FoundWords:
    """Opened entries of a query's words and, where few, what they say:
    the (word, batch, blocks) places and the postings of each word."""

    entries: DataFrame
    places: list[tuple[str, int, int]] | None = None
    postings_per_word: dict[str, int] | None = None

    @property
    def blocks(self) -> int | None:
        return None if self.places is None else sum(n for _, _, n in self.places)

    def only(self, words) -> FoundWords:
        places = None if self.places is None else [p for p in self.places if p[0] in words]
        return FoundWords(self.entries.where(F.col("word").isin(list(words))), places, self.postings_per_word)


class SealedIndex:
    def __init__(self, store: IndexStore, keys: ReaderKeys, block_size: int = P.BLOCK_SIZE,
                 split_above: int = P.SPLIT_ABOVE, fan_out: int = FAN_OUT):
        self.store = store
        self.fan_out = fan_out
        self.keys = keys
        self.block_size = block_size
        self.split_above = split_above
        self.spark = store.spark
        self.secrets = keys.secrets(store.spark)

    # --- growing ---

    def upsert(self, rows: DataFrame, batch: int | None = None, base: DataFrame | None = None,
               run: Run | None = None) -> UpsertReport:
        """Index (uid, words) rows as one batch.

        ``base`` is the (token, stored) state the caller's revisions build on, by
        default the store's own. Words that moved on since ``base`` are refused
        and proposed again against the present state, in the same batch: no
        other batch is touched. The tables take one writer at a time. ``run``: the
        rows are those of several batches, and make up that run. A batch that was
        merged into a run cannot be written by itself any more.
        """
        batch = (self.store.next_batch() if run is None else run.number) if batch is None else batch
        with self._together(), staging(self.spark, "upsert") as stage:
            if run is None:
                covering = self.run_of(batch)
                if covering is not None and covering.number != batch:
                    raise ValueError(f"batch {batch} is part of run {covering.number}: write that run")
            else:
                self.store.describe(run)
            report = self._upsert(rows, batch, base, stage, min(run.covers) if run else batch)
        self._merge_full_levels()
        return report

    def run_of(self, batch: int) -> Run | None:
        """The run that holds a batch."""
        return next((r for r in self._runs() if batch in r.covers), None)

    def _runs(self) -> list[Run]:
        return self.store.runs() if hasattr(self.store, "runs") else []

    def _together(self):
        return self.store.together() if hasattr(self.store, "together") else nullcontext()

    def _upsert(self, rows: DataFrame, batch: int, base: DataFrame | None, stage, before: int) -> UpsertReport:
        counted = P.with_blocks(P.record_word_counts(rows), self.block_size)
        # Words of several blocks are needed again; no word is staged in the clear.
        counted = counted.select(
            word_token(self.secrets, F.col("word")).alias("token"), "word_hash", "n", "blocks",
            F.when(F.col("blocks") > 1, self._hidden(F.col("word"))).alias("hidden"),
        )
        shown = crypto.open_or_fail(F.col("hidden"), self.secrets.key("nonce"), F.col("token"))
        counts = stage(counted, "word-counts").withColumn("word", F.decode(shown, "UTF-8"))
        totals = P.word_totals(counts)
        lost = None

        def entries() -> DataFrame:
            nonlocal lost
            stored = self._stored(counts.select("token"), before, stage)
            proposed = self._proposals(counts, stored if base is None else base)
            lost = None if base is None else self._refused(proposed, stored, stage)
            if lost is None:
                return proposed
            again = self._proposals(counts.join(lost, "token", "left_semi"), stored)
            return proposed.join(lost, "token", "left_anti").unionByName(again)

        self._write(lambda splits: P.packed_words(rows, splits), counts, totals, entries, batch)
        conflicts = 0 if lost is None else lost.count()
        return UpsertReport(batch, totals.words, totals.postings, conflicts)

    def _write(self, packed: Callable[[DataFrame | None], DataFrame], counts: DataFrame, totals: P.WordTotals,
               entries: Callable[[], DataFrame], batch: int, token: Column | None = None) -> None:
        """The chain, sketch and entry rows of a run, of postings packed with the words that are split.

        Three tables of their own: while one is planned or ends, the others use the cores.
        """

        def chain() -> None:
            threshold = totals.split_threshold(self.split_above)
            splits = P.split_words(counts, threshold) if totals.most > threshold else None
            blocks = place_blocks(P.cut_blocks(packed(splits), counts, splits), self.secrets, batch, token)
            size = totals.postings * POSTING_BYTES + totals.words * ROW_BYTES
            self._append(self.store.upsert_chain, blocks, batch, size, lambda placed: seal_blocks(placed, self.secrets))

        def entry() -> None:
            size = totals.words * ROW_BYTES
            self._append(self.store.append_entries, entries(), batch, size, lambda placed: seal_entries(placed, self.secrets, batch))

        def sketch() -> None:
            if hasattr(self.store, "append_sketch"):
                self.store.append_sketch(counts.select("token"), batch, totals.words)

        side_by_side(self.spark, [chain, entry, sketch])

    def _append(self, write, rows: DataFrame, batch: int, size: int, seal: Seal) -> None:
        if hasattr(self.store, "runs"):
            write(rows, batch, size, seal)
        else:
            write(seal(rows), batch, size)

    def _hidden(self, word: Column) -> Column:
        nonce = crypto.nonce_from(self.secrets.hmac("terms", utf8(word)))
        return crypto.seal(utf8(word), self.secrets.key("nonce"), nonce, word_token(self.secrets, word))

    def _stored(self, tokens: DataFrame, before: int, stage) -> DataFrame:
        """Latest stored revision of each token that earlier batches have.

        Sketches rule most new words out, so only those that may be stored are
        looked up; where none may, no entry is read.
        """
        if hasattr(self.store, "maybe_stored"):
            tokens = stage(self.store.maybe_stored(tokens, before), "maybe-stored")
            if tokens.isEmpty():
                return tokens.select("token", F.lit(0).alias("stored"))
        return current_revisions(self.store.get_entries(tokens, before=before))

    def _refused(self, proposed: DataFrame, stored: DataFrame, stage) -> DataFrame | None:
        """Tokens whose proposed revision no longer follows the stored one."""
        lost = stage(flag_applicable(proposed, stored).where(~F.col("applied")).select("token"), "stale-words")
        return None if lost.isEmpty() else lost

    def _proposals(self, counts: DataFrame, stored: DataFrame) -> DataFrame:
        """Next revision of each word in the batch."""
        revision = F.coalesce(F.col("stored") + 1, F.lit(0)).cast("int")
        return counts.join(stored, "token", "left").select("token", revision.alias("revision"), "blocks", "n")

    # --- merging ---

    def _merge_full_levels(self) -> None:
        while True:
            levels: dict[int, list[Run]] = {}
            for run in self._runs():
                levels.setdefault(run.level, []).append(run)
            full = [runs for _, runs in sorted(levels.items()) if len(runs) >= self.fan_out]
            if not full:
                return
            chosen = sorted(full[0], key=lambda r: max(r.covers))[: self.fan_out]
            # What would fill the next level is merged with that at once: no posting moves twice.
            while len(above := levels.get(max(r.level for r in chosen) + 1, [])) == self.fan_out - 1:
                chosen = above + chosen
            self.merge(chosen)

    def merge(self, runs: list[Run]) -> Run:
        """Make one run of several: a word's postings in blocks of their own, under its last revision.

        Readers see either the old runs or the new one. Postings are grouped as
        when a batch is indexed, so a hot word spreads over as many tasks as it has blocks.
        """
        covers = tuple(sorted(b for r in runs for b in r.covers))
        level = max(r.level for r in runs) + 1
        run = Run(merged_number(level, covers), level, covers)
        part = self.store.only(runs)
        with self._together(), staging(self.spark, "merge") as stage:
            entries = part.entries().withColumn("key", F.col("token")).select("key", "token", "revision", "sealed")
            opened = open_entries(entries, self.secrets)
            word = F.base64("key").alias("word")
            totals = P.by_word_hash(opened.select(word, F.col("key").alias("token"), "n", "revision")).groupBy("word_hash", "word", "token")
            counts = P.with_blocks(totals.agg(F.sum("n").alias("n"), F.max("revision").alias("revision")), self.block_size)
            counts = stage(counts, "word-counts")
            merged = P.word_totals(counts)
            # Looking for words of more than a run of blocks opens all entries once more: only where there may be one.
            keys = chain_keys(opened.select(word, "word_key", "batch", "blocks"), spread=merged.most > BLOCK_RUN * self.block_size)
            bodies = open_bodies(whole_chain(part.chain(), keys))
            self.store.describe(run)
            self._write(lambda splits: P.packed_bodies(bodies, splits), counts, merged, lambda: counts.select("token", "revision", "blocks", "n"), run.number, F.unbase64("word"))
            self.store.drop(runs)
        return run

    # --- looking up ---

    def query_tokens(self, words: list[str]) -> DataFrame:
        rows = [(w, crypto.mac(self.keys.token_key(), w.encode("utf-8"))) for w in words]
        return crypto.local_frame(self.spark, rows, {"word": pa.string(), "token": pa.binary()})

    def find_words(self, words: list[str]) -> FoundWords:
        opened = open_entries(self.store.get_entries(self.query_tokens(words)), self.secrets)
        opened = opened.select("word", "word_key", "batch", "blocks", "n")
        rows = rows_if_few(opened, FEW_ENTRIES)
        if rows is None:
            return FoundWords(opened)
        frame = crypto.local_frame(
            self.spark,
            [(r.word, bytes(r.word_key), r.batch, r.blocks, r.n) for r in rows],
            {"word": pa.string(), "word_key": pa.binary()}
            | {n: pa.int64() for n in ("batch", "blocks", "n")},
        )
        per_word = {w: sum(r.n for r in rows if r.word == w) for w in {r.word for r in rows}}
        return FoundWords(frame, [(r.word, r.batch, r.blocks) for r in rows], per_word)

    def postings(self, found: FoundWords) -> DataFrame:
        """(word, uid) of the found words."""
        spread = found.blocks is None or found.blocks > BLOCK_RUN
        keys = chain_keys(found.entries, spread)
        if found.blocks is None and hasattr(self.store, "chain"):
            return P.unpack_many(open_bodies(whole_chain(self.store.chain(), keys)))
        return open_blocks(self._whole(self.store.get_chain(keys), keys))

    def _whole(self, rows: DataFrame, keys: DataFrame) -> DataFrame:
        return rows.where(all_found(rows, keys))

    def postings_of(self, found: FoundWords, uids: DataFrame) -> DataFrame:
        """(word, uid) of the found words, for some ids (a broadcastable frame)."""
        rows = None
        if found.places is not None and len(found.places) <= FEW_PLACES:
            rows = rows_if_few(uids.select("uid"), FEW_UIDS)
        if rows is not None:
            held = [(bytes(r["uid"]),) for r in rows]
            uids = crypto.local_frame(self.spark, held, {"uid": pa.binary()})
        if rows is not None and len(rows) * len(found.places) < found.blocks:
            keys = chain_keys_within(found.entries, found.places, uids)
            postings = open_blocks(self._whole(self.store.get_chain(keys), keys))
        else:
            postings = self.postings(found)
        return postings.join(F.broadcast(uids), "uid", "left_semi")

    def lookup(self, words) -> DataFrame:
        """(word, uid) of every given word that the index knows."""
        return self.postings(self.find_words(fold_query(words)))
