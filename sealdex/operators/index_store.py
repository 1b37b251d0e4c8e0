"""Where the index tables live: lookups, conditional upserts, runs, truncation.

``entry`` has a row per word and run, ``chain`` a row per posting block, ``sketch``
a few rows per run that tell which words it surely has not. A run holds one batch, or
the batches that were merged into it. All are Parquet folders under
``<root>/gen=<g>/<table>/batch=<folder>``, and the ledger says which of them count:
readers see a run whole or not at all, and a run that is written again takes another
folder. Truncating or rebuilding starts a new generation, which readers follow once
it is published.

Tokens are keyed hashes and hence uniform, so a token's leading bits say where
its row goes: every file of a batch holds one narrow token range, and files lie
in folders by token prefix. A lookup of few tokens lists few folders and opens
few files. Larger batches get more files and longer prefixes; readers compare a
token with whatever prefix a folder has.
"""

from __future__ import annotations

import copy
from collections.abc import Callable
from contextlib import AbstractContextManager
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sealdex.operators import sketch
from sealdex.operators.bounds import rows_if_few
from sealdex.operators.ledger import Ledger, Piece, batch_in
from sealdex.session import delete_path, started_folders

ENTRY_SCHEMA = T.StructType(
    [
        T.StructField("token", T.BinaryType()),
        T.StructField("revision", T.IntegerType()),
        T.StructField("sealed", T.BinaryType()),
    ]
)
CHAIN_SCHEMA = T.StructType(
    [T.StructField("token", T.BinaryType()), T.StructField("sealed", T.BinaryType())]
)
_PLACEMENT = [T.StructField("batch", T.LongType()), T.StructField("shard", T.StringType())]

# Up to this many tokens a lookup names them to the scan; beyond, it joins.
FEW_TOKENS = 512

# Up to this many rows of an upsert travel to the entries; beyond, both are shuffled.
FEW_UPSERTS = 100_000

# Size a file is aimed at, and the least worth a task of its own.
FILE_BYTES = 256 << 20
TASK_BYTES = 2 << 20
MAX_FILES = 1 << 16

# Folder of a batch too small to be divided.
_WHOLE = "_"

# A merged run's level stands above its highest batch in its number.
_LEVEL_BITS = 34

# Numbers from here on are of batches that were not numbered in turn.
SPECIAL = 1 << (_LEVEL_BITS - 1)


# Makes the stored rows of rows that carry their token, once these are where they are written.
Seal = Callable[[DataFrame], DataFrame]


class IndexStore(Protocol):
    """What an index needs from its tables; every argument and result is a DataFrame.

    A store may also offer :class:`RunStore`; without it batches are never merged,
    and every word of a batch is looked up.
    """

    spark: SparkSession

    def create(self) -> None: ...

    def truncate(self) -> None: ...

    def begin(self) -> IndexStore:
        """Empty tables that take the place of the present ones once published."""
        ...

    def publish(self) -> None: ...

    def next_batch(self) -> int: ...

    def entries(self, before: int | None = None) -> DataFrame: ...

    def get_entries(self, keys: DataFrame, before: int | None = None) -> DataFrame: ...

    def get_chain(self, keys: DataFrame) -> DataFrame: ...

    def upsert_entries(self, rows: DataFrame, batch: int) -> DataFrame: ...

    def append_entries(self, rows: DataFrame, batch: int, size: int | None = None) -> None: ...

    def upsert_chain(self, rows: DataFrame, batch: int, size: int | None = None) -> None: ...

    def row_counts(self) -> DataFrame: ...


@dataclass(frozen=True)
class Run:
    """A batch, or batches that were merged: its number, how often, and of what."""

    number: int
    level: int
    covers: tuple[int, ...]


class RunStore(Protocol):
    """Its ``append_entries`` and ``upsert_chain`` also take a :data:`Seal`."""

    def chain(self) -> DataFrame: ...

    def runs(self) -> list[Run]: ...

    def describe(self, run: Run) -> None:
        """Say what the run being written covers, before its entries are appended."""
        ...

    def only(self, runs: list[Run]) -> IndexStore:
        """The same store as if it held nothing but these runs."""
        ...

    def drop(self, runs: list[Run]) -> None: ...

    def append_sketch(self, tokens: DataFrame, batch: int, words: int) -> None: ...

    def maybe_stored(self, tokens: DataFrame, before: int) -> DataFrame:
        """Those of ``tokens`` that the sketches of earlier runs do not rule out."""
        ...

    def together(self) -> AbstractContextManager:
        """Writes inside become visible at once."""
        ...


def merged_number(level: int, covers) -> int:
    """Number of a merged run; apart from all batch numbers, so that its chain rows are its own."""
    return (level << _LEVEL_BITS) | max(covers)


def current_revisions(entries: DataFrame) -> DataFrame:
    """Latest revision of each token."""
    return entries.groupBy("token").agg(F.max("revision").alias("stored"))


def flag_applicable(rows: DataFrame, stored: DataFrame) -> DataFrame:
    """Add ``applied``: a first revision needs an absent token, any other needs
    the stored revision to be the one just before it."""
    absent = (F.col("revision") == 0) & F.col("stored").isNull()
    successor = F.col("stored") == F.col("revision") - 1
    applied = F.coalesce(absent | successor, F.lit(False))
    return rows.join(stored, "token", "left").withColumn("applied", applied).drop("stored")


def shard_digits(files: int) -> int:
    """Prefix length that puts up to about 32 files of a batch into one folder."""
    return next(d for d in range(4) if files <= 32 * 16**d or d == 3)


def token_shard(token: Column, digits: int) -> Column:
    return F.lower(F.substring(F.hex(token), 1, digits)) if digits else F.lit(_WHOLE)


def token_slot(token: Column, slots: int) -> Column:
    """Which of ``slots`` equal ranges of the token space a token lies in."""
    lead = F.conv(F.hex(F.substring(token, 1, 4)), 16, 10).cast("bigint")
    return F.shiftright(lead * F.lit(slots).cast("bigint"), 32).cast("int")


class ParquetIndexStore:
    def __init__(self, spark: SparkSession, root: str, file_bytes: int = FILE_BYTES,
                 generation: int | None = None, ledger: Ledger | None = None):
        """Follows the latest published generation unless bound to one.

        ``ledger``: that of a larger whole whose commits the index is part of.
        """
        self.spark = spark
        self.root = root.rstrip("/")
        self.file_bytes = file_bytes
        self.generation = generation
        self.ledger = ledger or Ledger(spark, f"{self.root}/ledger")
        self._only: frozenset[int] | None = None

    # --- layout ---

    def _generation(self) -> int | None:
        return self.ledger.fact("generation") if self.generation is None else self.generation

    def _table(self, table: str) -> str:
        generation = self._generation()
        if generation is None:
            raise ValueError(f"no index at {self.root}; call create() first")
        return f"gen={generation}/{table}"

    def _pieces(self, table: str, before: int | None = None) -> list[Piece]:
        pieces = self.ledger.pieces(self._table(table))
        if self._only is not None:
            pieces = [p for p in pieces if p.batch in self._only]
        if before is not None:
            covers = {r.number: r.covers for r in self.runs()}
            pieces = [p for p in pieces if max(covers.get(p.batch, (p.batch,))) < before]
        return pieces

    def _read(self, table: str, schema: T.StructType, before: int | None = None) -> DataFrame:
        folder = f"{self.root}/{self._table(table)}"
        visible = [f"{folder}/batch={p.folder}" for p in self._pieces(table, before)]
        full = T.StructType(schema.fields + _PLACEMENT)
        if not visible:
            # A false filter lets the optimizer drop joins with the empty table.
            return self.spark.createDataFrame([], full).where(F.lit(False))
        return self.spark.read.schema(full).option("basePath", folder).parquet(*visible)

    def _files(self, size: int | None) -> int:
        if size is None:
            return int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        for_size = -(-size // self.file_bytes)
        for_cores = min(self.spark.sparkContext.defaultParallelism, -(-size // TASK_BYTES))
        return min(max(for_size, for_cores, 1), MAX_FILES)

    def _new(self, table: str, batch: int) -> tuple[str, int]:
        parent = f"{self.root}/{self._table(table)}"
        folder = self.ledger.new_folder(parent, batch)
        return f"{parent}/batch={folder}", folder

    def _write(self, rows: DataFrame, schema: T.StructType, table: str, batch: int, size: int | None, seal: Seal | None) -> None:
        path, folder = self._new(table, batch)
        files = self._files(size)
        placed = rows.repartitionById(files, token_slot(F.col("token"), files))
        # Ciphertext does not shrink on the wire: rows travel as they are and are sealed where they lie.
        stored = (placed if seal is None else seal(placed)).select(schema.fieldNames())
        (
            stored.withColumn("shard", token_shard(F.col("token"), shard_digits(files)))
            .sortWithinPartitions("shard", "token")
            .write.partitionBy("shard")
            .parquet(path)
        )
        self.ledger.put(Piece(self._table(table), batch, folder))

    # --- life cycle ---

    def create(self) -> None:
        if self._generation() is None:
            self.truncate()

    def truncate(self) -> None:
        self.begin().publish()

    def begin(self) -> ParquetIndexStore:
        started = self.ledger.fact("generations", 0)
        self.ledger.note("generations", started + 1)
        return ParquetIndexStore(self.spark, self.root, self.file_bytes, started, self.ledger)

    def publish(self) -> None:
        """Make a generation begun earlier the one that readers follow."""
        with self.ledger.together() as state:
            state.facts["generation"] = self.generation
            mine = f"gen={self.generation}/"
            for held in (state.pieces, state.facts):
                for name in [n for n in held if n.startswith("gen=") and not n.startswith(mine)]:
                    del held[name]

    def next_batch(self) -> int:
        held = [batch_in(p.folder) for t in ("entry", "chain") for p in self._pieces(t) if p.batch < 1 << _LEVEL_BITS]
        covered = [b for r in self.runs() for b in r.covers]
        return max([b for b in [*held, *covered] if b < SPECIAL], default=0) + 1

    def together(self):
        return self.ledger.together()

    def tidy(self) -> int:
        """Delete the folders that no kept commit names; how many there were."""
        gone = 0
        for name in started_folders(self.spark, self.root, "gen"):
            for table in ("entry", "chain", "sketch"):
                for path in self.ledger.unused(f"gen={name}/{table}", f"{self.root}/gen={name}/{table}"):
                    delete_path(self.spark, path)
                    gone += 1
        return gone

    # --- runs ---

    def runs(self) -> list[Run]:
        """What the entries are of, by number; a batch not described otherwise is a run of its own."""
        said = self.ledger.fact(f"{self._table('runs')}", {})
        numbers = [p.batch for p in self.ledger.pieces(self._table("entry")) if self._only is None or p.batch in self._only]
        known = {n: said.get(str(n), (0, (n,))) for n in numbers}
        return [Run(n, level, tuple(covers)) for n, (level, covers) in known.items()]

    def describe(self, run: Run) -> None:
        with self.ledger.together() as state:
            state.facts.setdefault(self._table("runs"), {})[str(run.number)] = [run.level, list(run.covers)]

    def only(self, runs: list[Run]) -> ParquetIndexStore:
        part = copy.copy(self)
        part._only = frozenset(r.number for r in runs)
        return part

    def drop(self, runs: list[Run]) -> None:
        with self.ledger.together() as state:
            for table in ("entry", "chain", "sketch"):
                self.ledger.drop(self._table(table), [r.number for r in runs])
            for run in runs:
                state.facts.get(self._table("runs"), {}).pop(str(run.number), None)

    def append_sketch(self, tokens: DataFrame, batch: int, words: int) -> None:
        path, folder = self._new("sketch", batch)
        slots = sketch.slots_for(words)
        sketch.built(tokens, slots).write.parquet(path)
        self.ledger.put(Piece(self._table("sketch"), batch, folder, {"slots": slots}))

    def maybe_stored(self, tokens: DataFrame, before: int) -> DataFrame:
        root = f"{self.root}/{self._table('sketch')}"
        sketches = {p.batch: p for p in self._pieces("sketch")}
        told: dict[int, list[str]] = {}
        for piece in self._pieces("entry", before):
            known = sketches.get(piece.batch)
            if known is None:
                return tokens
            told.setdefault(known.info["slots"], []).append(f"{root}/batch={known.folder}")
        return sketch.possible(tokens, told)

    # --- reads ---

    def entries(self, before: int | None = None) -> DataFrame:
        return self._read("entry", ENTRY_SCHEMA, before)

    def chain(self) -> DataFrame:
        return self._read("chain", CHAIN_SCHEMA)

    def get_entries(self, keys: DataFrame, before: int | None = None) -> DataFrame:
        return _lookup(self.entries(before), keys)

    def get_chain(self, keys: DataFrame) -> DataFrame:
        return _lookup(self.chain(), keys)

    def row_counts(self) -> DataFrame:
        """Words and posting blocks stored, as one row."""
        words = self.entries().agg(F.count_distinct("token").alias("entries"))
        blocks = self.chain().agg(F.count(F.lit(1)).alias("chain_rows"))
        return words.select("entries", blocks.scalar().alias("chain_rows"))

    # --- writes ---

    def upsert_entries(self, rows: DataFrame, batch: int) -> DataFrame:
        """Store the rows whose revision fits; the result tells which did.

        The comparison is pinned to the batches before this one, so reading the
        result later does not see this batch's own rows.
        """
        # Rows meet the revisions once. Only where they are few are the entries looked up for them before.
        tokens, entries = rows.select("token"), self.entries(before=batch)
        if tokens.limit(FEW_UPSERTS + 1).count() <= FEW_UPSERTS:
            entries = _lookup(entries, F.broadcast(tokens))
        stored = current_revisions(entries)
        flagged = flag_applicable(rows, stored)
        self.append_entries(flagged.where("applied"), batch)
        return flagged.select("token", "revision", "applied")

    def append_entries(self, rows: DataFrame, batch: int, size: int | None = None, seal: Seal | None = None) -> None:
        """Store rows whose revisions were computed from this store's own state.

        ``size`` is about how many bytes the rows take; it decides on the files.
        """
        self._write(rows, ENTRY_SCHEMA, "entry", batch, size, seal)

    def upsert_chain(self, rows: DataFrame, batch: int, size: int | None = None, seal: Seal | None = None) -> None:
        self._write(rows, CHAIN_SCHEMA, "chain", batch, size, seal)


def _lookup(table: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows of ``table`` for the tokens in ``keys``, with the key columns added.

    Few tokens become literals, which prune shards, files and row groups before
    the join. A token is what the store holds in the clear, so naming it in a
    plan reveals nothing the table does not.
    """
    few = rows_if_few(keys.select("token"), FEW_TOKENS)
    if few is None:
        return table.join(keys, "token")
    tokens = sorted({bytes(r["token"]) for r in few})
    if not tokens:
        return table.where(F.lit(False)).join(keys, "token")
    named = F.array(*[F.lit(t.hex()) for t in tokens])
    in_shard = (F.col("shard") == _WHOLE) | F.exists(named, lambda t: t.startswith(F.col("shard")))
    return table.where(in_shard & F.col("token").isin(tokens)).join(F.broadcast(keys), "token")
