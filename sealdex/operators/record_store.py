"""Sealed records and their wrapped keys as Parquet tables.

``records/batch=<folder>/class_token=<t>`` holds one column per part, so a reader
opens only the classes and parts a keyring allows. ``headers/epoch=<e>`` holds
the wrapped class keys of a key epoch and is written before its first records.
The ledger says which folders of records count, so a batch that runs again
takes the place of the old one at its commit, and readers of the old one go on.

Lines that are no records, or that wait behind the end of a stream, are sealed in
the same pass into classes of their own, which only their owners read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sealdex.functions.uid import batch_of, partition_of
from sealdex.operators.bounds import broadcast_if_few, rows_if_few
from sealdex.operators.index_store import SPECIAL
from sealdex.operators.keyring import HEADER_SCHEMA
from sealdex.operators.ledger import Ledger, Piece
from sealdex.operators.sealing import LINE_CLASSES, PLACE, SEALED_LINE, TERMS
from sealdex.session import delete_path, published_folders

# Up to this many hit files a fetch names them to the scan; beyond, it joins.
FEW_FILES = 1_000

# Up to this many hits travel to the records (about 80 bytes each); beyond, both are shuffled.
FEW_HITS = 500_000

# The number Spark writes into a part file's name is its task's partition.
_PART_FILE = r"^part-(\d+)-"


class RecordStore:
    def __init__(self, spark: SparkSession, root: str, part_names: list[str], tolerant: bool = False,
                 ledger: Ledger | None = None):
        """``tolerant`` skips unreadable or vanished files instead of failing."""
        self.spark = spark
        self.ledger = ledger or Ledger(spark, f"{root.rstrip('/')}/ledger")
        self.root = root.rstrip("/")
        self.part_names = list(part_names)
        self.tolerant = tolerant

    @property
    def _records(self) -> str:
        return f"{self.root}/records"

    def pieces(self) -> list[Piece]:
        return self.ledger.pieces("records")

    def batches(self) -> list[int]:
        """Committed batches."""
        return [p.batch for p in self.pieces()]

    def next_batch(self) -> int:
        return max((b for b in self.batches() if b < SPECIAL), default=0) + 1

    def schema(self) -> T.StructType:
        sealed = [T.StructField(n, T.BinaryType()) for n in [*self.part_names, TERMS]]
        return T.StructType(
            [
                T.StructField("file", T.StringType()),
                T.StructField("pos", T.LongType()),
                *sealed,
                T.StructField(PLACE, T.StringType()),
                T.StructField(SEALED_LINE, T.BinaryType()),
                T.StructField("batch", T.LongType()),
                T.StructField("class_token", T.StringType()),
            ]
        )

    def has_headers(self, epoch: str) -> bool:
        return epoch in published_folders(self.spark, f"{self.root}/headers", "epoch")

    def append_headers(self, headers: DataFrame, epoch: str) -> None:
        headers.coalesce(1).write.mode("overwrite").parquet(f"{self.root}/headers/epoch={epoch}")

    def append(self, sealed: DataFrame, batch: int, max_rows_per_file: int = 0, **info) -> None:
        """Write one batch; writing the same batch again replaces it.

        Nothing is shuffled: each task splits its rows by class into files of at
        most ``max_rows_per_file`` records (0: no limit). ``info`` stays with the batch.
        """
        folder = self.ledger.new_folder(self._records, batch)
        (
            sealed.write.option("maxRecordsPerFile", max_rows_per_file)
            .partitionBy("class_token")
            .parquet(f"{self._records}/batch={folder}")
        )
        self.ledger.put(Piece("records", batch, folder, info))

    def read(self, batches: list[int] | None = None) -> DataFrame:
        """All committed sealed records, or those of some batches."""
        rows = self._all(batches)
        return rows.where(~F.col("class_token").isin(*LINE_CLASSES)).drop(PLACE, SEALED_LINE)

    def read_lines(self, line_class: str, batches: list[int] | None = None) -> DataFrame:
        """(file, pos, place, sealed_line) of the lines of a class, which are no records."""
        return self._all(batches).where(F.col("class_token") == line_class).select("file", "pos", PLACE, SEALED_LINE)

    def read_placed(self, batches: list[int]) -> DataFrame:
        """Everything some batches hold, with the places of their lines in a stream."""
        return self._all(batches)

    def _all(self, batches: list[int] | None) -> DataFrame:
        pieces = [p for p in self.pieces() if batches is None or p.batch in set(batches)]
        if not pieces:
            return self.spark.createDataFrame([], self.schema()).where(F.lit(False))
        reader = self.spark.read.schema(self.schema()).option("basePath", self._records)
        if self.tolerant:
            reader = reader.option("ignoreCorruptFiles", "true").option("ignoreMissingFiles", "true")
        return reader.parquet(*[f"{self._records}/batch={p.folder}" for p in pieces])

    def tidy(self) -> int:
        """Delete the folders that no kept commit names; how many there were."""
        gone = self.ledger.unused("records", self._records)
        for path in gone:
            delete_path(self.spark, path)
        return len(gone)

    def headers(self) -> DataFrame:
        """Wrapped class keys of every epoch."""
        root = f"{self.root}/headers"
        epochs = published_folders(self.spark, root, "epoch")
        if not epochs:
            return self.spark.createDataFrame([], HEADER_SCHEMA).where(F.lit(False))
        return self.spark.read.schema(HEADER_SCHEMA).parquet(*[f"{root}/epoch={e}" for e in epochs])

    def read_selected(self, hits: DataFrame) -> DataFrame:
        """Sealed records named by (file, pos) hits.

        Only batches that hold hits are listed, however many hits there are. The files
        of few distinct names are passed to the scan, and others not opened. The
        semi-join decides either way.
        """
        few = rows_if_few(hits.select("file").distinct(), FEW_FILES)
        if few is None:
            # As many numbers at most as the ledger holds batches.
            batch = F.substring_index("file", "-", 1).cast("long").alias("batch")
            records = self.read([r["batch"] for r in hits.select(batch).distinct().collect()])
        else:
            names = sorted(r["file"] for r in few)
            held = {batch_of(n) for n in names}.intersection(self.batches())
            records = self.read(sorted(held))
            if held:
                part = F.regexp_extract("_metadata.file_name", _PART_FILE, 1).cast("int")
                in_part = part.isin(sorted({partition_of(n) for n in names}))
                records = records.where(in_part & F.col("file").isin(names))
        return records.join(broadcast_if_few(hits, hits.count(), FEW_HITS), ["file", "pos"], "left_semi")
