"""Token ids of a corpus as range-coded files, and reading them back.

A file is a Parquet part; every row is a segment: whole documents in ascending
id order, coded by :mod:`range_coder` in independently reset, checksummed
blocks. Rows stand in corpus order by (part, segment).

Cases: a null or empty text is its end id alone. Repeated rows are documents of
their own, ties of an id in the order of their texts; null ids come first. A
very long text makes a long segment, still in blocks. An empty table gives no
rows. A damaged block raises ValueError.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sealdex.llm import range_coder
from sealdex.llm.tokens import encoder, forget_words
from sealdex.session import scratch_path

END_ID = 1
#: Bytes of text encoded at once.
BATCH_BYTES = 1 << 18
#: Rows turned into Python values at once.
_ROWS_AT_ONCE = 256

_FILE = "part int, segment int, doc_ids array<long>, doc_tokens array<long>, n_tokens long, coded binary"
_READ = "part int, segment int, doc_id long, offset long, n_tokens long, ids_crc32 long"


def _batches(rows: Iterator[tuple[int, str]], most: int) -> Iterator[tuple[list, list[str]]]:
    ids, texts, size = [], [], 0
    for doc, text in rows:
        ids.append(doc)
        texts.append(text or "")
        size += len(texts[-1])
        if size >= most:
            yield ids, texts
            ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def _rows(batches: Iterator[pa.RecordBatch], part: list) -> Iterator[tuple[int, str]]:
    for batch in batches:
        if batch.num_rows:
            part[:] = [batch.column(2)[0].as_py()]
        for low in range(0, batch.num_rows, _ROWS_AT_ONCE):
            some = batch.slice(low, _ROWS_AT_ONCE)
            yield from zip(some.column(0).to_pylist(), some.column(1).to_pylist(), strict=True)


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Segments one by one: a batch holds many, and each is some megabytes."""
    # A worker that encoded before needs its words no more.
    forget_words()
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def _coded(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, part = encoder(path), [0]
        vocabulary = max(own.vocabulary, end_id + 1)
        segment, docs, counts, parts, size = 0, [], [], [], 0

        def row():
            ids = np.concatenate(parts)
            parts.clear()
            return pa.RecordBatch.from_pylist(
                [{"part": part[0], "segment": segment, "doc_ids": docs, "doc_tokens": counts, "n_tokens": len(ids), "coded": range_coder.encode(ids, vocabulary)}],
                schema=pa.schema([("part", pa.int32()), ("segment", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("doc_tokens", pa.list_(pa.int64())), ("n_tokens", pa.int64()), ("coded", pa.binary())]),
            )

        for ids, texts in _batches(_rows(batches, part), BATCH_BYTES):
            tokens, bounds = own.encode(texts)
            for i, doc in enumerate(ids):
                n = int(bounds[i + 1] - bounds[i]) + 1
                if docs and size + n > range_coder.GROUP_IDS:
                    yield row()
                    segment, docs, counts, parts, size = segment + 1, [], [], [], 0
                docs.append(doc)
                counts.append(n)
                parts += [tokens[bounds[i] : bounds[i + 1]], np.array([end_id], np.uint32)]
                size += n
        if docs:
            yield row()

    return run


def write_token_files(docs: DataFrame, path: str, vocabulary: str, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every whole text, append ``end_id``, write in ascending id order."""
    (
        docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
        .repartitionByRange("id")
        .sortWithinPartitions("id", "text")
        .select("id", "text", F.spark_partition_id().alias("part"))
        .mapInArrow(_coded(vocabulary, end_id), _FILE)
        .write.option("parquet.block.size", 64 << 20)
        .parquet(path)
    )


def _decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for row in _segments(batches):
        ids = range_coder.decode(row["coded"])
        counts = np.array(row["doc_tokens"], np.int64)
        ends = np.cumsum(counts)
        if len(ids) != row["n_tokens"] or ends[-1] != len(ids):
            raise ValueError(f"segment {row['part']}, {row['segment']} does not hold its documents")
        body = memoryview(ids).cast("B")
        crc = [zlib.crc32(body[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), counts.tolist(), strict=True)]
        n = len(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array([row["part"]] * n, pa.int32()), pa.array([row["segment"]] * n, pa.int32()), pa.array(row["doc_ids"], pa.int64()), pa.array(ends - counts), pa.array(counts), pa.array(crc, pa.int64())],
            names=["part", "segment", "doc_id", "offset", "n_tokens", "ids_crc32"],
        )


def read_token_ids(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, ids) of every document of the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _segments(batches):
            ids = range_coder.decode(row["coded"])
            bounds = np.r_[0, np.cumsum(row["doc_tokens"])].astype(np.int32)
            n = len(bounds) - 1
            yield pa.RecordBatch.from_arrays(
                [pa.array([row["part"]] * n, pa.int32()), pa.array([row["segment"]] * n, pa.int32()), pa.array(row["doc_ids"], pa.int64()), pa.array(bounds[:-1].astype(np.int64)), pa.ListArray.from_arrays(pa.array(bounds), pa.array(ids.astype(np.int64)))],
                names=["part", "segment", "doc_id", "offset", "ids"],
            )

    files = spark.read.schema(_FILE).parquet(path)
    found = files.mapInArrow(run, "part int, segment int, doc_id long, offset long, ids array<long>")
    return found.join(_segment_starts(files), ["part", "segment"]).select("doc_id", (F.col("offset") + F.col("base")).alias("start"), "ids")


def _segment_starts(files: DataFrame) -> DataFrame:
    """Ids before every segment: sums of the parts first, then inside a part."""
    sizes = files.groupBy("part", "segment").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = sizes.groupBy("part").agg(F.sum("n").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"))
    inside = Window.partitionBy("part").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.withColumn("within", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(parts, "part").select("part", "segment", (F.col("ahead") + F.col("within")).alias("base"))


def read_token_digest(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, decoded from the files."""
    files = spark.read.schema(_FILE).parquet(path)
    found = files.mapInArrow(_decoded, _READ)
    return found.join(_segment_starts(files), ["part", "segment"]).select("doc_id", (F.col("offset") + F.col("base")).alias("start"), "n_tokens", "ids_crc32")


def written_and_read(docs: DataFrame, vocabulary: str) -> DataFrame:
    """Write the files of ``docs`` into the shared folder and read their digest back."""
    path = scratch_path(docs.sparkSession, "token-files")
    write_token_files(docs, path, vocabulary)
    return read_token_digest(docs.sparkSession, path)
