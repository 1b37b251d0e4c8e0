"""Line inputs: text files and folders, alone or together."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sealdex.session import staged


def read_lines(spark: SparkSession, paths, tolerant: bool = False) -> DataFrame:
    """Lines of every input, each a file or a folder read without its subfolders.

    ``tolerant`` skips inputs that cannot be read and goes on with the others.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    if not paths:
        raise ValueError("no input given")
    reader = spark.read
    if tolerant:
        reader = reader.option("ignoreCorruptFiles", "true").option("ignoreMissingFiles", "true")
    return reader.text(paths)


def listed_files(spark: SparkSession, paths) -> DataFrame:
    """(path, bytes) of the files of every input that hold anything now; nothing is opened."""
    files = spark.read.format("binaryFile").load([paths] if isinstance(paths, str) else list(paths))
    return staged(files.select("path", F.col("length").alias("bytes")), "listed-files")


def reconciled(listed: DataFrame, paths) -> DataFrame:
    """What a tolerant read made of every listed file: (path, bytes, lines, outcome).

    A file was ``read``, was ``skipped`` as unreadable, or ``vanished`` after it was listed. A compressed file that breaks off half-way
    counts as read, with the lines ahead of the break.
    """
    spark = listed.sparkSession
    lines = read_lines(spark, paths, tolerant=True)
    return outcome_of(listed, lines, listed_files(spark, paths))


def outcome_of(listed: DataFrame, lines: DataFrame, present: DataFrame) -> DataFrame:
    """:func:`reconciled` for lines already read: rows are counted per file where they are, joined with the list."""
    counts = lines.groupBy(F.url_decode(F.regexp_replace("_metadata.file_path", r"\+", "%2B")).alias("key")).agg(F.count(F.lit(1)).alias("lines"))
    there = present.select(_plain("path").alias("key"), F.lit(True).alias("there"))
    counts = counts.select(_plain("key").alias("key"), "lines")
    joined = listed.withColumn("key", _plain("path")).join(counts, "key", "left").join(there, "key", "left")
    outcome = F.when(F.col("lines") > 0, "read").when(F.col("there").isNull(), "vanished").otherwise("skipped")
    return joined.select("path", "bytes", F.coalesce("lines", F.lit(0)).alias("lines"), outcome.alias("outcome"))


def _plain(path: str):
    """A path without the differing ways to write its scheme."""
    return F.regexp_replace(F.col(path), "^file:/+", "file:/")


def union_lines(inputs: list[DataFrame]) -> DataFrame:
    """All lines of several inputs, repeated lines included."""
    return reduce(lambda a, b: a.unionByName(b), [df.select("value") for df in inputs])


def without_blank(lines: DataFrame) -> DataFrame:
    return lines.where(F.length(F.trim("value")) > 0)
