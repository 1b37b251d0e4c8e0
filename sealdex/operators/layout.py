"""Positions in record files: offsets, roll-over, gaps between hits.

Each is a window over one file in position order, and one file may hold a third
of all records. So rows are first cut into position ranges; ranges are summed or
their last hit taken, the short list of ranges is scanned per file, and each row
finishes inside its own range. Results equal the plain per-file window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Positions per range; they are distinct within a file, so also its most rows.
RANGE_SPAN = 1 << 20

# Positions per listed chunk of one file.
CHUNK_SPAN = 1 << 12


def _range_of(position: str, span: int) -> Column:
    return F.floor(F.col(position) / F.lit(span)).cast("bigint")


def running_offsets(df: DataFrame, file: str, seq: str, size: str, span: int = RANGE_SPAN) -> DataFrame:
    """Add ``offset``: total ``size`` of the rows before this one in its file.

    ``seq`` is a non-negative number, distinct within a file.
    """
    ranged = df.withColumn("_range", _range_of(seq, span))
    before = Window.partitionBy(file).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    bases = (
        ranged.groupBy(file, "_range")
        .agg(F.sum(size).alias("_size"))
        .select(file, "_range", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_base"))
    )
    inside = Window.partitionBy(file, "_range").orderBy(seq).rowsBetween(Window.unboundedPreceding, -1)
    local = F.coalesce(F.sum(size).over(inside), F.lit(0))
    return (
        ranged.join(bases, [file, "_range"])
        .withColumn("offset", (F.col("_base") + local).cast("bigint"))
        .drop("_range", "_base")
    )


def roll_bucket(offset: Column, max_bytes: int) -> Column:
    """Which rolled file a record starts in, when files roll every ``max_bytes``.

    The running total carries each overflow on, where a writer that restarts its
    count may place single records one bucket later.
    """
    return F.floor(offset / F.lit(max_bytes)).cast("bigint")


def rows_per_file(records: DataFrame, size: Column, max_bytes: int) -> int:
    """Record limit that keeps written files near ``max_bytes`` on average."""
    mean = records.agg(F.avg(size)).first()[0]
    return max(1, int(max_bytes // mean)) if mean else 0


def hit_gaps(hits: DataFrame, file: str, pos: str, size: str, span: int = RANGE_SPAN) -> DataFrame:
    """Add ``gap``: distance from the end of the previous hit in the file (its
    start, for the first hit) to this one."""
    ranged = hits.withColumn("_range", _range_of(pos, span)).withColumn("_end", F.col(pos) + F.col(size))
    by_range = Window.partitionBy(file).orderBy("_range")
    previous = (
        ranged.groupBy(file, "_range")
        .agg(F.max_by("_end", pos).alias("_last"))
        .select(file, "_range", F.lag("_last").over(by_range).alias("_before"))
    )
    inside = Window.partitionBy(file, "_range").orderBy(pos)
    reached = F.coalesce(F.lag("_end").over(inside), F.col("_before"), F.lit(0))
    return (
        ranged.join(previous, [file, "_range"])
        .withColumn("gap", (F.col(pos) - reached).cast("bigint"))
        .drop("_range", "_end", "_before")
    )


def positions_per_file(uids: DataFrame, span: int = CHUNK_SPAN) -> DataFrame:
    """Ascending positions of each file, listed in chunks of bounded length."""
    return (
        uids.groupBy("file", _range_of("pos", span).alias("chunk"))
        .agg(F.sort_array(F.collect_list("pos")).alias("positions"))
    )
