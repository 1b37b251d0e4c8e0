"""Continuous ingest: lines arrive, each micro-batch becomes one vault batch.

A stream ends at its end line, wherever and whenever that arrives. Where it stands
is kept in the vault (:mod:`sealdex.plans.streams`), so a restart, a replay or a
batch that arrives out of order knows it too.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from sealdex.operators.sealing import PLACE
from sealdex.plans.streams import GROUP_END, VaultStream
from sealdex.plans.vault import Secrets, Vault
from sealdex.sources.lines import without_blank

# Fixed value: the line that ends a stream.
END_LINE = "%END%"

POLL_INTERVAL = "1 second"

# Rows of a Spark task count up from its number times 2^33.
_ROW_BITS = (1 << 33) - 1

# Moves any long to a number of at most 19 digits and no sign.
_SHIFT = 1 << 62


def stream_file_lines(spark: SparkSession, path: str, max_files_per_batch: int | None = None,
                      number: str | None = None) -> DataFrame:
    """Streamed lines of the files arriving in a folder, with their place.

    ``number`` is a pattern whose group finds the number in a file's name, for
    :data:`NUMBERED_ORDER`; a name without one is an error.
    """
    reader = spark.readStream.format("text")
    if max_files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", max_files_per_batch)
    columns = [
        F.col("value"),
        F.col("_metadata.file_modification_time").alias("modified"),
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("block"),
    ]
    if number is not None:
        columns.append(F.regexp_extract("_metadata.file_name", number, 1).cast("long").alias("number"))
    return reader.load(path).select(*columns)


@dataclass(frozen=True)
class LineOrder:
    """Columns that order lines, within groups that are ordered on their own.

    Files form one sequence, by age or by the number in their names, then path and
    place. A topic is ordered only within each partition, so there the end line
    cuts each partition by itself. Batches may take lines in any order.
    """

    by: tuple[str, ...]
    within: tuple[str, ...] = ()

    def placed(self, batch: DataFrame) -> DataFrame:
        """(value, place): the group, and behind it text that sorts as the lines do."""
        row = F.monotonically_increasing_id().bitwiseAND(F.lit(_ROW_BITS))
        group = F.concat_ws("\x1e", *[F.col(c).cast("string") for c in self.within], F.lit(""))
        keys = [_sortable(batch.schema[c].dataType, F.col(c)) for c in self.by]
        return batch.select("value", F.concat(group, F.lit(GROUP_END), F.concat_ws("\x1f", *keys, _sortable(T.LongType(), row))).alias(PLACE))


def _sortable(kind: T.DataType, column: Column) -> Column:
    if isinstance(kind, T.StringType):
        return column
    number = F.unix_micros(column) if isinstance(kind, T.TimestampType) else column.cast("long")
    return F.lpad((number + F.lit(_SHIFT)).cast("string"), 19, "0")


FILE_ORDER = LineOrder(("modified", "path", "block"))
NUMBERED_ORDER = LineOrder(("number", "path", "block"))
TOPIC_ORDER = LineOrder(("offset",), within=("partition",))


def before_end(batch: DataFrame, order: LineOrder, end: str = END_LINE) -> tuple[DataFrame, bool]:
    """Lines of one batch ahead of the end line, and whether there is one.

    The cut is one aggregated row per ordered group; no line is sorted.
    """
    placed = order.placed(batch)
    group = F.substring_index(PLACE, GROUP_END, 1)
    ends = placed.where(F.trim("value") == end)
    cuts = {r["g"]: r["cut"] for r in ends.groupBy(group.alias("g")).agg(F.min(PLACE).alias("cut")).collect()}
    if not cuts:
        return batch.select("value"), False
    frame = batch.sparkSession.createDataFrame(list(cuts.items()), "g string, cut string")
    ahead = placed.join(F.broadcast(frame), group == F.col("g"), "left")
    return ahead.where(F.col("cut").isNull() | (F.col(PLACE) < F.col("cut"))).select("value"), True


@dataclass
class StreamState:
    """What the driver learns while a stream runs."""

    batches: list[int] = field(default_factory=list)
    records: int = 0
    rejected: int = 0
    ended: bool = False
    drains: bool = False
    stream: VaultStream | None = None


def ingest_stream(vault: Vault, lines: DataFrame, secrets: Secrets, checkpoint: str,
                  order: LineOrder = FILE_ORDER, epoch: str = "stream", first_batch: int = 1,
                  available_now: bool = False, interval: str = POLL_INTERVAL,
                  strict: bool = False) -> tuple[StreamingQuery, StreamState]:
    """Start a query that seals and indexes every micro-batch.

    Micro-batch ``i`` always becomes vault batch ``first_batch + i``, which
    replaces itself when it runs again after a failure. The interval is also the
    age at which a new set of record files begins. Lines that are no records are
    quarantined. Once an end line was seen, the vault holds exactly the lines ahead
    of it, whatever the order of arrival; those behind it wait in the vault, sealed,
    for the next run, which starts with them. A run that broke off between the
    end line and its caller's :func:`run_to_end` is taken up where it was.
    """
    stream = VaultStream(vault, secrets, epoch, END_LINE)
    state = StreamState(drains=available_now, stream=stream)

    def done(report) -> None:
        state.batches.append(report.batch)
        state.records += report.records
        state.rejected += report.rejected
        # Last, because whoever watches the state stops the query on it.
        state.ended = stream.ended

    resumed = stream.resume(strict)
    if resumed is not None:
        done(resumed)
    state.ended = stream.ended

    def one_batch(batch: DataFrame, number: int) -> None:
        done(stream.ingest(order.placed(without_blank(batch)), first_batch + number, strict))

    writer = lines.writeStream.foreachBatch(one_batch).option("checkpointLocation", checkpoint)
    trigger = {"availableNow": True} if available_now else {"processingTime": interval}
    return writer.trigger(**trigger).start(), state


def run_to_end(query: StreamingQuery, state: StreamState, poll_seconds: int = 1) -> StreamState:
    """Wait until the source is drained, or, where it never is, until an end line was seen.

    Then the end is marked as taken note of: the next run goes on behind it.
    """
    while not query.awaitTermination(poll_seconds):
        # What a draining query has not taken yet may still lie ahead of the end.
        if state.ended and not state.drains:
            query.stop()
            break
    if state.ended and state.stream is not None:
        state.stream.take_note()
    return state


def progress_counters(query: StreamingQuery) -> list[tuple[int, int]]:
    """(micro-batch, lines read) of the recent micro-batches."""
    return [(p["batchId"], p["numInputRows"]) for p in query.recentProgress]
