"""Location-based record ids: a file name and a position in it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sealdex.functions.crypto import long_bytes, utf8

POSITION_BYTES = 8

# A Spark task numbers its rows from (partition << 33); the low bits are the row.
_ROW_BITS = (1 << 33) - 1


def uid_bytes(file: Column, pos: Column) -> Column:
    return F.concat(utf8(file), long_bytes(pos))


def uid_text(file: Column, pos: Column) -> Column:
    return F.concat_ws(":", file, pos.cast("string"))


def _checked(uid: Column) -> Column:
    return F.when(F.octet_length(uid) > POSITION_BYTES, uid).otherwise(
        F.raise_error(F.lit("a record id has at least nine bytes")).cast("binary")
    )


def uid_file(uid: Column) -> Column:
    uid = _checked(uid)
    return F.decode(F.substring(uid, F.lit(1), F.octet_length(uid) - POSITION_BYTES), "UTF-8")


def uid_pos(uid: Column) -> Column:
    return F.conv(F.hex(F.substring(uid, -POSITION_BYTES, POSITION_BYTES)), 16, 10).cast("bigint")


def file_name(batch: int, partition: Column) -> Column:
    """At least six digits of the task's partition, all of them however many there are."""
    return F.concat(F.lit(f"{batch:010d}-"), F.format_string("%06d", partition))


def assign_uids(df: DataFrame, batch: int) -> DataFrame:
    """Give each row the next id of the file its task is about to write.

    The file name holds the batch and the task's partition, which is also the
    number Spark puts in the written part file. Ids are fixed only once written:
    everything that refers to them must read the written table.
    """
    return df.withColumn("file", file_name(batch, F.spark_partition_id())).withColumn(
        "pos", F.monotonically_increasing_id().bitwiseAND(F.lit(_ROW_BITS))
    )


def batch_of(file: str) -> int:
    return int(file.split("-")[0])


def partition_of(file: str) -> int:
    return int(file.split("-")[1])
