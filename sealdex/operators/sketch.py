"""Membership sketches of token sets: which tokens a run surely does not have.

A Bloom filter dealt over slots of the token space. A slot's bits are one binary
row of 4 KB, built by a partially combined aggregate and met by an equi-join on the
slot, so neither building nor asking gathers a whole filter anywhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of a row, as Spark's bitmap aggregates build them.
SLOT_BITS = 1 << 15
#: Bits set per token, and bits provided for each: about one token in 400 passes by chance.
HASHES, BITS_PER_TOKEN = 4, 16


def slots_for(tokens: int) -> int:
    """A power of two, so that sketches of like size are asked together."""
    need = max(tokens, 1) * BITS_PER_TOKEN / SLOT_BITS
    slots = 1
    while slots < need:
        slots *= 2
    return slots


def _number(token: Column, at: int) -> Column:
    """Four bytes of a token; tokens are keyed hashes and thus uniform."""
    return F.conv(F.hex(F.substring(token, at, 4)), 16, 10).cast("bigint")


def _slot(token: Column, slots: int) -> Column:
    return F.pmod(_number(token, 1), F.lit(slots).cast("bigint")).cast("int")


def _bits(token: Column) -> list[Column]:
    return [F.pmod(_number(token, 5 + 4 * i), F.lit(SLOT_BITS)) for i in range(HASHES)]


def built(tokens: DataFrame, slots: int) -> DataFrame:
    """(slot, bits) of the distinct or repeated ``token`` rows."""
    each = tokens.select(_slot(F.col("token"), slots).alias("slot"), F.explode(F.array(*_bits(F.col("token")))).alias("bit"))
    return each.groupBy("slot").agg(F.bitmap_construct_agg("bit").alias("bits"))


def holds(bits: str, token: str) -> Column:
    """Whether all bits of a token are set, of two columns named."""

    def is_set(i: int) -> str:
        bit = f"(conv(hex(substring({token}, {5 + 4 * i}, 4)), 16, 10)::bigint % {SLOT_BITS})"
        byte = f"conv(hex(substring({bits}, ({bit} >> 3)::int + 1, 1)), 16, 10)::int"
        return f"(({byte} >> ({bit} % 8)::int) & 1) = 1"

    return F.expr(" AND ".join(is_set(i) for i in range(HASHES)))


def possible(tokens: DataFrame, sketches: dict[int, list[str]]) -> DataFrame:
    """Those of ``tokens`` (one ``token`` column) that some sketch does not rule out.

    ``sketches`` are the folders of sketches by their number of slots.
    """
    if not sketches:
        return tokens.where(F.lit(False))
    reader = tokens.sparkSession.read.schema("slot int, bits binary")
    stored = None
    for slots, paths in sorted(sketches.items()):
        rows = reader.parquet(*paths).select(F.lit(slots).alias("slots"), "slot", "bits")
        stored = rows if stored is None else stored.unionByName(rows)
    asked = tokens.select("token", F.explode(F.array(*map(F.lit, sketches))).alias("slots"))
    asked = asked.withColumn("slot", F.expr("(conv(hex(substring(token, 1, 4)), 16, 10)::bigint % slots)::int"))
    met = asked.join(stored, ["slots", "slot"]).where(holds("bits", "token"))
    # Sketches of one size are asked once a token; a token held by several is one.
    return met.select("token").distinct()
