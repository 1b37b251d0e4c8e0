"""Keyed hashing and authenticated encryption as plain column expressions.

Key bytes never become column literals: ``SecretRow`` hands them to a plan as a
scalar subquery over a one-row table, and record keys arrive through a join.
Query plans and event logs therefore never show key material.
"""

from __future__ import annotations

import hashlib
import hmac as _hmac

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KEY_BYTES = 32

# HMAC block padding (RFC 2104) and the SHA-256 block size.
_INNER_PAD = 0x36
_OUTER_PAD = 0x5C
_BLOCK_BYTES = 64

NONCE_BYTES = 12
TAG_BYTES = 16
SEAL_OVERHEAD = NONCE_BYTES + TAG_BYTES


def utf8(col: Column) -> Column:
    return F.encode(col, "UTF-8")


def long_bytes(col: Column) -> Column:
    """Eight-byte big-endian form of a non-negative long."""
    return F.unhex(F.lpad(F.hex(col), 16, "0"))


def as_key(col: Column) -> Column:
    """Pad with zero bytes or cut to exactly 32 bytes."""
    return F.call_function("rpad", col, F.lit(KEY_BYTES), F.lit(b"\x00"))


def _xor_block(key: Column, pad: int) -> Column:
    """XOR a 32-byte key with ``pad`` and extend it to one hash block.

    Works on four signed 64-bit words, which is what Spark can XOR.
    """
    mask = F.lit(int.from_bytes(bytes([pad] * 8), "big", signed=True))

    def word(at: int) -> Column:
        value = F.conv(F.hex(F.substring(key, at, 8)), 16, -10).cast("bigint")
        return F.lpad(F.hex(value.bitwiseXOR(mask)), 16, "0")

    tail = f"{pad:02X}" * (_BLOCK_BYTES - KEY_BYTES)
    return F.unhex(F.concat(*[word(at) for at in range(1, KEY_BYTES, 8)], F.lit(tail)))


def hmac_pads(key: Column) -> Column:
    """Both padded key blocks of a per-row key, computed once for many messages."""
    return F.struct(
        _xor_block(key, _INNER_PAD).alias("inner"), _xor_block(key, _OUTER_PAD).alias("outer")
    )


def hmac_padded(inner: Column, outer: Column, message: Column) -> Column:
    digest = F.unhex(F.sha2(F.concat(inner, message), 256))
    return F.unhex(F.sha2(F.concat(outer, digest), 256))


def hmac(key: Column, message: Column) -> Column:
    """HMAC-SHA256 under a 32-byte key column."""
    return hmac_padded(_xor_block(key, _INNER_PAD), _xor_block(key, _OUTER_PAD), message)


def nonce_from(mac: Column) -> Column:
    return F.substring(mac, 1, NONCE_BYTES)


def seal(plain: Column, key: Column, nonce: Column, bound_to: Column) -> Column:
    """AES-256-GCM: nonce, ciphertext and tag in one binary, bound to ``bound_to``.

    The nonce is an argument because a lazily drawn random one changes each time
    the plan runs again. Callers derive it from a MAC that covers the plaintext.
    """
    return F.aes_encrypt(plain, key, F.lit("GCM"), F.lit("DEFAULT"), nonce, bound_to)


def open_or_fail(sealed: Column, key: Column, bound_to: Column) -> Column:
    return F.aes_decrypt(sealed, key, F.lit("GCM"), F.lit("DEFAULT"), bound_to)


def open_or_null(sealed: Column, key: Column, bound_to: Column) -> Column:
    """NULL for a wrong key, a NULL key, or a value bound to something else."""
    return F.try_aes_decrypt(sealed, key, F.lit("GCM"), F.lit("DEFAULT"), bound_to)


# --- key handling outside rows -------------------------------------------------


def normal_key(key: bytes) -> bytes:
    return key[:KEY_BYTES].ljust(KEY_BYTES, b"\x00")


def derive(key: bytes, label: str) -> bytes:
    """A sub-key for one named purpose."""
    return _hmac.new(normal_key(key), label.encode("utf-8"), hashlib.sha256).digest()


def mac(key: bytes, message: bytes) -> bytes:
    return _hmac.new(normal_key(key), message, hashlib.sha256).digest()


def local_frame(spark: SparkSession, rows: list[tuple], schema: dict[str, pa.DataType]) -> DataFrame:
    """A small configuration table held by the plan itself (no Python worker)."""
    columns = list(zip(*rows)) if rows else [[] for _ in schema]
    table = pa.table(
        {name: pa.array(list(values), type=kind) for (name, kind), values in zip(schema.items(), columns)}
    )
    return spark.createDataFrame(table)


class SecretRow:
    """Named 32-byte keys offered to plans as scalar subqueries."""

    def __init__(self, spark: SparkSession, keys: dict[str, bytes]):
        self._names = set(keys)
        row: dict[str, bytes] = {}
        for name, key in keys.items():
            key = normal_key(key)
            row[name] = key
            row[f"{name}_inner"] = bytes(b ^ _INNER_PAD for b in key) + bytes([_INNER_PAD]) * 32
            row[f"{name}_outer"] = bytes(b ^ _OUTER_PAD for b in key) + bytes([_OUTER_PAD]) * 32
        self._frame = local_frame(spark, [tuple(row.values())], {n: pa.binary() for n in row})

    def _value(self, name: str) -> Column:
        return self._frame.select(name).scalar()

    def key(self, name: str) -> Column:
        return self._value(name)

    def hmac(self, name: str, message: Column) -> Column:
        return hmac_padded(self._value(f"{name}_inner"), self._value(f"{name}_outer"), message)
