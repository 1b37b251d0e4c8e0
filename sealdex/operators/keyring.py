"""Seal classes, their wrapped keys, and the keyring a user's rule amounts to.

Every (row value, part, epoch) is one seal class with its own key. The key is
wrapped once under each policy cell allowed to open it; wrapped keys are the
``headers`` table next to the records. A user holds the keys of the cells for
which their rule is true, unwraps what they can, and gets one keyring row per
class token. All tables here have the size of the policy, not of the data.
"""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sealdex.functions import crypto
from sealdex.functions.policy import Policy, Rule
from sealdex.operators.bounds import rows_if_few
from sealdex.operators.specs import RecordSpec

HEADER_SCHEMA = T.StructType(
    [
        T.StructField("class_token", T.StringType()),
        T.StructField("part", T.StringType()),
        T.StructField("cell", T.StringType()),
        T.StructField("wrapped", T.BinaryType()),
    ]
)

# Up to here a keyring is broadcast and its tokens become static filters.
FEW_CLASSES = 2_000


def key_column(part: str) -> str:
    return f"key_{part}"


def _cell_name(policy: Policy, row_value: str, column_value: str) -> str:
    return f"{policy.rows.name}::{row_value}|{policy.columns.name}::{column_value}"


def _cell_key(master: bytes, cell: str) -> bytes:
    return crypto.derive(master, f"cell|{cell}")


def class_token(master: bytes, epoch: str, row_value: str) -> str:
    """Opaque name of a row value within an epoch; equal values share it."""
    return crypto.derive(master, f"class token|{epoch}|{row_value}").hex()


def _class_key(master: bytes, epoch: str, row_value: str, part: str) -> bytes:
    return crypto.derive(master, f"class key|{epoch}|{row_value}|{part}")


def seal_classes(spark: SparkSession, spec: RecordSpec, master: bytes, epoch: str) -> DataFrame:
    """One row per row value: its class token and the key of each part (writer side)."""
    rows = [
        (value, class_token(master, epoch, value))
        + tuple(_class_key(master, epoch, value, p) for p in spec.part_names())
        for value in spec.policy.rows.values
    ]
    schema = {spec.row_field: pa.string(), "class_token": pa.string()}
    schema |= {key_column(p): pa.binary() for p in spec.part_names()}
    return crypto.local_frame(spark, rows, schema)


def seal_headers(spark: SparkSession, spec: RecordSpec, master: bytes, epoch: str) -> DataFrame:
    """Each class key, wrapped under every cell allowed to open that part."""
    rows = []
    for value in spec.policy.rows.values:
        token = class_token(master, epoch, value)
        for part in spec.parts:
            key = _class_key(master, epoch, value, part.name)
            for audience in part.audience:
                cell = _cell_name(spec.policy, value, audience)
                nonce = crypto.derive(master, f"wrap|{token}|{part.name}|{cell}")[: crypto.NONCE_BYTES]
                rows.append((token, part.name, cell, key, _cell_key(master, cell), nonce))
    frame = crypto.local_frame(
        spark,
        rows,
        {"class_token": pa.string(), "part": pa.string(), "cell": pa.string()}
        | {n: pa.binary() for n in ("class_key", "cell_key", "nonce")},
    )
    wrapped = crypto.seal(F.col("class_key"), F.col("cell_key"), F.col("nonce"), _wrap_binding())
    return frame.select("class_token", "part", "cell", wrapped.alias("wrapped"))


def _wrap_binding():
    return crypto.utf8(F.concat_ws("|", "class_token", "part", "cell"))


def issue_user_keys(
    spark: SparkSession, policy: Policy, master: bytes, rules: dict[str, Rule]
) -> DataFrame:
    """The cell keys each named user's rule allows: (user, axis values, cell, cell_key)."""
    rows, cols = policy.rows, policy.columns
    keys = crypto.local_frame(
        spark,
        [
            (cell, _cell_key(master, cell))
            for r in rows.values
            for c in cols.values
            for cell in [_cell_name(policy, r, c)]
        ],
        {"cell": pa.string(), "cell_key": pa.binary()},
    )
    cell = F.concat_ws("|", rows.literal(F.col(rows.name)), cols.literal(F.col(cols.name)))
    issued = None
    for user, rule in rules.items():
        cells = policy.allowed_cells(spark, rule).select(
            F.lit(user).alias("user"), rows.name, cols.name, cell.alias("cell")
        )
        issued = cells if issued is None else issued.unionByName(cells)
    return issued.join(F.broadcast(keys), "cell")


def unwrap(user_keys: DataFrame, headers: DataFrame, spec: RecordSpec) -> DataFrame:
    """Keyring of one user: a row per class, a nullable key per part."""
    opened = crypto.open_or_null(F.col("wrapped"), F.col("cell_key"), _wrap_binding())
    keys = (
        headers.join(user_keys.select("cell", "cell_key"), "cell")
        .select("class_token", "part", opened.alias("class_key"))
        .where(F.col("class_key").isNotNull())
    )
    # Several cells may wrap the same key, so any non-null one per part will do.
    per_part = [
        F.max(F.when(F.col("part") == p, F.col("class_key"))).alias(key_column(p))
        for p in spec.part_names()
    ]
    return keys.groupBy("class_token").agg(*per_part)


@dataclass(frozen=True)
class Keyring:
    """A user's keyring, with what the planner may know about it."""

    frame: DataFrame
    tokens: list[str] | None
    openable: frozenset[str]

    @property
    def is_small(self) -> bool:
        return self.tokens is not None


def keyring_for(user_keys: DataFrame, headers: DataFrame, spec: RecordSpec) -> Keyring:
    """Unwrap a user's keys once, for the classes whose gate part they open.

    Records of any other class are invisible to the user. Where the classes are
    few, as a policy makes them, the unwrapped keyring becomes a local table.
    """
    parts = spec.part_names()
    frame = unwrap(user_keys, headers, spec).where(F.col(key_column(parts[0])).isNotNull())
    rows = rows_if_few(frame, FEW_CLASSES)
    if rows is None:
        return Keyring(frame, None, frozenset(parts))
    schema = {"class_token": pa.string()} | {key_column(p): pa.binary() for p in parts}
    held = [(r["class_token"], *(r[key_column(p)] for p in parts)) for r in rows]
    return Keyring(
        crypto.local_frame(frame.sparkSession, held, schema),
        [r["class_token"] for r in rows],
        frozenset(p for p in parts if any(r[key_column(p)] for r in rows)),
    )
