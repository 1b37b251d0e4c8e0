"""Declarative description of a record kind: fields, column groups, index words."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sealdex.functions.policy import Policy
from sealdex.functions.terms import IndexSpec


@dataclass(frozen=True)
class PartSpec:
    """One column group and the column-axis values whose holders may open it.

    A column is a field name, or a pair of a name and the SQL expression or
    ``Column`` it is derived by.
    """

    name: str
    columns: tuple[str | tuple[str, str | Column], ...]
    audience: tuple[str, ...]

    def names(self) -> list[str]:
        return [c if isinstance(c, str) else c[0] for c in self.columns]

    def json(self) -> Column:
        pairs = [(c, F.col(c)) if isinstance(c, str) else c for c in self.columns]
        values = [(F.expr(v) if isinstance(v, str) else v).cast("string").alias(n) for n, v in pairs]
        return F.to_json(F.struct(*values))

    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(n, T.StringType()) for n in self.names()])


@dataclass(frozen=True)
class RecordSpec:
    """``parts[0]`` is the gate: a record is visible only where that part opens."""

    fields: tuple[str, ...]
    row_field: str
    policy: Policy
    parts: tuple[PartSpec, ...]
    index: IndexSpec

    def __post_init__(self):
        for part in self.parts:
            for value in part.audience:
                self.policy.columns.attribute(value)
        if self.row_field not in self.fields:
            raise ValueError(f"{self.row_field!r} is not a field")
        taken = {"file", "pos", "class_token", "batch", "terms"} | {f"key_{p.name}" for p in self.parts}
        clash = taken & {*self.fields, *self.part_names()}
        if clash:
            raise ValueError(f"names used by the record table itself: {sorted(clash)}")

    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(n, T.StringType()) for n in self.fields])

    def part_names(self) -> list[str]:
        return [p.name for p in self.parts]

    def opened_columns(self) -> list[str]:
        """Columns of an opened record, in order of first appearance."""
        return list(dict.fromkeys(n for p in self.parts for n in p.names()))
