"""Two-axis access policies, compiled to boolean columns over policy cells.

A policy names a row axis (which rows) and a column axis (which column groups).
A *cell* is one value of each. An access rule is a tree of attributes joined by
``&`` and ``|``; a key opens exactly the cells for which its rule is true.
"""

from __future__ import annotations

from dataclasses import dataclass
from enum import Enum
from functools import reduce
from itertools import product

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sealdex.functions.crypto import local_frame

# A policy is configuration; its grid is held by the driver and broadcast.
MAX_CELLS = 100_000


@dataclass(frozen=True)
class Axis:
    name: str
    values: tuple[str, ...]

    @staticmethod
    def of_enum(name: str, values: type[Enum]) -> Axis:
        """Axis over an enum's member names, underscores removed."""
        return Axis(name, tuple(member.name.replace("_", "") for member in values))

    def attribute(self, value: str) -> Attr:
        if value not in self.values:
            raise ValueError(f"axis {self.name} has no value {value!r}")
        return Attr(self.name, value)

    def holds(self, col: Column) -> Column:
        """True where ``col`` is a value of this axis; false for NULL as well."""
        return F.coalesce(col.isin(*self.values), F.lit(False))

    def literal(self, col: Column) -> Column:
        """Attribute text of a row's value, as ``Axis::Value``."""
        return F.concat(F.lit(f"{self.name}::"), col)


class Rule:
    def __and__(self, other: Rule) -> Rule:
        return And(self, other)

    def __or__(self, other: Rule) -> Rule:
        return Or(self, other)

    def column(self) -> Column:
        """Boolean column over a frame that has one column per axis."""
        raise NotImplementedError

    def attributes(self) -> set[Attr]:
        raise NotImplementedError


@dataclass(frozen=True)
class Attr(Rule):
    axis: str
    value: str

    def __str__(self) -> str:
        return f"{self.axis}::{self.value}"

    def column(self) -> Column:
        return F.col(self.axis) == F.lit(self.value)

    def attributes(self) -> set[Attr]:
        return {self}


@dataclass(frozen=True)
class And(Rule):
    left: Rule
    right: Rule

    def column(self) -> Column:
        return self.left.column() & self.right.column()

    def attributes(self) -> set[Attr]:
        return self.left.attributes() | self.right.attributes()


@dataclass(frozen=True)
class Or(Rule):
    left: Rule
    right: Rule

    def column(self) -> Column:
        return self.left.column() | self.right.column()

    def attributes(self) -> set[Attr]:
        return self.left.attributes() | self.right.attributes()


def rule_from_dict(tree: dict) -> Rule:
    """Read the serialised form ``{"And": [{"Attr": "Axis::Value"}, ...]}``."""
    (kind, body), = tree.items()
    if kind == "Attr":
        axis, _, value = body.partition("::")
        return Attr(axis, value)
    if kind not in ("And", "Or"):
        raise ValueError(f"unknown access rule node {kind!r}")
    join = And if kind == "And" else Or
    return reduce(join, [rule_from_dict(child) for child in body])


@dataclass(frozen=True)
class Policy:
    rows: Axis
    columns: Axis

    def __post_init__(self):
        if len(self.rows.values) * len(self.columns.values) > MAX_CELLS:
            raise ValueError(f"a policy has at most {MAX_CELLS} cells")

    def axes(self, spark: SparkSession) -> DataFrame:
        """The axes and their values as a dimension table."""
        pairs = [(axis.name, v) for axis in (self.rows, self.columns) for v in axis.values]
        return local_frame(spark, pairs, {"axis": pa.string(), "value": pa.string()})

    def grid(self, spark: SparkSession) -> DataFrame:
        """Every cell, one column per axis."""
        cells = list(product(self.rows.values, self.columns.values))
        return local_frame(spark, cells, {self.rows.name: pa.string(), self.columns.name: pa.string()})

    def allow(self, columns, rows) -> Rule:
        """(any of ``columns``) and (any of ``rows``); neither list may be empty."""
        if not columns or not rows:
            raise ValueError("an access rule needs at least one value on each axis")
        any_column = reduce(Or, [self.columns.attribute(v) for v in columns])
        any_row = reduce(Or, [self.rows.attribute(v) for v in rows])
        return any_column & any_row

    def check(self, rule: Rule) -> Rule:
        axes = {self.rows.name: self.rows, self.columns.name: self.columns}
        for attr in rule.attributes():
            if attr.axis not in axes:
                raise ValueError(f"the policy has no axis {attr.axis!r}")
            axes[attr.axis].attribute(attr.value)
        return rule

    def allowed_cells(self, spark: SparkSession, rule: Rule) -> DataFrame:
        return self.grid(spark).where(self.check(rule).column())

    def part_attributes(self, row_value: Column, audience) -> Column:
        """Attribute set of a column group: the row's value and its audience."""
        literals = [F.lit(str(self.columns.attribute(v))) for v in audience]
        return F.array(self.rows.literal(row_value), *literals)
