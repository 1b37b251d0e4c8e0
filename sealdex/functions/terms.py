"""Index words: how a record's fields or a text become searchable terms."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


def folded(col: Column) -> Column:
    return F.lower(col)


def fold_query(words) -> list[str]:
    """The caller's words, folded like the indexed ones and each kept once."""
    return sorted({w.lower() for w in words})


@dataclass(frozen=True)
class Term:
    """One indexed value: ``source`` bare, or scoped as ``<scope>=<source>``.

    ``source`` is a field name, any SQL expression over the fields, or a Column.
    """

    source: str | Column
    scope: str | None = None

    def column(self) -> Column:
        value = folded(F.expr(self.source) if isinstance(self.source, str) else self.source)
        return value if self.scope is None else F.concat(F.lit(f"{self.scope}="), value)


@dataclass(frozen=True)
class IndexSpec:
    terms: tuple[Term, ...]

    def column(self) -> Column:
        """Distinct non-null words of a record."""
        return F.array_distinct(F.array_compact(F.array(*[t.column() for t in self.terms])))


def text_words(text: Column) -> Column:
    """Whitespace-separated words of a whole text, folded."""
    return F.array_remove(F.split(folded(text), r"\s+"), "")
