"""Clear-text output."""

from __future__ import annotations

from pyspark.sql import DataFrame

from sealdex.operators.sealing import clear_json
from sealdex.operators.specs import RecordSpec


def write_clear_lines(opened: DataFrame, spec: RecordSpec, path: str) -> None:
    """Opened records as a folder of JSON lines, written by all tasks at once."""
    clear_json(opened, spec).write.mode("overwrite").text(path)
