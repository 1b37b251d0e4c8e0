"""From JSON lines to typed records, with the bad lines set aside."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sealdex.operators.specs import RecordSpec

# Helper columns, named apart from any field.
_BAD, _LINE, _FAULT = "_malformed", "_line", "_fault"
LINE, FAULT = _LINE, _FAULT


def _parsed(lines: DataFrame, spec: RecordSpec) -> DataFrame:
    """Parse each line once: a filter cannot move below the generator and parse
    the line a second time, as it would with a plain projection."""
    schema = T.StructType([*spec.schema().fields, T.StructField(_BAD, T.StringType())])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _BAD}
    more = [c for c in lines.columns if c != "value"]
    return lines.select(F.col("value").alias(_LINE), *more, F.inline(F.array(F.from_json("value", schema, options))))


def _fault(spec: RecordSpec) -> Column:
    """Why a parsed line is not a record; NULL for a good one."""
    missing = [
        F.when(F.col(name).isNull(), F.lit(f"missing {name}")) for name in spec.fields
    ]
    row = F.col(spec.row_field)
    unknown = F.when(
        ~spec.policy.rows.holds(row), F.concat(F.lit(f"unknown {spec.policy.rows.name} "), row)
    )
    malformed = F.when(F.col(_BAD).isNotNull(), F.lit("malformed"))
    return F.coalesce(malformed, *missing, unknown)


def parse_records(lines: DataFrame, spec: RecordSpec, strict: bool = False) -> DataFrame:
    """Records of the good lines. ``strict`` fails the job on a bad line instead
    of leaving it to :func:`rejected_lines`."""
    judged = _parsed(lines, spec).withColumn(_FAULT, _fault(spec))
    if strict:
        good = F.when(F.col(_FAULT).isNull(), F.lit(True)).otherwise(
            F.raise_error(F.concat(F.lit("bad record: "), _FAULT)).cast("boolean")
        )
        judged = judged.where(good)
    else:
        judged = judged.where(F.col(_FAULT).isNull())
    return judged.select(*spec.fields)


def rejected_lines(lines: DataFrame, spec: RecordSpec) -> DataFrame:
    """(value, fault) of the lines :func:`parse_records` leaves out."""
    judged = _parsed(lines, spec).withColumn(_FAULT, _fault(spec))
    return judged.where(F.col(_FAULT).isNotNull()).select(F.col(_LINE).alias("value"), F.col(_FAULT).alias("fault"))


def judged_lines(lines: DataFrame, spec: RecordSpec, strict: bool = False) -> DataFrame:
    """Good and bad lines in one pass: the fields, the line itself, why it is no record,
    and the further columns of ``lines``. ``strict`` fails the job on a bad line."""
    fault = _fault(spec)
    if strict:
        fault = F.when(fault.isNotNull(), F.raise_error(F.concat(F.lit("bad record: "), fault)).cast("string"))
    more = [c for c in lines.columns if c != "value"]
    return _parsed(lines, spec).select(*spec.fields, *more, _LINE, fault.alias(_FAULT))


def record_lines(records: DataFrame, spec: RecordSpec) -> DataFrame:
    """Records as JSON lines, the inverse of :func:`parse_records`."""
    fields = [F.col(name).cast("string").alias(name) for name in spec.fields]
    return records.select(F.to_json(F.struct(*fields)).alias("value"))
