"""Seal records part by part, and open the parts a keyring allows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sealdex.functions import crypto
from sealdex.functions.crypto import SecretRow, utf8
from sealdex.functions.uid import uid_bytes
from sealdex.operators.bounds import broadcast_if_few
from sealdex.operators.keyring import FEW_CLASSES, Keyring, key_column
from sealdex.operators.specs import RecordSpec

TERMS = "terms"

#: Where in its stream a line stood, as text that sorts as the lines do.
PLACE = "place"
#: A line that is no record, or not yet one, sealed for index writers.
SEALED_LINE = "sealed_line"
#: Classes of such lines: set aside as bad, or waiting behind the end of a stream.
REJECTED, WAITING = "-rejected", "-waiting"
LINE_CLASSES = (REJECTED, WAITING)
#: Helper columns of rows on their way to be sealed.
LINE_CLASS, LINE_BODY = "_line_class", "_line_body"
#: Up to so many classes a row's keys are looked up in one map; beyond, they come with the class.
LOOKED_UP_CLASSES = 64
RECORD_FRAME_BYTES = 4
PART_FRAME_BYTES = 8


def _binding(uid: Column, part: str) -> Column:
    return F.concat(uid, utf8(F.lit(part)))


def seal_records(df: DataFrame, spec: RecordSpec, classes: DataFrame, writer: SecretRow) -> DataFrame:
    """Sealed form of rows that carry (file, pos) and the fields of ``spec``.

    One narrow pass: a broadcast of the policy-sized class table, one MAC per
    record and one cipher call per part. The MAC covers the id and every part,
    so its nonce repeats only for identical content, and parts may share it
    because each is sealed under its own key. The index words travel with the
    record as one more sealed part that only the index writer opens.

    Rows may carry ``LINE_CLASS`` and ``LINE_BODY``: where a class is set the row is
    no record, and its body is sealed under the key of such lines. A place in a
    stream (``PLACE``) stays with its row.
    """
    row = F.col(spec.row_field)
    has_lines = LINE_CLASS in df.columns
    line_class = F.col(LINE_CLASS) if has_lines else F.lit(None).cast("string")
    line_body = F.col(LINE_BODY) if has_lines else F.lit(None).cast("string")
    place = F.col(PLACE) if PLACE in df.columns else F.lit(None).cast("string")
    is_record = line_class.isNull()
    unknown = F.raise_error(F.concat(F.lit("no seal class for "), F.coalesce(row, F.lit("NULL")))).cast("string")
    # Never null, which the writer then need not make sure of: it takes the rows in the order they come in.
    token = F.coalesce(line_class, F.col("class_token"), unknown, F.lit(""))
    bodies = {p.name: F.col(f"body_{p.name}") for p in spec.parts} | {TERMS: F.col(f"body_{TERMS}")}
    parts = [key_column(name) for name in bodies]
    classes = classes.withColumn(key_column(TERMS), _terms_key(writer))
    by_lookup = len(spec.policy.rows.values) <= LOOKED_UP_CLASSES
    joined = classes.select(spec.row_field, "class_token") if by_lookup else classes
    # Rows are brought in the order of their folders as they are, before they get ciphertext and,
    # where classes are few, keys: what is sorted is a fraction of what is written.
    placed = df.join(F.broadcast(joined), spec.row_field, "left").withColumn("class_token", token)
    placed = placed.sortWithinPartitions("class_token")
    if by_lookup:
        held = F.map_from_entries(F.collect_list(F.struct("class_token", F.struct(*parts))))
        own = F.try_element_at(classes.agg(held).scalar(), F.col("class_token"))
        placed = placed.withColumn("_keys", own).withColumns({k: F.col("_keys").getField(k) for k in parts})
    prepared = placed.select(
        "file",
        "pos",
        "class_token",
        uid_bytes(F.col("file"), F.col("pos")).alias("uid"),
        *[F.when(is_record, p.json()).alias(f"body_{p.name}") for p in spec.parts],
        F.when(is_record, F.to_json(spec.index.column())).alias(f"body_{TERMS}"),
        *parts,
        place.alias(PLACE),
        F.when(~is_record, utf8(line_body)).alias("line"),
    )
    covered = F.concat(F.col("uid"), utf8(F.concat_ws("\x1f", *bodies.values())))
    prepared = prepared.withColumn("nonce", crypto.nonce_from(writer.hmac("nonce", covered)))

    def sealed(part: str) -> Column:
        key, uid = F.col(key_column(part)), F.col("uid")
        return crypto.seal(utf8(bodies[part]), key, F.col("nonce"), _binding(uid, part)).alias(part)

    line = F.when(F.col("line").isNotNull(), _sealed_line(F.col("line"), writer)) if has_lines else F.lit(None).cast("binary")
    return prepared.select("file", "pos", "class_token", *[sealed(name) for name in bodies], PLACE, line.alias(SEALED_LINE))


_LINE_BINDING = "quarantine"


def _sealed_line(body: Column, writer: SecretRow) -> Column:
    nonce = crypto.nonce_from(writer.hmac("bad", body))
    return crypto.seal(body, writer.key("bad"), nonce, utf8(F.lit(_LINE_BINDING)))


def line_body(line: Column, fault: Column) -> Column:
    return F.to_json(F.struct(line.alias("value"), fault.alias("fault")))


def open_lines(lines: DataFrame, writer: SecretRow, *kept: str) -> DataFrame:
    """(value, fault) of sealed lines, and the columns named."""
    plain = crypto.open_or_fail(F.col(SEALED_LINE), writer.key("bad"), utf8(F.lit(_LINE_BINDING))).cast("string")
    return lines.select(*kept, F.from_json(plain, "value string, fault string").alias("line")).select(*kept, "line.*")


def _terms_key(writer: SecretRow) -> Column:
    return writer.hmac("terms", utf8(F.col("class_token")))


def open_terms(records: DataFrame, tokens: DataFrame, writer: SecretRow) -> DataFrame:
    """(uid, words) of sealed records of the given classes (one row per token).

    A damaged word list fails the job.
    """
    keys = tokens.select("class_token", _terms_key(writer).alias(key_column(TERMS)))
    uid = uid_bytes(F.col("file"), F.col("pos"))
    body = crypto.open_or_fail(F.col(TERMS), F.col(key_column(TERMS)), _binding(uid, TERMS))
    words = F.from_json(F.decode(body, "UTF-8"), "array<string>")
    keys = broadcast_if_few(keys, tokens.count(), FEW_CLASSES)
    return records.join(keys, "class_token").select(uid.alias("uid"), words.alias("words"))


def open_records(records: DataFrame, keyring: Keyring, spec: RecordSpec, kept: tuple[str, ...] = ()) -> DataFrame:
    """One flat row per record the keyring may see; closed parts stay NULL.

    The gate part is opened and parsed by a generator that yields no row where
    it stays closed. A filter would be pushed below and open the part twice.
    Parts that no class of this keyring opens are never read from the files.
    Where parts share a column the later part wins. Columns in ``kept`` stay.
    """
    if keyring.is_small:
        records = records.where(F.col("class_token").isin(keyring.tokens))
    keys = F.broadcast(keyring.frame) if keyring.is_small else keyring.frame
    uid = uid_bytes(F.col("file"), F.col("pos"))

    def body(part: str) -> Column:
        plain = crypto.open_or_null(F.col(part), F.col(key_column(part)), _binding(uid, part))
        return F.decode(plain, "UTF-8")

    gate, *others = spec.parts
    others = [p for p in others if p.name in keyring.openable]
    gate_names = [f"{gate.name}.{n}" for n in gate.names()]
    parsed = records.join(keys, "class_token").select(
        "file",
        "pos",
        *kept,
        *[c for p in others for c in (p.name, key_column(p.name))],
        F.inline(F.from_json(body(gate.name), T.ArrayType(gate.schema()))).alias(*gate_names),
    )
    parsed = parsed.select(
        "file",
        "pos",
        *kept,
        *[F.col(f"`{n}`") for n in gate_names],
        *[F.from_json(body(p.name), p.schema()).alias(p.name) for p in others],
    )
    holders: dict[str, list[Column]] = {}
    for part in spec.parts:
        for name in part.names():
            if part is gate:
                value = F.col(f"`{gate.name}.{name}`")
            elif part in others:
                value = F.col(part.name).getField(name)
            else:
                value = F.lit(None).cast("string")
            holders.setdefault(name, []).insert(0, value)
    values = [(F.coalesce(*cols) if len(cols) > 1 else cols[0]).alias(n) for n, cols in holders.items()]
    return parsed.select("file", "pos", *kept, *values)


def clear_json(opened: DataFrame, spec: RecordSpec) -> DataFrame:
    """Opened records as JSON lines; columns that stayed closed are left out."""
    return opened.select(F.to_json(F.struct(*spec.opened_columns())).alias("value"))


def sealed_size(parts: list[str]) -> Column:
    """Framed size of a sealed record: record frame, and a frame per part."""
    sizes = [F.octet_length(p).cast("bigint") + PART_FRAME_BYTES for p in parts]
    return reduce(lambda a, b: a + b, sizes, F.lit(RECORD_FRAME_BYTES).cast("bigint"))


def planned_size(spec: RecordSpec) -> Column:
    """The same size computed from the clear fields, before any encryption."""
    sizes = [
        F.octet_length(p.json()).cast("bigint") + crypto.SEAL_OVERHEAD + PART_FRAME_BYTES
        for p in spec.parts
    ]
    return reduce(lambda a, b: a + b, sizes, F.lit(RECORD_FRAME_BYTES).cast("bigint"))
