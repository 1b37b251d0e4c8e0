"""Vectorised work on the words and bytes of Arrow text columns, a slice of rows at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text worked on at once; a longer text is a slice of its own.
SLICE_BYTES = 1 << 20

#: Separators of words: blank and the control characters tab to carriage return.
_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS: dict[int, np.ndarray] = {}


def utf8_column(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a text column and the row bounds in them; null counts as empty."""
    column = batch.column(batch.schema.get_field_index(name)).cast(pa.large_utf8()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    body = column.buffers()[2]
    data = np.frombuffer(body, np.uint8) if body is not None and len(column) else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]] if len(column) else data, offsets - offsets[0]


def row_slices(bounds: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``most`` bytes, every row whole."""
    row, rows = 0, len(bounds) - 1
    while row < rows:
        end = max(row + 1, int(np.searchsorted(bounds, bounds[row] + most, "right")) - 1)
        yield row, min(end, rows)
        row = min(end, rows)


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int, base: int = _BASE) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64; kept between calls up to the size of a slice."""
    known = _POWERS.get(base)
    if known is None or len(known) < n:
        table = np.full(max(n, SLICE_BYTES + 1), base, np.uint64)
        table[0] = 1
        known = np.multiply.accumulate(table)
        if n <= SLICE_BYTES + 1:
            _POWERS[base] = known
    return known[:n]


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """Running polynomial hash; ``span_hashes`` reads any span from it."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(len(data)), out=out[1:])
    return out


def span_hashes(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return mix((prefix[ends] - prefix[starts]) * powers(len(prefix), _BASE_INVERSE)[starts])


def word_spans(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and rows of the words; a word never crosses a row."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, none
    inside = ~_SEPARATOR[data]
    before = np.empty(len(data), bool)
    before[0], before[1:] = False, inside[:-1]
    before[bounds[:-1][bounds[:-1] < len(data)]] = False
    after = np.empty(len(data), bool)
    after[-1], after[:-1] = False, inside[1:]
    after[bounds[1:][bounds[1:] > 0] - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(bounds, starts, "right") - 1


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return span_hashes(prefix_hashes(data), starts, ends)


def shingles(hashes: np.ndarray, rows: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and rows of all ``width``-word shingles; a shorter row is one shingle."""
    n = len(hashes)
    if not n:
        return hashes, rows
    first = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
    count = np.diff(np.r_[first, n])
    step = powers(width + 1)
    total = np.zeros(max(n - width + 1, 0), np.uint64)
    for j in range(width):
        total += hashes[j : j + len(total)] * step[j + 1]
    whole = np.flatnonzero(rows[: len(total)] == rows[width - 1 :]) if len(total) else np.zeros(0, np.int64)
    out, of = [mix(total[whole])], [rows[whole]]
    short = np.flatnonzero(count < width)
    if len(short):
        part = np.zeros(len(short), np.uint64)
        for j in range(width - 1):
            has = count[short] > j
            part[has] += hashes[first[short][has] + j] * step[j + 1]
        out.append(mix(part + count[short].astype(np.uint64)))
        of.append(rows[first[short]])
    return np.concatenate(out), np.concatenate(of)


def distinct_by_row(values: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of each row, sorted by row and value."""
    order = np.lexsort((values, rows))
    values, rows = values[order], rows[order]
    if len(values):
        keep = np.r_[True, (values[1:] != values[:-1]) | (rows[1:] != rows[:-1])]
        values, rows = values[keep], rows[keep]
    return values, rows
