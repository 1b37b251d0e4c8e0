"""Exact token counts of whole texts and of all their prefixes, by dynamic programming.

``count[p] = count[start of the word that p cuts] + count of that cut word``:
the table of a text grows word by word, and a cut word's own count comes from
the table of the word, shared by all texts. A long word (text without white
space, as in Chinese, base64 or minified code) has a table of its own, piece by
piece, where the pre-tokenizer always cuts. Truncation and budget questions are
then look-ups; no text is encoded again.

Cases: a null or empty text has no tokens. Special strings inside a text count
as the library takes them by default. Repeated rows are counted each. An empty
table gives no rows. Columns other than id and text are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sealdex.llm.tokens import _SPREADS, WORD, Encoder, encoder
from sealdex.llm.words import row_slices, utf8_column

LIMIT = 2048
#: Words and pieces of more code points are not filled prefix by prefix.
SHORT = 64
#: Code points encoded at once, and pieces of a word counted at once.
AT_ONCE, PIECES_AT_ONCE = 1 << 20, 4096
#: Tokens beyond the budget, and code points on the way there, of a long piece: a
#: longer prefix can have fewer tokens, but by far not so many fewer.
BEYOND, STRIDE = 256, 256


class PrefixTable:
    """The counts of all prefixes of one text, by code point."""

    def __init__(self, text: str, own: Encoder):
        self.text, self.own = text, own
        if not own.by_word:
            # Such a library looks across blanks: every prefix is a text of its own.
            self.all = np.array(own.counts([text[:p] for p in range(len(text) + 1)]))
            return
        spans = [m.span() for m in WORD.finditer(text)]
        codes, _ = own.word_codes([text])
        self.starts, self.ends = [a for a, _ in spans], [b for _, b in spans]
        self.counts = np.r_[0, np.cumsum(own.length[codes], dtype=np.int64)]

    def at(self, p: int) -> int:
        """Tokens of ``text[:p]``."""
        if not self.own.by_word:
            return int(self.all[p])
        words = bisect_right(self.ends, p)
        here = int(self.counts[words])
        if words < len(self.starts) and self.starts[words] < p:
            here += count_within(self._word(words), p - self.starts[words], self.own)
        return here

    def longest(self, budget: int) -> int:
        """Code points of the longest prefix of at most ``budget`` tokens."""
        if not self.own.by_word:
            return int(np.flatnonzero(self.all <= budget)[-1])
        words = int(np.searchsorted(self.counts, budget, "right")) - 1
        if words >= len(self.starts):
            return len(self.text)
        left = budget - int(self.counts[words])
        return self.starts[words] + longest_within(self._word(words), left, self.own)

    def _word(self, i: int) -> str:
        return self.text[self.starts[i] : self.ends[i]]


@lru_cache(1 << 16)
def _kind(c: str) -> str:
    """L, N or S as the pre-tokenizer's classes; empty for what folding may join to its neighbour or that not all versions know."""
    kind = unicodedata.category(c)
    if kind[0] in "MCZ" or c == _SPREADS or 0x1100 <= ord(c) <= 0x11FF or unicodedata.ucd_3_2_0.category(c) != kind:
        return ""
    return kind[0] if kind[0] in "LN" else "S"


def cuts_of(word: str, own: Encoder) -> list[int]:
    """Places from 0 to the end where any prefix beyond is cut: what stands on both sides is counted apart.

    Letters are a piece, a number is one, other signs are one; an apostrophe may
    belong to the letters after it. Within a special string nothing is cut.
    """
    kinds = [_kind(c) for c in word]
    special = re.finditer("|".join(map(re.escape, own.added)), word) if own.added else ()
    held = {i for m in special for i in range(m.start(), m.end())}
    cuts = [0]
    for i in range(1, len(word)):
        a, b = kinds[i - 1], kinds[i]
        if a and b and i not in held and (a == "N" or a != b) and not (word[i - 1] == "'" and b == "L") and not (i - 1 in held):
            cuts.append(i)
    return [*cuts, len(word)]


def count_within(word: str, p: int, own: Encoder) -> int:
    """Tokens of ``word[:p]``."""
    if len(word) <= SHORT:
        return prefixes_of_word(word, own)[p]
    cuts, counts = _table(word, own)
    piece = bisect_right(cuts, p) - 1
    if cuts[piece] == p:
        return int(counts[piece])
    part = word[cuts[piece] : cuts[piece + 1]]
    within = prefixes_of_word(part, own)[p - cuts[piece]] if len(part) <= SHORT else own.counts([part[: p - cuts[piece]]])[0]
    return int(counts[piece]) + within


@lru_cache(16)
def _table(word: str, own: Encoder) -> tuple[list[int], np.ndarray]:
    cuts = cuts_of(word, own)
    return cuts, np.r_[0, np.cumsum([n for some in _pieces(word, cuts, own) for n in some])]


def _pieces(word: str, cuts: list[int], own: Encoder) -> Iterator[list[int]]:
    """Tokens of the pieces, so many at once."""
    for k in range(0, len(cuts) - 1, PIECES_AT_ONCE):
        yield own.counts([word[a:b] for a, b in zip(cuts[k : k + PIECES_AT_ONCE], cuts[k + 1 : k + 1 + PIECES_AT_ONCE], strict=False)])


def longest_within(word: str, budget: int, own: Encoder) -> int:
    """Code points of the longest prefix of at most ``budget`` tokens."""
    if len(word) > SHORT:
        cuts, piece = cuts_of(word, own), 0
        if len(cuts) > 2:
            for some in _pieces(word, cuts, own):
                total = np.cumsum(some)
                fit = int(np.searchsorted(total, budget, "right"))
                piece += fit
                if fit < len(some):
                    budget -= int(total[fit - 1]) if fit else 0
                    break
                budget -= int(total[-1])
            else:
                return len(word)
        return cuts[piece] + _longest_of_piece(word[cuts[piece] : cuts[piece + 1]], budget, own)
    return _longest_of_piece(word, budget, own)


def _longest_of_piece(piece: str, budget: int, own: Encoder) -> int:
    if len(piece) <= SHORT:
        return [p for p, n in enumerate(prefixes_of_word(piece, own)) if n <= budget][-1]
    end = STRIDE
    while end < len(piece) and own.counts([piece[:end]])[0] <= budget + BEYOND:
        end += STRIDE
    end = min(end, len(piece))
    while end:
        # Downwards, so the first that fits is the longest.
        some = max(1, min(SHORT, AT_ONCE // end, end))
        for p, n in zip(range(end, end - some, -1), own.counts([piece[:p] for p in range(end, end - some, -1)]), strict=True):
            if n <= budget:
                return p
        end -= some
    return 0


#: Tables of cut words kept by a worker, by encoder.
_CUT: dict[tuple[int, str], list[int]] = {}
_CUT_KEPT = 100_000


def prefixes_of_word(word: str, own: Encoder) -> list[int]:
    """Tokens of the prefixes of a word, from none to all of it."""
    key = (id(own), word)
    if key not in _CUT:
        if len(_CUT) >= _CUT_KEPT:
            _CUT.clear()
        _CUT[key] = own.counts([word[:p] for p in range(len(word) + 1)])
    return _CUT[key]


def _counted(path: str, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for batch in batches:
            _, bounds = utf8_column(batch, "text")
            texts = batch.column(1).fill_null("")
            for low, high in row_slices(bounds):
                some = texts.slice(low, high - low).to_pylist()
                if own.by_word:
                    codes, of = own.word_codes(some)
                    running = np.r_[0, np.cumsum(own.length[codes], dtype=np.int64)]
                    n = running[of[1:]] - running[of[:-1]]
                else:
                    n = np.array(own.counts(some), np.int64)
                fits = [PrefixTable(t, own).longest(limit) if k > limit else len(t) for t, k in zip(some, n.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(low, high - low), pa.array(np.diff(bounds[low : high + 1])), pa.array(n), pa.array(n > limit), pa.array(fits, pa.int64())],
                    names=["doc_id", "n_bytes", "n_tokens", "over_limit", "fits_chars"],
                )

    return run


def token_counts(docs: DataFrame, vocabulary: str, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit, fits_chars) of every row.

    ``fits_chars``: code points of the longest prefix of at most ``limit`` tokens.
    """
    plain = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return plain.mapInArrow(_counted(vocabulary, limit), "doc_id long, n_bytes long, n_tokens long, over_limit boolean, fits_chars long")


def prefix_tables(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, counts): tokens of every prefix, from none to the whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(vocabulary)
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).fill_null("").to_pylist(), strict=True):
                table = PrefixTable(text, own)
                counts = [table.at(p) for p in range(len(text) + 1)]
                yield pa.RecordBatch.from_arrays([pa.array([doc], pa.int64()), pa.array([counts], pa.list_(pa.int32()))], names=["doc_id", "counts"])

    plain = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return plain.mapInArrow(run, "doc_id long, counts array<int>")
