"""Benchmark decontamination by template canonicalisation.

Words are read in three ways: as they stand, in lower-case letters; folded, with
numbers, units and names (capitalised words inside a sentence) as typed
placeholders; and folded with capitalised words as names wherever they stand.
Windows of each reading are hash-joined with those of the benchmark. Where a
document holds enough of an item's windows on one alignment, or on alignments a
few words apart, and the placeholders are filled consistently (equal fillers in
the item stand for equal fillers in the document, and the other way round), it
holds the item, if need be with other numbers and names. Words as they stand
need no placeholders, so a copy is found whatever its line ends and its case. A
long unbroken run of an item's windows counts whatever the item's length.

Cases: null or empty texts hold nothing, and items without a word cannot be
held. An item of fewer words than a window is one window; one of fewer than LEAST_WORDS
words, too common to be told from chance within a sentence, is held where it is a whole line,
in letters of any case (its ``place`` is null). Windows with less than half plain words are looked for only as
they stand, and an item of nothing else only as a whole. Repeated rows of a document
count as one document, repeated items as one item. Documents without an id are
never reported. With an empty benchmark, or no documents, there are no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sealdex.llm.words import mix, powers, prefix_hashes, row_slices, span_hashes, utf8_column, word_spans
from sealdex.session import staged, staging

WINDOW = 8
#: Share of an item's windows that a document must hold on one alignment.
COVERAGE = 0.5
#: Words of an unbroken run that is held whatever the item's length.
LONG_RUN = 25
#: Alignments that differ by up to half as many words, by words put in or left out, count together.
NEARBY = 16
#: Bits of the filter that windows pass before they are shuffled: a fixed size,
#: whatever the benchmark's; more windows only let more pass.
FILTER_BITS = 1 << 24
#: Items of fewer words are looked for as whole lines only.
LEAST_WORDS = 5

UNITS = (
    "mm cm m km inch inches foot feet yard yards mile miles mg g kg gram grams kilogram kilograms ounce ounces lb lbs pound pounds "
    "ml l litre litres liter liters gallon gallons s sec second seconds min minute minutes h hour hours day days week weeks month "
    "months year years usd eur gbp dollar dollars euro euros cent cents percent kmh mph degrees celsius fahrenheit watt watts volt volts"
).split()
_PLACEHOLDER = {"number": np.uint64(11), "name": np.uint64(22), "unit": np.uint64(33)}

_DIGIT, _UPPER, _LOWER, _HIGH = (np.zeros(256, bool) for _ in range(4))
_DIGIT[48:58], _UPPER[65:91], _LOWER[97:123], _HIGH[128:] = True, True, True, True
_LETTER = _UPPER | _LOWER | _HIGH
_SENTENCE_END = np.zeros(256, bool)
_SENTENCE_END[[ord(c) for c in ".!?:;|\"()#&%$*"]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


def _unit_hashes() -> np.ndarray:
    body = " ".join(UNITS).encode()
    data = np.frombuffer(body, np.uint8)
    starts, ends, _ = word_spans(data, np.array([0, len(data)]))
    return np.sort(span_hashes(prefix_hashes(data), starts, ends))


_UNITS = _unit_hashes()


#: Readings of a window, as bits: a window that reads the same in several ways has all of theirs.
AS_IT_STANDS, FOLDED, FOLDED_ANYWHERE = 1, 2, 4


def canonical_words(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes, placeholders (0: none), whether a capital opens a sentence there, and rows.

    A word is a run between blanks, stripped of all but letters and digits at
    both ends; runs of nothing else are skipped. A number is digits alone but
    for separators; a unit is a known unit straight after a number; a name is a
    capitalised word, for sure only inside a sentence.
    """
    starts, ends, rows = word_spans(data, bounds)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, bool), rows
    kept = (_LETTER | _DIGIT)[data]
    total = np.r_[0, np.cumsum(kept)]
    solid = total[ends] > total[starts]
    after = _SENTENCE_END[data[ends - 1]]
    # A sentence begins after closing punctuation, at a row's start or after a line's end.
    newline = np.r_[0, np.cumsum(data == 10)]
    opens = np.r_[True, after[:-1] | (rows[1:] != rows[:-1]) | (newline[starts[1:]] > newline[ends[:-1]])]
    starts, ends, rows, opens = starts[solid], ends[solid], rows[solid], opens[solid]
    places = np.flatnonzero(kept)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, bool), rows
    first = places[np.searchsorted(places, starts)]
    last = places[np.searchsorted(places, ends) - 1] + 1
    inner = _FOLD[data]
    # Capital letters with accents are two bytes, of which the second differs by the same step.
    inner[1:] += np.where((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97), 32, 0).astype(np.uint8)
    prefix = prefix_hashes(inner)
    hashes = span_hashes(prefix, first, last)
    letters = np.r_[0, np.cumsum(_LETTER[data])]
    digits = np.r_[0, np.cumsum(_DIGIT[data])]
    number = (letters[last] == letters[first]) & (digits[last] > digits[first])
    follows = np.r_[False, number[:-1] & (rows[1:] == rows[:-1])]
    place = np.minimum(np.searchsorted(_UNITS, hashes), len(_UNITS) - 1)
    unit = follows & (_UNITS[place] == hashes)
    uppers = np.r_[0, np.cumsum(_UPPER[data])]
    capital = _UPPER[data[first]] & (uppers[last] - uppers[first] == 1) & (last - first > 1)
    none = np.uint64(0)
    holder = np.where(number, _PLACEHOLDER["number"], np.where(unit, _PLACEHOLDER["unit"], np.where(capital, _PLACEHOLDER["name"], none)))
    return hashes, holder, capital & opens & ~number & ~unit, rows


def windows(hashes: np.ndarray, holder: np.ndarray, opening: np.ndarray, rows: np.ndarray, width: int, whole_rows: bool, sparse: bool):
    """Hash, readings, first word's index, fillers of the words, and whether dense: all windows of all readings.

    ``whole_rows``: only of rows of just so many words. ``sparse``: folded
    windows need half plain words (those that may be names at the beginning of
    a sentence count, but half of that must be sure).
    """
    m = len(hashes) - width + 1
    if m <= 0:
        return
    inside = rows[:m] == rows[width - 1 :]
    if whole_rows:
        inside &= np.r_[True, rows[: m - 1] != rows[1:m]] & np.r_[rows[width:] != rows[: m - 1], True]
    step = powers(width + 1)

    def count(what: np.ndarray) -> np.ndarray:
        total = np.r_[0, np.cumsum(what)]
        return total[width:] - total[:m]

    sure = (holder != 0) & ~opening
    names, opened = count(sure), count(opening)
    dense = width - names < width / 2
    readings = (
        (np.zeros(len(holder), bool), inside, AS_IT_STANDS + FOLDED * (names == 0) + FOLDED_ANYWHERE * (names + opened == 0)),
        (sure, inside & (names > 0) & ~(dense & sparse), FOLDED + FOLDED_ANYWHERE * (opened == 0)),
        (holder != 0, inside & (opened > 0) & ~((dense | (width - names - opened < width / 4)) & sparse), np.full(m, FOLDED_ANYWHERE)),
    )
    for held, wanted, bits in readings:
        folded = np.where(held, holder, hashes)
        total = np.zeros(m, np.uint64)
        for j in range(width):
            total += folded[j : j + m] * step[j + 1]
        good = np.flatnonzero(wanted)
        yield mix(total[good]), bits[good], good, np.where(held, hashes | np.uint64(1), np.uint64(0)), dense[good]


_ROWS = "id long, key long, readings long, place long, dense boolean, fillers array<long>"


def _emit(widths_of, accept, sparse: bool):
    """Windows of the texts in all the widths asked for, those that ``accept`` lets pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, bounds = utf8_column(batch, "text")
            for low, high in row_slices(bounds):
                part = data[bounds[low] : bounds[high]]
                hashes, holder, opening, rows = canonical_words(part, bounds[low : high + 1] - bounds[low])
                begin = np.searchsorted(rows, rows)
                for width, whole_rows in widths_of:
                    for keys, bits, at, fillers, dense in windows(hashes, holder, opening, rows, width, whole_rows, sparse):
                        keep = np.flatnonzero(accept(keys))
                        if not len(keep):
                            continue
                        at = at[keep]
                        own = fillers.view(np.int64)[at[:, None] + np.arange(width)].reshape(-1)
                        yield pa.RecordBatch.from_arrays(
                            [
                                batch.column(0).take(pa.array(low + rows[at])), pa.array(keys[keep].view(np.int64)), pa.array(bits[keep], pa.int64()), pa.array(at - begin[at]),
                                pa.array(dense[keep]), pa.ListArray.from_arrays(pa.array(np.arange(0, len(own) + 1, width), pa.int32()), pa.array(own)),
                            ],
                            names=["id", "key", "readings", "place", "dense", "fillers"],
                        )

    return run


def contaminated(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, coverage: float = COVERAGE,
    id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """(doc_id, item_id, matched, windows, place, reparameterised) of every item a document holds.

    ``place`` is the word of the document where the item's first word stands (or
    would), ``reparameterised`` tells whether placeholders are filled otherwise.
    """
    items = benchmark.select(F.col(f"`{item_col}`").cast("long").alias("id"), F.col(f"`{item_text}`").alias("text")).where("id IS NOT NULL").distinct()
    plain = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text")).where("id IS NOT NULL")
    with staging(docs.sparkSession, "decontamination") as stage:
        held = _held(plain, items, window, coverage, stage)
        short = stage(_plain_words(items, "text").where(f"size(words) BETWEEN 1 AND {LEAST_WORDS - 1}"), "short")
        if not short.isEmpty():
            held = held.unionByName(_held_lines(plain, short))
        return staged(held, "contaminated")


def _plain_words(rows: DataFrame, text_col: str) -> DataFrame:
    """(id, words): the words of a text in lower-case letters."""
    lower = F.translate(F.col(text_col), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return rows.select("id", F.filter(F.split(lower, r"[\x20\x09-\x0D]+"), lambda w: w != "").alias("words"))


def _held_lines(plain: DataFrame, short: DataFrame) -> DataFrame:
    """Documents of which a whole line is an item too short for windows."""
    lines = _plain_words(plain.select("id", F.explode(F.split("text", "\n")).alias("line")), "line")
    lines = lines.where(f"size(words) BETWEEN 1 AND {LEAST_WORDS - 1}").distinct()
    met = lines.join(short.select(F.col("id").alias("item_id"), "words"), "words").select(F.col("id").alias("doc_id"), "item_id").distinct()
    one = F.lit(1).cast("long")
    return met.select("doc_id", "item_id", one.alias("matched"), one.alias("windows"), F.lit(None).cast("long").alias("place"), F.lit(False).alias("reparameterised"))


def _held(plain: DataFrame, items: DataFrame, window: int, coverage: float, write) -> DataFrame:
    spark = plain.sparkSession
    everything = lambda keys: np.ones(len(keys), bool)
    known = write(
        items.mapInArrow(_emit([(window, False), *((w, True) for w in range(LEAST_WORDS, window))], everything, True), _ROWS).select(F.col("id").alias("item"), "key", F.col("readings").alias("item_readings"), "dense", F.col("place").alias("item_place"), F.col("fillers").alias("item_fillers")),
        "items",
    )
    # Widths of the short items, at most window - 1 of them.
    widths = sorted({r[0] for r in known.select(F.size("item_fillers").alias("w")).distinct().collect()})
    bit = F.pmod("key", F.lit(FILTER_BITS))
    marked = known.groupBy(F.floor(bit / 32).alias("at")).agg(F.bit_or(F.expr(f"shiftleft(1L, CAST(pmod(key, {FILTER_BITS}) % 32 AS INT))")).alias("bits")).collect()
    table = np.zeros(FILTER_BITS // 32, np.uint32)
    for row in marked:
        table[row["at"]] = row["bits"]
    packed = spark.sparkContext.broadcast(table.tobytes())

    def accept(keys: np.ndarray) -> np.ndarray:
        at = np.mod(keys.view(np.int64), FILTER_BITS)
        bits = np.frombuffer(packed.value, np.uint32)[at >> 5]
        return (bits >> (at & 31).astype(np.uint32)) & np.uint32(1) == 1

    found = plain.mapInArrow(_emit([(w, False) for w in widths], accept, False), _ROWS).drop("dense")
    met = found.join(known, "key").where(F.size("fillers") == F.size("item_fillers")).withColumn("both", F.col("readings").bitwiseAND(F.col("item_readings"))).where("both <> 0")
    hits = write(met.select("id", "item", "item_place", "dense", "fillers", "item_fillers", "both", (F.col("place") - F.col("item_place")).alias("shift")), "hits")

    # Each folding is judged with the windows found as they stand, and these by themselves.
    judged = F.array(*[F.when(F.col("both").bitwiseAND(AS_IT_STANDS | bit) != 0, F.lit(bit)) for bit in (AS_IT_STANDS, FOLDED, FOLDED_ANYWHERE)])
    judged = hits.withColumn("reading", F.explode(judged)).where(f"reading IS NOT NULL AND (reading = {AS_IT_STANDS} OR NOT dense)").drop("both")
    isle = F.col("item_place") - F.dense_rank().over(Window.partitionBy("id", "item", "reading", "shift").orderBy("item_place"))
    # One alignment, alignments of a stretch (two grids of stretches), or an unbroken run of one alignment.
    groups = F.array(
        F.struct(F.lit(0).alias("how"), F.col("shift").alias("at"), F.lit(0).cast("long").alias("isle")),
        F.struct(F.lit(1).alias("how"), F.floor(F.col("shift") / NEARBY).alias("at"), F.lit(0).cast("long").alias("isle")),
        F.struct(F.lit(2).alias("how"), F.floor((F.col("shift") + NEARBY // 2) / NEARBY).alias("at"), F.lit(0).cast("long").alias("isle")),
        F.struct(F.lit(3).alias("how"), F.col("shift").alias("at"), F.col("isle").cast("long").alias("isle")),
    )
    grouped = judged.withColumn("isle", isle).withColumn("group", F.explode(groups)).drop("isle").select("*", "group.*").drop("group")
    one = ["id", "item", "reading", "how", "at", "isle"]
    totals = known.groupBy("item").agg(F.countDistinct("item_place").alias("all"), F.countDistinct(F.when(~F.col("dense"), F.col("item_place"))).alias("sparse"))
    # A window is counted once.
    places = grouped.groupBy(*one, "item_place").agg(F.min("shift").alias("shift"), F.max((~F.col("dense")).cast("int")).alias("plain"))
    aligned = places.groupBy(*one).agg(F.count("*").alias("matched"), F.min("shift").alias("shift"), F.max("plain").alias("plain"))
    aligned = aligned.join(totals, "item").withColumn("windows", F.when(F.col("reading") == AS_IT_STANDS, F.col("all")).otherwise(F.col("sparse")))
    share = (F.col("matched") >= F.lit(coverage) * F.col("windows")) & ((F.col("plain") == 1) | (F.col("matched") == F.col("windows")))
    long_run = (F.col("how") == 3) & (F.col("plain") == 1) & (F.col("matched") > LONG_RUN - window)
    enough = write(aligned.where(share | long_run), "enough")
    slots = (
        grouped.join(enough.select(*one), one, "left_semi")
        .select(*one, F.explode(F.arrays_zip("fillers", "item_fillers")).alias("slot"))
        .select(*one, F.col("slot.fillers").alias("got"), F.col("slot.item_fillers").alias("had"))
        .where(f"got <> 0 AND reading <> {AS_IT_STANDS}")
        .distinct()
        .groupBy(*one)
        .agg(
            F.count("*").alias("pairs"),
            F.countDistinct("got").alias("gots"),
            F.countDistinct("had").alias("hads"),
            F.max((F.col("got") != F.col("had")).cast("int")).alias("other"),
        )
    )
    held = enough.join(slots, one, "left").where("pairs IS NULL OR (pairs = gots AND pairs = hads)")
    best = held.groupBy("id", "item").agg(F.max(F.struct("matched", (-F.col("how")).alias("single"), (-F.col("shift")).alias("back"), "windows", "other")).alias("best"))
    return best.select(
        F.col("id").alias("doc_id"),
        F.col("item").alias("item_id"),
        F.col("best.matched").alias("matched"),
        F.col("best.windows").alias("windows"),
        (-F.col("best.back")).alias("place"),
        (F.coalesce("best.other", F.lit(0)) == 1).alias("reparameterised"),
    )
