"""Toxicity: a linear classifier of character n-grams scaled by naive Bayes log-count ratios.

A text's features are the character n-grams (3 to 6 code points of the
lower-cased text) that it holds at least once, hashed into buckets. A bucket's
value is its log-count ratio: the logarithm of the smoothed share of toxic
documents that hold it over that of clean ones. Logistic regression with a
quadratic penalty then weighs these values, so an n-gram that the ratios
overrate can be turned down.

The model is fitted on a bounded sample: the labelled documents of smallest id
hash, at most ``MOST_TOXIC`` and ``MOST_CLEAN`` of at most ``MOST_BYTES`` bytes,
and the ``FEATURES`` buckets whose shares differ most, of those that two
documents hold. Spark counts the buckets; the driver holds the chosen ones and
the sample's places in them (two bytes each). Every whole text of the table is
then scored where it lies.

Cases: a null or empty text, or one shorter than three characters, has no
features and gets the score of the bias. A document with contradicting labels,
or a null label or id, is not learnt from; of a repeated id the least text is. With
no label at all every score is 0.5; with one kind only, the smoothed share of
that kind. Repeated rows get equal scores; ties in a hash are ordered by id. An
empty table gives no rows. Further columns are not read, whatever their names. A
very long text is read in pieces that overlap, so memory does not grow with it
beyond its own bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sealdex.llm.words import SLICE_BYTES, prefix_hashes, row_slices, span_hashes, utf8_column
from sealdex.session import staging

ORDERS = (3, 4, 5, 6)
#: Buckets that n-grams are hashed into, as a power of two.
BUCKET_BITS = 20
#: Buckets a model weighs; their numbers fit two bytes.
FEATURES = 1 << 15
#: Bound of the sample the model is fitted on.
MOST_TOXIC, MOST_CLEAN, MOST_BYTES = 1500, 3000, 50_000
EPOCHS, RATE, PENALTY = 100, 0.01, 0.01
#: A fifth of the documents by crc32 of their id is never learnt from.
FOLDS, HELD_OUT = 5, 0

#: Rows whose features are marked at once, and bytes that the longest n-gram may take.
_ROWS = 512
_LONGEST = 4 * max(ORDERS)


def _lowered(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    text = batch.column(batch.schema.get_field_index(name)).cast(pa.large_utf8()).fill_null("")
    return utf8_column(pa.RecordBatch.from_arrays([pc.utf8_lower(text)], names=["text"]), "text")


def _ngrams(data: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bucket, row) of every n-gram, a piece of the bytes and an order at a time."""
    for at in range(0, len(data), SLICE_BYTES):
        piece = data[at : at + SLICE_BYTES + _LONGEST]
        starts = np.flatnonzero((piece & 0xC0) != 0x80)
        ends = np.r_[starts, len(piece)] + at
        own = int(np.searchsorted(starts, SLICE_BYTES))
        row = np.searchsorted(bounds, ends[:own], "right") - 1
        prefix = prefix_hashes(piece)
        for n in ORDERS:
            first = np.arange(min(own, len(ends) - n))
            first = first[ends[first + n] <= bounds[row[first] + 1]]
            hashes = span_hashes(prefix, ends[first] - at, ends[first + n] - at)
            yield (hashes >> np.uint64(64 - BUCKET_BITS)).astype(np.int64), row[first]


def _marked(data: np.ndarray, bounds: np.ndarray, place: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) of the features each row holds, once each; ``place`` numbers the buckets, -1 for none."""
    rows = len(bounds) - 1
    seen = np.zeros(rows * width, bool)
    for bucket, row in _ngrams(data, bounds):
        feature = place[bucket]
        held = feature >= 0
        seen[row[held] * width + feature[held]] = True
    return np.divmod(np.flatnonzero(seen), width)


def _row_groups(bounds: np.ndarray) -> Iterator[tuple[int, int]]:
    for low, high in row_slices(bounds):
        for start in range(low, high, _ROWS):
            yield start, min(start + _ROWS, high)


@dataclass
class Model:
    """Chosen buckets, what each adds to the logit (weight times ratio), and the bias."""

    buckets: np.ndarray
    added: np.ndarray
    bias: float

    def scores(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        place = np.full(1 << BUCKET_BITS, -1, np.int64)
        place[self.buckets] = np.arange(len(self.buckets))
        out = [np.zeros(0)]
        for low, high in _row_groups(bounds):
            part = data[bounds[low] : bounds[high]]
            row, feature = _marked(part, bounds[low : high + 1] - bounds[low], place, max(len(self.buckets), 1))
            out.append(np.bincount(row, self.added[feature], high - low))
        return _sigmoid(np.concatenate(out) + self.bias)


@dataclass
class Constant:
    """Where there is nothing to tell apart."""

    value: float

    def scores(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        return np.full(len(bounds) - 1, self.value)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(x / 2))


def fit(rows: np.ndarray, features: np.ndarray, labels: np.ndarray, ratios: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights and bias of (row, feature) places by Adam on the penalised logistic loss, the classes weighed alike."""
    docs, width = len(labels), len(ratios)
    share = np.where(labels == 1, 0.5 / labels.sum(), 0.5 / (1 - labels).sum())
    value = ratios[features]
    w, m, v = (np.zeros(width + 1) for _ in range(3))
    for epoch in range(1, EPOCHS + 1):
        logit = np.bincount(rows, value * w[features], docs) + w[width]
        delta = share * (_sigmoid(logit) - labels)
        grad = np.r_[np.bincount(features, value * delta[rows], width) + PENALTY * w[:width], delta.sum()]
        m = 0.9 * m + 0.1 * grad
        v = 0.99 * v + 0.01 * grad**2
        w = w - RATE * (m / (1 - 0.9**epoch)) / (np.sqrt(v / (1 - 0.99**epoch)) + 1e-8)
    return w[:width], float(w[width])


def _fold(id_col: str) -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % FOLDS


def _sample(labels: DataFrame, id_col: str, label_col: str) -> DataFrame:
    """(id, label) of the labelled documents that are learnt from."""
    known = (
        labels.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{label_col}`").alias("label"))
        .where("id IS NOT NULL AND label IN (0, 1)")
        .where(_fold("id") != HELD_OUT)
        .groupBy("id")
        .agg(F.min("label").alias("label"), F.max("label").alias("top"))
        .where("label = top")
        .select("id", "label")
    )
    least = [known.where(F.col("label") == k).orderBy(F.xxhash64("id"), "id").limit(n) for k, n in ((1, MOST_TOXIC), (0, MOST_CLEAN))]
    return least[0].unionByName(least[1])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(bucket, toxic, clean): documents that hold each bucket, by label."""
    size = 1 << BUCKET_BITS
    held = np.zeros((2, size), np.int64)
    for batch in batches:
        data, bounds = _lowered(batch, "text")
        label = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
        for r in range(len(label)):
            seen = np.zeros(size, bool)
            low, high = bounds[r], bounds[r + 1]
            for bucket, _ in _ngrams(data[low:high], np.array([0, high - low])):
                seen[bucket] = True
            held[label[r]] += seen
    some = np.flatnonzero(held.any(0))
    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(held[1][some]), pa.array(held[0][some])], names=["bucket", "toxic", "clean"])


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model | Constant:
    """Fit on the sample that the module describes."""
    sample = _sample(labels, id_col, label_col)
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    with staging(docs.sparkSession, "toxicity") as stage:
        # At most MOST_TOXIC + MOST_CLEAN ids: a broadcast of known size.
        learnt = (
            texts.join(F.broadcast(sample), "id")
            .where(F.coalesce(F.octet_length("text"), F.lit(0)) <= MOST_BYTES)
            .groupBy("id")
            .agg(F.min("label").alias("label"), F.min("text").alias("text"))
        )
        learnt = stage(learnt, "learnt")
        sizes = {r["label"]: r["n"] for r in learnt.groupBy("label").agg(F.count("*").alias("n")).collect()}
        toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
        if not toxic or not clean:
            return Constant((toxic + 1) / (toxic + clean + 2))
        share = (F.col("toxic") + F.col("clean")) / F.lit(toxic + clean)
        apart = F.abs(F.col("toxic") / F.lit(toxic) - F.col("clean") / F.lit(clean)) / F.sqrt(share * (1 - share) + F.lit(1e-9))
        counts = learnt.mapInArrow(_counted, "bucket long, toxic long, clean long").groupBy("bucket")
        chosen = (
            counts.agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
            .where("toxic + clean >= 2")
            .orderBy(apart.desc(), "bucket")
            .limit(FEATURES)
            .collect()
        )
        if not chosen:
            return Constant((toxic + 1) / (toxic + clean + 2))
        buckets, n1, n0 = (np.array([r[k] for r in chosen]) for k in ("bucket", "toxic", "clean"))
        ratios = np.log((n1 + 1) / (toxic + 2)) - np.log((n0 + 1) / (clean + 2))

        def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            place = np.full(1 << BUCKET_BITS, -1, np.int64)
            place[buckets] = np.arange(len(buckets))
            for batch in batches:
                data, bounds = _lowered(batch, "text")
                held = [_marked(data[a:b], np.array([0, b - a]), place, len(buckets))[1].astype("<u2").tobytes() for a, b in zip(bounds, bounds[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1).cast(pa.int64()), pa.array(held, pa.binary())], names=["id", "label", "held"])

        rows = learnt.mapInArrow(placed, "id long, label long, held binary").orderBy("id").collect()
    held = [np.frombuffer(r["held"], "<u2").astype(np.int64) for r in rows]
    row = np.repeat(np.arange(len(held)), [len(h) for h in held])
    weights, bias = fit(row, np.concatenate(held), np.array([r["label"] for r in rows], np.float64), ratios)
    return Model(buckets, weights * ratios, bias)


def scored(docs: DataFrame, model: Model | Constant, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.scores(*_lowered(batch, "text")))], names=["doc_id", "score"])

    plain = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return plain.mapInArrow(run, "doc_id long, score double").select(
        "doc_id",
        F.coalesce(_fold("doc_id") == HELD_OUT, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
