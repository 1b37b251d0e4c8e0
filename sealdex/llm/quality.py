"""Quality classifier: attention-based multiple-instance learning.

A document is a bag of passages. Every passage is encoded from its characters
and the repetition of its words; gated attention weighs the passages; the score
is a logistic function of the weighted encoding. Only documents are labelled:
what makes a passage tell is learnt from them.

The model is fitted on a bounded sample of labelled rows (``MAX_TRAINED``
documents of at most ``MAX_TRAINED_BYTES``) and then scores every whole text of
the table, each where it lies.

Cases: a null or empty text is a bag of one empty passage and gets a score. A
document with contradicting labels, or a null label or id, is not learnt from.
With no label at all every score is 0.5; with one kind only, the smoothed share
of that kind. Repeated rows get equal scores. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sealdex.llm.words import lower_ascii, mix, row_slices, utf8_column, word_hashes, word_spans

PASSAGE_BYTES = 512
#: Bound of the sample the model is fitted on.
MAX_TRAINED = 3000
MAX_TRAINED_BYTES = 50_000
EPOCHS, RATE, DECAY, HIDDEN, GATE = 150, 0.02, 1e-4, 24, 12
#: A third of the documents by crc32 of their id is never learnt from.
FOLDS, HELD_OUT = 3, 1

#: Kinds of bytes.
_KIND = np.zeros(256, np.int64)
for _i, _set in enumerate(("aeiou", "bcdfghjklmnpqrstvwxyz", "AEIOU", "BCDFGHJKLMNPQRSTVWXYZ", "0123456789", " ", "\n\t\r", ".", ",", ";:?!", "'\"()-", "#$%&*@^~", "|/\\_=+<>[]{}"), 1):
    _KIND[[ord(c) for c in _set]] = _i
_KIND[128:] = 14
_KINDS = 15
FEATURES = _KINDS * _KINDS + _KINDS + 6


def features(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Feature rows of all passages, and the bounds of the texts among them."""
    sizes = np.diff(bounds)
    count = np.maximum(-(-sizes // PASSAGE_BYTES), 1)
    of = np.r_[0, np.cumsum(count)]
    passages = int(of[-1])
    row = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(len(data)) - bounds[row]
    passage = of[row] + place // PASSAGE_BYTES
    kind = _KIND[data]
    one = np.bincount(passage * _KINDS + kind, minlength=passages * _KINDS).reshape(passages, _KINDS)
    inside = np.flatnonzero(row[1:] == row[:-1]) if len(data) else np.zeros(0, np.int64)
    pair = passage[inside] * _KINDS**2 + kind[inside] * _KINDS + kind[inside + 1]
    two = np.bincount(pair, minlength=passages * _KINDS**2).reshape(passages, -1)
    length = np.maximum(one.sum(1, keepdims=True), 1)

    more = np.zeros((passages, 6))
    lower = lower_ascii(data)
    starts, ends, rows = word_spans(lower, bounds)
    if len(starts):
        hashes, own = word_hashes(lower, starts, ends), passage[starts]
        words = np.maximum(np.bincount(own, minlength=passages), 1)
        same = np.r_[False, (hashes[1:] == hashes[:-1]) & (rows[1:] == rows[:-1])]
        more[:, 0] = np.bincount(own, same, passages) / words
        triple = hashes.copy()
        triple[2:] = mix(hashes[2:] + np.uint64(3) * hashes[1:-1] + np.uint64(7) * hashes[:-2])
        for k, values in ((1, hashes), (2, triple)):
            order = np.lexsort((values, rows))
            again = np.zeros(len(values), bool)
            again[order[1:]] = (values[order[1:]] == values[order[:-1]]) & (rows[order[1:]] == rows[order[:-1]])
            more[:, k] = np.bincount(own, again, passages) / words
        more[:, 3] = words / length[:, 0]
        more[:, 4] = np.bincount(own, ends - starts, passages) / words / 10
        more[:, 5] = np.log1p(sizes)[np.repeat(np.arange(len(sizes)), count)] / 10
    return np.concatenate([np.sqrt(one / length), np.sqrt(two / length), more], 1).astype(np.float32), of


@dataclass
class Model:
    """Passage encoder ``tanh(x W + b)``, gated attention ``w (tanh(h V) * sigmoid(h U))``, logistic output."""

    mean: np.ndarray
    scale: np.ndarray
    weights: dict[str, np.ndarray]

    def score(self, x: np.ndarray, of: np.ndarray) -> np.ndarray:
        return _forward(self.weights, (x - self.mean) / self.scale, of)["score"]


@dataclass
class Constant:
    """Where there is nothing to tell apart."""

    value: float

    def score(self, x: np.ndarray, of: np.ndarray) -> np.ndarray:
        return np.full(len(of) - 1, self.value)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(x / 2))


def _forward(w: dict[str, np.ndarray], x: np.ndarray, of: np.ndarray) -> dict[str, np.ndarray]:
    h = np.tanh(x @ w["W"] + w["b"])
    t, g = np.tanh(h @ w["V"]), _sigmoid(h @ w["U"])
    raw = (t * g) @ w["w"]
    bag = np.repeat(np.arange(len(of) - 1), np.diff(of))
    power = np.exp(raw - np.maximum.reduceat(raw, of[:-1])[bag])
    a = power / np.add.reduceat(power, of[:-1])[bag]
    z = np.add.reduceat(a[:, None] * h, of[:-1])
    return {"h": h, "t": t, "g": g, "a": a, "bag": bag, "z": z, "score": _sigmoid(z @ w["c"] + w["d"])}


def fit(x: np.ndarray, of: np.ndarray, labels: np.ndarray) -> Model | Constant:
    """Adam on the logistic loss, the classes weighed alike, from fixed first weights."""
    labels = labels.astype(np.float64)
    if not len(labels):
        return Constant(0.5)
    if labels.min() == labels.max():
        return Constant(float((labels.sum() + 1) / (len(labels) + 2)))
    mean, scale = x.mean(0), x.std(0) + 1e-2
    x = ((x - mean) / scale).astype(np.float64)
    draw = np.random.default_rng(7)
    shapes = {"W": (x.shape[1], HIDDEN), "V": (HIDDEN, GATE), "U": (HIDDEN, GATE)}
    w = {k: draw.normal(0, s[0] ** -0.5, s) for k, s in shapes.items()}
    w |= {"b": np.zeros(HIDDEN), "w": draw.normal(0, GATE**-0.5, GATE), "c": draw.normal(0, HIDDEN**-0.5, HIDDEN), "d": np.zeros(1)}
    share = np.where(labels == 1, 0.5 / labels.sum(), 0.5 / (1 - labels).sum())
    m, v = ({k: np.zeros_like(a) for k, a in w.items()} for _ in range(2))
    for epoch in range(1, EPOCHS + 1):
        f = _forward(w, x, of)
        delta = share * (f["score"] - labels)
        grad = {"d": delta.sum(keepdims=True), "c": f["z"].T @ delta}
        dz = (delta[:, None] * w["c"])[f["bag"]]
        da = (dz * f["h"]).sum(1)
        draw_ = f["a"] * (da - np.add.reduceat(f["a"] * da, of[:-1])[f["bag"]])
        grad["w"] = (f["t"] * f["g"]).T @ draw_
        dt = draw_[:, None] * w["w"] * f["g"] * (1 - f["t"] ** 2)
        dg = draw_[:, None] * w["w"] * f["t"] * f["g"] * (1 - f["g"])
        grad["V"], grad["U"] = f["h"].T @ dt, f["h"].T @ dg
        dh = (f["a"][:, None] * dz + dt @ w["V"].T + dg @ w["U"].T) * (1 - f["h"] ** 2)
        grad["W"], grad["b"] = x.T @ dh, dh.sum(0)
        for k in w:
            step = grad[k] + DECAY * w[k]
            m[k] = 0.9 * m[k] + 0.1 * step
            v[k] = 0.99 * v[k] + 0.01 * step**2
            w[k] = w[k] - RATE * (m[k] / (1 - 0.9**epoch)) / (np.sqrt(v[k] / (1 - 0.99**epoch)) + 1e-8)
    return Model(mean, scale, {k: a.astype(np.float32) for k, a in w.items()})


def _fold(id_col: str):
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % FOLDS


def train(docs: DataFrame, labels: DataFrame, most: int = MAX_TRAINED, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model | Constant:
    """Fit on at most ``most`` labelled rows, those of the smallest hash of the id, none of the held-out fold."""
    sample = (
        labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"))
        .where("id IS NOT NULL AND label IN (0, 1)")
        .where(_fold("id") != HELD_OUT)
        .groupBy("id")
        .agg(F.min("label").alias("label"), F.max("label").alias("top"))
        .where("label = top")
        .orderBy(F.xxhash64("id"), "id")
        .limit(most)
    )
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    # At most ``most`` ids and labels: a broadcast of known size.
    rows = (
        texts.join(F.broadcast(sample), "id")
        .where(F.coalesce(F.octet_length("text"), F.lit(0)) <= MAX_TRAINED_BYTES)
        .groupBy("id")
        .agg(F.min("text").alias("text"), F.min("label").alias("label"))
        .select("id", "label", "text")
        .mapInArrow(_featured, "id long, label long, passages int, features binary")
        .orderBy("id")
        .collect()
    )
    if not rows:
        return fit(np.zeros((0, FEATURES)), np.zeros(1, np.int64), np.zeros(0))
    x = np.concatenate([np.frombuffer(r["features"], np.float32).reshape(-1, FEATURES) for r in rows])
    of = np.r_[0, np.cumsum([r["passages"] for r in rows])]
    return fit(x, of, np.array([r["label"] for r in rows]))


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, bounds = utf8_column(batch, "text")
        for low, high in row_slices(bounds):
            x, of = features(data[bounds[low] : bounds[high]], bounds[low : high + 1] - bounds[low])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(low, high - low), batch.column(1).slice(low, high - low).cast(pa.int64()), pa.array(np.diff(of).astype(np.int32)), pa.array([x[a:b].tobytes() for a, b in zip(of, of[1:], strict=False)], pa.binary())],
                names=["id", "label", "passages", "features"],
            )


def scored(docs: DataFrame, model: Model | Constant, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, bounds = utf8_column(batch, "text")
            for low, high in row_slices(bounds):
                score = model.score(*features(data[bounds[low] : bounds[high]], bounds[low : high + 1] - bounds[low]))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), pa.array(score.astype(np.float64))], names=["doc_id", "score"])

    plain = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return plain.mapInArrow(run, "doc_id long, score double").select(
        "doc_id",
        F.coalesce(_fold("doc_id") == HELD_OUT, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def accepted(docs: DataFrame, model: Model | Constant, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the model accepts, and those without an id.

    Each is judged where it lies: only texts go to the workers, only scores come back.
    """

    @F.arrow_udf("double")
    def score(text: pa.Array) -> pa.Array:
        data, bounds = utf8_column(pa.RecordBatch.from_arrays([text], names=["text"]), "text")
        parts = [np.zeros(0)]
        for low, high in row_slices(bounds):
            parts.append(model.score(*features(data[bounds[low] : bounds[high]], bounds[low : high + 1] - bounds[low])).astype(np.float64))
        return pa.array(np.concatenate(parts))

    return docs.where((score(F.col(f"`{text_col}`")) >= 0.5) | F.col(f"`{id_col}`").isNull())
