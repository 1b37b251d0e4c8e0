"""Near duplicates by SetSketch registers: banded, estimated by likelihood, verified on whole sets.

A register holds the smallest of many exponential variates, one per shingle, on
an exponentially spaced scale: ``floor(1 - log_b(min))``, shifted so that the
largest possible variate has a level of its own, and truncated at both ends. Registers of two shards of a set merge by maximum. Two sets agree in a
register with about the probability of their Jaccard similarity.

Cases: a null or empty text, or one of separators only, has no shingle, is
linked with nothing and kept. Texts of one to four words are one shingle.
Repeated rows and equal shingle sets are one class, so thousands of copies cost
one candidate. An empty table gives no rows. Rows without an id belong to no
group: they are passed through with a null component and kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sealdex.llm.words import (
    distinct_by_row,
    lower_ascii,
    mix,
    row_slices,
    shingles,
    utf8_column,
    word_hashes,
    word_spans,
)
from sealdex.session import staged, staging

WIDTH = 5
#: Link where 100 * intersection >= PERCENT * union.
PERCENT = 85
REGISTERS = 96
#: Rows of a band: two sets of similarity 0.85 miss all 24 bands with probability 2e-8.
BAND_ROWS = 4
#: Spacing of the register scale.
SPACING = 1.02
_SCALE_TOP = (1 << 15) - 1
#: Levels below that of a variate of 1: a set of few shingles has smallest variates of up to 53 ln 2.
_SCALE_SHIFT = 200
#: A pair goes on to verification unless its likelihood at the threshold is below
#: the best by this much (five standard deviations).
LIKELIHOOD_GAP = 12.5

#: One-bit registers (the parity of a level) of sets whose bucket holds several
#: components: enough of them to tell 0.85 from 0.77 by five standard deviations.
FINE_BITS = 1024
FINE_DEVIATIONS = 4.5

_SEEDS = mix(np.arange(1, 2 * (REGISTERS + FINE_BITS) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_FACTORS, _SHIFTS = _SEEDS[::2] | np.uint64(1), _SEEDS[1::2]


def registers(values: np.ndarray, first: np.ndarray, which: range = range(REGISTERS)) -> np.ndarray:
    """Registers of each run of ``values`` that starts at ``first``, one row a run."""
    out = np.empty((len(first), len(which)), np.uint16)
    for place, i in enumerate(which):
        # The smallest uniform variate gives the smallest exponential one.
        least = np.minimum.reduceat((values ^ _SHIFTS[i]) * _FACTORS[i], first)
        uniform = (least.astype(np.float64) + 1.0) / 2.0**64
        level = np.floor(1.0 + _SCALE_SHIFT - np.log(-np.log1p(-np.minimum(uniform, 1 - 2.0**-53))) / np.log(SPACING))
        out[:, place] = np.clip(level, 0, _SCALE_TOP)
    return out


def merge(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Registers of the union of two sets."""
    return np.maximum(left, right)


def _shingle_sets(batch: pa.RecordBatch, name: str, width: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    data, bounds = utf8_column(batch, name)
    for low, high in row_slices(bounds):
        part = lower_ascii(data[bounds[low] : bounds[high]])
        starts, ends, rows = word_spans(part, bounds[low : high + 1] - bounds[low])
        values, of = distinct_by_row(*shingles(word_hashes(part, starts, ends), rows, width))
        yield low, high, values, of


def _digests(values: np.ndarray, filled: np.ndarray, first: np.ndarray, rows: int) -> list[bytes | None]:
    """128 bits that name the shingle set of each row; null for none."""
    out: list[bytes | None] = [None] * rows
    if len(filled):
        sums = [np.add.reduceat(mix(values ^ np.uint64(seed)), first) for seed in (1, 2)]
        for row, a, b in zip(filled, *sums, strict=True):
            out[row] = a.tobytes() + b.tobytes()
    return out


def _sketches(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for low, high, values, of in _shingle_sets(batch, "text", width):
                count = np.bincount(of, minlength=high - low)
                filled = np.flatnonzero(count)
                first = np.r_[0, np.cumsum(count[filled])[:-1]].astype(np.int64)
                digests, sketch = _digests(values, filled, first, high - low), [None] * (high - low)
                if len(filled):
                    for row, own in zip(filled, registers(values, first), strict=True):
                        sketch[row] = own.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(low, high - low), pa.array(count, pa.int64()), pa.array(digests, pa.binary()), pa.array(sketch, pa.binary())],
                    names=["id", "n", "digest", "sketch"],
                )

    return run


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, values, of in _shingle_sets(batch, "text", width):
                offsets = np.searchsorted(of, np.arange(high - low + 1)).astype(np.int32)
                filled = np.unique(of)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(low, high - low),
                        pa.array(_digests(values, filled, offsets[filled], high - low), pa.binary()),
                        pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.view(np.int64))),
                    ],
                    names=["id", "digest", "members"],
                )

    return run


def _fine(width: int):
    """Parities of FINE_BITS further registers, 64 in a long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, values, of in _shingle_sets(batch, "text", width):
                filled = np.unique(of)
                if not len(filled):
                    continue
                first = np.searchsorted(of, filled)
                bits = registers(values, first, range(REGISTERS, REGISTERS + FINE_BITS)).astype(np.uint8) & 1
                longs = np.packbits(bits, axis=1).view(np.int64)
                digests = _digests(values, filled, first, high - low)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(low + filled)), pa.array([digests[i] for i in filled], pa.binary()), pa.array(longs.tolist(), pa.list_(pa.int64()))],
                    names=["id", "digest", "bits"],
                )

    return run


def _fine_agreement(left: str, right: str) -> F.Column:
    differ = [F.bit_count(F.get(left, F.lit(i)).bitwiseXOR(F.get(right, F.lit(i)))) for i in range(FINE_BITS // 64)]
    return F.lit(FINE_BITS) - sum(differ[1:], differ[0])


def least_agreement(percent: int) -> int:
    """Agreeing bits that a pair of similarity ``percent`` has, but for FINE_DEVIATIONS standard deviations."""
    p = (1 + percent / 100) / 2
    return int(np.floor(FINE_BITS * p - FINE_DEVIATIONS * np.sqrt(FINE_BITS * p * (1 - p))))


def likely(left: pd.Series, right: pd.Series, n_left: pd.Series, n_right: pd.Series, percent: int) -> np.ndarray:
    """Joint likelihood estimate: may the similarity reach ``percent``?

    With sizes u and v as shares of their sum and similarity j, a left register
    is the larger with probability p(u - v j), p(x) = -log_b(1 - x (b - 1) / b).
    """
    a = np.frombuffer(b"".join(left), np.uint16).reshape(len(left), -1).astype(np.int32)
    b = np.frombuffer(b"".join(right), np.uint16).reshape(len(right), -1).astype(np.int32)
    above, below = (a > b).sum(1)[:, None], (a < b).sum(1)[:, None]
    equal = a.shape[1] - above - below
    u = (n_left / (n_left + n_right)).to_numpy()[:, None]
    v = 1 - u
    most = np.minimum(u / v, v / u)
    grid = np.linspace(0, 1, 101)[None, :] * most
    grid = np.concatenate([grid, np.minimum(most, percent / 100)], 1)

    def larger(x):
        return np.maximum(-np.log1p(-x * (SPACING - 1) / SPACING) / np.log(SPACING), 1e-9)

    up, down = larger(u - v * grid), larger(v - u * grid)
    chance = above * np.log(up) + below * np.log(down) + equal * np.log(np.maximum(1 - up - down, 1e-9))
    best = grid[np.arange(len(grid)), chance.argmax(1)]
    return (best >= percent / 100) | (chance.max(1) - chance[:, -1] <= LIKELIHOOD_GAP)


class _Tables:
    """Written tables of one run, numbered."""

    def __init__(self, stage):
        self.stage, self.n = stage, 0

    def write(self, df: DataFrame) -> DataFrame:
        self.n += 1
        return self.stage(df, str(self.n))


def components(links: DataFrame, write) -> DataFrame:
    """(node, root) of every node of ``links`` (a, b): root is the smallest node reachable.

    Hash-to-min with pointer jumping. Every round is a written table; the driver
    sees only how many labels changed.
    """
    edges = write(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    roots = write(edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root")).select("node", F.least("node", "root").alias("root")))
    while True:
        seen = edges.join(roots.select(F.col("node").alias("b"), "root"), "b").select(F.col("a").alias("node"), "root")
        near = roots.unionByName(seen).groupBy("node").agg(F.min("root").alias("root"))
        jump = roots.select(F.col("node").alias("root"), F.col("root").alias("far"))
        fresh = near.join(jump, "root", "left").select("node", F.least("root", F.coalesce("far", "root")).alias("root"))
        after = write(fresh)
        changed = after.join(roots.withColumnRenamed("root", "was"), "node").where("root <> was").count()
        roots = after
        if not changed:
            return roots


def near_duplicate_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, percent: int = PERCENT
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs``.

    Equal shingle sets form classes first. Classes that share a band of
    registers are compared in rounds: each bucket's pivot with all others, one of
    its components with the rest, then whatever is left between the components
    of a bucket and may link, so a large group of near copies costs about one
    pair a member and no link between components is missed.
    """
    with staging(docs.sparkSession, "near-duplicates") as stage:
        return staged(_groups(docs, id_col, text_col, width, percent, _Tables(stage).write), "near-duplicate-groups")


def _groups(docs: DataFrame, id_col: str, text_col: str, width: int, percent: int, write) -> DataFrame:
    plain = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    sketches = write(plain.mapInArrow(_sketches(width), "id long, n long, digest binary, sketch binary"))

    classes = write(
        sketches.where("id IS NOT NULL AND n > 0").groupBy("digest", "n").agg(F.min("id").alias("class"), F.min("sketch").alias("sketch"))
    )
    keys = F.array(*[F.xxhash64(F.lit(i), F.substring("sketch", 2 * BAND_ROWS * i + 1, 2 * BAND_ROWS)) for i in range(REGISTERS // BAND_ROWS)])
    # A set of n shingles is at best n in n + 1 like another: smaller ones have their class and meet nobody.
    bands = classes.where(F.lit(100) * F.col("n") >= F.lit(percent) * (F.col("n") + 1)).select("class", F.explode(keys).alias("key"))
    shared = write(bands.groupBy("key").agg(F.count("*").alias("size")).where("size > 1"))
    sized = write(bands.join(shared, "key"))
    # The pivot of a bucket is the class that meets the most others over all its buckets:
    # of a family of near copies the one they were copied from.
    degrees = write(sized.groupBy("class").agg(F.sum("size").alias("degree")))
    members = write(sized.select("key", "class").join(degrees, "class"))
    # Whole texts are needed again only of classes that meet another; all later passes read these.
    plain = write(plain.join(degrees.select(F.col("class").alias("id")), "id", "left_semi"))
    pivots = write(members.groupBy("key").agg(F.max(F.struct("degree", (-F.col("class")).alias("back"))).alias("top")).select("key", (-F.col("top.back")).alias("pivot")))

    star = members.join(pivots, "key").where("class <> pivot")
    pairs = write(star.select(F.least("pivot", "class").alias("a"), F.greatest("pivot", "class").alias("b")).distinct())
    links = _verified(pairs, classes, plain, width, percent, write)
    tried = [pairs]
    for last in (False, True):
        roots = components(links, write)
        placed = write(
            members.select("key", "class")
            .join(roots.withColumnRenamed("node", "class"), "class", "left")
            .select("key", "class", F.coalesce("root", "class").alias("root"))
        )
        split = write(
            placed.groupBy("key").agg(F.min(F.struct("root", "class")).alias("first"), F.max("root").alias("top")).where("first.root <> top")
        )
        if last:
            rest = _across_components(placed.join(split.select("key"), "key", "left_semi"), classes, plain, width, percent, write)
        else:
            rest = placed.join(split, "key").where("root <> first.root").select(F.least("class", "first.class").alias("a"), F.greatest("class", "first.class").alias("b"))
        fresh = rest.distinct()
        for old in tried:
            fresh = fresh.join(old, ["a", "b"], "left_anti")
        fresh = write(fresh)
        tried.append(fresh)
        links = write(links.unionByName(_verified(fresh, classes, plain, width, percent, write)))
    roots = components(links, write).withColumnRenamed("node", "class")

    placed = classes.select("digest", "n", "class").join(roots, "class", "left").select("digest", "n", F.coalesce("root", "class").alias("root"))
    filled = sketches.where("id IS NOT NULL AND n > 0").select("id", "n", "digest").join(placed, ["digest", "n"])
    bare = sketches.where("id IS NULL OR n = 0").select("id", "n", F.col("id").alias("root"))
    return filled.select("id", "n", "root").unionByName(bare).select(
        F.col("id").alias("doc_id"),
        F.col("n").alias("n_shingles"),
        F.col("root").alias("component_id"),
        F.coalesce(F.col("id") == F.col("root"), F.lit(True)).alias("kept"),
    )


def _across_components(left: DataFrame, classes: DataFrame, plain: DataFrame, width: int, percent: int, write) -> DataFrame:
    """Pairs (a, b) of ``left`` (key, class, root) that share a bucket, not a component, and may link.

    The fine registers are compared in the join, so that of a family whose
    members are alike but not enough only the doubtful pairs come out of it,
    each from the least of the keys it shares.
    """
    left = write(left)
    owned = left.groupBy("class").agg(F.sort_array(F.collect_set("key")).alias("keys"))
    owned = write(owned.join(classes.select("class", "digest"), "class"))
    fine = (
        plain.join(owned.select(F.col("class").alias("id")).distinct(), "id", "left_semi")
        .mapInArrow(_fine(width), "id long, digest binary, bits array<long>")
        .dropDuplicates(["id", "digest"])
        .withColumnRenamed("id", "class")
    )
    owned = write(owned.join(fine, ["class", "digest"]).select("class", "keys", "bits"))
    one = write(left.join(owned, "class"))
    other = one.select("class", "key", "root", "keys", "bits").toDF("other", "other_key", "other_root", "other_keys", "other_bits")
    near = (
        (F.col("root") < F.col("other_root"))
        & (_fine_agreement("bits", "other_bits") >= least_agreement(percent))
        & (F.col("key") == F.array_min(F.array_intersect("keys", "other_keys")))
    )
    met = one.join(other, (F.col("key") == F.col("other_key")) & near)
    return met.select(F.least("class", "other").alias("a"), F.greatest("class", "other").alias("b"))


def _verified(pairs: DataFrame, classes: DataFrame, plain: DataFrame, width: int, percent: int, write) -> DataFrame:
    """Those pairs (a, b) of classes whose whole sets are similar enough."""

    @F.pandas_udf("boolean")
    def may_link(left: pd.Series, right: pd.Series, n_left: pd.Series, n_right: pd.Series) -> pd.Series:
        return pd.Series(likely(left, right, n_left, n_right, percent))

    own = classes.select("class", "n", "digest", "sketch")
    near = write(
        pairs.join(own.toDF("a", "n_a", "digest_a", "sketch_a"), "a")
        .join(own.toDF("b", "n_b", "digest_b", "sketch_b"), "b")
        .where(F.lit(100) * F.least("n_a", "n_b") >= F.lit(percent) * F.greatest("n_a", "n_b"))
        .where(may_link("sketch_a", "sketch_b", "n_a", "n_b"))
        .drop("sketch_a", "sketch_b")
    )
    wanted = write(near.select(F.col("a").alias("id"), F.col("digest_a").alias("digest")).unionByName(near.select(F.col("b").alias("id"), F.col("digest_b").alias("digest"))).distinct())
    sets = write(
        plain.join(wanted.select("id").distinct(), "id", "left_semi")
        .mapInArrow(_sets(width), "id long, digest binary, members array<long>")
        .join(wanted, ["id", "digest"], "left_semi")
        .dropDuplicates(["id", "digest"])
    )
    both = near.join(sets.toDF("b", "digest_b", "members_b"), ["b", "digest_b"]).join(sets.toDF("a", "digest_a", "members_a"), ["a", "digest_a"])
    common = F.size(F.array_intersect("members_a", "members_b"))
    return write(
        both.select("a", "b", common.cast("long").alias("common"), (F.col("n_a") + F.col("n_b")).alias("sum"))
        .where(F.lit(100) * F.col("common") >= F.lit(percent) * (F.col("sum") - F.col("common")))
        .select("a", "b")
        .distinct()
    )
