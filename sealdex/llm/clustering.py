"""Centroid clustering with Ptolemaic pivots.

Vectors become whole numbers, floor(64 * x); centroids start as the vectors of
smallest hash and move to the componentwise floor of their vectors' mean. Who is
nearest is decided with few distances: each vector's distances to a few fixed
pivots are computed once and kept with it. For a pair of pivots p and s,
Ptolemy's inequality gives

    d(x, c) >= |d(x, p) d(c, s) - d(x, s) d(c, p)| / d(p, s),

and the largest of these bounds over the fixed pairs rules a centroid out where
it exceeds the distance to one computed already. Bounds are rounded down by more
than their floating-point error can be; what they leave is computed in integers.

A round is one pass without a shuffle of vectors: tasks emit the sums of their
clusters, a few hundred numbers each. The driver holds the centroids only.

Cases: vectors that are null, of another length, or hold null or a non-finite
component take no part. Repeated ids are vectors of their own; as first centroids
they are ordered by their components. A null id is clustered but is no first centroid.
With fewer vectors than centroids there are as many centroids as vectors; none give
no rows. Equal centroids: the smaller number takes all, the other stays where it is.
Components beyond 2^27 are worked on as unbounded integers, row by row; a distance,
or sum of distances, that 64 bits do not hold is null. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sealdex.functions.crypto import local_frame
from sealdex.session import staged, staging

LENGTH, SCALE = 64, 64
CENTROIDS, ROUNDS, SEED = 16, 3, 1
#: Pivots, the vectors they are chosen among, and the pairs of them that bounds use.
PIVOTS, PIVOT_SAMPLE, PAIRS = 8, 256, 28

#: Up to here squared distances of 64 components fit 64 bits; up to EXACT, the 53 bits of a double.
NARROW, EXACT = 1 << 27, 1 << 22
#: More than the relative error of a bound's few roundings.
_ERROR = 2.0**-48
_LIMB = 60


def whole(x: float) -> int:
    """floor(64 * x) of any finite double."""
    return int(x) * SCALE if abs(x) >= 2.0**53 else math.floor(x * SCALE)


def _vectors(batch: pa.RecordBatch, name: str, width: int) -> np.ndarray:
    column = batch.column(batch.schema.get_field_index(name))
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


class Pivots:
    """Fixed pivots, the pairs of them, and the bounds these give."""

    def __init__(self, vectors: list[list[int]]):
        """Of ``vectors`` (components within NARROW), each pivot is the one farthest from those before."""
        rows = np.array([v for v in vectors if max(map(abs, v)) <= NARROW], np.float64).reshape(-1, LENGTH)
        chosen: list[int] = []
        left = np.full(len(rows), np.inf)
        while len(chosen) < PIVOTS and len(rows) and left.max() > 0:
            chosen.append(int(left.argmax()))
            left = np.minimum(left, ((rows - rows[chosen[-1]]) ** 2).sum(1))
        self.points = rows[chosen]
        apart = self.distances(self.points) if chosen else np.zeros((0, 0))
        pairs = [(apart[i, j], i, j) for i in range(len(chosen)) for j in range(i)]
        self.pairs = [(i, j, d) for d, i, j in sorted(pairs, reverse=True)[:PAIRS]]

    def distances(self, rows: np.ndarray) -> np.ndarray:
        """Distances of rows to the pivots, right up to a few roundings."""
        return np.stack([np.sqrt(((rows - p) ** 2).sum(1)) for p in self.points], 1) if len(self.points) else np.zeros((len(rows), 0))

    def bounds(self, near: np.ndarray, centroids: np.ndarray) -> np.ndarray:
        """Lower bounds of the distances of rows, by their pivot distances, to centroids."""
        to = self.distances(centroids)
        out = np.zeros((len(near), len(centroids)))
        for i, j, apart in self.pairs:
            one = near[:, i, None] * to[None, :, j]
            two = near[:, j, None] * to[None, :, i]
            np.maximum(out, (np.abs(one - two) - (one + two) * _ERROR) / (apart * (1 + _ERROR)), out=out)
        return out


def _squared(rows: np.ndarray, point: list[int]) -> np.ndarray:
    """Exact squared distances of narrow rows (whole numbers as doubles) to a narrow point."""
    small = len(rows) == 0 or max(np.abs(rows).max(), max(map(abs, point))) <= EXACT
    diff = rows - np.array(point, np.float64) if small else rows.astype(np.int64) - np.array(point, np.int64)
    return np.einsum("ij,ij->i", diff, diff).astype(np.int64)


def nearest(rows: np.ndarray, near: np.ndarray, centroids: list[list[int]], pivots: Pivots) -> tuple[np.ndarray, np.ndarray, int]:
    """(cluster, squared distance) of narrow rows, and how many distances it took."""
    low = pivots.bounds(near, np.array(centroids, np.float64))
    guess = low.argmin(1)
    best = np.zeros(len(rows), np.int64)
    for c in np.unique(guess):
        best[guess == c] = _squared(rows[guess == c], centroids[c])
    # A centroid stays unless its rounded-down bound is surely beyond the distance known.
    stays = low * low * (1 - _ERROR) <= best[:, None] * (1 + _ERROR)
    cluster, taken = guess.copy(), len(rows)
    for c in range(len(centroids)):
        at = np.flatnonzero(stays[:, c] & (guess != c))
        d = _squared(rows[at], centroids[c])
        closer = (d < best[at]) | ((d == best[at]) & (c < cluster[at]))
        best[at[closer]], cluster[at[closer]] = d[closer], c
        taken += len(at)
    return cluster, best, taken


def _nearest_wide(row: list[int], centroids: list[list[int]]) -> tuple[int, int]:
    return min((sum((a - b) ** 2 for a, b in zip(row, c)), k) for k, c in enumerate(centroids))[::-1]


def _assigned(batches: Iterator[pa.RecordBatch], centroids: list[list[int]], pivots: Pivots):
    """(ids, narrow rows and their clusters and distances, wide rows with theirs) of every batch."""
    all_narrow = max(abs(x) for c in centroids for x in c) <= NARROW
    for batch in batches:
        given = _vectors(batch, "embedding", LENGTH)
        with np.errstate(over="ignore"):
            rows = np.floor(given * SCALE)
        narrow = (np.abs(rows) <= NARROW).all(1) & all_narrow
        near = _vectors(batch, "near", len(pivots.points)) if len(pivots.points) else np.zeros((len(rows), 0))
        none = np.zeros(0, np.int64)
        cluster, distance, taken = nearest(rows[narrow], near[narrow], centroids, pivots) if narrow.any() else (none, none, 0)
        wide = [[whole(x) for x in row] for row in given[~narrow].tolist()]
        yield batch.column(0), narrow, rows[narrow], cluster, distance, wide, [_nearest_wide(w, centroids) for w in wide], taken


def _limbs(total: int) -> Iterator[int]:
    """Signed digits of a whole number to base 2^60, lowest first."""
    while not -(1 << _LIMB) < total < 1 << _LIMB:
        yield total & ((1 << _LIMB) - 1)
        total >>= _LIMB
    yield total


def _sums(table: DataFrame, centroids: list[list[int]], pivots: Pivots) -> list[list[int]]:
    """The centroids of the next round."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Component sums of each cluster, and its count behind them.
        total = [[0] * (LENGTH + 1) for _ in centroids]
        for _, _, rows, cluster, _, wide, found, _ in _assigned(batches, centroids, pivots):
            for c in np.unique(cluster):
                own = rows[cluster == c].astype(np.int64)
                for j, s in enumerate([*own.sum(0).tolist(), len(own)]):
                    total[c][j] += s
            for row, (c, _) in zip(wide, found):
                for j, s in enumerate([*row, 1]):
                    total[c][j] += s
        out = [(c, j, k, x) for c, t in enumerate(total) if t[LENGTH] for j, s in enumerate(t) for k, x in enumerate(_limbs(s))]
        yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.int64()) for x in (zip(*out) if out else [[]] * 4)], names=["cluster", "place", "limb", "part"])

    parts = table.mapInArrow(run, "cluster long, place long, limb long, part long")
    # At most centroids x 65 components x the digits of a number.
    rows = parts.groupBy("cluster", "place", "limb").agg(F.sum(F.col("part").cast("decimal(38,0)")).alias("part")).collect()
    total = [[0] * (LENGTH + 1) for _ in centroids]
    for r in rows:
        total[r["cluster"]][r["place"]] += int(r["part"]) << (_LIMB * r["limb"])
    return [[s // t[LENGTH] for s in t[:LENGTH]] if t[LENGTH] else c for c, t in zip(centroids, total)]


def kept_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, embedding) of the vectors that take part."""
    inf = float("inf")
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{vector_col}`").cast("array<double>").alias("embedding"))
    odd = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(inf)))
    return rows.where((F.size("embedding") == LENGTH) & ~odd)


def clusters(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every vector that takes part."""
    spark = vectors.sparkSession
    kept = kept_vectors(vectors, id_col, vector_col)
    drawn = F.sha2(F.concat(F.lit(f"{SEED}:"), F.col("vec_id").cast("string")), 256)
    first = kept.where("vec_id IS NOT NULL").orderBy(drawn, "embedding").limit(PIVOT_SAMPLE).collect()
    sample = [[whole(x) for x in r["embedding"]] for r in first]
    centroids = sample[:CENTROIDS]
    if not centroids:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    pivots = Pivots(sample)

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            with np.errstate(over="ignore"):
                near = pivots.distances(np.floor(_vectors(batch, "embedding", LENGTH) * SCALE))
            near = pa.array(list(near), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), near], names=["vec_id", "embedding", "near"])

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, narrow, _, cluster, distance, _, found, _ in _assigned(batches, centroids, pivots):
            number, away = np.empty(len(narrow), np.int32), np.zeros(len(narrow), np.int64)
            number[narrow], away[narrow] = cluster, distance
            fits = np.ones(len(narrow), bool)
            for i, (c, d) in zip(np.flatnonzero(~narrow), found):
                number[i], fits[i] = c, d < 1 << 63
                away[i] = d if fits[i] else 0
            yield pa.RecordBatch.from_arrays([ids, pa.array(number), pa.array(away, mask=~fits)], names=["vec_id", "cluster", "distance"])

    with staging(spark, "clusters") as stage:
        table = stage(kept.mapInArrow(measured, "vec_id long, embedding array<double>, near array<double>"), "measured")
        for _ in range(ROUNDS):
            centroids = _sums(table, centroids, pivots)
        result = staged(table.mapInArrow(placed, "vec_id long, cluster int, distance long"), "clusters")
    sums = result.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("sum"), F.bool_or(F.col("distance").isNull()).alias("lost")).collect()
    held = {r["cluster"]: None if r["lost"] else int(r["sum"]) for r in sums}
    total = None if None in held.values() else sum(held.values())

    def long(x: int | None) -> int | None:
        return x if x is not None and x < 1 << 63 else None

    name = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    rows = [(c, long(held[c]), long(total), name[c]) for c in sorted(held)]
    about = local_frame(spark, rows, {"cluster": pa.int32(), "cluster_inertia": pa.int64(), "inertia": pa.int64(), "centroid_sha256": pa.string()})
    # At most CENTROIDS rows.
    return result.join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
