"""Exact top-k search by inner product, with pivot-table elimination.

Vectors become whole numbers, ``floor(scale * x)``. Pivots are chosen once from a
bounded sample, and every vector is written with its distances to them: the pivot
table. By the triangle inequality the largest difference between a candidate's
distances and the query's bounds the distance of the two from below, and so
their inner product from above. Candidates are evaluated in the order of their
bounds until the next bound is below the k-th score: what is left cannot enter
the result.

Queries are searched in blocks of ``QUERY_BLOCK`` against all candidates; a
block is broadcast (its size is that bound), its best per partition are merged
by key, so nothing but a block passes through the driver.

Cases: vectors that are null, or hold a null or non-finite component, take no
part. Vectors of another dimension than a query's are no candidates of it.
Rows without an id take no part. Rows are told apart by numbers of their own: only
the query's own row is no candidate of it, rows of one id are candidates and
queries each by itself, and ties go to the smaller id. Queries without candidates
give no rows, and so does an empty table. Scores beyond 64 bits raise. Other
columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sealdex.session import staged, staging

K = 10
SCALE = 1024
QUERY_EVERY = 100
PIVOTS = 24
QUERY_BLOCK = 1024
#: Candidates whose bounds are computed together, and evaluated at a time.
CANDIDATE_BLOCK = 4096
STEP = 256

#: Vectors of a dimension that pivots are chosen among: those of smallest hash.
PIVOT_SAMPLE = 512

_FOUND = "query_at long, query_id long, at long, vec_id long, score long"


def whole_vectors(df: DataFrame, id_col: str, vector_col: str, wanted, scale: int = SCALE) -> DataFrame:
    """(at, id, v, wanted): the rows that take part, with whole components and a number."""
    v = F.transform(F.col(vector_col), lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))
    sound = F.col(vector_col).isNotNull() & F.forall(F.col(vector_col), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = df.where(F.col(id_col).isNotNull() & sound)
    return rows.select(F.monotonically_increasing_id().alias("at"), F.col(id_col).cast("long").alias("id"), v.alias("v"), wanted.alias("wanted"))


class _Block:
    """Queries of one dimension with their pivot distances, and the best scores found so far."""

    def __init__(self, places: np.ndarray, ids: np.ndarray, vectors: np.ndarray, near: np.ndarray, k: int):
        self.places, self.ids, self.k = places, ids, k
        self.vectors = vectors.astype(np.float64)
        self.square = (self.vectors**2).sum(1)
        self.to_pivots = near
        self.worst = np.full(len(ids), -np.inf)
        #: (-score, id, place), ascending.
        self.best: list[list[tuple[int, int, int]]] = [[] for _ in ids]
        self.evaluated = 0

    def search(self, places: np.ndarray, ids: np.ndarray, vectors: np.ndarray, to_pivots: np.ndarray) -> None:
        plain = vectors.astype(np.float64)
        square = (plain**2).sum(1)
        # Sums of products below 2**53 are exact in doubles.
        exact = np.sqrt(self.square.max() * max(square.max(), 1.0)) < 2.0**52
        for q in range(len(self.ids)):
            gap = np.abs(to_pivots - self.to_pivots[q]).max(1, initial=0.0)
            # Rounding of the roots must not lift a bound under the true score.
            bound = (self.square[q] + square - np.maximum(gap * (1 - 1e-9) - 1e-6, 0) ** 2) / 2
            bound += 1e-9 * (self.square[q] + square) + 1
            open_ = np.flatnonzero(bound >= self.worst[q])
            order = open_[np.argsort(-bound[open_], kind="stable")]
            for low in range(0, len(order), STEP):
                some = order[low : low + STEP]
                if bound[some[0]] < self.worst[q]:
                    break
                self.evaluated += len(some)
                if exact:
                    scores = (plain[some] @ self.vectors[q]).astype(np.int64).tolist()
                else:
                    own = [int(x) for x in self.vectors[q]]
                    scores = [sum(a * b for a, b in zip(row, own, strict=True)) for row in vectors[some].tolist()]
                self._keep(q, places[some], ids[some], scores)

    def _keep(self, q: int, places: np.ndarray, ids: np.ndarray, scores: list[int]) -> None:
        own = self.places[q]
        fresh = [(-s, i, at) for s, i, at in zip(scores, ids.tolist(), places.tolist(), strict=True) if at != own and s >= self.worst[q]]
        self.best[q] = sorted(self.best[q] + fresh)[: self.k]
        if len(self.best[q]) == self.k:
            self.worst[q] = -self.best[q][-1][0]


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    square = (x**2).sum(1)[:, None] + (pivots**2).sum(1)[None, :] - 2 * (x @ pivots.T)
    return np.sqrt(np.maximum(square, 0))


def choose_pivots(vectors: np.ndarray, most: int = PIVOTS) -> np.ndarray:
    """Vectors far from each other: each next one has the largest least distance to those before."""
    chosen = [0]
    least = _distances(vectors, vectors[:1])[:, 0]
    while len(chosen) < min(most, len(vectors)):
        chosen.append(int(least.argmax()))
        least = np.minimum(least, _distances(vectors, vectors[chosen[-1:]])[:, 0])
    return vectors[chosen]


def _matrix(column: pa.Array, at: np.ndarray, width: int, kind: type) -> np.ndarray:
    return column.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False).reshape(len(at), width)


def _measured(pivots: dict[int, np.ndarray]):
    """Rows with their distances to the pivots of their dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(2)
            sizes = np.diff(column.offsets.to_numpy())
            near: list = [None] * len(sizes)
            for dim, points in pivots.items():
                some = np.flatnonzero(sizes == dim)
                rows = _distances(_matrix(column, some, dim, np.float64), points)
                for i, row in zip(some.tolist(), rows, strict=True):
                    near[i] = row
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near, pa.list_(pa.float64()))], names=["at", "id", "v", "wanted", "near"])

    return run


def _searched(blocks, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = {dim: _Block(*rows, k) for dim, rows in blocks.value.items()}
        for batch in batches:
            places, ids, column, near = (batch.column(i) for i in range(4))
            places, ids = places.to_numpy(), ids.to_numpy()
            sizes = np.diff(column.offsets.to_numpy())
            for dim, block in own.items():
                some = np.flatnonzero(sizes == dim)
                for low in range(0, len(some), CANDIDATE_BLOCK):
                    at = some[low : low + CANDIDATE_BLOCK]
                    block.search(places[at], ids[at], _matrix(column, at, dim, np.int64), _matrix(near, at, block.to_pivots.shape[1], np.float64))
        rows = [(p, q, at, i, -s) for block in own.values() for p, q, best in zip(block.places.tolist(), block.ids.tolist(), block.best, strict=True) for s, i, at in best]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=[f.split()[0] for f in _FOUND.split(", ")])

    return run


def exact_top_k(vectors: DataFrame, wanted, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row that ``wanted`` (a column) is true for, the k
    highest inner products with other rows, ties to the smaller id."""
    spark = vectors.sparkSession
    with staging(spark, "vectors") as stage:
        rows = stage(whole_vectors(vectors, id_col, vector_col, wanted, scale), "whole")
        dim = F.size("v")
        by_hash = Window.partitionBy(dim).orderBy(F.xxhash64("v", "id"), "at")
        sample = rows.withColumn("nth", F.row_number().over(by_hash)).where(F.col("nth") <= PIVOT_SAMPLE).select("v").collect()
        by_size: dict[int, list] = {}
        for r in sample:
            by_size.setdefault(len(r["v"]), []).append(r["v"])
        pivots = {n: choose_pivots(np.array(rows_, np.float64).reshape(len(rows_), n)) for n, rows_ in by_size.items()}
        table = stage(rows.mapInArrow(_measured(pivots), "at long, id long, v array<long>, wanted boolean, near array<double>"), "table")
        asked = stage(table.where("wanted").drop("wanted"), "queries")
        count = asked.count()
        if not count:
            return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
        blocks = -(-count // QUERY_BLOCK)
        # Blocks by hash; one that comes out larger is cut.
        bucket = F.pmod(F.xxhash64("at"), F.lit(blocks)).cast("int")
        found = []
        for number in range(blocks):
            queries = asked.where(bucket == number).orderBy("at").collect()
            for low in range(0, len(queries), 2 * QUERY_BLOCK):
                by_dim: dict[int, list] = {}
                for r in queries[low : low + 2 * QUERY_BLOCK]:
                    by_dim.setdefault(len(r["v"]), []).append(r)
                packed = {}
                for n, own in by_dim.items():
                    numbers = [np.array([r[c] for r in own], np.int64) for c in ("at", "id")]
                    packed[n] = (*numbers, np.array([r["v"] for r in own], np.int64).reshape(len(own), n), np.array([r["near"] for r in own], np.float64).reshape(len(own), -1))
                run = _searched(spark.sparkContext.broadcast(packed), k)
                found.append(stage(table.select("at", "id", "v", "near").mapInArrow(run, _FOUND), f"found-{len(found)}"))
        best = Window.partitionBy("query_at").orderBy(F.desc("score"), "vec_id", "at")
        ranked = reduce(DataFrame.unionByName, found).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        return staged(ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"), "vectors-found")
