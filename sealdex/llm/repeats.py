"""Removal of bytes covered by strings that occur twice, by suffix arrays.

A string of ``LENGTH`` bytes is looked up by its anchor: of its 64-byte pieces
the one with the least hash. Equal strings have equal anchors at the same
place, so only anchors that occur twice are followed, and their strings meet by
anchor. The bytes around an anchor that its strings cover are its context.
Equal contexts are counted once. Contexts that share an anchor but differ are
dealt into shards of bounded size; every shard's suffixes are sorted by
Larsson-Sadakane refinement, Kasai's walk gives their common prefixes, and
those of LENGTH or more are repeats. An anchor with very many contexts is in
many shards; its sorted windows are then merged across shards by binary search.

Cases: a null or empty text, or one shorter than LENGTH bytes, has nothing to
remove. Repeated rows are documents of their own and remove each other. Rows
without an id are documents like others. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sealdex.llm.words import mix, powers, row_slices, utf8_column
from sealdex.session import staged, staging

LENGTH = 200
PIECE = 64
#: Bytes of contexts in a shard, and contexts of one anchor that stay in one shard.
SHARD_BYTES = 1 << 20
TOGETHER = 1024
#: Windows that are merged together.
MERGED_WINDOWS = 1 << 18

#: Stands for a null id.
_NO_ID = -(1 << 63)
_BASES = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)
_HIGH, _LOW = np.uint64(0xFFFFFFFF00000000), np.uint64(0xFFFFFFFF)


class _Hashes:
    """Hashes of any span of some bytes."""

    def __init__(self, data: np.ndarray, base: int):
        self.back = powers(len(data) + 1, pow(base, -1, 1 << 64))
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(len(data), base), out=self.sums[1:])

    def __call__(self, starts, ends) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self.back[starts])


def anchors(data: np.ndarray, bounds: np.ndarray, length: int, piece: int):
    """Rows, anchor places, and first and last start of the strings that each anchor stands for."""
    n = len(data)
    if n < length:
        return (np.zeros(0, np.int64),) * 4 + (None,)
    first = _Hashes(data, _BASES[0])
    at = np.arange(n - piece + 1)
    least = first(at, at + piece) & _HIGH | at.astype(np.uint64)
    wide, step = length - piece + 1, 1
    while 2 * step <= wide:
        least = np.minimum(least[:-step], least[step:])
        step *= 2
    if step < wide:
        least = np.minimum(least[: len(least) - (wide - step)], least[wide - step :])
    starts = np.arange(len(least))
    row = np.searchsorted(bounds, starts, "right") - 1
    starts = starts[bounds[row + 1] - starts >= length]
    if not len(starts):
        return (np.zeros(0, np.int64),) * 4 + (None,)
    row, place = row[starts], (least[starts] & _LOW).astype(np.int64)
    new = np.flatnonzero(np.r_[True, (place[1:] != place[:-1]) | (row[1:] != row[:-1])])
    last = np.r_[new[1:] - 1, len(starts) - 1]
    return row[new], place[new], starts[new], starts[last], first


def _anchored(length: int, piece: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, bounds = utf8_column(batch, "text")
            for low, high in row_slices(bounds):
                part, own = data[bounds[low] : bounds[high]], bounds[low : high + 1] - bounds[low]
                row, place, begin, end, first = anchors(part, own, length, piece)
                if not len(row):
                    continue
                second = _Hashes(part, _BASES[1])
                # A context is its bytes and where in them the anchor stands.
                lead = (place - begin).astype(np.uint64)
                one = mix(first(begin, end + length) + lead).view(np.int64)
                two = mix(second(begin, end + length) ^ lead).view(np.int64)
                took = pa.array(low + row)
                columns = [first(place, place + piece).view(np.int64), one, two, batch.column(0).take(took), batch.column(1).take(took), begin - own[row], end - begin + length]
                names = ["anchor", "one", "two", "id", "key", "begin", "size"]
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, pa.int64()) for c in columns], names=names)

    return run


def suffix_order(data: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes in the order of at least their first ``depth`` bytes, by Larsson-Sadakane refinement.

    Groups of suffixes that agree so far are sorted by the group of the suffix
    ``known`` bytes on, which doubles ``known``; suffixes alone in their group
    are not touched again.
    """
    n = len(data)
    padded = np.r_[data, np.zeros(8, np.uint8)].astype(np.uint64)
    key = np.zeros(n, np.uint64)
    for j in range(8):
        key = key << np.uint64(8) | padded[j : j + n]
    order = np.argsort(key, kind="stable")
    fresh = np.r_[True, key[order[1:]] != key[order[:-1]]]
    group = np.empty(n + 1, np.int64)
    group[n] = -1
    group[order] = np.flatnonzero(fresh)[np.cumsum(fresh) - 1]
    known = 8
    # Places in the order that are not settled.
    unsettled = np.flatnonzero(~(fresh & np.r_[fresh[1:], True]))
    while known < depth and len(unsettled):
        some = order[unsettled]
        own = group[some]
        then = group[np.minimum(some + known, n)]
        inner = np.lexsort((then, own))
        some, own, then = some[inner], own[inner], then[inner]
        order[unsettled] = some
        fresh = np.r_[True, (own[1:] != own[:-1]) | (then[1:] != then[:-1])]
        group[some] = unsettled[np.flatnonzero(fresh)[np.cumsum(fresh) - 1]]
        unsettled = unsettled[~(fresh & np.r_[fresh[1:], True])]
        known *= 2
    return order


def common_prefixes(data: np.ndarray, order: np.ndarray, bounds: np.ndarray, most: int) -> np.ndarray:
    """Bytes (at most ``most``) that each suffix shares with the one before it in ``order``: Kasai's walk.

    A suffix shares at least one byte less than the suffix a byte longer did, so
    the walk never goes back. Of suffixes that share ``most`` bytes the order may
    be unsettled, and then says nothing of the suffixes a byte shorter: unless
    these follow one another again, the walk starts anew. The contexts within
    ``bounds`` are walked in step.
    """
    n = len(data)
    padded = np.r_[data, np.zeros(most + 16, np.uint8)].astype(np.uint64)
    word = np.zeros(n + most + 8, np.uint64)
    for j in range(8):
        word |= padded[j : j + len(word)] << np.uint64(8 * j)
    before = np.full(n, -1)
    before[order[1:]] = order[:-1]
    shared = np.zeros(n, np.int64)
    sizes = np.diff(bounds)
    lanes = np.argsort(-sizes, kind="stable")
    starts, sizes = bounds[:-1][lanes], sizes[lanes]
    height, last = np.zeros(len(lanes), np.int64), np.full(len(lanes), -1)
    for step in range(int(sizes.max(initial=0))):
        active = int(np.searchsorted(-sizes, -step, "left"))
        at = starts[:active] + step
        other = before[at]
        h = np.maximum(height[:active] - 1, 0)
        h[(other < 0) | ((height[:active] >= most) & (other != last[:active] + 1))] = 0
        go = np.flatnonzero((other >= 0) & (h < most))
        while len(go):
            differ = word[at[go] + h[go]] ^ word[other[go] + h[go]]
            same = differ == 0
            lowest = (differ & (~differ + np.uint64(1))).astype(np.float64)
            h[go] += np.where(same, 8, (np.log2(np.where(same, 1.0, lowest)) / 8).astype(np.int64))
            go = go[same & (h[go] < most)]
        # Bytes after the end are not bytes.
        h = np.minimum(np.minimum(h, n - np.maximum(at, other)), most)
        height[:active], last[:active] = h, other
        shared[at] = h
    return shared


def repeated_windows(data: np.ndarray, bounds: np.ndarray, length: int) -> np.ndarray:
    """Mask of the starts, inside their context, of strings of ``length`` that start at two places."""
    n = len(data)
    sizes = np.diff(bounds)
    place = np.arange(n) - np.repeat(bounds[:-1], sizes)
    window = place + length <= np.repeat(sizes, sizes)
    order = suffix_order(data, length)
    shared = common_prefixes(data, order, bounds, length)[order]
    at = np.flatnonzero(window[order])
    mask = np.zeros(n, bool)
    if len(at) > 1:
        # Shared between one window and the next: the least on the way.
        least = np.minimum.reduceat(shared, at + 1 if at[-1] + 1 < n else np.r_[at[:-1] + 1, n - 1])[: len(at) - 1]
        equal = np.flatnonzero(least >= length)
        mask[order[at[equal]]] = True
        mask[order[at[equal + 1]]] = True
    return mask


def _runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.flatnonzero(np.diff(np.r_[0, mask.astype(np.int8), 0]))
    return edge[0::2], edge[1::2]


_RUNS = "id long, key long, begin long, end long"


def _sharded(length: int):
    def run(table: pa.Table) -> pa.Table:
        bodies = table.column("bytes").to_pylist()
        bounds = np.r_[0, np.cumsum([len(b) for b in bodies])].astype(np.int64)
        mask = repeated_windows(np.frombuffer(b"".join(bodies), np.uint8), bounds, length)
        ids, keys, begin = (table.column(c).to_pylist() for c in ("id", "key", "begin"))
        out: list[tuple[int, int, int, int]] = []
        for i in range(len(bodies)):
            for a, b in zip(*_runs(mask[bounds[i] : bounds[i + 1]]), strict=True):
                out.append((ids[i], keys[i], begin[i] + int(a), begin[i] + int(b) - 1 + length))
        columns = list(zip(*out, strict=True)) or [()] * 4
        return pa.Table.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["id", "key", "begin", "end"])

    return run


def _windows(length: int, buckets: int):
    """Sorted window hashes of the contexts of a shard, cut into ranges of the hash.

    Windows that the shard itself has twice are there to be met, not to be found.
    """

    def run(table: pa.Table) -> pa.Table:
        bodies = table.column("bytes").to_pylist()
        data = np.frombuffer(b"".join(bodies), np.uint8)
        sizes = np.array([len(b) for b in bodies], np.int64)
        bounds = np.r_[0, np.cumsum(sizes)]
        of = np.repeat(np.arange(len(bodies)), sizes - length + 1)
        counts = sizes - length + 1
        place = np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts, counts)
        at = bounds[:-1][of] + place
        open_ = ~repeated_windows(data, bounds, length)[at]
        one, two = (_Hashes(data, b)(at, at + length) for b in _BASES)
        order = np.lexsort((two, one))
        one, two, of, place, open_ = one[order], two[order], of[order], place[order], open_[order]
        bucket = (one >> np.uint64(32)).astype(np.int64) * buckets >> 32
        cuts = np.r_[np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]), len(bucket)] if len(bucket) else np.zeros(1, np.int64)
        ids, keys, begin = (np.array(table.column(c).to_pylist(), np.int64) for c in ("id", "key", "begin"))
        rows = []
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            at = a + np.flatnonzero(open_[a:b])
            own = of[at]
            rows.append({"bucket": int(bucket[a]), "one": one[a:b].view(np.int64), "two": two[a:b].view(np.int64), "open": at - a, "ids": ids[own], "keys": keys[own], "starts": begin[own] + place[at]})
        fields = [("bucket", pa.int64()), *((c, pa.list_(pa.int64())) for c in ("one", "two", "open", "ids", "keys", "starts"))]
        return pa.Table.from_pylist(rows, pa.schema(fields))

    return run


def _merged(length: int):
    """Windows of one range of the hash from all shards: each is searched in all of them."""

    def run(table: pa.Table) -> pa.Table:
        one, two, open_, ids, keys, starts = ([np.asarray(x, np.int64) for x in table.column(c).to_pylist()] for c in ("one", "two", "open", "ids", "keys", "starts"))
        both = [mix(a.view(np.uint64) ^ mix(b.view(np.uint64))) for a, b in zip(one, two, strict=True)]
        all_ = np.sort(np.concatenate(both))
        wanted = np.concatenate([b[at] for b, at in zip(both, open_, strict=True)])
        found = np.searchsorted(all_, wanted, "right") - np.searchsorted(all_, wanted, "left") > 1
        ids, keys, starts = (np.concatenate(x)[found] for x in (ids, keys, starts))
        columns = (ids, keys, starts, starts + length)
        return pa.Table.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["id", "key", "begin", "end"])

    return run


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bytes of the contexts wanted of each document."""
    schema = pa.schema([("shard", pa.int64()), ("id", pa.int64()), ("key", pa.int64()), ("begin", pa.int64()), ("spread", pa.bool_()), ("bytes", pa.binary())])
    for batch in batches:
        for row in batch.to_pylist():
            body = (row["text"] or "").encode()
            out = [
                {"shard": w["shard"], "id": row["id"], "key": row["key"], "begin": w["begin"], "spread": w["spread"], "bytes": body[w["begin"] : w["begin"] + w["size"]]}
                for w in row["wanted"]
            ]
            yield pa.RecordBatch.from_pylist(out, schema)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents without the bytes of their intervals."""
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            body = (row["text"] or "").encode()
            kept, place, removed, spans = hashlib.sha256(), 0, 0, 0
            open_end = -1
            for a, b in sorted((x["begin"], x["end"]) for x in row["cuts"] or ()):
                if a > open_end:
                    spans += 1
                if b > open_end:
                    kept.update(body[place : max(a, place)])
                    removed += b - max(a, place)
                    place = open_end = b
            kept.update(body[place:])
            out.append((row["id"], len(body), removed, spans, kept.hexdigest()))
        columns = list(zip(*out, strict=True)) or [()] * 5
        kinds = [pa.int64()] * 4 + [pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def without_repeats(docs: DataFrame, length: int = LENGTH, piece: int = PIECE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every row of ``docs``."""
    with staging(docs.sparkSession, "repeats") as stage:
        return staged(_without_repeats(docs, length, piece, id_col, text_col, stage), "without-repeats")


def _without_repeats(docs: DataFrame, length: int, piece: int, id_col: str, text_col: str, write) -> DataFrame:

    # The key tells rows of one id with different texts apart.
    plain = docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID)).alias("id"), F.xxhash64(text_col).alias("key"), F.col(text_col).alias("text")
    )
    # Texts are hashed once; what repeats is picked from the written contexts.
    anchored = write(plain.mapInArrow(_anchored(length, piece), "anchor long, one long, two long, id long, key long, begin long, size long"), "anchored")
    common = write(
        anchored.groupBy("anchor")
        .agg(F.count("*").alias("n"), F.min("one").alias("a"), F.max("one").alias("b"), F.min("two").alias("c"), F.max("two").alias("d"))
        .where("n > 1")
        .select("anchor", F.expr("a = b AND c = d").alias("whole")),
        "common",
    )
    followed = write(anchored.join(common, "anchor"), "followed")

    # Of contexts that differ, one of each kind is compared with the others.
    kind = ["anchor", "one", "two"]
    kinds = write(followed.where("NOT whole").groupBy(*kind).agg(F.count("*").alias("n"), F.min(F.struct("id", "key", "begin", "size")).alias("at")), "kinds")
    crowds = write(kinds.groupBy("anchor").agg(F.ceil(F.count("*") / TOGETHER).alias("salts")), "crowds")
    size, most = kinds.agg(F.coalesce(F.sum("at.size"), F.lit(0))).first()[0], crowds.agg(F.coalesce(F.max("salts"), F.lit(1))).first()[0]
    shards = max(1, -(-size // SHARD_BYTES))
    wanted = (
        kinds.join(crowds, "anchor")
        .select("at.*", (F.col("salts") > 1).alias("spread"), F.pmod(F.xxhash64("anchor", F.pmod("one", "salts")), F.lit(shards)).alias("shard"))
        .groupBy("id", "key")
        .agg(F.collect_list(F.struct("shard", "begin", "size", "spread")).alias("wanted"))
    )
    contexts = plain.join(wanted, ["id", "key"]).mapInArrow(_contexts, "shard long, id long, key long, begin long, spread boolean, bytes binary")
    found = contexts.groupBy("shard").applyInArrow(_sharded(length), _RUNS)
    if most > 1:
        spread = contexts.where("spread")
        buckets = max(1, -(-kinds.join(crowds.where("salts > 1"), "anchor").agg(F.coalesce(F.sum(F.col("at.size") - (length - 1)), F.lit(0))).first()[0] // MERGED_WINDOWS))
        kept = "bucket long, one array<long>, two array<long>, open array<long>, ids array<long>, keys array<long>, starts array<long>"
        found = found.unionByName(spread.groupBy("shard").applyInArrow(_windows(length, buckets), kept).groupBy("bucket").applyInArrow(_merged(length), _RUNS))

    span = ["id", "key", "begin", (F.col("begin") + F.col("size")).alias("end")]
    alike = followed.where("NOT whole").join(kinds.where("n > 1").select(*kind), kind)
    cuts = followed.where("whole").select(*span).unionByName(alike.select(*span)).unionByName(found)
    cuts = cuts.groupBy("id", "key").agg(F.collect_list(F.struct("begin", "end")).alias("cuts"))
    done = plain.join(cuts, ["id", "key"], "left").mapInArrow(_cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    return done.withColumn("doc_id", F.when(F.col("doc_id") != _NO_ID, F.col("doc_id")))
