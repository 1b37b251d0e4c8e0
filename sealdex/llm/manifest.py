"""Merkle manifest of a dataset by time-forward processing.

Every document is a leaf: a digest of its fields, each with its length. The
leaves of a source ascend by id; every three neighbours become their digest, up
to the source's subroot, and the subroots become the root in the same way.

Nodes are labelled (level, place) in the order of time. A priority queue
ordered by label delivers digests to parents: a node takes all messages with
its label off the queue, and sends its own digest to a later label. Then a
reversed sweep delivers to every child its parent's proof suffix, with the
child's siblings put in front. The queue is external: ``STRIDE`` levels run in a
task on a block of ``FAN ** STRIDE`` neighbouring nodes, whose messages leave
through a table and come back sorted by label in the next epoch, so no task and
no source's size bounds the tree. After the text is digested it is not moved again.

A proof is text: for each level from the leaf up ``left,right;``, the digests of
the run's other nodes before and behind. Folding it from a leaf gives the root.

Cases: a null field is ``-``; a null source is a tree of its own and the first
one; a null id comes first in its source and is never tampered with. Rows of one
id are ordered by their digest; equal rows are leaves of their own, side by side.
A lone leaf is its subroot, a lone subroot the root, and their proofs are empty.
A run of one node is still digested. An empty table gives no rows. Other columns
are not read, whatever their names. A very long text costs its own digest only.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sealdex.session import staged, staging

#: Nodes of a run.
FAN = 3
#: Levels that one task works on; a block has FAN ** STRIDE nodes.
STRIDE = 6
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

_KEY = ["tree", "block", "turn", "pos"]
_NODES = "tree string, pos long, n long, digest string"
_PROOFS = "tree string, pos long, proof string, subroot string"
_FOLDED = "doc_id long, leaf string, subroot string, proof string, proof_sha256 string, folded_root string"


def digest(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_digest(*fields: Column) -> Column:
    """Digest of a row's fields, each ``-`` or its length in bytes, a colon and its value."""
    texts = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def without_line_ends(docs: DataFrame) -> Column:
    """The tampering of the manifest query: every second document by crc32 of its id loses its line ends."""
    even = F.crc32(F.col("`doc_id`").cast("string").cast("binary")) % 2 == 0
    return F.when(even, F.replace(F.col("`text`"), F.lit("\n"), F.lit("")))


# --- trees in blocks --------------------------------------------------------------


def levels_of(n: int, stride: int) -> int:
    """Levels a block of a tree with ``n`` nodes is folded by: all that are left, or ``stride``."""
    level = 0
    while level < stride and n > 1:
        n, level = -(-n // FAN), level + 1
    return level


def forward(digests: list[str], levels: int) -> tuple[str, dict[tuple[int, int], list[str]]]:
    """Root of a block, and the children of each of its nodes by label."""
    queue = [((1, i // FAN), i % FAN, d) for i, d in enumerate(digests)] if levels else []
    children: dict[tuple[int, int], list[str]] = {}
    top = digests[0]
    while queue:
        label = queue[0][0]
        run = children[label] = []
        while queue and queue[0][0] == label:
            run.append(heapq.heappop(queue)[2])
        level, place = label
        top = digest(*run)
        if level < levels:
            heapq.heappush(queue, ((level + 1, place // FAN), place % FAN, top))
    return top, children


def backward(children: dict[tuple[int, int], list[str]], levels: int, suffix: str) -> Iterator[str]:
    """Proofs of the block's nodes in order, given the proof suffix of its root."""
    queue = [((-levels, 0), suffix)]
    while queue and queue[0][0][0] < 0:
        (level, place), proof = heapq.heappop(queue)
        run = children[-level, place]
        for i in range(len(run)):
            heapq.heappush(queue, ((level + 1, place * FAN + i), f"{''.join(run[:i])},{''.join(run[i + 1 :])};{proof}"))
    while queue:
        yield heapq.heappop(queue)[1]


def folded(leaf: str, proof: str) -> str:
    """The root that a leaf and its proof amount to."""
    for level in proof.split(";")[:-1]:
        before, behind = level.split(",")
        leaf = digest(before, leaf, behind)
    return leaf


def _by_block(batches: Iterator[pa.RecordBatch], work: Callable[[list[dict]], Iterator[tuple]], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Give ``work`` the rows of one block after another; they come sorted by block and cross batches."""
    rows: list[dict] = []
    out: list[tuple] = []

    def flushed() -> pa.RecordBatch:
        columns = list(zip(*out)) if out else [[] for _ in schema]
        batch = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)
        out.clear()
        return batch

    for batch in batches:
        for row in batch.to_pylist():
            if rows and (row["tree"], row["block"]) != (rows[0]["tree"], rows[0]["block"]):
                out.extend(work(rows))
                rows = []
                if len(out) >= 4096:
                    yield flushed()
            rows.append(row)
    if rows:
        out.extend(work(rows))
    yield flushed()


def _dealt(rows: DataFrame) -> DataFrame:
    """Take messages off the external queue: whole blocks, in the order of their labels."""
    return rows.repartition("tree", "block").sortWithinPartitions(*[F.col(c).asc_nulls_first() for c in _KEY])


def _schema(spec: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "string": pa.string()}
    return pa.schema([(name, kinds[kind]) for name, kind in (field.split() for field in spec.split(", "))])


def _up(nodes: DataFrame, stride: int) -> DataFrame:
    """The nodes ``stride`` levels up, or the root of trees that are not as high."""
    block = FAN**stride

    def work(rows: list[dict]) -> Iterator[tuple]:
        n = rows[0]["n"]
        top, _ = forward([r["digest"] for r in rows], levels_of(n, stride))
        yield rows[0]["tree"], rows[0]["block"], -(-n // block), top

    def run(batches):
        return _by_block(batches, work, _schema(_NODES))

    return _dealt(nodes.select("tree", _block_of(stride), F.lit(1).alias("turn"), "pos", "n", "digest")).mapInArrow(run, _NODES)


def _block_of(stride: int) -> Column:
    return F.floor(F.col("pos") / F.lit(FAN**stride)).cast("long").alias("block")


def _down(nodes: DataFrame, suffixes: DataFrame, stride: int, leaves: bool) -> DataFrame:
    """Proofs of ``nodes`` from the proof suffixes of the nodes their blocks became;
    for leaves, what their proofs amount to."""

    def proofs(rows: list[dict]) -> Iterator[tuple]:
        sent, nodes = rows[0], rows[1:]
        if sent["turn"] or not nodes or nodes[0]["turn"] == 0:
            raise ValueError(f"block {sent['block']} of {sent['tree']!r} needs exactly one proof suffix and a node")
        levels = levels_of(nodes[0]["n"], stride)
        _, children = forward([r["digest"] for r in nodes], levels)
        for row, proof in zip(nodes, backward(children, levels, sent["proof"]), strict=True):
            if leaves:
                plain = proof.replace(",", "").replace(";", "")
                yield row["doc_id"], row["digest"], sent["subroot"], proof, digest(plain), folded(row["changed"] or row["digest"], proof)
            else:
                yield row["tree"], row["pos"], proof, sent["subroot"]

    spec = _FOLDED if leaves else _PROOFS

    def run(batches):
        return _by_block(batches, proofs, _schema(spec))

    more = ["doc_id", "changed"] if leaves else []
    sent = suffixes.select("tree", F.col("pos").alias("block"), F.lit(0).alias("turn"), F.lit(None).cast("long").alias("pos"), "proof", "subroot")
    rows = nodes.select("tree", _block_of(stride), F.lit(1).alias("turn"), "pos", "n", "digest", *more)
    return _dealt(sent.unionByName(rows, allowMissingColumns=True)).mapInArrow(run, spec)


def _placed(rows: DataFrame, order: list[str], stage, name: str) -> DataFrame:
    """``rows`` with ``pos``, their place in their tree, and ``n``, its nodes.

    Ranges are sorted and counted, and places follow from the counts before: no
    tree is sorted in one task.
    """
    columns = [F.col(c).asc_nulls_first() for c in ("tree", *order)]
    ranged = rows.repartitionByRange(*columns).sortWithinPartitions(*columns)
    ranged = stage(ranged.withColumn("at", F.monotonically_increasing_id()), f"{name}-ranged")
    part = F.shiftright("at", 33)
    runs = ranged.groupBy("tree", part.alias("part")).agg(F.min("at").alias("first"), F.count("*").alias("rows"))
    along = Window.partitionBy("tree").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select(
        F.col("tree").alias("its"),
        "part",
        (F.coalesce(F.sum("rows").over(along), F.lit(0)) - F.col("first")).alias("shift"),
        F.sum("rows").over(Window.partitionBy("tree")).alias("n"),
    )
    runs = stage(runs, f"{name}-runs")
    same = F.col("tree").eqNullSafe(F.col("its")) & (part == F.col("part"))
    return stage(ranged.join(runs, same).withColumn("pos", F.col("at") + F.col("shift")).drop("its", "part", "shift", "at"), f"{name}-placed")


def _grown(nodes: DataFrame, stride: int, stage, name: str) -> tuple[list[DataFrame], list[DataFrame]]:
    """Nodes of every epoch, and the trees' roots (tree, pos 0, n 1, digest) that each epoch came to."""
    epochs, roots = [nodes], []
    while True:
        above = stage(_up(epochs[-1], stride), f"{name}-{len(epochs)}")
        roots.append(above.where("n = 1"))
        left = above.where("n > 1")
        if left.isEmpty():
            return epochs, roots
        epochs.append(left)


def _delivered(epochs: list[DataFrame], roots: list[DataFrame], stride: int, stage, name: str, leaves: bool) -> DataFrame:
    """Proofs of the first epoch's nodes; ``roots`` now say (tree, pos 0, proof, subroot)."""
    below = None
    for at in reversed(range(len(epochs))):
        suffixes = roots[at] if below is None else roots[at].unionByName(below)
        below = _down(epochs[at], suffixes, stride, leaves and at == 0)
        if at:
            below = stage(below, f"{name}-{at}")
    return below


# --- the manifest -----------------------------------------------------------------


def manifest(docs: DataFrame, changed_text: Column | None = None, stride: int = STRIDE) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof, proof_sha256, folded_root, verified) of every row of ``docs``.

    ``changed_text`` is another text for some rows (null: as it was): their proof,
    made from the text as it was, is then folded from the changed leaf.
    """
    spark = docs.sparkSession
    rest = [F.col(f"`{c}`") for c in FIELDS[:-1]]
    changed = F.lit(None).cast("string") if changed_text is None else F.when(changed_text.isNotNull(), leaf_digest(*rest, changed_text))
    leaves = docs.select(
        F.col("`source`").cast("string").alias("tree"),
        F.col("`doc_id`").cast("long").alias("doc_id"),
        leaf_digest(*rest, F.col("`text`")).alias("digest"),
        changed.alias("changed"),
        # Deals equal rows over ranges.
        F.monotonically_increasing_id().alias("row"),
    )
    with staging(spark, "manifest") as stage:
        placed = _placed(stage(leaves, "leaves"), ["doc_id", "digest", "row"], stage, "leaves")
        epochs, subroots = _grown(placed, stride, stage, "up")

        # The subroots are the leaves of the tree of all sources.
        tops = [s.select(F.lit("").alias("tree"), F.col("tree").alias("source"), "digest", F.lit(at).alias("epoch")) for at, s in enumerate(subroots)]
        sources = tops[0]
        for top in tops[1:]:
            sources = sources.unionByName(top)
        sources = _placed(sources, ["source"], stage, "sources")
        above, roots = _grown(sources, stride, stage, "sources-up")
        ends = [r.select("tree", "pos", F.lit("").alias("proof"), F.lit(None).cast("string").alias("subroot")) for r in roots]
        proofs = stage(_delivered(above, ends, stride, stage, "sources-down", False), "sources-proofs")
        held = sources.select("pos", "source", "epoch", "digest").join(proofs.select("pos", "proof"), "pos")
        held = stage(held.select(F.col("source").alias("tree"), "epoch", F.lit(0).cast("long").alias("pos"), "proof", F.col("digest").alias("subroot")), "subroots")
        ends = [held.where(F.col("epoch") == at).drop("epoch") for at in range(len(epochs))]

        out = _delivered(epochs, ends, stride, stage, "down", True)
        root = roots[-1].select("digest").first()
        root = F.lit(root["digest"] if root else None).cast("string")
        out = out.select("doc_id", "leaf", "subroot", root.alias("root"), "proof", "proof_sha256", "folded_root", (F.col("folded_root") == root).alias("verified"))
        return staged(out, "manifest")
