"""Inverting records to words: postings, counts, and bounded posting blocks."""

from __future__ import annotations

from base64 import b64decode, b64encode
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sealdex.functions.uid import POSITION_BYTES
from sealdex.session import ship

BLOCK_SIZE = 64

# A word is split ahead of the shuffle once it has more postings than
# max(SPLIT_ABOVE, all postings / MAX_SPLIT_WORDS). At most MAX_SPLIT_WORDS words
# can exceed that, whatever the data, so the broadcast split table is bounded.
SPLIT_ABOVE = 4_096
MAX_SPLIT_WORDS = 500_000

# Within a block body: between ids of a file, after its name, and between files.
UID_SEPARATOR, NAME_END, GROUP_SEPARATOR = ",", ":", ";"

# Blocks, and characters of them, that a worker hands back at once.
OUT_ROWS, OUT_CHARS = 10_000, 4 << 20

# Ids that a task packs together, and bodies it unpacks together.
LOT_IDS, UNPACKED_ROWS = 1 << 19, 2_000

# Most neighbouring blocks of a split word in one group.
PART_BLOCKS = 32

# Longest run of block numbers generated within one row.
BLOCK_RUN = 16_384


def explode_words(df: DataFrame) -> DataFrame:
    """(uid, word) from (uid, words), each word of a record once.

    Exploding an expression rather than a column also keeps the optimizer from
    testing the size of ``words`` first, which would compute them twice.
    """
    return df.select("uid", F.explode(F.array_distinct("words")).alias("word"))


def word_counts(postings: DataFrame) -> DataFrame:
    """Postings per word, combined within each task before the shuffle."""
    return postings.groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def with_blocks(counts: DataFrame, block_size: int) -> DataFrame:
    """Add ``word_hash``, where it is not there, and ``blocks`` to (word, n).

    Words that share a hash share the larger block count, so that the hash alone
    tells it; a collision costs a few short blocks and no posting.
    """
    needed = F.ceil(F.col("n") / F.lit(block_size)).cast("bigint")
    hashed = counts if "word_hash" in counts.columns else counts.withColumn("word_hash", F.xxhash64("word"))
    return hashed.withColumn("blocks", F.max(needed).over(Window.partitionBy("word_hash")))


@dataclass(frozen=True)
class WordTotals:
    words: int
    postings: int
    most: int

    def split_threshold(self, split_above: int = SPLIT_ABOVE, max_split_words: int = MAX_SPLIT_WORDS) -> int:
        return max(split_above, -(-self.postings // max_split_words))


def word_totals(counts: DataFrame) -> WordTotals:
    row = counts.agg(F.count(F.lit(1)).alias("words"), F.sum("n").alias("n"), F.max("n").alias("most")).first()
    return WordTotals(row["words"], row["n"] or 0, row["most"] or 0)


def block_of(uid: Column, blocks: Column) -> Column:
    """The block a record id is in, for a word with that many blocks."""
    return F.pmod(F.xxhash64(uid), blocks)


def split_words(counts: DataFrame, threshold: int) -> DataFrame:
    """(word_hash, split_blocks) of the words with more postings than ``threshold``."""
    frequent = counts.where(F.col("n") > threshold)
    return frequent.groupBy("word_hash").agg(F.max("blocks").alias("split_blocks"))


def block_postings(postings: DataFrame, counts: DataFrame, splits: DataFrame | None, block_size: int = BLOCK_SIZE) -> DataFrame:
    """(word, block, body, uids): the postings (uid, word) in blocks of about ``block_size``."""
    blocks = cut_blocks(packed_words(postings.select("uid", F.array("word").alias("words")), splits), counts, splits)
    return blocks.select("word", "block", "body", uids_of(F.col("body")).alias("uids"))


def cut_blocks(packed: DataFrame, counts: DataFrame, splits: DataFrame | None) -> DataFrame:
    """(word, block, body): every word's postings, packed with the same ``splits``, in its blocks.

    A record id's hash says which of its word's blocks it is in. Where a word has
    several, their count travels to its postings as one more row from the staged
    ``counts``, ahead of them in their order: one shuffle and one sort serve all. A frequent word is
    placed by runs of a few blocks, so it spreads over many groups; its
    block count comes with ``splits``. No group outgrows the split
    threshold. ``splits`` is None where no word is that frequent.

    Every block of a word is there, also one that no id falls into: a reader can
    tell a lost block from an empty one.
    """
    no_part, none = F.lit(None).cast("bigint").alias("part"), F.lit(None).cast("binary")
    heads = counts.where(F.col("blocks") > 1).select("word", "word_hash", "blocks")
    if splits is None:
        heads = heads.select("word", no_part, "blocks")
    else:
        heads = heads.join(F.broadcast(splits), "word_hash", "left")
        last = F.floor((F.col("split_blocks") - 1) / _blocks_a_part(F.col("split_blocks"))).cast("bigint")
        runs = F.explode(F.sequence(F.lit(0).cast("bigint"), last, F.lit(BLOCK_RUN).cast("bigint"))).alias("first")
        runs = heads.where(F.col("split_blocks").isNotNull()).select("word", "split_blocks", last.alias("last"), runs)
        end = F.least(F.col("first") + (BLOCK_RUN - 1), F.col("last"))
        apart = runs.select("word", F.explode(F.sequence("first", end)).alias("part"), F.col("split_blocks").alias("blocks"))
        heads = heads.where(F.col("split_blocks").isNull()).select("word", no_part, "blocks").unionByName(apart)
    rows = packed.select("word", "part", F.lit(None).cast("bigint").alias("blocks"), "file", "places")
    rows = rows.unionByName(heads.select("word", "part", "blocks", none.alias("file"), none.alias("places")))
    # The row that tells the block count stands first.
    rows = rows.repartition("word", "part").sortWithinPartitions("word", "part", F.col("blocks").desc())
    return rows.mapInArrow(_cut_blocks, "word string, block bigint, body string")


def _blocks_a_part(blocks):
    """How many neighbouring blocks of a split word, of so many, stand together."""
    if isinstance(blocks, Column):
        return F.greatest(F.lit(1), F.least(F.lit(PART_BLOCKS), F.floor(blocks / F.lit(PART_BLOCKS * 2))))
    return np.maximum(1, np.minimum(PART_BLOCKS, blocks // (PART_BLOCKS * 2)))


# --- packed postings: the ids of a word that a task has seen, in few rows ---------


def packed_words(df: DataFrame, splits: DataFrame | None) -> DataFrame:
    """(word, part, file, places) from (uid, words), each word of a record once.

    ``places`` are the positions of ids of one file, eight bytes each, or an id
    too short to end in one, which has no file; records without an id have none.
    """
    ship(df.sparkSession)
    hot = _held(splits)
    return df.select("uid", "words").mapInArrow(lambda batches: _pack_words(batches, hot), _PACKED)


def packed_bodies(df: DataFrame, splits: DataFrame | None) -> DataFrame:
    """The same from (word, body) of block bodies."""
    ship(df.sparkSession)
    hot = _held(splits)
    return df.select("word", "body").mapInArrow(lambda batches: _pack_bodies(batches, hot), _PACKED)


def record_words(df: DataFrame) -> DataFrame:
    """(word, n) of (uid, words): each word of a record once, rows of a word as many as tasks have it or more."""
    ship(df.sparkSession)
    return df.select("words").mapInArrow(_count_words, "word string, n bigint")


_PACKED = "word string, part bigint, file binary, places binary"


def _held(splits: DataFrame | None) -> tuple[np.ndarray, np.ndarray] | None:
    """Word hashes in order and their blocks; never more than MAX_SPLIT_WORDS."""
    if splits is None:
        return None
    table = splits.select("word_hash", "split_blocks").toArrow().sort_by("word_hash")
    return (table.column(0).to_numpy(), table.column(1).to_numpy()) if table.num_rows else None


def _lots(batches: Iterator[pa.RecordBatch], size) -> Iterator[pa.Table]:
    """Batches together until they hold about LOT_IDS."""
    held, n = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            n += size(batch) + batch.nbytes // 64
        if n >= LOT_IDS:
            yield pa.Table.from_batches(held)
            held, n = [], 0
    if held:
        yield pa.Table.from_batches(held)


def _array(rows: pa.Table, name: str) -> pa.Array:
    column = rows.column(name)
    return column.chunk(0) if column.num_chunks == 1 else pa.concat_arrays(column.chunks)


def _distinct(words: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The words, and (word's number, record's number) of each word of a record once, by word and record."""
    flat = words.flatten()
    if flat.null_count:
        raise ValueError("a record has a word that is null")
    lengths = pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False)
    coded = flat.dictionary_encode()
    codes, n = coded.indices.to_numpy().astype(np.int64), max(len(words), 1)
    keys = np.unique(codes * n + np.repeat(np.arange(len(words)), lengths))
    codes = keys // n
    return coded.dictionary, codes, keys - codes * n


def _words_of(batch: pa.RecordBatch) -> int:
    return pc.sum(pc.list_value_length(batch.column("words"))).as_py() or 0


def record_word_counts(df: DataFrame) -> DataFrame:
    """(word_hash, word, n) of (uid, words), one row a word."""
    return by_word_hash(record_words(df)).groupBy("word_hash", "word").agg(F.sum("n").alias("n"))


def by_word_hash(rows: DataFrame) -> DataFrame:
    """Rows with their ``word_hash``, dealt by it: what is summed by word and compared by hash moves once."""
    return rows.withColumn("word_hash", F.xxhash64("word")).repartition("word_hash")


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for lot in _lots(batches, _words_of):
        words, codes, _ = _distinct(_array(lot, "words"))
        yield pa.RecordBatch.from_arrays([words, pa.array(np.bincount(codes, minlength=len(words)), pa.int64())], ["word", "n"])


def _pack_words(batches: Iterator[pa.RecordBatch], hot) -> Iterator[pa.RecordBatch]:
    for lot in _lots(batches, _words_of):
        words, codes, records = _distinct(_array(lot, "words"))
        uids = lot.column("uid").to_pylist()
        files: dict[bytes, int] = {}
        file = np.array([-2 if u is None else -1 if len(u) < POSITION_BYTES else files.setdefault(u[:-POSITION_BYTES], len(files)) for u in uids])
        places = np.frombuffer(b"".join(u[-POSITION_BYTES:] if f >= 0 else bytes(POSITION_BYTES) for u, f in zip(uids, file.tolist(), strict=True)), ">u8")
        if len(file) and file.min() < 0:
            # Words of records without an id are there all the same, with a row of no places.
            bare = np.unique(codes[file[records] == -2])
            is_split, none = _split_blocks(words, hot)[bare] > 0, pa.nulls(len(bare), pa.binary())
            yield _packed_batch(words.take(pa.array(bare)), np.zeros(len(bare), np.int64), is_split, none, none)
            short = file[records] == -1
            yield from _packed_short(words, codes[short], [uids[r] for r in records[short].tolist()], hot)
            codes, records = codes[file[records] >= 0], records[file[records] >= 0]
        yield from _packed_rows(words, codes, list(files), file[records], places[records].astype(np.uint64), hot)


def _pack_bodies(batches: Iterator[pa.RecordBatch], hot) -> Iterator[pa.RecordBatch]:
    for lot in _lots(batches, _ids_of):
        words, codes, files, file, places, short_codes, short = _parsed(lot)
        yield from _packed_short(words, short_codes, short, hot)
        yield from _packed_rows(words, codes, files, file, places, hot)


def _unpack_bodies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for low in range(0, batch.num_rows, UNPACKED_ROWS):
            words, codes, files, file, places, short_codes, short = _parsed(pa.Table.from_batches([batch.slice(low, UNPACKED_ROWS)]))
            if short:
                yield pa.RecordBatch.from_arrays([words.take(pa.array(short_codes)), pa.array(short, pa.binary())], ["word", "uid"])
            for number, name in enumerate(files):
                at = np.flatnonzero(file == number)
                head = np.frombuffer(name, np.uint8)
                tail = places[at].astype(">u8").view(np.uint8).reshape(-1, POSITION_BYTES)
                ids = np.hstack([np.broadcast_to(head, (len(at), len(head))), tail])
                ends = np.arange(len(at) + 1, dtype=np.int32) * np.int32(ids.shape[1])
                uids = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(ends), pa.py_buffer(ids.tobytes())])
                yield pa.RecordBatch.from_arrays([words.take(pa.array(codes[at])), uids], ["word", "uid"])


def _ids_of(bodies: pa.RecordBatch) -> int:
    return (pc.sum(pc.count_substring(bodies.column("body"), UID_SEPARATOR)).as_py() or 0) + bodies.num_rows


def _parsed(lot: pa.Table) -> tuple[pa.Array, np.ndarray, list[bytes], np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    """The words of block bodies, (word's number, file's number, position) of their ids with the files, and
    (word's number, id) of those too short to end in a position."""
    coded = _array(lot, "word").dictionary_encode()
    names: dict[str, int] = {}
    code, file, sizes, texts, short, short_codes = [], [], [], [], [], []
    for word, body in zip(coded.indices.to_pylist(), lot.column("body").to_pylist(), strict=True):
        for group in body.split(GROUP_SEPARATOR) if body else ():
            name, end, listed = group.rpartition(NAME_END)
            ids = listed.split(UID_SEPARATOR)
            if end:
                code.append(word)
                file.append(names.setdefault(name, len(names)))
                sizes.append(len(ids))
                texts += ids
                continue
            # Whole ids, as all bodies once listed them.
            for uid in map(b64decode, ids):
                if len(uid) < POSITION_BYTES:
                    short_codes.append(word)
                    short.append(uid)
                else:
                    code.append(word)
                    file.append(names.setdefault(b64encode(uid[:-POSITION_BYTES]).decode(), len(names)))
                    sizes.append(1)
                    texts.append(uid[-POSITION_BYTES:].hex())
    places = np.array([int(t, 16) if t else 0 for t in texts], np.uint64)
    codes, file = (np.repeat(np.array(x, np.int64), sizes) for x in (code, file))
    return coded.dictionary, codes, [b64decode(n) for n in names], file, places, np.array(short_codes, np.int64), short


def _split_blocks(words: pa.Array, hot) -> np.ndarray:
    """The blocks of each word that is split, and 0 for all others."""
    found = np.zeros(len(words), np.int64)
    if hot is not None and len(words):
        hashes, blocks = hot
        own = xxhash64(words.cast(pa.binary()))
        at = np.minimum(np.searchsorted(hashes, own), len(hashes) - 1)
        found = np.where(hashes[at] == own, blocks[at], 0)
    return found


def _packed_short(words: pa.Array, codes: np.ndarray, uids: list[bytes], hot) -> Iterator[pa.RecordBatch]:
    if uids:
        places = pa.array(uids, pa.binary())
        blocks = _split_blocks(words, hot)[codes]
        part = xxhash64(places) % np.maximum(blocks, 1) // _blocks_a_part(np.maximum(blocks, 1))
        yield _packed_batch(words.take(pa.array(codes)), part, blocks > 0, pa.nulls(len(uids), pa.binary()), places)


def _packed_batch(words: pa.Array, part: np.ndarray, is_split: np.ndarray, file: pa.Array, places: pa.Array) -> pa.RecordBatch:
    parts = pa.array(part, pa.int64(), mask=~is_split)
    return pa.RecordBatch.from_arrays([words, parts, file, places], ["word", "part", "file", "places"])


def _packed_rows(words: pa.Array, codes: np.ndarray, files: list[bytes], file: np.ndarray, places: np.ndarray, hot) -> Iterator[pa.RecordBatch]:
    """A row for each word, part and file, of ids (word's number, file's number, position)."""
    if not len(codes):
        return
    names, blocks = pa.array(files, pa.binary()), _split_blocks(words, hot)
    split = blocks[codes]
    for chosen, is_split in ((split == 0, False), (split > 0, True)):
        c, f, p = codes[chosen], file[chosen], places[chosen]
        if not len(c):
            continue
        part = np.zeros(len(c), np.int64)
        if is_split:
            of = split[chosen]
            part = id_hashes(names, f, p) % of // _blocks_a_part(of)
        order = np.lexsort((f, part, c))
        c, f, p, part = c[order], f[order], p[order], part[order]
        starts = np.flatnonzero(np.concatenate(([True], (c[1:] != c[:-1]) | (part[1:] != part[:-1]) | (f[1:] != f[:-1]))))
        for low in range(0, len(starts), OUT_ROWS):
            own = starts[low : low + OUT_ROWS]
            end = starts[low + OUT_ROWS] if low + OUT_ROWS < len(starts) else len(c)
            ends = ((np.append(own, end) - own[0]) * POSITION_BYTES).astype(np.int32)
            data = p[own[0] : end].astype(">u8").tobytes()
            rows = pa.Array.from_buffers(pa.binary(), len(own), [None, pa.py_buffer(ends), pa.py_buffer(data)])
            yield _packed_batch(words.take(pa.array(c[own])), part[own], np.full(len(own), is_split), names.take(pa.array(f[own])), rows)


# --- cutting ----------------------------------------------------------------------


def _cut_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of rows (word, part, blocks, file, places) that stand by word and part, the one with a count first.

    A word without a count has one block. A row without places is in a block, but not of its ids.
    """
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
        if held.num_rows >= OUT_ROWS or held.nbytes >= OUT_CHARS:
            word, part = held.column("word")[-1], held.column("part")[-1]
            first = pc.equal(held.column("word"), word)
            first = pc.and_(first, pc.is_null(held.column("part")) if part.as_py() is None else pc.equal(held.column("part"), part))
            whole = held.num_rows - (pc.sum(pc.fill_null(first, False)).as_py() or 0)
            if whole:
                yield from _cut(held.slice(0, whole).combine_chunks())
                held = held.slice(whole)
    if held is not None and held.num_rows:
        yield from _cut(held.combine_chunks())


def _cut(rows: pa.Table) -> Iterator[pa.RecordBatch]:
    """Blocks of whole words and parts."""
    words, file, places = _array(rows, "word"), _array(rows, "file").dictionary_encode(), _array(rows, "places")
    codes = words.dictionary_encode().indices.to_numpy()
    part, blocks = (_array(rows, n).fill_null(-1 if n == "part" else 0).to_numpy(zero_copy_only=False) for n in ("part", "blocks"))
    starts = np.flatnonzero(np.concatenate(([True], (codes[1:] != codes[:-1]) | (part[1:] != part[:-1]))))
    group = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(codes))))
    blocks = np.maximum(np.maximum.reduceat(blocks, starts), 1)
    part = part[starts]
    run = _blocks_a_part(blocks)
    low = np.where(part >= 0, part * run, 0)
    made = np.where(part >= 0, np.minimum(blocks - low, run), blocks)
    base = np.cumsum(made) - made
    # Ids of each row: positions of a file, or a whole short id.
    named = file.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    sizes = pc.fill_null(pc.binary_length(places), 0).to_numpy(zero_copy_only=False)
    sizes = np.where(named >= 0, sizes // POSITION_BYTES, 0)
    data = places if not (named < 0).any() else places.filter(pa.array(named >= 0))
    ids = np.frombuffer(b"".join(data.to_pylist()), ">u8").astype(np.uint64)
    row = np.repeat(np.arange(len(codes)), sizes)
    own, f = group[row], named[row]
    ranks = np.argsort(np.argsort(np.array(file.dictionary.to_pylist() or [b""], object)))
    several = blocks[own] > 1
    block = np.zeros(len(ids), np.int64)
    block[several] = id_hashes(file.dictionary, f[several], ids[several]) % blocks[own[several]]
    key, rank = base[own] + block - low[own], ranks[f]
    order = np.lexsort((ids, rank, key))
    key, f, ids = key[order], f[order], ids[order]
    names = [b64encode(n).decode() + NAME_END for n in file.dictionary.to_pylist()]
    texts = ["%x" % i for i in ids.tolist()]
    bodies = [""] * int(made.sum())
    if len(ids):
        cuts = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (f[1:] != f[:-1])))).tolist()
        for at, end, k, name in zip(cuts, [*cuts[1:], len(ids)], key[cuts].tolist(), f[cuts].tolist(), strict=True):
            body = names[name] + UID_SEPARATOR.join(texts[at:end])
            bodies[k] = f"{bodies[k]}{GROUP_SEPARATOR}{body}" if bodies[k] else body
    is_short = (named < 0) & places.is_valid().to_numpy(zero_copy_only=False)
    if is_short.any():
        at = np.flatnonzero(is_short)
        uids = places.take(pa.array(at))
        g = group[at]
        key = base[g] + xxhash64(uids) % blocks[g] - low[g]
        listed: dict[int, list[bytes]] = {}
        for k, uid in zip(key.tolist(), uids.to_pylist(), strict=True):
            listed.setdefault(k, []).append(uid)
        for k, found in listed.items():
            bodies[k] += GROUP_SEPARATOR * bool(bodies[k]) + UID_SEPARATOR.join(b64encode(uid).decode() for uid in sorted(found))
    of = np.repeat(np.arange(len(starts)), made)
    number = np.arange(len(of)) - base[of] + low[of]
    heads = pa.array(starts[of])
    for at in range(0, len(bodies), OUT_ROWS):
        end = at + OUT_ROWS
        arrays = [words.take(heads.slice(at, OUT_ROWS)), pa.array(number[at:end], pa.int64()), pa.array(bodies[at:end], pa.string())]
        yield pa.RecordBatch.from_arrays(arrays, ["word", "block", "body"])


# --- hashes as Spark's ``xxhash64`` -------------------------------------------------

_P1, _P2, _P3, _P4, _P5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
_SEED = np.uint64(42)


def id_hashes(names: pa.Array, file: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Hashes of ids given by file and position."""
    held = names.to_pylist()
    sizes = np.array([len(n) for n in held], np.int64)
    out = np.empty(len(places), np.int64)
    for size in np.unique(sizes[np.unique(file)]).tolist():
        at = np.flatnonzero(sizes[file] == size)
        kept = np.zeros((len(held), size), np.uint8)
        for i in np.flatnonzero(sizes == size).tolist():
            kept[i] = np.frombuffer(held[i], np.uint8)
        tail = places[at].astype(">u8").view(np.uint8).reshape(-1, POSITION_BYTES)
        out[at] = _xxhash64_rows(np.hstack([kept[file[at]], tail]))
    return out


def xxhash64(values: pa.Array) -> np.ndarray:
    """Hashes of binary values, none of them null."""
    sizes = pc.binary_length(values).to_numpy(zero_copy_only=False)
    out = np.empty(len(values), np.int64)
    for size in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == size)
        data = b"".join(values.take(pa.array(at)).to_pylist())
        out[at] = _xxhash64_rows(np.frombuffer(data, np.uint8).reshape(len(at), size))
    return out


def _rotated(x: np.ndarray, by: int) -> np.ndarray:
    return (x << np.uint64(by)) | (x >> np.uint64(64 - by))


def _xxhash64_rows(rows: np.ndarray) -> np.ndarray:
    """Hash of every row of a byte matrix."""
    n, size = rows.shape
    if not size:
        rows = np.zeros((n, 1), np.uint8)

    def word(at: int, kind: str) -> np.ndarray:
        return np.ascontiguousarray(rows[:, at : at + int(kind[-1])]).view(kind).reshape(n).astype(np.uint64)

    def mixed(acc: np.ndarray, value: np.ndarray) -> np.ndarray:
        return _rotated(acc + value * _P2, 31) * _P1

    at = 0
    with np.errstate(over="ignore"):
        if size >= 32:
            acc = [np.full(n, v, np.uint64) for v in (_SEED + _P1 + _P2, _SEED + _P2, _SEED, _SEED - _P1)]
            while at + 32 <= size:
                acc = [mixed(a, word(at + 8 * i, "<u8")) for i, a in enumerate(acc)]
                at += 32
            total = _rotated(acc[0], 1) + _rotated(acc[1], 7) + _rotated(acc[2], 12) + _rotated(acc[3], 18)
            for a in acc:
                total = (total ^ mixed(np.zeros(n, np.uint64), a)) * _P1 + _P4
        else:
            total = np.full(n, _SEED + _P5, np.uint64)
        total = total + np.uint64(size)
        while at + 8 <= size:
            total = _rotated(total ^ mixed(np.zeros(n, np.uint64), word(at, "<u8")), 27) * _P1 + _P4
            at += 8
        if at + 4 <= size:
            total = _rotated(total ^ (word(at, "<u4") * _P1), 23) * _P2 + _P3
            at += 4
        while at < size:
            total = _rotated(total ^ (rows[:, at].astype(np.uint64) * _P5), 11) * _P1
            at += 1
        total = (total ^ (total >> np.uint64(33))) * _P2
        total = (total ^ (total >> np.uint64(29))) * _P3
        return (total ^ (total >> np.uint64(32))).view(np.int64)


def uids_of(body: Column) -> Column:
    """The record ids of a block body, as an array.

    A group without a file's name lists whole ids, as all bodies once did.
    """

    def of_group(group: Column) -> Column:
        name = F.unbase64(F.substring_index(group, NAME_END, 1))
        texts = F.split(F.substring_index(group, NAME_END, -1), UID_SEPARATOR)
        placed = F.transform(texts, lambda t: F.concat(name, F.unhex(F.lpad(t, 2 * POSITION_BYTES, "0"))))
        return F.when(F.contains(group, F.lit(NAME_END)), placed).otherwise(F.transform(texts, lambda t: F.unbase64(t)))

    every = F.flatten(F.transform(F.split(body, GROUP_SEPARATOR), of_group))
    return F.when(body == "", F.array().cast("array<binary>")).otherwise(every)


def unpack_many(blocks: DataFrame) -> DataFrame:
    """What :func:`unpack_uids` gives, for so many bodies that workers are worth their start."""
    ship(blocks.sparkSession)
    return blocks.select("word", "body").mapInArrow(_unpack_bodies, "word string, uid binary")


def unpack_uids(blocks: DataFrame) -> DataFrame:
    """(word, uid) from (word, body): one row per record id of a block body.

    Empty bodies give no rows by themselves: a filter would open every body twice.
    """
    return blocks.select("word", F.explode(uids_of(F.col("body"))).alias("uid"))
