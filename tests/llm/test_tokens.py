import random
import tracemalloc
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer
from llm_rows import SF_DIR, odd_rows, shipped  # noqa: F401

from sealdex.llm import prefix_counts, range_coder, token_files, tokens
from sealdex.llm.queries import QUERIES, VOCABULARY
from sealdex.llm.tokens import Encoder, encoder

SCHEMA = "doc_id long, text string, n_tokens string, start int"
LIBRARY = Tokenizer.from_file(VOCABULARY)


def ids_of(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


def wide(rows):
    return [(i, t, "x", 1) for i, t in rows]


def test_words_encoded_once_give_the_library_s_ids(odd_rows):
    texts = [t or "" for _, t in odd_rows]
    flat, bounds = encoder(VOCABULARY).encode(texts)
    for i, text in enumerate(texts):
        assert flat[bounds[i] : bounds[i + 1]].tolist() == ids_of(text)


@pytest.mark.parametrize("alphabet", ["ab's.,! \n\x1c\x85 ", "éÉéΣσςİIıﬁK ½²1a.", "<|endoftext|> a​ ̸=.'"])
def test_any_mixture_of_letters(alphabet):
    draw = random.Random(alphabet)
    texts = ["".join(draw.choice(alphabet) for _ in range(draw.randrange(30))) for _ in range(2000)]
    flat, bounds = encoder(VOCABULARY).encode(texts)
    for i, text in enumerate(texts):
        assert flat[bounds[i] : bounds[i + 1]].tolist() == ids_of(text), repr(text)


def test_special_strings_in_another_case():
    texts = ["a <|ENDOFTEXT|> b", "<|EndOfText|>", "x<|ENDOFTEXT|>.", "<|endoftext|> <|STARTOFTEXT|>!", "<|startoftext|>?", "<|ENDOFTEXT|><|endoftext|>"]
    for some in (texts, texts[::-1]):
        own = Encoder(VOCABULARY)
        flat, bounds = own.encode(some)
        for i, text in enumerate(some):
            assert flat[bounds[i] : bounds[i + 1]].tolist() == ids_of(text), text


def test_counts_of_odd_rows(shipped, odd_rows):
    got = prefix_counts.token_counts(shipped.createDataFrame(wide(odd_rows), SCHEMA), VOCABULARY, limit=100).collect()
    assert sorted((r.doc_id is None, r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in got) == sorted(
        (i is None, i, len((t or "").encode()), len(ids_of(t)), len(ids_of(t)) > 100) for i, t in odd_rows
    )


def test_counts_query_equals_the_library(shipped):
    texts = {r.doc_id: r.text for r in shipped.read.parquet(f"{SF_DIR}/documents.parquet").collect()}
    for r in QUERIES["op5_token_counts"](shipped, SF_DIR).collect():
        text = texts[r.doc_id]
        n = len(ids_of(text))
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(text.encode()), n, n > 2048)
        if n > 2048:
            assert len(ids_of(text[: r.fits_chars])) <= 2048 < len(ids_of(text[: r.fits_chars + 1]))


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_every_prefix(shipped, name):
    path, text = public_tokenizers.path(name), "The quick—brown FOX's 12 jumps,  over\n the lazy dog... éé <|endoftext|>!"
    own = encoder(path)
    table = prefix_counts.PrefixTable(text, own)
    counts = own.counts([text[:p] for p in range(len(text) + 1)])
    assert [table.at(p) for p in range(len(text) + 1)] == counts
    for budget in range(len(text)):
        longest = table.longest(budget)
        assert counts[longest] <= budget and all(n > budget for n in counts[longest + 1 :])
    rows = prefix_counts.prefix_tables(shipped.createDataFrame([(1, text), (2, None)], "doc_id long, text string"), path).collect()
    assert {r.doc_id: r.counts for r in rows} == {1: counts, 2: [0]}


def unspaced(n, alphabet, seed=3):
    draw = random.Random(seed)
    return "".join(draw.choice(alphabet) for _ in range(n))


@pytest.mark.parametrize("alphabet", ["中文字。，漢かなカ", "abYZ09+/=", "it'sd!{}();=1.", "<|endoftext|>!a'", "éÉe\u0301İı2.Σ'ſ🙂½가ᄀ"])
def test_prefixes_of_long_words(alphabet):
    own = encoder(VOCABULARY)
    text = unspaced(150, alphabet) + "<|endoftext|>" + unspaced(150, alphabet, 4) + "<|endoftext|>x"
    table = prefix_counts.PrefixTable(text, own)
    counts = own.counts([text[:p] for p in range(len(text) + 1)])
    assert [table.at(p) for p in range(len(text) + 1)] == counts
    for budget in range(max(counts) + 1):
        assert table.longest(budget) == max(p for p, n in enumerate(counts) if n <= budget)


@pytest.mark.parametrize("alphabet", ["中文字。，漢かなカ", "abYZ09+/=", "中文字漢かなカ", "x"])
def test_unspaced_texts_of_100_000(shipped, alphabet):
    text = unspaced(100_000, alphabet)
    (row,) = prefix_counts.token_counts(shipped.createDataFrame(wide([(1, text)]), SCHEMA), VOCABULARY).collect()
    assert row.n_tokens == len(ids_of(text)) and row.over_limit
    assert len(ids_of(text[: row.fits_chars])) <= 2048 < len(ids_of(text[: row.fits_chars + 1]))


@pytest.mark.parametrize("n", [0, 1, 2, 1023, 1024, 1025, 70_000, 600_000])
def test_coder_round_trip(n):
    draw = np.random.default_rng(n)
    ids = (draw.zipf(1.3, n) % 5000).astype(np.uint32)
    ids[n // 2 :] = ids[: n - n // 2]
    ids[: n // 9] = 4999
    segment = range_coder.encode(ids, 5000)
    assert (range_coder.decode(segment) == ids).all()
    if n > 60_000:
        assert len(segment) < 1.6 * n


def test_extremes_of_the_coder():
    for ids in (np.zeros(50_000, np.uint32), np.full(50_000, 49_407, np.uint32), np.arange(49_408, dtype=np.uint32)[::-1].copy()):
        assert (range_coder.decode(range_coder.encode(ids, 49_408)) == ids).all()
    with pytest.raises(ValueError):
        range_coder.encode(np.array([7], np.uint32), 7)


def test_damage_is_noticed():
    segment = bytearray(range_coder.encode(np.arange(5000, dtype=np.uint32), 49_408))
    segment[-400] ^= 1
    with pytest.raises(ValueError):
        range_coder.decode(bytes(segment))
    with pytest.raises(ValueError):
        range_coder.decode(bytes(segment[:-10]))


def expected(rows):
    out, start = [], 0
    for i, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = [*ids_of(text), 1]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_files_of_odd_rows(shipped, odd_rows, tmp_path):
    docs = shipped.createDataFrame(wide(odd_rows), SCHEMA).repartition(3)
    got = token_files.written_and_read(docs, VOCABULARY).collect()
    assert sorted(map(tuple, got), key=lambda r: r[1]) == expected(odd_rows)
    token_files.write_token_files(docs, str(tmp_path / "f"), VOCABULARY)
    ids = token_files.read_token_ids(shipped, str(tmp_path / "f")).orderBy("start").collect()
    assert [i for r in ids for i in r.ids] == [i for _, t in sorted(odd_rows, key=lambda r: (r[0] is not None, r[0] or 0)) for i in [*ids_of(t), 1]]


def test_files_query(shipped):
    rows = [(r.doc_id, r.text) for r in shipped.read.parquet(f"{SF_DIR}/documents.parquet").collect()]
    got = QUERIES["op4_token_files"](shipped, SF_DIR).collect()
    assert sorted(map(tuple, got), key=lambda r: r[1]) == expected(rows)


def test_no_rows(shipped):
    none = shipped.createDataFrame([], SCHEMA)
    assert token_files.written_and_read(none, VOCABULARY).count() == 0
    assert prefix_counts.token_counts(none, VOCABULARY).count() == 0


def test_encoding_a_full_group_takes_little_memory():
    ids = np.random.default_rng(3).zipf(1.3, range_coder.GROUP_IDS).astype(np.uint32) % 49_152
    tracemalloc.start()
    try:
        coded = range_coder.encode(ids, 49_152)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 80e6
    assert (range_coder.decode(coded) == ids).all()


def test_new_words_reach_the_library_few_at_a_time():
    own = tokens.Encoder(VOCABULARY)
    asked, whole = [], own._ids
    own._ids = lambda texts: asked.append(len(texts)) or whole(texts)
    text = " ".join(f"w{i}x" for i in range(3 * tokens.WORDS_AT_ONCE))
    ids, bounds = own.encode([text])
    assert sum(asked) >= 3 * tokens.WORDS_AT_ONCE and max(asked) <= tokens.WORDS_AT_ONCE
    assert ids.tolist() == whole([text])[0] and bounds.tolist() == [0, len(ids)]
