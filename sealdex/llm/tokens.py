"""Token ids of whole texts by a public vocabulary file, one distinct word encoded once.

The path of the vocabulary is a parameter; the library that reads it does the
encoding. Where the file's own rules never let a token cross white space, texts
are cut at white space and words found before are not encoded again. Any other
file goes to its library text by text.
"""

from __future__ import annotations

import json
import re
from itertools import chain

import numpy as np

#: Distinct words remembered by a worker before it starts afresh.
REMEMBERED_WORDS = 600_000
#: New words given to the library at once.
WORDS_AT_ONCE = 4_096

#: White space of Unicode. ``str.split`` also cuts at \x1c to \x1f.
_BLANKS = "\\t\\n\\x0b\\x0c\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
WORD = re.compile(f"[^{_BLANKS}]+")
_ODD = ("\x1c", "\x1d", "\x1e", "\x1f")

#: A word's closing punctuation is cut off before it is looked up: it always
#: stands apart from a letter or digit before it.
_TAIL = ".,;:!?%#&$*)"
#: That holds for letters that folding leaves one letter: up to here, but for one.
_STABLE, _SPREADS = "\u024f", "\u0130"

_ENCODERS: dict[str, Encoder] = {}


def words_of(text: str) -> list[str]:
    return WORD.findall(text) if any(c in text for c in _ODD) else text.split()


class Encoder:
    """``encode`` gives the ids of many texts at once."""

    def __init__(self, path: str):
        self.by_word = False
        #: Strings that are one token wherever a text has them in just this case.
        self.added: list[str] = []
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.vocabulary = model.vocab_size()
            self._ids = lambda texts: model.encode(texts, num_threads=1)
        else:
            from tokenizers import Tokenizer

            tokenizer = Tokenizer.from_file(path)
            tokenizer.no_truncation()
            tokenizer.no_padding()
            self.vocabulary = tokenizer.get_vocab_size()
            self._ids = lambda texts: [e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
            with open(path) as f:
                spec = json.load(f)
            self.by_word = _cut_at_blanks(spec)
            self.added = [t["content"] for t in spec["added_tokens"]]
        self._forget()

    def _forget(self) -> None:
        self.codes: dict[str, int] = {}
        self.first, self.length, self.flat = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int32), np.zeros(1 << 18, np.uint32)
        self.used = 0

    def _learn(self, words: list[str]) -> None:
        # A stem or a tail is a word of its own, with the same ids: one memory holds all.
        stems, tails = [], []
        for word in words:
            stem = word.rstrip(_TAIL)
            tail = word[len(stem) :]
            if not tail or not stem or not stem[-1].isalnum() or stem[-1] in _SPREADS or stem[-1] > _STABLE:
                stem, tail = word, ""
            stems.append(stem.lower() if stem.isascii() else stem)
            tails.append(tail)
        # The library looks for added strings before it folds case: words that may hold one stay as they are.
        if self._may_hold_added("\n".join(words)):
            for i, word in enumerate(words):
                if self._may_hold_added(word):
                    stems[i], tails[i] = word, ""
        codes = self.codes
        fresh = [p for p in {*stems, *tails} if p not in codes]
        if fresh:
            # The library's answer takes far more memory than the ids in it.
            for low in range(0, len(fresh), WORDS_AT_ONCE):
                ids = self._ids(some := fresh[low : low + WORDS_AT_ONCE])
                flat = np.fromiter(chain.from_iterable(ids), np.uint32)
                self._remember(some, np.fromiter(map(len, ids), np.int64, len(ids)), flat)
        joined = [i for i, word in enumerate(words) if word != stems[i]]
        if joined:
            pieces = np.empty((len(joined), 2), np.int64)
            pieces[:, 0] = [codes[stems[i]] for i in joined]
            pieces[:, 1] = [codes[tails[i]] for i in joined]
            self._remember([words[i] for i in joined], self.length[pieces].sum(1), self.flat[self._places(pieces.reshape(-1))[0]])

    def _may_hold_added(self, text: str) -> bool:
        low = text.lower()
        return any(c in low or c in text for c in self.added)

    def _places(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the ids of some words in ``flat``, and where each word's end."""
        ends = np.r_[0, np.cumsum(self.length[codes], dtype=np.int64)]
        return np.arange(ends[-1]) + np.repeat(self.first[codes] - ends[:-1], self.length[codes]), ends

    def _remember(self, words: list[str], lengths: np.ndarray, ids: np.ndarray) -> None:
        count, size = len(self.codes), len(ids)
        while len(self.first) < count + len(words):
            self.first, self.length = np.resize(self.first, 2 * len(self.first)), np.resize(self.length, 2 * len(self.length))
        while len(self.flat) < self.used + size:
            self.flat = np.resize(self.flat, 2 * len(self.flat))
        self.length[count : count + len(words)] = lengths
        self.first[count : count + len(words)] = self.used + np.cumsum(lengths) - lengths
        self.flat[self.used : self.used + size] = ids
        self.used += size
        self.codes.update(zip(words, range(count, count + len(words)), strict=True))

    def word_codes(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Places of the words in the memory, and the bounds of the texts among them."""
        if len(self.codes) > REMEMBERED_WORDS:
            self._forget()
        words: list[str] = []
        bounds = np.zeros(len(texts) + 1, np.int64)
        for i, text in enumerate(texts):
            words += words_of(text)
            bounds[i + 1] = len(words)
        codes = list(map(self.codes.get, words))
        if None in codes:
            self._learn(list({w for w, c in zip(words, codes, strict=True) if c is None}))
            codes = list(map(self.codes.__getitem__, words))
        return np.array(codes, np.int64), bounds

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and the bounds of the texts among them."""
        if not self.by_word:
            ids = self._ids(texts)
            bounds = np.r_[0, np.cumsum([len(x) for x in ids], dtype=np.int64)]
            return np.array([i for x in ids for i in x], np.uint32), bounds
        codes, bounds = self.word_codes(texts)
        places, ends = self._places(codes)
        return self.flat[places], ends[bounds]

    def counts(self, texts: list[str]) -> list[int]:
        return [len(x) for x in self._ids(texts)]


def _cut_at_blanks(spec: dict) -> bool:
    """Does this file fold white space away before it pairs symbols, and keep no state across it?"""
    steps = lambda part, kind: [x["type"] for x in (part or {}).get(kind, [part] if part else [])]
    folds = steps(spec.get("normalizer"), "normalizers") == ["NFC", "Replace", "Lowercase"]
    cuts = steps(spec.get("pre_tokenizer"), "pretokenizers") == ["Split", "ByteLevel"]
    if not (folds and cuts) or spec.get("truncation") or spec.get("padding"):
        return False
    fold, cut = spec["normalizer"]["normalizers"][1], spec["pre_tokenizer"]["pretokenizers"][0]
    plain = all(not (t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"]) for t in spec["added_tokens"])
    return (
        plain
        and fold["pattern"] == {"Regex": "\\s+"}
        and fold["content"] == " "
        and cut["behavior"] == "Removed"
        and cut["invert"]
        and cut["pattern"]["Regex"].endswith("|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+")
        and not spec["pre_tokenizer"]["pretokenizers"][1]["add_prefix_space"]
    )


def encoder(path: str) -> Encoder:
    """The worker's own encoder for this file, kept between tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def forget_words() -> None:
    """Give up the words the worker's encoders remember, where other work comes next."""
    for own in _ENCODERS.values():
        own._forget()
