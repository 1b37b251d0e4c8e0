"""AND / OR of keyword hits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sealdex.functions.terms import fold_query
from sealdex.operators.index import SealedIndex

# A word with at most this many postings may be broadcast to thin out the others.
FEW_POSTINGS = 200_000

_MASK_BITS = 62


def any_word(postings: DataFrame) -> DataFrame:
    """Distinct ids that have at least one of the words."""
    return postings.select("uid").distinct()


def all_words(postings: DataFrame, words: list[str]) -> DataFrame:
    """Distinct ids that have every one of ``words``.

    A bit per word makes this one partially combined aggregate on the id, with
    no separate pass to drop repeated (id, word) pairs.
    """
    if len(words) > _MASK_BITS:
        per_id = postings.groupBy("uid").agg(F.count_distinct("word").alias("n"))
        return per_id.where(F.col("n") == len(words)).select("uid")
    bit = F.lit(0).cast("bigint")
    for i, word in enumerate(words):
        bit = F.when(F.col("word") == word, F.lit(1 << i).cast("bigint")).otherwise(bit)
    per_id = postings.groupBy("uid").agg(F.bit_or(bit).alias("seen"))
    return per_id.where(F.col("seen") == (1 << len(words)) - 1).select("uid")


def find(index: SealedIndex, words, disjunction: bool = False) -> DataFrame:
    """Ids of the records matching the words: all of them, or any of them."""
    wanted = fold_query(words)
    found = index.find_words(wanted)
    counts = found.postings_per_word
    if disjunction:
        return any_word(index.postings(found))
    if not wanted or (counts is not None and len(counts) < len(wanted)):
        # An unknown word leaves nothing to intersect; the chain is not read.
        return index.postings(found).where(F.lit(False)).select("uid")
    if len(wanted) == 1:
        return any_word(index.postings(found))
    if counts is not None:
        rarest = min(wanted, key=lambda w: (counts[w], w))
        others = [w for w in wanted if w != rarest]
        if counts[rarest] <= FEW_POSTINGS:
            # The rare word's ids pick the blocks of the others, or at least
            # filter them where they are read: a frequent word is neither
            # shuffled nor aggregated.
            few = any_word(index.postings(found.only([rarest])))
            return all_words(index.postings_of(found.only(others), few), others)
    return all_words(index.postings(found), wanted)
