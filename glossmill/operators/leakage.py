"""Passages of evaluation texts inside training texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.structure import let

#: Held passages are broadcast up to this many (about 100 bytes each); beyond that both sides are shuffled by a hash.
BROADCAST_PASSAGES = 500_000
WORDS = r"([\p{L}\p{N}]+)"


def passages(text: Column, words: int) -> Column:
    """The distinct runs of `words` words of a text, lower-cased, without marks; none if it has fewer."""
    found = F.regexp_extract_all(F.lower(text), F.lit(WORDS), F.lit(1))

    def runs(w: Column) -> Column:
        starts = F.when(F.size(w) >= words, F.sequence(F.lit(1), F.size(w) - (words - 1))).otherwise(F.array().cast("array<int>"))
        return F.array_distinct(F.transform(starts, lambda i: F.array_join(F.slice(w, i, F.lit(words)), " ")))

    return let(found, runs)


def leaking(texts: DataFrame, key: str, held: DataFrame, words: int = 13, text: str = "text", held_text: str = "text") -> DataFrame:
    """The distinct keys of texts that share a run of `words` words with a held text; null texts share none.

    Texts are taken apart where they lie. Few held passages are sent to every task; many are met by a semi-join on a
    hash of the passage, which the passages themselves confirm. A frequent passage has one row on the held side.
    """
    known = held.select(F.explode(passages(F.col(held_text), words)).alias("_passage")).distinct()
    own = texts.where(F.col(text).isNotNull()).select(key, F.explode(passages(F.col(text), words)).alias("_passage"))
    if known.limit(BROADCAST_PASSAGES + 1).count() <= BROADCAST_PASSAGES:
        return own.join(F.broadcast(known), "_passage", "left_semi").select(key).distinct()
    hashed = lambda df: df.withColumn("_hash", F.xxhash64("_passage"))
    return hashed(own).join(hashed(known), ["_hash", "_passage"], "left_semi").select(key).distinct()
