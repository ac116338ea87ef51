"""A corpus pipeline of five stages: quality classifier, language ID, near-duplicates, repeated passages, packing.

Each stage takes (spark, docs, sf_dir), works on all rows that the one before kept, and returns a DataFrame; all but
the last return the columns of documents. run() writes each stage's rows to the shared folder and reads them again.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossmill.llm import jaccard, langid, packing, quality, rlbwt
from glossmill.llm.common import drop, small_batches, store, table

#: A document goes if its probability of being good is below this.
LEAST_QUALITY = 0.5


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learn from the labels table (rows outside the held-out quarter) and drop what scores below LEAST_QUALITY."""
    small_batches(spark)
    return quality.keep_good(docs, quality.fit(docs, table(spark, sf_dir, "labels")), LEAST_QUALITY)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a letter, and those that are no nearer to a learned language than chance."""
    small_batches(spark)
    profiles = langid.fit(docs)
    return langid.keep_identified(docs, profiles, langid.least_cosine(docs, profiles))


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that 5-word shingles link at a similarity of 0.8 or more, keep the one with the smallest doc_id."""
    small_batches(spark)
    return jaccard.keep_first(docs, jaccard.Similarity(n=5, num=8, den=10))


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut strings of 50 bytes that an earlier document has; n_chars follows the text."""
    small_batches(spark)
    out = rlbwt.dedup_texts(docs)
    if "n_chars" in out.columns:
        out = out.withColumn("n_chars", F.length("text").cast(out.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack the ids of all texts into sequences of up to 1024 tokens: a row per piece."""
    small_batches(spark)
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("language_id", language_id),
    ("jaccard_join", jaccard_join),
    ("suffix_dedup", suffix_dedup),
    ("packing", packing_stage),
]
#: The stages learn, hash and tokenize: SQL can't express them. tests/llm/test_pipeline.py holds each against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    read = None
    for name, stage in STAGES:
        out = stage(spark, docs, sf_dir)
        if name == STAGES[-1][0]:
            return out
        docs = store(out)
        if read is not None:
            drop(read)  # no later stage reads what came before the one before it
        read = docs
