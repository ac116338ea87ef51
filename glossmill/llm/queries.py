"""The registered queries of this subpackage. Each takes (spark, sf_dir) and covers its whole table.

They are applications of the operators: what they return runs when its rows are asked for, so they bound the Arrow
batches of the session they are given (common.small_batches). The operators themselves leave settings as they are.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, jaccard, langid, merkle, oracles, packing, quality, rlbwt, rules, search, urls, warc
from .common import shared_dir, small_batches
from .common import table as stored_table


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return stored_table(small_batches(spark), sf_dir, name)


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "\\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id bigint, turn bigint, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat.chat_digests(chat.format_chats(rows))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.fit(docs))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.bpe_digests(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return rules.judge(docs, rules.learn(docs, table(spark, sf_dir, "labels")))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    return packing.pack_documents(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)


def op6_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return search.top_k(docs, docs.where("doc_id % 100 = 0"), k=10)


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.groups(table(spark, sf_dir, "documents"), jaccard.Similarity(n=3, num=90, den=100))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rlbwt.dedup_digests(table(spark, sf_dir, "documents"))


#: Fixed values of the contract.
URL_RULES = [urls.Rule("block", "net/"), urls.Rule("allow", "example.net/en/"), urls.Rule("block", "example.com/de/"), urls.Rule("allow", "org/fr/")]


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.filter_urls(table(spark, sf_dir, "pages"), URL_RULES)


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    changed = {"text": F.translate("text", urls.UPPER, urls.LOWER)}
    where = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    return merkle.verify(merkle.manifest(docs, ["doc_id", "source", "lang", "n_chars", "text"], "lang", "doc_id", changed, where), "doc_id")


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pages has no capture times: page_id counts as the second of capture."""
    pages = table(spark, sf_dir, "pages")
    second = F.expr("timestamp_ntz '2000-01-01 00:00:00' + make_dt_interval(0, 0, 0, pmod(page_id, 1000000000))").cast("string")
    path = shared_dir(spark)
    warc.write_archives(pages.withColumn("captured", F.concat(F.translate(second, " ", "T"), F.lit("Z"))), path)
    index = warc.capture_index(spark, path)
    kind = pages.schema["page_id"].dataType
    return index.select(F.col("page_id").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_chat_formatting, op2_language_id, op3_byte_bpe, op4_quality_rules, op5_packing, op6_topk_search, op7_jaccard_join, op8_suffix_dedup, op9_url_filters, op10_quality_classifier, op11_merkle_manifest, op12_warc)
}
#: The rest learn, hash or cut freely; tests/llm holds them against brute force.
ORACLES: dict[str, str] = oracles.ORACLES
