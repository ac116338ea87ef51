"""Every operator and stage on tables with nulls, empty and very long texts, repeated rows, clashing names, and no rows."""

import corpus_pipeline
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from glossmill.llm import bpe, chat, jaccard, langid, packing, quality, rlbwt, rules, search, urls
from glossmill.llm.queries import URL_RULES

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
LONG = " ".join(f"word{i % 7919} and{i % 31}" for i in range(380_000))
ROWS = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, " \t\n", None, None, 3), (4, "twice the same text, word for word, with more than fifty bytes in it", "en", "s", 66), (4, "twice the same text, word for word, with more than fifty bytes in it", "en", "s", 66), (None, "no id but a text", "en", None, 16), (5, LONG, "en", "s", len(LONG)), (6, "nul \0 and \U00010ee7 <|endoftext|>", "en", "s", 30), (100, "twice the same text, word for word, with more than fifty bytes in it", "de", None, 66)]
NAMES = "id h f key lo n spans own bucket payload kind at w t words line grp block role s u v shard x term rank score held_out predicted lang_pred kept bad quality grow chunk run host path rule verdict tokens start length sequence_id ids n_tokens decoded _doc _key component component_id n_shingles".split()


@pytest.fixture(scope="module")
def learned(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    return langid.fit(docs), quality.fit(docs, labels), rules.learn(docs, labels)


def operators(learned):
    profiles, net, decisions = learned
    return {
        "op2": lambda d: langid.identify(d, profiles),
        "op3": lambda d: bpe.bpe_digests(d, P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN),
        "op4": lambda d: rules.judge(d, decisions),
        "op5": lambda d: packing.pack_documents(d, P.path("byte_bpe_50k.json"), P.PATTERN).groupBy("doc_id", "doc_tokens").agg(F.sum("length").alias("n")),
        "op7": lambda d: jaccard.groups(d),
        "op8": lambda d: rlbwt.dedup_digests(d),
        "op10": lambda d: quality.score(d, net),
    }


def test_operators_on_odd_rows(spark, learned):
    odd = spark.createDataFrame(ROWS, DOCS).repartition(3).withColumns({c: F.lit("clash") for c in NAMES})
    ids = sorted((str(r[0]) for r in ROWS))
    for name, run in operators(learned).items():
        got = run(odd).collect()
        if name == "op5":
            assert {r["doc_id"] for r in got} == {r[0] for r in ROWS} and all(r["n"] % r["doc_tokens"] == 0 for r in got)
        else:
            assert sorted(str(r["doc_id"]) for r in got) == ids, name
            pair = [tuple(r) for r in got if r["doc_id"] == 4]
            assert len(pair) == 2 and pair[0] == pair[1], name
        assert run(odd.limit(0)).collect() == [], name


def test_search_on_odd_rows(spark):
    odd = spark.createDataFrame(ROWS, DOCS).withColumns({c: F.lit("clash") for c in NAMES})
    got = [(r["query_id"], r["rank"], r["doc_id"]) for r in search.top_k(odd, odd.where("doc_id IN (1, 2, 3, 5, 100)"), 3).collect()]
    assert {q for q, _, _ in got} == {5, 100} and [x for x in sorted(got) if x[0] == 100] == [(100, 1, 4), (100, 2, 4), (100, 3, 100)]


def test_chats_on_odd_rows(spark):
    schema = "conv_id bigint, turn bigint, role string, text string"
    rows = [(1, 0, "user", LONG), (1, 1, "assistant", LONG), (2, 0, "user", "x"), (2, 0, "user", "x"), (3, None, None, None), (None, 1, "assistant", "")]
    odd = spark.createDataFrame(rows, schema).withColumns({c: F.lit("clash") for c in [*NAMES, "segment", "loss", "in_order"] if c != "role"})
    got = {r["conv_id"]: r for r in chat.chat_digests(chat.format_chats(odd)).collect()}
    assert got.keys() == {1, 2, 3, None} and got[1]["loss_chars"] == len(LONG) and got[2]["n_turns"] == 2 and not got[2]["valid_order"] and got[None]["loss_chars"] == 0
    assert chat.chat_digests(chat.format_chats(odd.limit(0))).collect() == []


def test_urls_on_odd_rows(spark):
    rows = [(1, None, None), (2, "", ""), (3, "http://a.net/" + "spamfarm" * 20_000, "<p>spam farm"), (4, "http://b.com/x", None), (4, "http://b.com/x", None), (None, "http://c.org/fr/", "<p>")]
    odd = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumns({c: F.lit("clash") for c in NAMES if c != "key"})
    got = urls.filter_urls(odd, URL_RULES).collect()
    assert sorted(str(r["page_id"]) for r in got) == sorted(str(r[0]) for r in rows) and {r["verdict"] for r in got if r["page_id"] == 3} == {"block"}
    assert urls.filter_urls(odd.limit(0), URL_RULES).collect() == []


def test_stages_on_odd_rows(spark):
    sf = "/root/testdata/sf0.001"
    odd = spark.createDataFrame(ROWS, DOCS).repartition(2).withColumns({c: F.lit("clash") for c in NAMES})
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    both = docs.withColumns({c: F.lit("clash") for c in NAMES}).unionByName(odd)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, both, sf)
        if name != "packing":
            assert out.columns == both.columns, name
            if name in ("jaccard_join", "suffix_dedup"):
                assert out.where("doc_id IS NULL").count() == 1, name
            assert out.where("id <> 'clash' OR spans <> 'clash'").count() == 0, name
        none = stage(spark, both.limit(0), sf)
        assert none.collect() == [] and (name == "packing" or none.columns == both.columns), name
