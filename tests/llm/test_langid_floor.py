"""The pipeline's language stage decides by the cosine with the learned prototypes."""

import random

import corpus_pipeline as pipeline
from glossmill.llm import langid

SF = "/root/testdata/sf0.01"


def test_gibberish_goes_and_clean_documents_stay(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    r = random.Random(1)
    noise = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(500)), "x" * 2000, " ".join("".join(r.choice("bcdfgjkqvwxz") for _ in range(6)) for _ in range(80))]
    odd = spark.createDataFrame([(10**9 + i, t, None, None, len(t)) for i, t in enumerate(noise)], docs.schema)
    kept = {x["doc_id"] for x in pipeline.language_id(spark, docs.union(odd), SF).select("doc_id").collect()}
    assert not kept & {10**9 + i for i in range(len(noise))}
    own = {x["doc_id"] for x in docs.select("doc_id").collect()}
    assert len(own & kept) >= 0.999 * len(own)


def test_the_floor_is_calibrated_on_the_training_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    profiles = langid.fit(docs)
    least = langid.least_cosine(docs, profiles)
    assert 0 < least <= langid.CHANCE / langid.DIMENSIONS**0.5
    chosen = [x["text"] for x in langid.training(docs, langid.TRAINING_DOCS).collect() if langid.judgeable(x["text"])]
    assert sum(profiles.predict(t)[1] < least for t in chosen) <= len(chosen) // 1000


def test_without_a_language_every_lettered_document_stays(spark):
    rows = [(1, "some text", None, None, 9), (2, "123", None, None, 3), (3, None, None, None, 0), (4, "日本", None, None, 2)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    assert {x["doc_id"] for x in pipeline.language_id(spark, docs, SF).collect()} == {1, 4}


def test_the_floor_counts_every_labelled_document(spark, monkeypatch):
    """A bound on what prototypes are learned from is none on the floor: it equals a plain sort of all cosines."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    profiles = langid.fit(docs)
    monkeypatch.setattr(langid, "CHANCE", 1e6)  # so that no cosine is cut off
    monkeypatch.setattr(langid, "TRAINING_DOCS", 10)
    rows = docs.where(docs.lang.isNotNull() & ~langid.held_out(docs.doc_id)).collect()
    own = sorted(float(profiles.cosines(langid.bundle(r["text"]))[profiles.languages.index(r["lang"])]) for r in rows if langid.judgeable(r["text"]))
    assert langid.least_cosine(docs, profiles) == max(0.0, own[len(own) // 1000])


def test_the_value_at_a_place(spark):
    values = [0.5, -0.25, 0.5, 0.125, 1e-9, 0.0, 0.5, 2e-9, 0.75]
    rows = spark.createDataFrame([(x,) for x in values], "x double")
    assert [langid.smallest(rows, k, 9.0) for k in range(10)] == [*sorted(values), 9.0]
