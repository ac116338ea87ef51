"""Texts of one very long run of blanks, line feeds or letters, through Spark: ids are the libraries' own."""

import resource
import zlib

import corpus_pipeline
import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from glossmill.llm import bpe, packing

RUNS = {1: " " * 2_000_000, 2: "a" + "\n" * 2_000_000 + "b", 3: "x y" + " \t" * 1_000_000 + "z", 4: "ab" * 400_000, 5: "one two " * 150_000 + " " * 1_200_000 + "end"}


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(k, v, "en", "s", len(v)) for k, v in RUNS.items()], "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(3)


@pytest.fixture(scope="module")
def wanted():
    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    return {k: np.array([*tok.encode(v, add_special_tokens=False).ids, 0], "<u4") for k, v in RUNS.items()}


@pytest.mark.parametrize("stage", [False, True])
def test_packing_gives_the_tokenizers_ids(spark, docs, wanted, stage):
    if stage:
        got = dict(corpus_pipeline.STAGES)["packing"](spark, docs, "").collect()
    else:
        got = packing.pack_documents(docs, P.path("byte_bpe_50k.json"), P.PATTERN).collect()
    for k, ids in wanted.items():
        own = sorted((r for r in got if r["doc_id"] == k), key=lambda r: r["start"])
        assert sum(r["length"] for r in own) == len(ids) == own[0]["doc_tokens"]
        assert all(r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes()) for r in own)


def test_bpe_is_read_back(docs):
    got = {r["doc_id"]: (r["n_tokens"], bytes(r["decoded"])) for r in bpe.bpe_roundtrip(docs, P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN).collect()}
    assert {k: v[1].decode() for k, v in got.items()} == RUNS and all(0 < v[0] <= len(RUNS[k]) for k, v in got.items())


def test_one_word_of_millions_of_letters_in_bounded_memory():
    one = bpe.loaded(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
    word = bytes(b"abcdefgh"[i * i % 8] for i in range(3_000_000))
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    ids = one.merge(word)
    assert b"".join(one.entry[i] for i in ids) == word
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 900_000  # kB


def test_long_words_are_merged_as_short_ones(monkeypatch):
    one = bpe.loaded(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
    words = [b"internationalization", "größenwahnsinnig".encode(), b"aaaaaaaaaaaaa", b"x"]
    want = [one.merge(w) for w in words]
    monkeypatch.setattr(bpe, "LONG_PIECE", 0)
    assert [one.merge(w) for w in words] == want
