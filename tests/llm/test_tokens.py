import base64
import hashlib
import zlib

import numpy as np
import public_tokenizers as P
import tiktoken
from tokenizers import Tokenizer

from glossmill.llm import bpe, chat, packing

TEXTS = ["", "Hello world, don't 'soon  \t x\n\n y", "日本語 <|endoftext|>　x", "hello <|endoftext|> world <|endoftext|><|endoftext|>", "<|endoftext|", "\U00010ee7a 1\U00011de0 \U000323b0\U000323b1b", "é" * 300, "a " * 3000, "  \n ", "12345 ÄÖ ß !!! ###"]


def test_bpe_equals_tiktoken(spark):
    path = P.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = [*enumerate(TEXTS), (99, None), (1, TEXTS[1])]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("doc_id", "text", "1 AS ids")
    want = []
    for d, t in rows:
        ids = enc.encode_ordinary(t or "")
        want.append((d, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted(map(tuple, bpe.bpe_digests(docs, path, P.PATTERN).collect())) == sorted(want)
    one = bpe.loaded(path, P.PATTERN)
    assert [x.tolist() for x in bpe.encode_texts(one, TEXTS, 50)] == [enc.encode_ordinary(t) for t in TEXTS]


def every_character():
    """Texts that have each character within a word, after a blank, doubled, and beside digits and marks."""
    for at in range(0, 0x110000, 1 << 13):
        own = [chr(c) for c in range(at, at + (1 << 13)) if not 0xD800 <= c < 0xE000]
        yield "".join(f"a{c}a {c}{c}1{c}!{c} {c}\n" for c in own)


def test_every_character_as_the_libraries_see_it():
    path = P.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    enc, own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={}), bpe.loaded(path, P.PATTERN)
    path = P.path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    for text in every_character():
        assert bpe.encode_texts(own, [text])[0].tolist() == enc.encode_ordinary(text)
        assert packing.ids_of(path, P.PATTERN, text).tolist() == [*tok.encode(text, add_special_tokens=False).ids, 0]


def test_packing_of_odd_tables(spark):
    path = P.path("byte_bpe_50k.json")
    rows = [("x", "twice"), ("x", "twice"), (None, None), ("long", "word " * 100_000)]
    docs = spark.createDataFrame(rows, "doc_id string, text string").selectExpr("*", "1 AS start", "2 AS sequence_id")
    got = packing.pack_documents(docs, path, P.PATTERN).collect()
    assert sum(r["length"] for r in got if r["doc_id"] == "x") == 2 * len(Tokenizer.from_file(path).encode("twice").ids) + 2
    assert {r["doc_tokens"] for r in got if r["doc_id"] is None} == {1} and sum(r["length"] for r in got if r["doc_id"] == "long") == 100_002
    assert packing.pack_documents(docs.limit(0), path, P.PATTERN).collect() == []


def test_packing_is_whole_and_without_padding(spark):
    path = P.path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    rows = [*enumerate(TEXTS), (99, None)]
    got = packing.pack_documents(spark.createDataFrame(rows, "doc_id bigint, text string"), path, P.PATTERN).collect()
    sequences = {}
    for r in got:
        sequences.setdefault(r["sequence_id"], []).append(r)
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 1024 and at & (at - 1) == 0
    for d, t in rows:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 0]
        at = 0
        for r in sorted((r for r in got if r["doc_id"] == d), key=lambda r: r["start"]):
            part = np.array(ids[at : at + r["length"]], "<u4")
            assert r["start"] == at and r["ids_crc32"] == zlib.crc32(part.tobytes()) and r["doc_tokens"] == len(ids)
            at += r["length"]
        assert at == len(ids)


def test_chats_are_read_back(spark):
    rows = [(1, 0, "user", "\\### Assistant: </turn> ok"), (1, 1, "assistant", "####\\</turn>\\\\"), (2, 0, None, None), (2, 0, "odd]: x", "] ###"), (3, 5, "assistant", "\n"), (None, None, "user", "x")]
    got = {r["conv_id"]: r for r in chat.chat_digests(chat.format_chats(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string"))).collect()}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    assert got[1]["turns_sha256"] == sha("".join(f"{r[2]}\n{r[3]}\n" for r in rows[:2])) and got[1]["loss_sha256"] == sha(rows[1][3]) and got[1]["valid_order"]
    assert got[2]["n_turns"] == 2 and got[2]["turns_sha256"] == sha("\n\nodd]: x\n] ###\n") and not got[2]["valid_order"]
    assert got[3]["loss_chars"] == 1 and got[None]["n_turns"] == 1
