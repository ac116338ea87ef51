import hashlib
import random

import numpy as np
import pytest

from glossmill.llm import rlbwt


def brute(rows, length):
    first = {}
    for d, t in rows:
        raw = (t or "").encode()
        for p in range(len(raw) - length + 1):
            if d is not None:
                s = raw[p : p + length]
                first[s] = min(first.get(s, d), d)
    out = []
    for d, t in rows:
        raw = (t or "").encode()
        gone = np.zeros(len(raw), bool)
        for p in range(len(raw) - length + 1):
            if d is not None and first[raw[p : p + length]] < d:
                gone[p : p + length] = True
        spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()) if len(gone) else 0
        out.append((d, len(raw), int(gone.sum()), spans, hashlib.sha256(bytes(b for b, g in zip(raw, gone) if not g)).hexdigest()))
    return sorted(out, key=str)


def texts(seed, n):
    r = random.Random(seed)
    words = ["".join(r.choice("abcdé") for _ in range(r.randrange(2, 9))) for _ in range(60)]
    make = lambda k: " ".join(r.choice(words) for _ in range(k))
    passages = [make(r.randrange(8, 40)) for _ in range(4)]
    rows = []
    for i in range(n):
        t = make(r.randrange(1, 60))
        for _ in range(r.randrange(3)):
            p = r.choice(passages)
            a = r.randrange(len(p))
            t += " " + p[a : a + r.randrange(20, 200)] + make(r.randrange(9))
        if i and r.random() < 0.2:
            t = rows[r.randrange(len(rows))][1]
        rows.append((i, t))
    return [(d, rows[i][1]) for i, d in enumerate(r.sample(range(n), n))]


def run(spark, rows, length=50):
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4).selectExpr("doc_id", "text", "1 AS key", "2 AS doc", "3 AS spans")
    return sorted((tuple(r) for r in rlbwt.dedup_digests(docs, length).collect()), key=str)


def test_equals_brute_force(spark):
    rows = texts(1, 60) + [(100, "ab" * 300), (101, "ab" * 200), (102, "x" * 500), (99, "x" * 400)]
    assert run(spark, rows) == brute(rows, 50)


def test_portions_and_flushes(spark, monkeypatch):
    monkeypatch.setattr(rlbwt, "PORTION", 300)
    monkeypatch.setattr(rlbwt, "FLUSH", 40)
    rows = texts(2, 50)
    assert run(spark, rows) == brute(rows, 50)


def test_nulls_empty_repeats(spark):
    long = "the same long passage that stands in both of these documents, word for word"
    rows = [(1, None), (2, ""), (3, long), (3, long + " again"), (4, long), (None, long), (4, long), (5, "é" * 40 + long)]
    assert run(spark, rows) == brute(rows, 50)
    assert run(spark, []) == []


@pytest.mark.parametrize("seed", range(4))
def test_matching_statistics(seed):
    r = random.Random(seed)
    make = lambda k: bytes(r.choice(b"abc") for _ in range(k))
    index_texts, queries = [make(r.randrange(1, 30)) for _ in range(8)] + [b"ababababababab"], [make(r.randrange(1, 40)) for _ in range(6)] + [b"", b"abababab", b"zaz"]
    owners, length = np.array([r.randrange(5) for _ in index_texts]), 8
    index = rlbwt.RunLengthIndex(index_texts, owners, length)
    got = {}
    for text, place, n, row in index.matching_statistics(queries):
        for t, p, k, least in zip(text, place, n, index.least_owner(row)):
            got[t, p] = k
            if k >= length:
                assert least == min(o for o, x in zip(owners, index_texts) if queries[t][p : p + length] in x)
    for t, q in enumerate(queries):
        for p in range(len(q)):
            best = max(n for n in range(len(q) - p + 1) if any(q[p : p + n] in x for x in index_texts))
            assert got[t, p] == best


def test_the_index_is_as_large_as_the_runs():
    r = random.Random(9)
    text = bytes(r.choice(b"abcdefgh") for _ in range(400))
    small, large = (rlbwt.RunLengthIndex([text] * k, np.arange(k), 50) for k in (2, 40))
    assert large.n == 20 * small.n and len(large.run_start) < 1.3 * len(small.run_start)
    kept = [x for k, x in vars(large).items() if isinstance(x, np.ndarray) and k not in ("text", "words", "room")]
    assert all(len(x) <= len(large.run_start) for x in kept) and len(large.least) <= 100


def test_each_content_is_streamed_against_earlier_ones(monkeypatch):
    r = random.Random(4)
    make = lambda: bytes(r.choice(b"ab") for _ in range(70))
    base = [make() for _ in range(3)]
    contents = [b[: r.randrange(50, 71)] if r.random() < 0.5 else b[r.randrange(0, 20) :] for b in base for _ in range(9)]
    groups, docs = np.repeat(np.arange(3), 9), np.array([r.randrange(8) for _ in contents])
    t, p, n = rlbwt.repeated_windows(contents, docs, groups)
    got = {(a, b + k) for a, b, m in zip(t.tolist(), p.tolist(), n.tolist()) for k in range(m)}
    want = {(i, p) for i, c in enumerate(contents) for p in range(len(c) - 49) if any(docs[j] < docs[i] and c[p : p + 50] in x for j, x in enumerate(contents))}
    assert got == want and want


def test_minimizers_in_every_document(spark, monkeypatch):
    monkeypatch.setattr(rlbwt, "HOT_LEAST", 3)
    r = random.Random(8)
    passage = "a passage that stands in every document, with other words around it each time"
    rows = [(i, f"{''.join(r.choice('abcdef ') for _ in range(40))}{passage}{''.join(r.choice('xyz ') for _ in range(40))}") for i in range(40)]
    assert len(rlbwt._hot(spark.createDataFrame(rows, "doc_id bigint, text string"), 50)) > 0
    assert run(spark, rows + texts(3, 20)) == brute(rows + texts(3, 20), 50)


@pytest.mark.parametrize("length", [21, 33, 50, 300, 400])
def test_lengths(spark, length):
    rows = texts(5, 30) + [(50, "ab" * 900), (51, "cd" + "ab" * 900), (52, texts(5, 30)[3][1] * 9), (53, texts(5, 30)[3][1] * 8)]
    assert run(spark, rows, length) == brute(rows, length)


def test_short_lengths_are_refused(spark):
    with pytest.raises(ValueError):
        run(spark, [(1, "a")], 20)


def test_other_columns_of_any_name_stay(spark):
    names = ["spans", "_spans", "_doc", "_key", "_of_doc", "_of_key", "_d", "_k", "doc", "key", "lo", "n", "h", "own"]
    docs = spark.createDataFrame([(1, "x" * 60), (2, "x" * 60 + "rest")], "doc_id bigint, text string").selectExpr("*", *(f"'{c}' AS `{c}`" for c in names))
    out = rlbwt.dedup_texts(docs)
    assert out.columns == docs.columns
    got = {r["doc_id"]: r.asDict() for r in out.collect()}
    assert got[2]["text"] == "rest" and all(got[2][c] == c for c in names)


def test_texts_keep_whole_characters(spark):
    same = "à" * 40
    docs = spark.createDataFrame([(1, same, "a"), (2, "b" + same + "c", "a"), (3, None, None)], "doc_id bigint, text string, lang string")
    got = {r["doc_id"]: r["text"] for r in rlbwt.dedup_texts(docs).collect()}
    assert got == {1: same, 2: "bc", 3: None}


def test_suffixes_and_run_mapping_equal_brute_force():
    for seed in range(60):
        r = random.Random(seed)
        owned = [bytes(r.choice(b"ab c") for _ in range(r.randrange(30))) for _ in range(r.randrange(1, 6))]
        index = rlbwt.RunLengthIndex(owned, np.arange(len(owned)), 8)
        suffixes = [(t[p:], i, p) for i, t in enumerate(owned) for p in range(len(t) + 1)]
        starts = np.cumsum([0] + [len(t) + 1 for t in owned])
        rows = [(t, i) for t, i, _ in sorted(suffixes)]
        order = np.array([starts[i] + p for _, i, p in sorted(suffixes)])
        assert np.array_equal(index._suffixes(index.text, index.room), order)
        asked = [bytes(r.choice(b"ab cd") for _ in range(r.randrange(1, 30))), owned[0][1:] + owned[-1]]
        for own, place, length, row in index.matching_statistics(asked):
            for t, p, n, at in zip(own.tolist(), place.tolist(), length.tolist(), row.tolist(), strict=True):
                wanted = asked[t][p:]
                assert n == max(k for k in range(len(wanted) + 1) if any(wanted[:k] in o for o in owned))
                assert rows[at][0][:n] == wanted[:n]
