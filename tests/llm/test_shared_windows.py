"""Contents that share no window with another need no index; all others are for the index."""

import random

import numpy as np

from glossmill.llm import rlbwt


def brute(contents, groups, length):
    windows = [{c[i : i + length] for i in range(len(c) - length + 1)} for c in contents]
    return [i for i in range(len(contents)) if any(j != i and groups[j] == groups[i] and windows[i] & windows[j] for j in range(len(contents)))]


def test_equals_brute_force(monkeypatch):
    rng = random.Random(6)
    for size in (1 << 20, 64):
        monkeypatch.setattr(rlbwt, "INDEXED", size)
        for _ in range(40):
            contents = [bytes(rng.choice(b"ab") for _ in range(rng.randrange(0, 40))) for _ in range(rng.randrange(1, 30))]
            groups = np.array([rng.randrange(4) - 2 for _ in contents], dtype=np.int64)
            got = rlbwt.sharing(contents, groups, 21)
            assert got.tolist() == brute(contents, groups, 21)


def test_a_window_that_repeats_within_one_content_is_not_shared():
    assert rlbwt.sharing([b"a" * 90, b"b" * 90], np.zeros(2, np.int64), 50).tolist() == []
    assert rlbwt.sharing([b"a" * 90, b"xa" * 20 + b"a" * 50], np.zeros(2, np.int64), 50).tolist() == [0, 1]
    assert rlbwt.sharing([b"", b"short"], np.zeros(2, np.int64), 50).tolist() == []


def _around(k):
    """Contents of as many documents that have a passage of 60 bytes in common, in other surroundings."""
    r = random.Random(k)
    passage = bytes(r.choice(b"abcd") for _ in range(60))
    return [bytes([128 + i]) * 12 + passage + bytes([128 + i]) * 12 for i in range(k)]


def test_the_index_holds_the_first_of_a_shared_passage_once(monkeypatch):
    held = []

    class Seen(rlbwt.RunLengthIndex):
        def __init__(self, texts, owners, length):
            held.append(len(texts))
            super().__init__(texts, owners, length)

    monkeypatch.setattr(rlbwt, "RunLengthIndex", Seen)
    t, p, n = rlbwt.repeated_windows(_around(64), np.arange(64), np.zeros(64, np.int64))
    assert held == [1]
    assert (t.tolist(), set(p.tolist()), set(n.tolist())) == (list(range(1, 64)), {12}, {11})


def test_windows_of_one_hash_are_told_apart_by_the_index(monkeypatch):
    contents = [*_around(5), *_around(7), b"q" * 70]
    docs, groups = np.array([3, 1, 2, 0, 4, 9, 8, 8, 7, 6, 5, 9, 0]), np.zeros(13, np.int64)
    want = [x.tolist() for x in rlbwt.repeated_windows(contents, docs, groups)]
    monkeypatch.setattr(rlbwt, "mix", lambda x: np.zeros_like(x))
    assert [x.tolist() for x in rlbwt.repeated_windows(contents, docs, groups)] == want and want[0]


def test_texts_cut_together_have_the_fragments_of_each_alone(monkeypatch):
    r = random.Random(3)
    texts = [bytes(r.choice(b"abc ") for _ in range(n)) for n in (0, 49, 50, 700, 3, 120, 299, 300, 301, 0, 90)]
    for portion in (300, 1 << 15, 1 << 17):
        monkeypatch.setattr(rlbwt, "PORTION", portion)
        ends = np.cumsum([len(x) for x in texts])
        got = list(zip(*(x.tolist() for x in rlbwt.fragments(np.frombuffer(b"".join(texts), np.uint8), ends=ends)), strict=True))
        want = [(h, f, lo + end - len(x), n) for x, end in zip(texts, ends.tolist(), strict=True) for h, f, lo, n in zip(*(y.tolist() for y in rlbwt.fragments(np.frombuffer(x, np.uint8))), strict=True)]
        assert got == want and sum(x[3] for x in got) == sum(max(0, len(x) - 49) for x in texts)
