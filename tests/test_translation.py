"""BLEU against scores that were worked out by hand and against a loop, and linear JSON blocks."""

import json
import math
import random
import re
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from glossmill.functions import texts as A
from glossmill.operators import translation as B


def by_hand(pairs):
    hits, totals, c, r = [0] * 4, [0] * 4, 0, 0
    for a, b in pairs:
        c, r = c + len(a), r + len(b)
        for n in range(4):
            x, y = (Counter(tuple(w[i : i + n + 1]) for i in range(len(w) - n)) for w in (a, b))
            hits[n] += sum((x & y).values())
            totals[n] += sum(x.values())
    if not hits[0] or not totals[3]:
        return 0.0
    smooth, total = 1, 0.0
    for h, t in zip(hits, totals):
        if not h:
            smooth *= 2
        total += math.log(h / t if h else 1 / (smooth * t))
    return 100 * math.exp(total / 4) * (math.exp(1 - r / c) if c < r else 1)


def test_scores(spark):
    rng = random.Random(1)
    rows = [(i, i % 3, [rng.choice("abcd") for _ in range(rng.randrange(0, 9))], [rng.choice("abcd") for _ in range(rng.randrange(0, 9))]) for i in range(200)]
    df = spark.createDataFrame(rows, "i int, g int, c array<string>, r array<string>").repartition(5)
    counts = B.ngram_counts(df, ["i", "g"], F.col("c"), F.col("r"))
    got = {r["i"]: r["bleu"] for r in B.score(counts).collect()}
    assert got.keys() == set(range(200)) and all(got[i] == pytest.approx(by_hand([(c, r)])) for i, _, c, r in rows)
    for r in B.score(B.summed(counts, "g")).collect():
        assert r["bleu"] == pytest.approx(by_hand([(x[2], x[3]) for x in rows if x[1] == r["g"]]))
    assert B.score(B.summed(counts)).collect()[0]["bleu"] == pytest.approx(by_hand([x[2:] for x in rows]))


def test_known_scores(spark):
    """2 of 3 bigrams and so on, written out; the last is what the usual tool prints for this pair."""
    rows = [(1, "the cat sat on the mat", "the cat sat on the mat"), (2, "the cat is on the mat", "the cat sat on the mat"), (3, "", "x"), (4, None, None), (5, "a b c", "a b c")]
    df = spark.createDataFrame(rows, "i int, c string, r string")
    got = {r["i"]: r["bleu"] for r in B.score(B.ngram_counts(df, ["i"], B.words_13a(F.col("c")), B.words_13a(F.col("r")))).collect()}
    assert got[1] == pytest.approx(100) and got[3] == got[4] == got[5] == 0
    assert got[2] == pytest.approx(100 * ((5 / 6) * (3 / 5) * (1 / 4) * (1 / (2 * 3))) ** 0.25)


@pytest.mark.parametrize(
    "text,want",
    [
        ("Hello, world.", ["Hello", ",", "world", "."]),
        ("1,000.5 costs 5-6 (well-known)", ["1,000.5", "costs", "5", "-", "6", "(", "well-known", ")"]),
        ("a &amp; b &lt;x&gt; &quot;q&quot;", ["a", "&", "b", "<", "x", ">", '"', "q", '"']),
        ("soft-\nhyphen\nline", ["softhyphen", "line"]),
        ("", []),
        (None, []),
    ],
)
def test_words_13a(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(B.words_13a(F.col("t")).alias("x")).collect()[0]["x"] == want


# --- JSON blocks ----------------------------------------------------------------------------------------------------------
@pytest.mark.parametrize(
    "text,want",
    [
        ('x {"a": {"b": 1}} y {', '{"a": {"b": 1}}'),
        ('{ {"a": 1} {"b": 2}', '{"a": 1}'),
        ('{ "open {"k": 1}', '{ "open {"k": 1}'),
        ('{"a": "}\\"}"} t', '{"a": "}\\"}"}'),
        ('{"a": 1, "b: 2}', '{"a": 1, "b: 2}'),
        ('} } {"x": "{"}', '{"x": "{"}'),
        ('{{{{"a": 1}}', '{{"a": 1}}'),
        ('\\{"a": "\\\\"}', '{"a": "\\\\"}'),
        ("{", None),
        ("", None),
    ],
)
def test_first_block(text, want):
    assert A.first_block(text) == want


def slow_block(text):
    """The leftmost bracket from which brackets, but for those in closed strings, come to nothing; each start is tried anew."""
    for start, c in enumerate(text):
        depth = 0
        for m in re.finditer(r'"(?:[^"\\]|\\.)*"|[{}]', text[start:]) if c == "{" else ():
            depth += (m[0] == "{") - (m[0] == "}")
            if not depth and m[0] == "}":
                return text[start : start + m.end()]
    return None


def test_blocks_equal_a_slow_version():
    rng = random.Random(8)
    for _ in range(5000):
        text = "".join(rng.choice(["{", "}", '"a"', '"}"', '"}\\""', "x", " "]) for _ in range(rng.randrange(0, 14)))
        assert A.first_block(text) == slow_block(text), text


@pytest.mark.parametrize("text", ["{" * 1_000_000, "}" * 1_000_000, '{"' * 500_000, '{"' + '\\"' * 500_000, "{}" + "{" * 1_000_000, "{" + "[" * 1_000_000, "{" + "{}" * 500_000])
def test_a_megabyte_takes_a_second(text):
    began = time.process_time()
    A.first_block(text)
    A.robust_json(text)
    assert time.process_time() - began < 3


def test_literals():
    assert json.loads(A.robust_json('{"a": TRUE, "b": "TRUE \\" None", "c": [None, False]}')) == {"a": True, "b": 'TRUE " None', "c": [None, False]}
