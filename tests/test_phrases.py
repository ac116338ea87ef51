"""Phrases against a loop over each text, on long texts, and with frequent words."""

import random
import re
import time

from pyspark.sql import functions as F

from glossmill.operators import phrases as P


def by_loop(text, lexicon):
    words = [(m.start(), m[0]) for m in re.finditer(r"\S+", text or "")]
    out, i = [], 0
    while i < len(words):
        best = None
        for n in range(1, min(5, len(words) - i) + 1):
            start, last = words[i][0], words[i + n - 1]
            span = text[start : last[0] + len(last[1])]
            span = re.sub(r"[.,;:!?)\]]+$", "", span)
            for surface, label in sorted(lexicon, key=lambda x: x[1]):
                if re.sub(r"\s+", " ", span.lower()) == surface.lower() and (best is None or n > best[0]):
                    best = n, start, start + len(span), span, label
        if best:
            out.append(best[1:])
            i += best[0]
        else:
            i += 1
    return out


def test_equals_a_loop(spark):
    rng = random.Random(2)
    vocabulary = ["the", "The", "of", "big", "cat,", "cat", "house.", "x", "(y)"]
    texts = [(i % 40, "".join(rng.choice(vocabulary) + rng.choice([" ", "  ", "\n"]) for _ in range(rng.randrange(0, 30)))) for i in range(60)] + [(50, None), (51, ""), (52, " ... ")]
    lexicon = [("the big", "A"), ("of the big cat", "B"), ("cat", "C"), ("cat", "B"), ("big cat house", "D"), ("House", "E"), ("of of", "F"), ("the", "G"), (" ", "no"), ("(y)", "no"), ("(y", "H")]
    df = spark.createDataFrame(texts, "id int, text string").repartition(5)
    got = sorted(tuple(r) for r in P.annotate(df, spark.createDataFrame(lexicon, "surface string, label string")).collect())
    assert got == sorted((i, *x) for i, t in texts for x in by_loop(t, [e for e in lexicon if e[0].strip()]))


def test_a_text_of_many_words(spark):
    """100,000 words, of which half are entries: no row carries the text, and the walk is linear."""
    text = " ".join(f"w{i % 50} the" for i in range(50_000))
    df = spark.createDataFrame([(1, text)], "id int, text string")
    lexicon = spark.createDataFrame([("the", "ART"), ("w1 the w2", "L"), ("w7", "N")], "surface string, label string")
    began = time.time()
    rows = P.annotate(df, lexicon)
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    got = rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()
    assert {r["label"]: r["n"] for r in got} == {"ART": 49_000, "L": 1000, "N": 1000}
    assert time.time() - began < 60 and "collect_list(_piece" in plan


def test_code_index_of_a_long_row(spark):
    words = [f"w{i % 50}" if i % 2 else "of" for i in range(60_000)]
    rows = spark.createDataFrame([(1, words, ["N"] * len(words)), (2, ["of", None, "of"], ["V", "N", None])], "id int, words array<string>, tags array<string>")
    entries = spark.createDataFrame([(["of"], "A"), (["of", "w1"], "B"), ([], "none")], "words array<string>, code string")
    got = P.code_index(rows, entries).groupBy("id", "code").agg(F.count(F.lit(1)).alias("n")).collect()
    assert {(r["id"], r["code"]): r["n"] for r in got} == {(1, "A"): 28_800, (1, "B"): 1_200, (2, "A"): 1}


def test_words_are_not_shuffled_to_a_small_lexicon(spark, monkeypatch):
    df = spark.createDataFrame([(1, "the big cat of the house"), (2, "the, big")], "id int, text string")
    lexicon = spark.createDataFrame([("the", "A"), ("the big", "B"), ("of the house", "C")], "surface string, label string")

    def found():
        rows = P.annotate(df, lexicon)
        shuffled = re.findall(r"hashpartitioning\((_first|_phrase)#\d+, ", rows._jdf.queryExecution().executedPlan().toString())
        return sorted(tuple(r) for r in rows.collect()), shuffled.count("_first") > 1 or "SortMergeJoin" in rows._jdf.queryExecution().executedPlan().toString()

    want = [(1, 0, 7, "the big", "B"), (1, 12, 24, "of the house", "C"), (2, 0, 3, "the", "A")]
    monkeypatch.setattr(P, "BROADCAST_ENTRIES", 0)
    with_joins, _ = found()
    monkeypatch.setattr(P, "BROADCAST_ENTRIES", 10)
    sent, shuffles = found()
    assert with_joins == sent == want and not shuffles
