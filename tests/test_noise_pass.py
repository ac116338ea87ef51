"""Several noises in one pass, and phrases of a small lexicon without a row for each word."""

import random

import pytest
from pyspark.sql import functions as F
from test_phrases import by_loop

from glossmill.operators import noise as N
from glossmill.operators import phrases as P
from glossmill.plans import registry


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_sentences_are_cut_once_for_all_noises(spark):
    out = plan(registry.queries()["noise_dispatch"](spark, "/root/testdata/sf0.001"))
    assert out.count("(?<=[.!?])") == 1


def test_several_noises_are_those_of_single_ones(spark):
    rows = spark.createDataFrame([(i, [f"The cat {i} of it.", "And so, the end!", "No more to say here."][: i % 4]) for i in range(40)], "k int, s array<string>").withColumn("r", F.transform("s", lambda x: F.array(F.upper(x))))
    lexicon = spark.createDataFrame([("the", "a"), ("cat", "pet")], "phrase string, synonym string")
    specs = ["rewrite@mono-50", "rewrite@mask-50", "none", "multi-40", "rewrite-50", "resent-50", "mask-30"]
    got = N.dispatch(rows, "k", "s", specs, rewrites="r", lexicon=lexicon)
    one = [r for x in specs for r in N.dispatch(rows, "k", "s", x, rewrites="r", lexicon=lexicon).collect()]
    assert got.columns == ["k", "spec", "noisy"] and sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, one), key=str)
    assert len(one) == 40 * len(specs)


@pytest.mark.parametrize("rows", [7, 20_000])
def test_only_first_words_become_rows(spark, monkeypatch, rows):
    monkeypatch.setattr(P, "WORD_ROWS", rows)
    rng = random.Random(8)
    vocabulary = ["the", "The", "of", "big", "cat,", "cat", "house.", "x", "(y)", "Élan", "ÉLAN!", "İx", "a b", "the\x1cof", "😀", "K"]
    texts = [(i % 30, "".join(rng.choice(["", " ", "\x0b"]) + rng.choice(vocabulary) + rng.choice([" ", "  ", "\n"]) for _ in range(rng.randrange(0, 40)))) for i in range(60)] + [(50, None), (51, ""), (52, " ... ")]
    lexicon = [("the big", "A"), ("of the big cat", "B"), ("cat", "C"), ("cat", "B"), ("House", "E"), ("the", "G"), ("(y", "H"), ("élan", "I"), ("élan of", "J"), ("k", "K"), ("x élan", "L")]
    df, entries = spark.createDataFrame(texts, "id int, text string").repartition(5), spark.createDataFrame(lexicon, "surface string, label string")
    every = sorted(map(tuple, P.annotate(df, entries).collect()))
    monkeypatch.setattr(P, "_every_word", None)
    assert sorted(map(tuple, P.annotate(df, entries, known=11).collect())) == every
    plain = [(i, t.replace("\x1c", "_").replace(" ", "_")) for i, t in texts if t]
    got = P.annotate(spark.createDataFrame(plain, "id int, text string"), entries, known=11).where("label NOT IN ('I', 'J', 'K', 'L')").count()
    assert got == sum(x[3] not in "IJKL" for _, t in plain for x in by_loop(t, lexicon))
