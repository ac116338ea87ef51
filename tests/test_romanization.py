"""Readings of words against all ways to cut a run, and what stays as it is."""

import itertools
import math
import random

from glossmill.operators import romanization as R

LEXICON = [("北京", "beijing", 50), ("大学", "daxue", 40), ("北", "bei", 5), ("京", "jing", 5), ("大", "da", 9), ("学", "xue", 9), ("北京大学", "beijingdaxue", 3), ("京大", "jingda", 4), ("行", "xing", 8), ("行", "hang", 9), ("行", "heng", 9), ("", "no", 9), ("无", "no", 0)]


def run(spark, texts, lexicon=LEXICON):
    rows = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "id int, t string, roman string").repartition(3)
    out = R.romanized(rows, "t", spark.createDataFrame(lexicon, "word string, reading string, weight int"), "said")
    return [r["said"] for r in sorted(out.collect(), key=lambda r: r["id"])]


def test_words_and_what_stays(spark):
    texts = ["北京大学", "我在北京，学 abc。", "北京 大", None, "", "abc, (d)", "无人行", "北" * 3]
    assert run(spark, texts) == ["beijing daxue", "我在 beijing， xue  abc。", "beijing   da", None, "", "abc,(d)", "无人 heng", "bei bei bei"]


def test_without_a_lexicon(spark):
    assert run(spark, ["北京x", None], []) == ["北京 x", None]


def by_all_cuts(text, costs, unknown):
    best = None
    for cuts in itertools.product([0, 1], repeat=len(text) - 1):
        words, start = [], 0
        for i, c in enumerate((*cuts, 1), 1):
            if c:
                words.append(text[start:i])
                start = i
        if any(len(w) > 1 and w not in costs for w in words):
            continue
        cost = sum(costs.get(w, unknown) for w in words)
        best = cost if best is None or cost < best else best
    return best


def test_the_best_path_is_the_best_of_all_cuts():
    rng = random.Random(5)
    for _ in range(300):
        words = {"".join(rng.choice("甲乙丙丁") for _ in range(rng.randrange(1, 4))): rng.randrange(1, 60) for _ in range(rng.randrange(0, 9))}
        total = sum(words.values()) or 1
        costs, unknown = {w: math.log(total) - math.log(n) for w, n in words.items()}, math.log(total) + 5.0
        text = "".join(rng.choice("甲乙丙丁") for _ in range(rng.randrange(1, 9)))
        edges = [{"i": i, "n": n, "reading": f"<{text[i : i + n]}>", "cost": costs[text[i : i + n]]} for i in range(len(text)) for n in range(1, 4) if text[i : i + n] in costs and i + n <= len(text)]
        got = R.best_path(text, edges, unknown)
        assert "".join(x.strip("<>") for x in got) == text
        cost = sum(costs[x[1:-1]] if x[0] == "<" else unknown * len(x) for x in got)
        assert abs(cost - by_all_cuts(text, costs, unknown)) < 1e-9


def test_a_run_of_many_characters(spark):
    assert run(spark, ["北京大学" * 2000])[0] == " ".join(["beijing daxue"] * 2000)
