import random
import re

import pandas as pd
import pytest

from glossmill.llm import jaccard
from glossmill.llm.components import components


def brute(rows, n, num, den):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set()))
    parent = {d: d for d, _ in rows if d is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and rows[i][0] is not None and rows[j][0] is not None and den * len(a & b) >= num * len(a | b):
                x, y = sorted((find(rows[i][0]), find(rows[j][0])))
                parent[y] = x
    return sorted(((d, len(s), None if d is None else find(d)) for (d, _), s in zip(rows, sets)), key=str)


def run(spark, rows, n, num, den):
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    docs = docs.selectExpr("doc_id", "text", "1 AS component_id", "'x' AS u")
    got = jaccard.groups(docs, jaccard.Similarity(n, num, den)).collect()
    return sorted((tuple(r) for r in got), key=str)


def near_copies(seed, n_base, copies, words, edits):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = []
    for _ in range(n_base):
        base = [r.choice(vocabulary) for _ in range(r.choice(words))]
        for _ in range(copies):
            w = list(base)
            for _ in range(r.randrange(edits)):
                w[r.randrange(len(w))] = r.choice(vocabulary)
            rows.append((len(rows), " ".join(w)))
    return rows


@pytest.mark.parametrize("n,num,den", [(3, 90, 100), (5, 8, 10)])
def test_groups_equal_brute_force(spark, n, num, den):
    rows = near_copies(1, 25, 4, [1, 2, 8, 14, 30, 60, 150], 5) + near_copies(2, 2, 40, [80, 200], 9)
    rows = [(i, t) for i, (_, t) in enumerate(rows)]
    assert run(spark, rows, n, num, den) == brute(rows, n, num, den)


def test_a_large_group_of_borderline_copies(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 16)
    monkeypatch.setattr(jaccard, "OPEN_BLOCK", 16)
    rows = near_copies(3, 1, 70, [120], 14) + [(1000 + i, t) for i, t in near_copies(4, 1, 5, [60], 3)]
    assert run(spark, rows, 3, 90, 100) == brute(rows, 3, 90, 100)


def test_nulls_ties_repeats_and_empty(spark):
    rows = [(5, None), (6, ""), (7, " \n\t"), (8, "A b"), (9, "a  B"), (9, "other words here now"), (None, "a b"), (3, "other words here now"), (4, "é " * 3000)]
    assert run(spark, rows, 3, 90, 100) == brute(rows, 3, 90, 100)
    assert run(spark, [], 3, 90, 100) == []


def test_keep_first(spark):
    docs = spark.createDataFrame([(4, "a b c d e f", "y"), (2, "a b c d e f", "x"), (9, None, None)], "doc_id bigint, text string, lang string")
    assert sorted(r["doc_id"] for r in jaccard.keep_first(docs).collect()) == [2, 9]


def test_components(spark):
    r = random.Random(5)
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, x) for x in range(200, 240)] + [(r.randrange(300, 360), r.randrange(300, 360)) for _ in range(40)] + [(1, 1), (None, 4)]
    got = {x["id"]: x["component"] for x in components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    frame = {u: u for e in edges if None not in e and e[0] != e[1] for u in e}
    changed = True
    while changed:
        changed = False
        for u, v in edges:
            if None not in (u, v) and u != v and frame[u] != frame[v]:
                frame[u] = frame[v] = min(frame[u], frame[v])
                changed = True
    assert got == frame
    assert pd.Series(got).nunique() >= 3
