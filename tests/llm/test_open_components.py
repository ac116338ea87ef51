"""Components that hold together by chance: histograms tell their sets apart, and texts travel only where sets may link."""

import random

import numpy as np
import pytest
from test_jaccard import brute, near_copies, run

from glossmill.llm import jaccard


@pytest.mark.parametrize("num,den", [(90, 100), (8, 10)])
def test_histograms_find_every_link(num, den):
    r, sim = np.random.default_rng(7), jaccard.Similarity(3, num, den)
    sets = []
    for size in (1, 2, 5, 9, 40, 380, 410, 430, 1700, 7000, 200_000):
        base = r.integers(0, 1 << 64, size, dtype=np.uint64)
        for _ in range(4):
            n = int(size * (1 - num / den) * 0.8)
            sets.append(np.unique(np.concatenate([base[r.integers(0, n + 1) :], r.integers(0, 1 << 64, r.integers(0, n + 1), dtype=np.uint64)])))
    h = [jaccard.histogram(s).tobytes() for s in sets]
    held = jaccard.Histograms(sim, list(range(len(sets))), [i % 3 for i in range(len(sets))], [len(s) for s in sets], h)
    chance = 0
    for i, s in enumerate(sets):
        near = held.near(i % 3, len(s), h[i])
        links = {j for j, x in enumerate(sets) if j % 3 != i % 3 and sim.linked(len(s), len(x), len(np.intersect1d(s, x)))}
        assert len(near) == len(set(near)) and links <= set(near)
        chance += sum(i // 4 != j // 4 for j in near)
    assert chance < 20


def test_only_texts_that_may_link_are_searched_again(spark, monkeypatch):
    for name, n in (("SMALL", 2), ("LEADERS", 1), ("BLOCK", 64), ("OPEN_BLOCK", 16), ("NEAR_BLOCK", 40)):
        monkeypatch.setattr(jaccard, name, n)
    r, words = random.Random(4), [f"v{i}" for i in range(60)]
    rows = [(i, " ".join(r.sample(words, r.randrange(14, 30)))) for i in range(400)]
    rows += [(1000 + i, t) for i, t in near_copies(3, 6, 3, [30], 2)] + [(2000 + i, t) for i, (_, t) in enumerate(rows[:60:4])]
    seen, real = [], jaccard._search
    monkeypatch.setattr(jaccard, "_search", lambda found, *a, **b: seen.append(found.count()) or real(found, *a, **b))
    assert run(spark, rows, 1, 8, 10) == brute(rows, 1, 8, 10)
    assert len(seen) in (2, 3) and sum(seen[1:]) < len(rows)  # by components alone, each text goes to three sizes of some ten blocks


def test_equal_texts_of_other_tasks_are_not_searched(spark, monkeypatch):
    rows = [(i, "one two three four five six seven eight nine") for i in range(40)] + [(7, "another text of this document is here"), (90, "another text of this document is here now")]
    seen, real = [], jaccard._search
    monkeypatch.setattr(jaccard, "_search", lambda found, *a, **b: seen.append(found.count()) or real(found, *a, **b))
    assert run(spark, rows, 1, 8, 10) == brute(rows, 1, 8, 10)
    assert seen[0] <= 5
