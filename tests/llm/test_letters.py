"""Every letter has a vector of its own."""

import numpy as np

from glossmill.llm import langid


def cosine(a, b):
    u, v = langid.bundle(a).astype(float), langid.bundle(b).astype(float)
    return float(u @ v / np.linalg.norm(u) / np.linalg.norm(v))


def test_letters_outside_a_to_z_are_told_apart():
    assert cosine("ééé", "ööö") < 0.3 and cosine("ñññ", "äää") < 0.3
    assert cosine("мир", "".join(chr(ord(c) + 13) for c in "мир")) < 0.3
    assert cosine("Été", "été") > 0.999 and cosine("abc déf", "abc déf") > 0.999


def test_a_long_text_is_the_sum_of_its_ngrams():
    text = "мир été, the mill! " * 70_000
    s = langid.symbol_table()[[0, *map(ord, text), 0]].astype(np.int64)
    s = s[[True, *((s[1:] != 0) | (s[:-1] != 0))]]
    grams, n = np.unique(np.stack([s[:-2], s[1:-1], s[2:]], axis=1), axis=0, return_counts=True)
    want = sum(k * langid.bind(*(langid.letter_vector(int(x)).astype(np.int64) for x in g)) for g, k in zip(grams, n, strict=True))
    assert len(text) > 1 << 20 and np.array_equal(langid.bundle(text), want)
