"""Every noise that a name calls for, against a loop over each document; orders against a plain version."""

import hashlib
import math

import duckdb
import pytest
import regex
from pyspark.sql import functions as F
from test_phrases import by_loop

from glossmill.operators import noise as N
from glossmill.plans import registry
from glossmill.plans.bound_operators import SYNONYMS

SF = "/root/testdata/sf0.001"
TOKENS = regex.compile(r"https?://[^\s]+|[A-Za-z0-9._]+@[A-Za-z0-9]+(?:\.[A-Za-z0-9]+)+|[0-9]+(?:[.,][0-9]+)+%?|[0-9]+%?|(?:[A-Z]\.){2,}|\p{L}+(?:['’]\p{L}+)+|\p{L}+(?:-\p{L}+)+|[\p{Han}\p{Hiragana}\p{Katakana}]|\p{L}+|\.\.\.|--+|[^\s\p{L}0-9]")


def u(*parts):
    return int(hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()[:8], 16) / (1 << 32)


def order(n, steps, width, *seed):
    """A run of displaced places, cut and turned."""
    k = min(steps, n)
    if k < 2:
        return list(range(n))
    start = math.floor(u(*seed, "start") * (n - k + 1))
    cuts = [list(range(at, min(at + width, k))) for at in range(0, k, width)]
    if len(cuts) > 1 and len(cuts[-1]) == 1:
        cuts[-2:] = [cuts[-2] + cuts[-1]]
    out = list(range(n))
    for c, cut in enumerate(cuts):
        turn = 1 + math.floor(u(*seed, "turn", c) * (len(cut) - 1))
        for j, x in enumerate(cut):
            out[start + x] = start + cut[(j + turn) % len(cut)]
    return out


def syntax(k, text, rate, width):
    t = TOKENS.findall(text)
    o = order(len(t), int(len(t) * rate) + 1, width, "syntax", k)
    kept = [t[x] for i, x in enumerate(o) if x != i or u("syntax", "gone", k, i) >= rate]
    text = regex.sub(r""" ([.,!?;:%)\]}'”’])""", r"\1", " ".join(kept))
    return regex.sub(r"""([(\[{'“‘]) """, r"\1", text)


def noisy(k, sentences, spec):
    text = " ".join(sentences)
    words = text.split(" ")
    chance = lambda seed, p: [i > 0 and u(seed, k, i) < p for i in range(len(words))]
    rewritten = [s.lower() if u("rewrite", k, i) < 0.4 else s for i, s in enumerate(sentences)]
    if spec == "mask-8":
        return " ".join("<unk>" if hit else w for w, hit in zip(words, chance("mask", 0.08), strict=True))
    if spec == "delete-8":
        return " ".join(w for w, hit in zip(words, chance("delete", 0.08), strict=True) if not hit)
    if spec == "replace-16":
        return " ".join(["word", "other"][int(u("replace", "id", k, i) * 2)] if hit else w for i, (w, hit) in enumerate(zip(words, chance("replace", 0.16), strict=True)))
    if spec == "mono-30":
        out, at = [], 0
        for start, end, _, label in by_loop(text, [(w, s) for w, s, _ in SYNONYMS if s]):
            if u("mono", k, start) < 0.3:
                out += [text[at:start], label]
                at = end
        return "".join([*out, text[at:]])
    if spec == "retoken-4@3":
        rest = words[1:]
        return " ".join([words[0], *(rest[i] for i in order(len(rest), max(int(len(rest) * 0.04), 2), 3, "reorder", k))])
    if spec == "resent-50":
        return " ".join(sentences[i] for i in order(len(sentences), max(int(len(sentences) * 0.5), 2), 3, "sentences", k))
    if spec == "syntax-16@8":
        return syntax(k, text, 0.16, 8)
    if spec == "rewrite-40":
        return " ".join(rewritten)
    if spec == "rewrite@syntax-40":
        return syntax(k, " ".join(rewritten), 0.4, 4)
    if spec == "partial-12":
        quarter = sorted(i % 4 for i in range(len(sentences)))
        return " ".join(s for s, q in zip(sentences, quarter, strict=True) if q in (0, 1))
    return text


def test_every_noise_equals_a_loop(spark):
    sentences = {r["doc_id"]: r["s"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", registry_sentences().alias("s")).collect() if r["s"]}
    got = registry.queries()["noise_dispatch"](spark, SF).collect()
    assert len(got) == 11 * len(sentences)
    for r in got:
        assert r["noisy"] == noisy(r["doc_id"], sentences[r["doc_id"]], r["spec"]), (r["doc_id"], r["spec"])


def registry_sentences():
    from glossmill.functions import structure

    return structure.sentences(F.col("text"))


@pytest.mark.parametrize("n,steps,width", [(0, 3, 3), (1, 3, 3), (2, 2, 2), (10, 4, 3), (10, 2, 2), (7, 7, 3), (5, 9, 4), (30, 11, 5), (9, 1, 3), (8, 7, 2)])
def test_orders(spark, n, steps, width):
    rows = spark.range(20).select("id", N.permutation(F.lit(n), F.lit(steps), width, "s", F.col("id")).alias("o")).collect()
    for r in rows:
        assert r["o"] == order(n, steps, max(2, width), "s", r["id"])
        moved = [abs(x - i) for i, x in enumerate(r["o"]) if x != i]
        assert sorted(r["o"]) == list(range(n)) and len(moved) == (min(steps, n) if min(steps, n) > 1 else 0) and max(moved, default=0) <= max(2, width)
    assert len({tuple(r["o"]) for r in rows}) > 1 or min(steps, n) < 3


def test_an_order_of_nothing(spark):
    assert spark.range(1).select(N.permutation(F.lit(None).cast("int"), F.lit(2), 3, "s").alias("o")).collect()[0]["o"] is None


def test_synonyms_of_a_repeated_key_and_of_nulls(spark):
    rows = spark.createDataFrame([(1, "the cat", "x"), (1, "no match", "y"), (2, None, "z"), (3, "The big cat.", "w")], "id int, text string, start string")
    lexicon = spark.createDataFrame([("the", "a"), ("big cat", "lion"), ("cat", "pet")], "phrase string, synonym string")
    got = sorted((r["id"], r["start"], r["noisy"], r["n_noise"]) for r in N.synonyms(rows, "id", "text", lexicon, 1.0, "s").collect())
    assert got == [(1, "x", "a pet", 2), (1, "y", "no match", 0), (2, "z", None, 0), (3, "w", "a lion.", 2)]
    assert {r["n_noise"] for r in N.synonyms(rows, "id", "text", lexicon, 0.0, "s").collect()} == {0}


def test_noise_rates_of_a_wrong_checkpoint(spark):
    rows = spark.createDataFrame([("a", 1, ["<token>", "<mask>"], 1.0), ("a", 2, ["<mask>", "<token>"], 3.0), ("b", 1, ["<token>"], 1.0), ("b", 2, ["<mask>"], 2.0), ("c", 1, [], 1.0)], "d string, i int, l array<string>, x double")
    got = {(r["d"], r["i"]): (r["noise_rate"], r["mean_loss"], r["constant"]) for r in N.noise_rates(rows, "d", "i", "l", "x").collect()}
    assert got == {("a", 1): (0.5, 1.0, True), ("a", 2): (0.5, 3.0, True), ("b", 1): (0.0, 1.0, False), ("b", 2): (1.0, 2.0, False), ("c", 1): (None, 1.0, None)}


def test_the_noises_change_most_documents():
    con = duckdb.connect()
    con.execute(f"create view benchmark as select * from '{SF}/benchmark.parquet'")
    rows = con.execute(registry.oracles()["noise_synonym"]).fetchall()
    assert sum(r[3] > 0 for r in rows) > 0.2 * len(rows)
