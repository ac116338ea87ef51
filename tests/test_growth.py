"""Steps whose rows or memory grew faster than their input, against loops and by their plans."""

import random
from collections import Counter

from pyspark.sql import functions as F

from glossmill.operators import switching as W
from glossmill.operators import translation as B
from glossmill.plans import registry


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_names_of_an_entry_are_compared_within_its_row(spark):
    rng = random.Random(3)
    name = lambda: " ".join(rng.choice(["a", "B", "c", "D", "e"]) for _ in range(rng.randrange(0, 4)))
    known = {f"c{i}": sorted({name() for _ in range(6)}) for i in range(5)}
    said = {i: (name(), sorted(rng.sample(sorted(known), rng.randrange(0, 4)))) for i in range(60)}
    mentions = spark.createDataFrame([(i, text, [(c, 1.0, c) for c in cands]) for i, (text, cands) in said.items()], "mention int, text string, cands array<struct<cui string, score double, name string>>")
    lexicon = spark.createDataFrame(list(known.items()), "cui string, aliases array<string>")

    def distance(a, b):
        x, y = set(a.lower().split()), set(b.lower().split())
        return 1 - len(x & y) / len(x | y) if x | y else 0.0

    for alias, sign in (("max_diff", -1), ("min_diff", 1)):
        out = W.entity_aliases(mentions, lexicon, "all", alias)
        assert plan(out).count("Generate ") == 1  # of the candidates; names make no rows
        want = {i: min((sign * distance(text, n), c, n) for c in cands for n in known[c])[1:] for i, (text, cands) in said.items() if cands}
        assert {r["mention"]: (r["cui"], r["code"]) for r in out.collect()} == want
    out = W.entity_aliases(mentions, lexicon, "all", "random")
    assert plan(out).count("Generate ") == 1 and {r["mention"] for r in out.collect()} == {i for i, (_, cands) in said.items() if cands}
    empty = spark.createDataFrame([(c, []) for c in known], "cui string, aliases array<string>")
    assert W.entity_aliases(mentions, empty, "all").where(F.lit(True)).count() == 0


def test_n_grams_are_counted_within_rows(spark):
    rng = random.Random(5)
    rows = [(i, None if i % 50 == 0 else [rng.choice(["a", "b c", "c", ""]) for _ in range(rng.randrange(0, 12))], [rng.choice(["a", "b c", "c"]) for _ in range(rng.randrange(0, 12))]) for i in range(300)]
    out = B.ngram_counts(spark.createDataFrame(rows, "i int, c array<string>, r array<string>"), ["i"], F.col("c"), F.col("r"))
    assert "Generate " not in plan(out) and "Aggregate " not in plan(out)
    grams = lambda w, n: Counter(tuple(w[k : k + n]) for k in range(len(w) - n + 1))
    want = {i: ([sum((grams(c or [], n) & grams(r, n)).values()) for n in range(1, 5)], [sum(grams(c or [], n).values()) for n in range(1, 5)], len(c or []), len(r)) for i, c, r in rows}
    assert {x["i"]: (x["hits"], x["totals"], x["candidate_length"], x["reference_length"]) for x in out.collect()} == want


def test_both_means_come_from_one_pass(spark):
    out = registry.queries()["agg_bleu_mean"](spark, "/root/testdata/sf0.001")
    assert plan(out).count("Relation [") == 1


def test_a_request_is_asked_once(spark):
    """Results and rejects come from one table of answers, so that no plan that is read asks the model again."""
    out = registry.queries()["llm_batch_call"](spark, "/root/testdata/sf0.001")
    assert "MapInArrow" not in plan(out) and out.count() > 0
