"""The mixture job on small tables: leaks, languages, budgets, reruns, config and command line."""

import json
import random
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from jobs import common, training_mixture
from glossmill.operators import leakage

REPO = Path(__file__).resolve().parent.parent.parent
PASSAGE = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"
CONFIG = training_mixture.DEFAULTS | {"percent": {"en": 50, "ja": 250}, "modes": ["pure_text", "completion"], "least_sentences": 2, "leak_words": 13}


def tables(spark, tmp_path, rows, held=((1, PASSAGE),)):
    docs, bench = str(tmp_path / "docs"), str(tmp_path / "bench")
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string").repartition(3).write.mode("overwrite").parquet(docs)
    spark.createDataFrame(list(held), "item_id bigint, text string").write.mode("overwrite").parquet(bench)
    return docs, bench


def many(n=60):
    rng = random.Random(5)
    return [(i, " ".join(f"Word{rng.randrange(99)} number{i} ends here." for _ in range(rng.randrange(2, 9))), "en" if i % 3 else "ja") for i in range(n)]


def rows_of(df):
    return sorted(map(tuple, df.select("doc_id", "mode", "lang", "cycle", "tokens", "text").collect()))


def test_leaks_and_unusable_documents_stay_out(spark, tmp_path):
    odd = [
        (100, "Starts well. ONE, two; three-four five six seven eight nine ten eleven twelve thirteen! Ends.", "en"),
        (101, "One two three four five six seven eight nine ten eleven twelve. And thirteen words are not there.", "en"),
        (102, PASSAGE.replace("seven", "7"), "en"),
        (None, "No id. But text.", "en"), (103, None, "en"), (104, "", "en"), (105, "Only one sentence here", "en"), (106, "Another language. Not configured.", "xx"), (107, "No language. None at all.", None),
        (108, "Second text of an id. Not the least.", "ja"), (108, "A text of an id. The least.", "ja"),
    ]
    docs, bench = tables(spark, tmp_path, many() + odd, [(1, PASSAGE), (2, None), (3, "too short")])
    out = str(tmp_path / "out")
    training_mixture.run(spark, docs, bench, out, CONFIG | {"percent": {"en": 100, "ja": 100}})
    got = {r["doc_id"]: r["abstract"] for r in spark.read.parquet(f"{out}/records").collect()}
    assert got.keys() == set(range(60)) | {101, 108} and got[108].startswith("A text")


def test_leaking_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(leakage, "BROADCAST_PASSAGES", 0)
    docs = spark.createDataFrame([(1, "x " + PASSAGE), (2, "clean words"), (3, None), (1, PASSAGE)], "doc_id bigint, text string")
    held = spark.createDataFrame([(PASSAGE,), (None,)], "text string")
    assert [tuple(r) for r in leakage.leaking(docs, "doc_id", held).collect()] == [(1,)]


def test_budgets_are_met_in_the_seeds_order(spark, tmp_path):
    docs, bench = tables(spark, tmp_path, many())
    out = training_mixture.run(spark, docs, bench, str(tmp_path / "out"), CONFIG)
    got = rows_of(out)
    whole = rows_of(training_mixture.run(spark, docs, bench, str(tmp_path / "whole"), CONFIG | {"percent": {"en": 100, "ja": 100}}))
    assert len(whole) == 120 and all(r[4] == len(r[5].split()) for r in whole)
    for lang, percent in CONFIG["percent"].items():
        total = sum(r[4] for r in whole if r[2] == lang)
        budget = -(-total * percent // 100)
        mine = [r for r in got if r[2] == lang]
        taken = sum(r[4] for r in mine)
        assert budget <= taken < budget + max(r[4] for r in whole)
        counts = [sum(1 for r in mine if r[:2] == w[:2]) for w in whole if w[2] == lang]
        assert set(counts) <= ({0, 1} if percent < 100 else {2, 3})


def test_a_rerun_gives_the_same_and_a_new_config_leaves_nothing_old(spark, tmp_path):
    docs, bench = tables(spark, tmp_path, many())
    out = str(tmp_path / "out")
    first = rows_of(training_mixture.run(spark, docs, bench, out, CONFIG))
    assert rows_of(training_mixture.run(spark, docs, bench, out, CONFIG)) == first
    assert {p.name for p in Path(out, "mixture").glob("lang=*")} == {"lang=en", "lang=ja"}
    assert {r[2] for r in rows_of(training_mixture.run(spark, docs, bench, out, CONFIG | {"percent": {"ja": 10}}))} == {"ja"}


def test_a_language_without_documents_is_an_error(spark, tmp_path):
    docs, bench = tables(spark, tmp_path, many())
    with pytest.raises(ValueError, match="zh"):
        training_mixture.run(spark, docs, bench, str(tmp_path / "out"), CONFIG | {"percent": {"en": 10, "zh": 10}})


def test_configs(spark, tmp_path):
    path = tmp_path / "c.json"
    path.write_text('{"seed": "other"}')
    assert common.read_config(spark, str(path), training_mixture.DEFAULTS) == training_mixture.DEFAULTS | {"seed": "other"}
    path.write_text('{"sed": "typo"}')
    with pytest.raises(ValueError, match="sed"):
        common.read_config(spark, str(path), training_mixture.DEFAULTS)
    assert common.read_config(spark, str(training_mixture.CONFIG), training_mixture.DEFAULTS)["percent"]


def test_command_line(spark, tmp_path):
    docs, bench = tables(spark, tmp_path, many())
    config = tmp_path / "c.json"
    config.write_text(json.dumps({k: v for k, v in CONFIG.items() if k != "seed"}))
    line = [sys.executable, "-m", "jobs.training_mixture", "--documents", docs, "--benchmark", bench, "--output", str(tmp_path / "out"), "--config", str(config)]
    said = subprocess.run(line, cwd=REPO, capture_output=True, text=True)
    assert said.returncode == 0, said.stderr[-2000:]
    assert "read 60 documents" in said.stderr and "wrote ja completion" in said.stderr
    again = training_mixture.run(spark, docs, bench, str(tmp_path / "again"), CONFIG)
    assert rows_of(spark.read.parquet(str(tmp_path / "out" / "mixture"))) == rows_of(again)


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_texts_are_cut_once_and_instructions_are_made_before_they_are_ordered(spark, tmp_path, monkeypatch):
    texts = spark.createDataFrame([(1, "A. B."), (2, "A")], "doc_id bigint, abstract string")
    cut = training_mixture.with_sentences(texts, 2)
    assert [tuple(r) for r in cut.collect()] == [(1, "A. B.", ["A.", "B."])]
    assert plan_of(cut.withColumn("title", F.get("sentences", F.lit(0)))).count("(?<=[.!?])") == 1
    seen, real = [], training_mixture.mixture.budget_prefixes
    monkeypatch.setattr(training_mixture.mixture, "budget_prefixes", lambda rows, *a: seen.append(plan_of(rows)) or real(rows, *a))
    training_mixture.run(spark, *tables(spark, tmp_path, many()), str(tmp_path / "out"), CONFIG)
    assert len(seen) == 1 and "regexp_extract_all" not in seen[0] and "Union" not in seen[0]
