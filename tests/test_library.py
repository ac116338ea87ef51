import json
import random

import pytest
from pyspark.sql import functions as F

from glossmill.functions import texts
from glossmill.operators import mixture, models
from glossmill.sources import files
from glossmill.streaming import incremental


def test_json_blocks():
    assert texts.first_block('x {"a": {"b": 1}} y') == '{"a": {"b": 1}}'
    assert texts.robust_json('```json\n{"a": TRUE, "b": NULL}\n``` done') == '{"a": true, "b": null}'
    assert texts.robust_json("nothing") is None and texts.robust_json("{bad}") is None


def test_romanize():
    assert texts.romanize("きゃっとシャツ") == "kyattoshatsu"
    assert texts.romanize("コーヒー") == "koohii"


def brute_budget(tokens, budget):
    out, total, i = [], 0, 0
    while total < budget:
        out.append((i % len(tokens), i // len(tokens)))
        total += tokens[i % len(tokens)]
        i += 1
    return sorted(out)


@pytest.mark.parametrize("budget", [0, 1, 57, 200, 499, 1300])
@pytest.mark.parametrize("parts", [1, 5])
def test_budget_prefix(spark, budget, parts):
    r = random.Random(4)
    tokens = [r.randrange(0, 30) for _ in range(40)]
    rows = spark.createDataFrame(list(enumerate(tokens)), "pos bigint, tokens bigint").repartition(parts)
    got = sorted((x["pos"], x["cycle"]) for x in mixture.budget_prefix(rows, "tokens", budget, "pos").collect())
    assert got == brute_budget(tokens, budget)


def test_budget_of_an_empty_source(spark):
    with pytest.raises(ValueError):
        mixture.budget_prefix(spark.createDataFrame([], "pos bigint, tokens bigint"), "tokens", 5, "pos")


def test_scans_and_rejects(spark, tmp_path):
    p = tmp_path / "a.jsonl"
    p.write_text('{"a": 1}\nbad\n\n{"a": 2}\n{"a": 3}\n')
    rows, rejects = files.scan_jsonl_tolerant(spark, str(p), "a int")
    assert sorted(x["a"] for x in rows.collect()) == [1, 2, 3] and [x["value"] for x in rejects.collect()] == ["bad"]
    assert [x["a"] for x in files.scan_line_range(spark, str(p), "a int", 1, 3).collect()] == [2]
    q = tmp_path / "b.txt"
    q.write_text("one\n一\ntwo\n二\n")
    assert sorted(tuple(x) for x in files.scan_interleaved_lines(spark, str(q)).select("en", "ja").collect()) == [("one", "一"), ("two", "二")]
    c = tmp_path / "iter_0000100-prompt.csv"
    c.write_text("Task,Accuracy\nx,0.5\n\nTask,Accuracy\ny,0.25\n")
    assert sorted(tuple(x) for x in files.scan_csv_headered(spark, str(c), "Task string, Accuracy double").collect()) == [("x", 0.5), ("y", 0.25)]
    t = tmp_path / "t.tsv"
    t.write_text("id\ta \t b\t0.9\nid\tc\td\t0.1\nid\te\tf\tx\n")
    assert [tuple(x)[:2] for x in files.scan_bitext_tsv(spark, str(t), 1, 2, 3).collect()] == [("a", "b")]


def test_append_is_idempotent(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k bigint, v string")
    assert files.sink_append_incremental(df, str(tmp_path / "s"), "k") == 2
    assert files.sink_append_incremental(df.unionByName(df.select((F.col("k") + 1).alias("k"), "v")), str(tmp_path / "s"), "k") == 1


def test_a_column_is_added_or_the_table_stays(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(3).write.parquet(path)
    with pytest.raises(Exception):
        files.sink_column_add(spark, path, "x", F.raise_error("no"))
    assert spark.read.parquet(path).columns == ["id"] and spark.read.parquet(path).count() == 3
    assert sorted(map(tuple, files.sink_column_add(spark, path, "x", F.col("id") * 2).collect())) == [(0, 0), (1, 2), (2, 4)]
    assert not [p.name for p in tmp_path.iterdir() if "before" in p.name]


def test_recipes():
    assert files.recipe_key({"a": 1, "b": 0}) == files.recipe_key({"a": 1})
    assert files.merge_config({"a": {"x": 1}, "b": 2}, {"a": {"y": 3}, "b": {"z": 4}}) == {"a": {"x": 1, "y": 3}, "b": {"z": 4}}


def test_model_hook(spark):
    def model(prompts):
        if "bad" in prompts:
            raise RuntimeError("no")
        return [json.dumps({"n": len(p)}) for p in prompts]

    req = spark.createDataFrame([(1, "abc"), (2, "bad"), (3, "z")], "id bigint, prompt string")
    out = {r["id"]: r for r in models.call_model(req, "id", "prompt", model, done=req.where("id = 3")).collect()}
    assert set(out) == {1, 2} and out[1]["response"] == '{"n": 3}' and out[2]["error"] == "no"
    ok, bad = models.parse_responses(models.call_model(req, "id", "prompt", model), "n int")
    assert sorted(r["parsed"]["n"] for r in ok.collect()) == [1, 3] and [r["id"] for r in bad.collect()] == [2]


def test_stream_resumes(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "1.json").write_text('{"k": 1}\n{"k": 2}\n')
    run = lambda: incremental.resume_stream(spark, str(src), "k bigint", "k", str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(60)
    run()
    (src / "2.json").write_text('{"k": 2}\n{"k": 3}\n')
    run()
    assert sorted(r["k"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [1, 2, 3]
