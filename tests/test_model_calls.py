"""Calls of a model that fails, is slow, or is killed; and lines of files by their numbers."""

import random
import threading
import time

import pytest
from pyspark.sql import functions as F

from glossmill.operators import models
from glossmill.sources import files


def test_calls_are_tried_again_with_growing_waits(monkeypatch):
    waits, calls = [], []
    monkeypatch.setattr(models.time, "sleep", waits.append)

    def model(prompts):
        calls.append(list(prompts))
        if len(calls) < 4 or "never" in prompts:
            raise RuntimeError(f"no {len(calls)}")
        return [p.upper() for p in prompts]

    pace = models.Pace(attempts=4, wait=1, longest=3)
    assert models._answer(model, ["a", "b"], pace) == (["A", "B"], [None, None]) and waits == [1, 2, 3]
    out, err = models._answer(model, ["a", "never"], pace)
    assert out == ["A", None] and err[0] is None and err[1].startswith("no")
    assert models._answer(lambda p: [], ["a"], models.Pace())[1] == ["as many responses as prompts are needed"]


def test_several_calls_are_in_flight_and_their_number_follows_the_throughput():
    most, now, lock = [0], [0], threading.Lock()

    def ask(call):
        with lock:
            now[0] += 1
            most[0] = max(most[0], now[0])
        time.sleep(0.01)
        with lock:
            now[0] -= 1
        return call

    assert sorted(models.in_flight(((i,) for i in range(100)), ask, models.Pace(most=5))) == [(i,) for i in range(100)]
    assert 2 <= most[0] <= 5
    most[0] = 0
    assert len(list(models.in_flight(((i,) for i in range(10)), ask, models.Pace(most=1)))) == 10 and most[0] == 1
    assert list(models.in_flight(iter(()), ask, models.Pace())) == []


def test_fewer_calls_when_the_throughput_falls():
    seconds, seen, lock, now = iter(x * x for x in range(10_000)), [], threading.Lock(), [0]

    def ask(call):
        with lock:
            now[0] += 1
            seen.append(now[0])
        time.sleep(0.005)
        with lock:
            now[0] -= 1
        return call

    list(models.in_flight(((i,) for i in range(60)), ask, models.Pace(start=6, most=6, step=1), clock=lambda: next(seconds)))
    assert max(seen[:6]) == 6 and max(seen[-10:]) <= 2


def test_requests_are_asked_until_they_are_answered(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"p{i}") for i in range(200)] + [(5, "p5")], "id int, prompt string").repartition(4)

    def model(prompts):
        if random.random() < 0.5:
            raise RuntimeError("busy")
        return [p.upper() for p in prompts]

    got = models.call_until_answered(rows, "id", "prompt", model, str(tmp_path / "r"), rounds=40, slices=4, pace=models.Pace(batch=8)).collect()
    assert sorted((r["id"], r["response"], r["error"]) for r in got) == [(i, f"P{i}", None) for i in range(200)]


def test_what_was_stored_is_not_asked_again(spark, tmp_path):
    asked, path = str(tmp_path / "asked"), str(tmp_path / "r")
    rows = spark.createDataFrame([(i, str(i)) for i in range(100)], "id int, prompt string")

    def model(prompts):
        with open(asked, "a") as f:
            f.writelines(p + "\n" for p in prompts)
        if any(p.startswith("7") for p in prompts):
            raise RuntimeError("never")
        return prompts

    kept = models.call_model

    def killed(*args):
        raise KeyboardInterrupt

    seen = []

    def some(*args):
        seen.append(1)
        return kept(*args) if len(seen) < 3 else killed()

    models.call_model = some
    try:
        with pytest.raises(KeyboardInterrupt):
            models.call_until_answered(rows, "id", "prompt", model, path, slices=4, pace=1)
    finally:
        models.call_model = kept
    before = open(asked).read().split()
    got = {r["id"]: (r["response"], r["error"]) for r in models.call_until_answered(rows, "id", "prompt", model, path, rounds=1, slices=4, pace=1).collect()}
    after = open(asked).read().split()[len(before) :]
    assert before and not {x for x in before if not x.startswith("7")} & set(after)
    assert len(got) == 100 and all(got[i] == (None, "never") if str(i).startswith("7") else got[i] == (str(i), None) for i in range(100))


# --- lines by their numbers -------------------------------------------------------------------------------------------------
@pytest.mark.parametrize("size", ["64", "1000", "134217728"])
def test_lines_are_numbered_over_splits_and_files(spark, tmp_path, size):
    lines = [f'{{"k": {i}}}' if i % 7 else f"bad {i}" for i in range(300)]
    for name, part in (("a", lines[:120]), ("b", lines[120:121]), ("c", lines[121:])):
        (tmp_path / name).write_text("\n".join(part) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    try:
        got = files.scan_line_range(spark, str(tmp_path), "k int", 100, 150).collect()
        assert sorted((r["line"], r["k"]) for r in got) == [(i, i) for i in range(100, 250) if i % 7]
        assert files.scan_line_range(spark, str(tmp_path), "k int", 299, 50).collect()[0]["k"] == 299
        assert files.scan_line_range(spark, str(tmp_path), "k int", 300, 5).collect() == []
        pairs = files.scan_interleaved_lines(spark, str(tmp_path), "x", "y").collect()
        assert sorted((r["x"], r["y"]) for r in pairs) == sorted(zip(lines[::2], lines[1::2], strict=True))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_only_the_splits_of_a_range_are_numbered(spark, tmp_path):
    (tmp_path / "a").write_text("".join(f"{i}\n" for i in range(5000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        rows = files._numbered(spark, str(tmp_path / "a"), 4990, 4995)
        assert sorted((r["line"], r["value"]) for r in rows.collect()) == [(i, str(i)) for i in range(4990, 4995)]
        plan = rows._jdf.queryExecution().executedPlan().toString()
        assert "Window" in plan and "FileScan text" in plan and "SerializeFromObject" not in plan
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_line_order_within_a_file_of_two_splits(spark, tmp_path):
    """The last line of a request wins, also where the file is read as several splits."""
    (tmp_path / "iter_5.jsonl").write_text("".join(f'{{"request_id": "r{i % 3}", "losses": [{i}.0], "prediction": {i}, "sample": {{"dataset": "d"}}}}\n' for i in range(90)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        got = files.scan_loss_dump(spark, str(tmp_path), "d")
        assert got.rdd.getNumPartitions() >= 1 and {r["request_id"]: r["prediction"] for r in got.select("request_id", F.col("prediction")).collect()} == {"r0": 87, "r1": 88, "r2": 89}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
