"""What the mixture job keeps on disk: texts are stored in its output alone."""

from pathlib import Path

from pyspark.sql import functions as F
from test_training_mixture import CONFIG, many, rows_of, tables

from glossmill.operators import mixture, ranking
from glossmill.sources import files
from jobs import training_mixture


def test_texts_are_stored_in_the_output_alone(spark, tmp_path, monkeypatch):
    docs, bench = tables(spark, tmp_path, many())
    made, seen, real = [], [], mixture.budget_prefixes
    own = files.scratch
    for module in (training_mixture, ranking):
        monkeypatch.setattr(module, "scratch", lambda *a, **b: made.append(own(*a, **b)) or made[-1])
    monkeypatch.setattr(mixture, "budget_prefixes", lambda rows, *a: seen.append(rows.columns) or real(rows, *a))
    training_mixture.run(spark, docs, bench, str(tmp_path / "out"), CONFIG)
    assert seen == [["lang", "tokens", "place"]]
    assert len(made) == 2 and not any(Path(x.removeprefix("file://")).exists() or x in files._SCRATCH for x in made)


def test_rows_read_again_take_little_room(spark, tmp_path):
    rows = [(i, " ".join(f"Word{i * j % 9973} ends here." for j in range(1, 60)), "en") for i in range(1, 300)]
    docs, bench = tables(spark, tmp_path, rows)
    room = {}
    for percent in (100, 400):
        out = training_mixture.run(spark, docs, bench, str(tmp_path / f"out{percent}"), CONFIG | {"percent": {"en": percent}})
        room[percent] = sum(p.stat().st_size for p in (tmp_path / f"out{percent}" / "mixture").rglob("*.parquet"))
        assert out.count() == 2 * 299 * percent // 100
    assert room[400] < 1.5 * room[100]


def test_last_places(spark):
    rows = spark.createDataFrame([("a", f"{i:03}", 1) for i in range(40)] + [("b", f"{i:03}", 2) for i in range(30)], "s string, place string, tokens int")
    chosen = mixture.budget_prefixes(rows, "s", "tokens", {"a": 10, "b": mixture.percent(250)}, "place")
    last = mixture.last_places(chosen, "s", "place")
    assert last == {"a": [(0, "009")], "b": [(0, "029"), (1, "029"), (2, "014")]}
    want = sorted((s, p, n) for s, p, _ in map(tuple, rows.collect()) for n, end in last[s] if p <= end)
    assert sorted(map(tuple, chosen.select("s", "place", "cycle").collect())) == want


def test_whole_cycles_have_every_row(spark, tmp_path):
    docs, bench = tables(spark, tmp_path, many())
    out = training_mixture.run(spark, docs, bench, str(tmp_path / "out"), CONFIG | {"percent": {"en": 200, "ja": 100}})
    got = rows_of(out.where(F.col("lang") == "en"))
    assert [r[:3] for r in got if r[3] == 0] == [r[:3] for r in got if r[3] == 1] and len(got) == 160
