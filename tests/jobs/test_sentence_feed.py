"""The feed over growing input: each document once, whatever the order of files and runs."""

import subprocess
import sys
from pathlib import Path

import pytest

from jobs import sentence_feed

REPO = Path(__file__).resolve().parent.parent.parent
CONFIG = {"languages": ["en", "ja"], "least_words": 2, "files_per_batch": 1}
SCHEMA = "doc_id bigint, text string, lang string, source string"


@pytest.fixture
def places(tmp_path):
    return str(tmp_path / "docs"), str(tmp_path / "out"), str(tmp_path / "state")


def add(spark, places, *rows):
    spark.createDataFrame([(*r, "s") for r in rows], SCHEMA).coalesce(1).write.mode("append").parquet(places[0])


def ids(df):
    return sorted((r["doc_id"], r["sentid"], r["sentence"], r["words"], r["lang"]) for r in df.collect())


def test_two_runs_over_growing_input(spark, places):
    add(spark, places, (1, "First here. Second here. x", "en"), (2, None, "en"), (None, "No id here.", "en"), (3, "Other language.", "xx"))
    first = ids(sentence_feed.run(spark, *places, CONFIG))
    assert first == [(1, 0, "First here.", 2, "en"), (1, 1, "Second here.", 2, "en")]
    add(spark, places, (1, "Came before. Not again.", "en"), (4, "New one.", "ja"))
    add(spark, places, (4, "Again in another file.", "ja"), (2, "Has text now.", "en"), (5, "", "en"))
    second = ids(sentence_feed.run(spark, *places, CONFIG))
    assert [r for r in second if r[0] == 1] == first and {r[0] for r in second} == {1, 2, 4}
    assert [r[2] for r in second if r[0] == 4] in (["New one."], ["Again in another file."])
    assert ids(sentence_feed.run(spark, *places, CONFIG)) == second


def test_request_ids(spark, places):
    add(spark, places, (7, "First here. Second here.", "en"))
    got = sentence_feed.run(spark, *places, CONFIG).collect()
    assert sorted(r["request_id"] for r in got) == ["7_sentid:0", "7_sentid:1"]


def test_only_new_files_are_read(spark, places, caplog):
    add(spark, places, *((i, f"Text number {i}. And more.", "en") for i in range(20)))
    with caplog.at_level("INFO", "jobs"):
        sentence_feed.run(spark, *places, CONFIG)
        add(spark, places, *((i, f"Text number {i}. And more.", "en") for i in range(15, 22)))
        sentence_feed.run(spark, *places, CONFIG)
    assert "read 20 new rows" in caplog.text and "20 new documents" in caplog.text
    assert "read 7 new rows" in caplog.text and "2 new documents" in caplog.text


def test_rows_that_are_left_out_are_logged(spark, places, caplog):
    add(spark, places, (1, "First here.", "en"), (None, "No id.", "en"), (2, None, "en"), (3, "Other.", "xx"), (4, "No language.", None), (1, "First again.", "en"))
    with caplog.at_level("INFO", "jobs"):
        sentence_feed.run(spark, *places, CONFIG)
    assert "read 6 new rows" in caplog.text and "1 new documents, 4 rows left out" in caplog.text


def test_what_a_failed_write_leaves_is_not_read(spark, places):
    add(spark, places, (1, "First here.", "en"))
    first = ids(sentence_feed.run(spark, *places, CONFIG))
    stray = Path(places[1]) / "lang=en"
    (part,) = stray.glob("part-*.parquet")
    (stray / "part-stray.parquet").write_bytes(part.read_bytes())
    assert ids(sentence_feed.run(spark, *places, CONFIG)) == first


def test_a_failed_run_is_taken_up(spark, places):
    """The second file cannot be read; when it is mended, the next run adds what is lacking and doubles nothing."""
    add(spark, places, (1, "First here.", "en"))
    sentence_feed.run(spark, *places, CONFIG)
    broken = Path(places[0]) / "part-99999-broken.parquet"
    broken.write_bytes(b"no parquet")
    with pytest.raises(Exception):
        sentence_feed.run(spark, *places, CONFIG)
    own = spark.createDataFrame([(2, "Second here.", "en", "s")], SCHEMA).coalesce(1)
    own.write.parquet(places[0] + "-mended")
    (part,) = Path(places[0] + "-mended").glob("part-*.parquet")
    broken.write_bytes(part.read_bytes())
    (Path(places[0]) / f".{broken.name}.crc").unlink(missing_ok=True)
    assert [r[0] for r in ids(sentence_feed.run(spark, *places, CONFIG))] == [1, 2]


def test_settings_are_as_before(spark, places):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    add(spark, places, (1, "First here.", "en"))
    sentence_feed.run(spark, *places, CONFIG)
    assert spark.conf.get(name, None) == before


def test_command_line(spark, places):
    add(spark, places, (1, "First of the texts. Second of the texts.", "en"))
    line = [sys.executable, "-m", "jobs.sentence_feed", "--documents", places[0], "--output", places[1], "--checkpoint", places[2]]
    said = subprocess.run(line, cwd=REPO, capture_output=True, text=True)
    assert said.returncode == 0 and "1 new documents" in said.stderr, said.stderr[-2000:]
    assert len(spark.read.parquet(places[1]).collect()) == 2
