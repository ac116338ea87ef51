"""Archives are read back as written, whatever the payloads, and their captures come in one order."""

import hashlib
import itertools
import random

import pytest
from pyspark.sql import functions as F

from glossmill.llm import warc

PAGES = "page_id bigint, url string, html string, captured string"
AT = "2001-02-03T04:05:06Z"
LONG = "<p>" + "long payload é " * 400_000
CUTTING = ["WARC/1.1\r\n" * 20, "x" * 90 + "\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n" * 3, "y" * 100 + "\r\n\r\n", "\r\n" * 60, "z" * 99 + "\r\n\r\n\r\nWARC/1.1\r\n", "W" * 100 + "\r\n\r\r\n\r\nWARC/1.1\r\n\r\n\r\nWARC/1.1\r\nWARC/1.1\r\n", "ends " * 30 + "WARC/1.1", "WARC/1.1" * 30, "WARC/1.1\r\n" * 9 + "WARC/WARC/1.1 "]


def sha(x):
    return hashlib.sha256((x or "").encode()).hexdigest()


def expected(rows):
    firsts = {}
    for page, _, html, _ in rows:
        if page is not None:
            firsts[html or ""] = min(page, firsts.get(html or "", page))
    out = []
    for page, _, html, _ in rows:
        size, first = len((html or "").encode()), firsts.get(html or "")
        again = size >= 100 and first is not None and first != page
        out.append((page, size, sha(html), "revisit" if again else "response", first if again else None))
    return sorted(out, key=str)


def read_back(spark, df, tmp_path):
    path = str(tmp_path / "archives")
    warc.write_archives(df, path)
    rows = warc.capture_index(spark, path).collect()
    number = lambda x: None if x is None else int(x)
    return sorted(((number(r["page_id"]), r["payload_bytes"], r["payload_digest"], r["record_type"], number(r["refers_to"])) for r in rows), key=str), rows


ROWS = [
    (1, "http://A.example.org/x", LONG, AT), (2, "http://a.example.org/x", LONG, AT), (3, None, None, None), (4, "", "", ""), (5, "http://b.org/\r\nWARC-Type: no", "s" * 99, AT), (6, "http://b.org/", "s" * 99, AT),
    (9, "http://c.org", "t" * 100, AT), (7, "http://c.org", "t" * 100, AT), (8, "http://c.org", "t" * 100, AT), (7, "http://c.org", "t" * 100, AT), (10, "http://c.org", "ü" * 50, AT), (11, "http://d.org", "ü" * 50, AT), (None, "http://d.org", "ü" * 50, AT),
    (None, "http://e.org", "n" * 200, AT), (None, "http://e.org", "n" * 200, AT), (13, "http://f.org/WARC/1.1", "u" * 101, AT), (14, "http://f.org/WARC/1.1 ", "v" * 101, AT), (12, "x: y", "nul \0 and \U00010ee7 " * 9, AT), *((20 + i, f"http://w.org/{i}", x, AT) for i, x in enumerate(CUTTING)), *((40 + i, f"http://w.org/{i}", x, AT) for i, x in enumerate(CUTTING)),
]


def test_odd_pages_are_read_back(spark, tmp_path):
    clash = {c: F.lit("clash") for c in ("payload", "payload_bytes", "payload_digest", "first", "hot", "cold", "key", "n", "value", "run", "at", "archive")}
    got, rows = read_back(spark, spark.createDataFrame(ROWS, PAGES).repartition(3).withColumns(clash), tmp_path)
    assert got == expected(ROWS)
    assert {r["url_key"] for r in rows if r["page_id"] in ("1", "2")} == {"org,example,a)/x"}
    assert {r["page_id"]: r["url_key"] for r in rows if r["page_id"] in ("13", "14")} == {"13": "org,f)/warc/1.1", "14": "org,f)/warc/1.1 "}
    assert {r["captured"] for r in rows if r["page_id"] == "1"} == {AT}


def test_empty_table(spark, tmp_path):
    assert read_back(spark, spark.createDataFrame([], PAGES), tmp_path)[0] == []


@pytest.mark.parametrize("size", ["97", "1000", "4099"])
def test_archives_are_split_at_records(spark, tmp_path, size):
    rng = random.Random(int(size))
    rows = [(i, f"http://{i % 7}.org/", "".join(rng.choice(["\r", "\n", "\r\n", "\r\n\r\n", "WARC/1.1", "\r\n\r\nWARC/1.1\r\n", "WARC/1.1\r\n", "WARC/", "1.1", "W", "a"]) for _ in range(60)), AT) for i in range(120)]
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    try:
        assert read_back(spark, spark.createDataFrame(rows, PAGES).coalesce(2), tmp_path)[0] == expected(rows)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_hot_payloads_are_looked_up_apart(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "HOT_ROWS", 3)
    monkeypatch.setattr(warc, "HOT_SHARE", 10)
    rows = [(i, f"http://{i}.org", ("h" if i % 3 else str(i % 30)) * 120, AT) for i in range(200)]
    assert read_back(spark, spark.createDataFrame(rows, PAGES).repartition(5), tmp_path)[0] == expected(rows)


def test_archives_are_plain_warc(spark, tmp_path):
    """Read by a loop over the files' bytes that knows only the format: version, fields, a blank line, length, an end."""
    path = tmp_path / "archives"
    rows = [(1, "http://a.org/", CUTTING[1], AT), (2, "http://a.org/", CUTTING[1], AT), (3, None, "plain", AT)]
    warc.write_archives(spark.createDataFrame(rows, PAGES).coalesce(1), str(path))
    data = b"".join(p.read_bytes() for p in sorted(path.glob("part-*")))
    seen, at = [], 0
    while at < len(data):
        head, _, _ = data[at:].partition(b"\r\n\r\n")
        version, *lines = head.decode().split("\r\n")
        fields = dict(x.split(": ", 1) for x in lines)
        at += len(head) + 4
        block = data[at : at + int(fields["Content-Length"])]
        at += len(block)
        assert version == "WARC/1.1" and data[at : at + 4] == b"\r\n\r\n" and block.startswith(b"HTTP/1.1 200 OK\r\n")
        at += 4
        seen.append((fields["WARC-Record-ID"], fields["WARC-Type"], fields.get("WARC-Refers-To"), fields.get("WARC-Target-URI")))
    assert sorted(seen) == [("<urn:page:1>", "response", None, "http://a.org/"), ("<urn:page:2>", "revisit", "<urn:page:1>", "http://a.org/"), ("<urn:page:3>", "response", None, None)]


def test_a_changed_payload_is_noticed(spark, tmp_path):
    path = tmp_path / "archives"
    warc.write_archives(spark.createDataFrame([(1, "http://a.org/", "payload", AT)], PAGES), str(path))
    (part,) = [p for p in path.glob("part-*") if p.stat().st_size]
    text = part.read_bytes()
    (path / "changed.txt").write_bytes(text.replace(b"payload", b"paylord", 1) if text.count(b"payload") == 1 else text[::-1].replace(b"daolyap", b"drolyap", 1)[::-1])
    part.unlink()
    (path / f".{part.name}.crc").unlink(missing_ok=True)
    with pytest.raises(Exception, match="another payload"):
        warc.capture_index(spark, str(path))


def test_captures_are_in_one_order(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "RUN_ROWS", 17)
    rows = [(i, f"http://{'hot' if i % 2 else i % 11}.org/{i % 3}", str(i), f"20{i * 7 % 90 + 10}-01-01T00:00:00Z") for i in range(700)]
    path = str(tmp_path / "archives")
    warc.write_archives(spark.createDataFrame(rows, PAGES).repartition(4), path)
    runs = warc.store(warc.capture_runs(spark, path))
    parts = warc.merged(runs, 6).withColumn("part", F.spark_partition_id()).collect()
    keys = [(r["url_key"], r["captured"], r["page_id"]) for r in sorted(parts, key=lambda r: r["part"])]
    assert keys == sorted(keys) and len(keys) == 700 and len({r["part"] for r in parts}) > 3
    own = runs.orderBy("run", "at").collect()
    assert len({r["run"] for r in own}) > 30
    for _, run in itertools.groupby(own, key=lambda r: r["run"]):
        k = [(r["url_key"], r["captured"], r["page_id"]) for r in run]
        assert k == sorted(k) and len(k) <= 17


def test_loser_tree():
    rng = random.Random(3)
    for k in (0, 1, 2, 3, 5, 8, 33):
        runs = [sorted((rng.randrange(50), i, j) for j in range(rng.choice([0, 1, 7, 40]))) for i in range(k)]
        tree = warc.LoserTree(runs)
        got = list(tree)
        assert got == sorted(itertools.chain(*runs))
        assert tree.matches <= (len(got) + k) * max(1, k.bit_length())
