"""The manifest against trees built by hand in Python, on odd tables, and what tampering does to it."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from glossmill.llm import merkle
from glossmill.llm.queries import QUERIES

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]


def h(*xs):
    return hashlib.sha256("".join(xs).encode()).hexdigest()


def leaf_of(row):
    return h(*("-" if row[c] is None else f"{len(str(row[c]).encode())}:{row[c]}" for c in COLUMNS))


def tree(nodes):
    """(top, for each node its steps of siblings before and after)."""
    steps, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, k in enumerate(at):
            run = nodes[k // 8 * 8 : k // 8 * 8 + 8]
            steps[i].append((run[: k % 8], run[k % 8 + 1 :]))
        nodes = [h(*nodes[k : k + 8]) for k in range(0, len(nodes), 8)]
        at = [k // 8 for k in at]
    return nodes[0], steps


def by_hand(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r["lang"], []).append(r)
    names = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    built = {}
    for name in names:
        own = sorted(groups[name], key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf_of(r)))
        built[name] = own, *tree([leaf_of(r) for r in own])
    root, above = tree([built[n][1] for n in names])
    out = []
    for name, more in zip(names, above, strict=True):
        own, subroot, steps = built[name]
        for r, s in zip(own, steps, strict=True):
            whole = s + more
            node = leaf_of(r)
            if r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0 and r["text"] is not None:
                node = leaf_of(r | {"text": "".join(c.lower() if c.isascii() else c for c in r["text"])})
            for before, after in whole:
                node = h(*before, node, *after)
            out.append((r["doc_id"], leaf_of(r), subroot, root, h(*(x for b, a in whole for x in (*b, *a))), node, node == root))
    return out


def run(df):
    where = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    text = {"text": F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")}
    return sorted((tuple(r) for r in merkle.verify(merkle.manifest(df, COLUMNS, "lang", "doc_id", text, where), "doc_id").collect()), key=str)


def rows_of(n, lang):
    return [{"doc_id": i * 7 % 1009, "text": f"Text {i} Ünï" * (i % 3), "lang": lang(i), "source": None if i % 5 else "S", "n_chars": i} for i in range(n)]


ODD = [
    {"doc_id": None, "text": None, "lang": None, "source": None, "n_chars": None},
    {"doc_id": None, "text": "A", "lang": "", "source": "", "n_chars": 0},
    {"doc_id": 4, "text": "Same", "lang": "en", "source": "s", "n_chars": 4},
    {"doc_id": 4, "text": "Same", "lang": "en", "source": "s", "n_chars": 4},
    {"doc_id": 4, "text": "other", "lang": "en", "source": "s", "n_chars": 4},
    {"doc_id": 5, "text": "LONG " * 1_000_000, "lang": "en", "source": "s", "n_chars": 5_000_000},
    {"doc_id": -3, "text": "\0\U00010ee7", "lang": "é", "source": "s", "n_chars": 2},
]
TABLES = {
    "one": rows_of(1, lambda i: "en"),
    "eight": rows_of(8, lambda i: "en"),
    "nine": rows_of(9, lambda i: None),
    "a run of one at two levels": rows_of(65, lambda i: "en"),
    "a hot group": rows_of(600, lambda i: "en" if i % 3 else f"x{i}"),
    "many groups": rows_of(90, lambda i: f"g{i}"),
    "odd": ODD,
}


@pytest.mark.parametrize("name", TABLES)
def test_equals_trees_by_hand(spark, name):
    rows = TABLES[name]
    df = spark.createDataFrame([tuple(r[c.split()[0]] for c in DOCS.split(", ")) for r in rows], DOCS).repartition(3)
    clash = {c: F.lit("clash") for c in ("grp", "key", "node", "place", "n", "parent", "run", "path", "root", "leaf", "given", "_row", "_part")}
    assert run(df.withColumns(clash)) == sorted(by_hand(rows), key=str)


def test_without_broadcast_of_the_places(spark, monkeypatch):
    monkeypatch.setattr(merkle, "BROADCAST_ROWS", 0)
    rows = TABLES["a hot group"]
    assert run(spark.createDataFrame([tuple(r[c.split()[0]] for c in DOCS.split(", ")) for r in rows], DOCS)) == sorted(by_hand(rows), key=str)


def test_empty_table(spark):
    assert run(spark.createDataFrame([], DOCS)) == []


def test_only_changed_texts_fail(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    got = {r["doc_id"]: r["verified"] for r in QUERIES["op11_merkle_manifest"](spark, "/root/testdata/sf0.001").collect()}
    for r in docs:
        changed = zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0 and r["text"] is not None and any("A" <= c <= "Z" for c in r["text"])
        assert got[r["doc_id"]] is not changed


def test_a_level_is_a_window_by_group_and_parent(spark):
    nodes = spark.createDataFrame([("", i, "x", 100) for i in range(100)], "grp string, place bigint, node string, n bigint")
    plan = merkle.parents(nodes, "grp")._jdf.queryExecution().optimizedPlan().toString()
    assert "Window [collect_list(node" in plan and "specifiedwindowframe(RowFrame, unboundedpreceding$(), unboundedfollowing$())" in plan
