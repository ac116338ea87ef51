"""Scans and sinks on the driver tables: a table is written in a format to the shared folder and read back."""

from __future__ import annotations

import io
import json
import sqlite3
import zipfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources import files as S
from ..streaming.incremental import resume_stream
from .bound import bind

EVENT = "event_id bigint, event_type string, value double, props string"


def _lines(df: DataFrame, value, path: str, *order: str) -> str:
    """Lines of text, in order over the files of a folder."""
    (df.orderBy(*order) if order else df).select(value.alias("value")).write.text(path)
    return path


def _events(t) -> DataFrame:
    return t("events").select("event_id", "event_type", "value", "props")


def _json():
    return F.to_json(F.struct("event_id", "event_type", "value", "props"), {"ignoreNullFields": "false"})


def _bad():
    """Every seventh line is cut off, and every eleventh is empty."""
    return F.when(F.col("event_id") % 11 == 0, "").when(F.col("event_id") % 7 == 0, F.substring(_json(), F.lit(1), F.length(_json()) - 3)).otherwise(_json())


@bind("scan_jsonl", "SELECT event_id, event_type, value, props FROM events")
def _(t):
    path = S.scratch(t.spark)
    S.sink_jsonl(_events(t), path)
    return S.scan_jsonl(t.spark, path, EVENT)


@bind("sink_jsonl", "SELECT '{\"doc_id\":' || CAST(doc_id AS VARCHAR) || ',\"lang\":' || coalesce('\"' || lang || '\"', 'null') || '}' AS line FROM documents")
def _(t):
    path = S.scratch(t.spark)
    S.sink_jsonl(t("documents").select("doc_id", "lang"), path)
    return t.spark.read.text(path).withColumnRenamed("value", "line")


@bind("scan_jsonl_tolerant", "SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 'reject' ELSE 'row' END AS kind, CASE WHEN event_id % 7 <> 0 THEN event_type END AS event_type FROM events WHERE event_id % 11 <> 0")
def _(t):
    path = _lines(_events(t), _bad(), S.scratch(t.spark))
    rows, rejects = S.scan_jsonl_tolerant(t.spark, path, EVENT)
    found = rejects.select(F.regexp_extract("value", r'"event_id":(\d+)', 1).cast("bigint").alias("event_id"), F.lit("reject").alias("kind"), F.lit(None).cast("string").alias("event_type"))
    return rows.select("event_id", F.lit("row").alias("kind"), "event_type").unionByName(found)


@bind("scan_line_range", "SELECT event_id AS line, event_id, event_type FROM (SELECT event_id, event_type, row_number() OVER (ORDER BY event_id) - 1 AS line FROM events) AS x WHERE line BETWEEN 100 AND 899 AND event_id % 7 <> 0 AND event_id % 11 <> 0")
def _(t):
    """Lines 100 to 899 of the file: bad ones count, then go."""
    path = _lines(_events(t), _bad(), S.scratch(t.spark), "event_id")
    return S.scan_line_range(t.spark, path, EVENT, 100, 800).select("line", "event_id", "event_type")


@bind("scan_json_object", "SELECT CAST(n_nationkey AS VARCHAR) AS key, n_name AS value FROM nation")
def _(t):
    path = S.scratch(t.spark)
    whole = t("nation").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct(F.col("n_nationkey").cast("string"), "n_name")))).alias("value"))
    whole.coalesce(1).write.text(path)
    return t.spark.createDataFrame(sorted(S.scan_json_object(t.spark, path).items()), "key string, value string")


@bind("scan_tsv_fields", "SELECT p_partkey, p_type AS kind, array_to_string(list_sort(string_split(p_name, ' ')), '|') AS keywords FROM part")
def _(t):
    line = F.concat_ws("\t", F.col("p_partkey").cast("string"), "p_brand", F.replace("p_name", F.lit(" "), F.lit("_")), "p_type")
    rows = S.scan_tsv_fields(t.spark, _lines(t("part"), line, S.scratch(t.spark)), {"p_partkey": 0, "kind": 3, "keywords": 2}, "keywords")
    return rows.select(F.col("p_partkey").cast("bigint").alias("p_partkey"), "kind", F.array_join(F.array_sort("keywords"), "|").alias("keywords"))


@bind("scan_bitext_tsv", "SELECT \"left\", \"right\", score FROM (SELECT c_name AS \"left\", c_mktsegment AS \"right\", CAST((c_custkey % 100) AS DOUBLE) / 100 AS score FROM customer) AS x WHERE score >= 0.7")
def _(t):
    score = F.when(F.col("c_custkey") % 100 == 99, F.lit("0.99")).otherwise(((F.col("c_custkey") % 100) / 100).cast("string"))
    line = F.concat_ws("\t", F.lit("id"), F.concat(F.lit(" "), "c_name"), F.concat("c_mktsegment", F.lit("  ")), score)
    return S.scan_bitext_tsv(t.spark, _lines(t("customer"), line, S.scratch(t.spark)), 1, 2, 3, 0.7)


@bind("scan_delimited_triple_pipe", "SELECT substring(p_type, 1, 1) || CAST(p_partkey AS VARCHAR) AS docid, p_name AS name FROM part WHERE substring(p_type, 1, 1) NOT IN ('E', 'S')")
def _(t):
    docid = F.concat(F.substring("p_type", 1, 1), F.col("p_partkey").cast("string"))
    path = _lines(t("part"), F.concat_ws("|||", docid, F.concat("p_name", F.lit(" "))), S.scratch(t.spark))
    return S.scan_delimited(t.spark, path, ["docid", "name"], drop_prefixes=["E", "S"])


@bind("scan_interleaved_lines", "SELECT c_name AS en, c_mktsegment || ' ' || CAST(c_custkey AS VARCHAR) AS ja FROM customer")
def _(t):
    lines = t("customer").select("c_custkey", F.posexplode(F.array(F.col("c_name"), F.concat_ws(" ", "c_mktsegment", F.col("c_custkey").cast("string")))).alias("side", "value"))
    path = _lines(lines, F.col("value"), S.scratch(t.spark), "c_custkey", "side")
    return S.scan_interleaved_lines(t.spark, path).select("en", "ja")


#: Reports with a header that stands twice, and blank lines.
def _report(t, path: str, iters: str) -> None:
    rows = t("orders").groupBy(F.expr(iters).alias("iter"), F.col("o_orderpriority").alias("Task")).agg(F.round(F.avg("o_totalprice"), 2).alias("Accuracy"))
    body = rows.groupBy("iter").agg(F.array_join(F.sort_array(F.collect_list(F.concat_ws(",", "Task", F.col("Accuracy").cast("string")))), "\n").alias("body"))
    text = body.select(F.concat(F.lit("iter_"), F.lpad(F.col("iter").cast("string"), 7, "0"), F.lit("-prompt")).alias("name"), F.concat(F.lit("Task,Accuracy\n"), "body", F.lit("\n\nTask,Accuracy\nlast,0.5")).alias("value"))
    text.write.partitionBy("name").text(path)


@bind("scan_csv_headered", "SELECT o_orderpriority AS Task, round(avg(o_totalprice), 2) AS Accuracy FROM orders GROUP BY o_orderpriority UNION ALL SELECT 'last' AS Task, 0.5 AS Accuracy")
def _(t):
    path = S.scratch(t.spark)
    _report(t, path, "0")
    return S.scan_csv_headered(t.spark, f"{path}/*", "Task string, Accuracy double")


@bind("scan_many_by_filename", "SELECT CAST(month(o_orderdate) * 100 AS INT) AS iter, o_orderpriority AS Task, round(avg(o_totalprice), 2) AS Accuracy FROM orders WHERE month(o_orderdate) BETWEEN 3 AND 10 GROUP BY ALL UNION ALL SELECT CAST(m * 100 AS INT) AS iter, 'last' AS Task, 0.5 AS Accuracy FROM range(3, 11) AS r(m)")
def _(t):
    path = S.scratch(t.spark)
    _report(t, path, "month(o_orderdate) * 100")
    return S.scan_many_by_filename(t.spark, f"{path}/*", "Task string, Accuracy double", r"iter_(\d+)-prompt", 300, 1000).select("iter", "Task", "Accuracy")


@bind(
    "scan_loss_dump",
    "SELECT CAST(month(o_orderdate) AS INT) AS iter, CAST(o_custkey AS VARCHAR) AS request_id, CAST(last(o_orderkey % 4 ORDER BY o_orderkey) AS INT) AS prediction FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') GROUP BY month(o_orderdate), o_custkey",
)
def _(t):
    """A dump for each month; a customer's later orders override earlier ones; other data sets stand in between."""
    path = S.scratch(t.spark)
    row = lambda name, p: F.struct(F.col("o_custkey").cast("string").alias("request_id"), F.array(F.col("o_totalprice")).alias("losses"), F.array(F.lit(1.0)).alias("norm_losses"), p.cast("int").alias("prediction"), F.struct(F.lit(name).alias("dataset")).alias("sample"))
    name = F.concat(F.lit("iter_"), F.month("o_orderdate").cast("string"))
    lines = t("orders").select(name.alias("name"), "o_orderkey", F.explode(F.array(F.to_json(row("mcq", F.col("o_orderkey") % 4)), F.to_json(row("other", F.lit(9))))).alias("value"))
    lines.repartition("name").sortWithinPartitions("name", "o_orderkey").select("name", "value").write.partitionBy("name").text(path)
    ids = t("customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").cast("string").alias("request_id"))
    return S.scan_loss_dump(t.spark, f"{path}/*", "mcq", ids).select("iter", "request_id", "prediction")


@bind("scan_token_info_csv", "SELECT lang || '/' || source AS name, CAST(sum(n_chars) AS BIGINT) AS tokens FROM documents GROUP BY lang || '/' || source")
def _(t):
    path = S.scratch(t.spark)
    rows = t("documents").groupBy(F.concat("lang", F.lit("/"), "source").alias("name")).agg(F.sum("n_chars").alias("tokens"))
    rows.select("name", F.concat(F.lit("data/"), "name").alias("path"), "tokens").write.csv(path)
    return S.scan_token_info_csv(t.spark, path).select("name", "tokens")


@bind("scan_python_literal", "SELECT event_id, event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, event_id % 2 = 0 AS ok FROM events")
def _(t):
    line = F.concat(F.lit("{'id': "), F.col("event_id").cast("string"), F.lit(", 'type': '"), "event_type", F.lit("', 'props': "), "props", F.when(F.col("event_id") % 2 == 0, F.lit(", 'ok': True, 'none': None}")).otherwise(F.lit(", 'ok': False}")))
    lines = t.spark.read.text(_lines(t("events"), line, S.scratch(t.spark)))
    parsed = S.scan_python_literal(lines).select(F.from_json("json", "id bigint, type string, ok boolean, props struct<k: bigint>").alias("x"))
    return parsed.select(F.col("x.id").alias("event_id"), F.col("x.type").alias("event_type"), F.col("x.props.k").alias("k"), F.col("x.ok").alias("ok"))


def _bytes_table(t, content: bytes, path: str) -> str:
    """A binary file in the shared folder, written by Spark's file system."""
    fs, at = S._file_system(t.spark, path)
    out = fs.create(at)
    out.write(bytearray(content))
    out.close()
    return path


@bind("scan_sqlite_thesaurus", "SELECT w.s_suppkey AS wordid, w.s_name AS lemma, CAST(count(o.s_suppkey) AS BIGINT) AS others FROM supplier AS w LEFT JOIN supplier AS o ON o.s_suppkey // 4 = w.s_suppkey // 4 AND o.s_suppkey <> w.s_suppkey GROUP BY w.s_suppkey, w.s_name")
def _(t):
    """A thesaurus of words and senses in an SQLite file, with its look-up as the query. A thesaurus is small."""
    con = sqlite3.connect(":memory:")
    con.execute("CREATE TABLE word(wordid INTEGER PRIMARY KEY, lemma TEXT)")
    con.execute("CREATE TABLE sense(synset INTEGER, wordid INTEGER)")
    words = [(r["s_suppkey"], r["s_name"]) for r in t("supplier").select("s_suppkey", "s_name").collect()]
    con.executemany("INSERT INTO word VALUES (?, ?)", words)
    con.executemany("INSERT INTO sense VALUES (?, ?)", [(k // 4, k) for k, _ in words])
    con.execute("CREATE INDEX by_synset ON sense(synset)")
    con.commit()
    path = _bytes_table(t, con.serialize(), S.scratch(t.spark))
    query = "SELECT w.wordid, w.lemma, count(o.wordid) FROM word AS w JOIN sense AS s ON s.wordid = w.wordid LEFT JOIN sense AS o ON o.synset = s.synset AND o.wordid <> w.wordid GROUP BY w.wordid, w.lemma"
    return S.scan_sqlite(t.spark, path, query, "wordid bigint, lemma string, others bigint")


def _workbook(rows: list[tuple]) -> bytes:
    """A workbook with inline and shared strings, as small as the format allows."""
    shared, cells = [], []
    for i, row in enumerate(rows, 1):
        own = ""
        for k, v in enumerate(row):
            ref = f"{chr(65 + k)}{i}"
            if v is None:
                continue
            if k == 0 and i > 1:
                own += f'<c r="{ref}"><v>{v}</v></c>'
            else:
                shared.append(str(v))
                own += f'<c r="{ref}" t="s"><v>{len(shared) - 1}</v></c>'
        cells.append(f'<row r="{i}">{own}</row>')
    out, space = io.BytesIO(), 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/sharedStrings.xml", f"<sst {space}>" + "".join(f"<si><t>{x}</t></si>" for x in shared) + "</sst>")
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {space}><sheetData>{''.join(cells)}</sheetData></worksheet>")
    return out.getvalue()


@bind("scan_excel", "SELECT CAST(n_nationkey AS VARCHAR) AS id, n_name AS name, CASE WHEN n_regionkey > 0 THEN CAST(n_regionkey AS VARCHAR) END AS region FROM nation")
def _(t):
    """A sheet of human judgements is small; here, the nations, some without a region."""
    rows = [(r["n_nationkey"], r["n_name"], r["n_regionkey"] or None) for r in t("nation").collect()]
    path = _bytes_table(t, _workbook([("id", "name", "region"), *rows]), S.scratch(t.spark))
    return S.scan_excel(t.spark, path, ["id", "name", "region"])


@bind("scan_hub_dataset", "SELECT conv_id, turn, text, role AS split FROM conversations WHERE role IN ('user', 'assistant')")
def _(t):
    base = S.scratch(t.spark)
    for role in ("user", "assistant"):
        S.sink_jsonl(t("conversations").where(F.col("role") == role).select("conv_id", "turn", "text"), f"{base}/chats/{role}.jsonl")
    return S.scan_hub_dataset(t.spark, base, "chats", "conv_id bigint, turn bigint, text string")


# --- sinks --------------------------------------------------------------------------------------------------------------
@bind("sink_append_incremental", "SELECT doc_id, CASE WHEN doc_id IN (SELECT doc_id FROM labels) THEN 'first' ELSE 'second' END AS batch FROM documents UNION SELECT doc_id, 'first' AS batch FROM labels")
def _(t):
    """Labelled ids, then all ids, the second batch twice as after a failure: each id is there once."""
    path = S.scratch(t.spark)
    S.sink_append_incremental(t("labels").select("doc_id"), path, "doc_id", "first")
    for _ in range(2):
        S.sink_append_incremental(t("documents").select("doc_id"), path, "doc_id", "second")
    return t.spark.read.parquet(path).select("doc_id", F.col("batch").cast("string").alias("batch"))


@bind("stream_resume", "SELECT DISTINCT conv_id FROM conversations")
def _(t):
    """Files arrive in two lots with common keys; each key is written once."""
    base = S.scratch(t.spark)
    ids = t("conversations").select("conv_id")
    for part in ("conv_id % 2 = 0 OR conv_id % 3 = 0", "conv_id % 2 = 1 OR conv_id % 3 = 0"):
        ids.where(part).distinct().write.mode("append").json(f"{base}/in")
        resume_stream(t.spark, f"{base}/in", "conv_id bigint", "conv_id", f"{base}/out", f"{base}/state").awaitTermination()
    return t.spark.read.parquet(f"{base}/out").select("conv_id")


@bind("sink_in_place_column_add", "SELECT item_id, text, CAST(length(text) AS INT) AS n_chars FROM benchmark")
def _(t):
    path = S.scratch(t.spark)
    t("benchmark").write.parquet(path)
    return S.sink_column_add(t.spark, path, "n_chars", F.length("text"))


@bind("sink_csv_report", "SELECT source AS Task, round(avg(n_chars), 3) AS mean, CAST(count(*) AS BIGINT) AS n FROM documents GROUP BY source")
def _(t):
    path = S.scratch(t.spark)
    S.sink_csv_report(t("documents").groupBy(F.col("source").alias("Task")).agg(F.round(F.avg("n_chars"), 3).alias("mean"), F.count(F.lit(1)).alias("n")), path)
    return S.scan_csv_headered(t.spark, path, "Task string, mean double, n bigint")


@bind("sink_pretty_table", "SELECT r_regionkey, r_name FROM region")
def _(t):
    """The table as text, and its cells read from the text."""
    text = S.sink_pretty_table(t("region").select("r_regionkey", "r_name"))
    cells = [[c.strip() for c in line.strip("|").split("|")] for line in text.splitlines() if line.startswith("|")]
    return t.spark.createDataFrame([(int(a), b) for a, b in cells[1:]], T.StructType([T.StructField("r_regionkey", T.LongType()), T.StructField("r_name", T.StringType())]))


def _judged():
    """A judgement of three distractors, two criteria each."""
    return F.concat(F.lit("question: "), "n_name", *(F.concat(F.lit(f"\ndistractor {i}: x\n**Score:** "), ((F.col("n_nationkey") + i) % 4).cast("string"), F.lit(f" fair\n**Score:** {i}\n")) for i in (1, 2, 3)))


@bind("sink_md_per_row", "SELECT CAST(n_nationkey + 2 AS VARCHAR) || '.md' AS file, 'question: ' || n_name AS first_line FROM nation")
def _(t):
    path = S.scratch(t.spark)
    S.sink_md_per_row(t("nation").withColumn("md", _judged()), path, "n_nationkey", "md")
    whole = t.spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True)
    return whole.select(F.regexp_extract(F.col("_metadata.file_path"), "file=([^/]+)/", 1).alias("file"), F.substring_index("value", "\n", 1).alias("first_line"))


@bind("scan_judgement_md", "SELECT CAST(n_nationkey + 2 AS VARCHAR) || '.md' AS file, CAST(i AS INT) AS distractor, CAST(c AS INT) AS criterion, CAST(CASE c WHEN 0 THEN (n_nationkey + i) % 4 ELSE i END AS INT) AS score FROM nation, range(1, 4) AS r(i), range(0, 2) AS s(c)")
def _(t):
    path = S.scratch(t.spark)
    S.sink_md_per_row(t("nation").withColumn("md", _judged()), path, "n_nationkey", "md")
    return S.scan_judgement_md(t.spark, path)


@bind("sink_content_addressed", "SELECT md5('{\"n\": 2, \"source\": \"region\"}') AS key, r_regionkey, r_name FROM region")
def _(t):
    """Two recipes that differ in an entry of 0 have one address; the second writes nothing."""
    base = S.scratch(t.spark)
    first = S.sink_content_addressed(t("region"), {"source": "region", "n": 2, "unused": 0}, base)
    second = S.sink_content_addressed(t("region").limit(0), {"n": 2, "source": "region"}, base)
    if first != second:
        raise AssertionError("equal recipes have equal addresses")
    return t.spark.read.parquet(second).select(F.lit(second.rsplit("/", 1)[-1]).alias("key"), "r_regionkey", "r_name")


@bind("sink_megatron_export", "WITH p AS (SELECT lang || '/' || source AS path, CAST(round(sum(n_chars) * 1.5) AS BIGINT) AS n FROM documents GROUP BY lang || '/' || source) SELECT path, CAST(n AS VARCHAR) || ' ' || path AS line, CAST((SELECT sum(n) FROM p) AS BIGINT) AS total FROM p WHERE path IS NOT NULL UNION ALL SELECT path, CAST(n AS VARCHAR) AS line, CAST((SELECT sum(n) FROM p) AS BIGINT) AS total FROM p WHERE path IS NULL")
def _(t):
    files = t("documents").groupBy(F.concat("lang", F.lit("/"), "source").alias("path")).agg(F.sum("n_chars").alias("tokens"))
    return S.megatron_listing(files.withColumn("repeat", F.lit(1.5)))


@bind("proj_config_merge", "SELECT * FROM (VALUES ('budget', '5'), ('model.size', '13'), ('model.name', 'base'), ('data', 'all')) AS v(key, value)")
def _(t):
    merged = S.merge_config({"budget": 3, "model": {"size": 7, "name": "base"}, "data": "none"}, {"budget": 5, "model": {"size": 13}, "data": "all"})
    flat = [(f"{k}.{a}", str(b)) for k, v in merged.items() if isinstance(v, dict) for a, b in v.items()] + [(k, str(v)) for k, v in merged.items() if not isinstance(v, dict)]
    return t.spark.createDataFrame(flat, "key string, value string")


@bind("proj_raw_roman_restructure", "SELECT doc_id, lang AS raw_lang, text AS raw_text, translate(text, 'äöüßéèñ', 'aouseen') AS roman_text, CAST(2 AS INT) AS views FROM documents")
def _(t):
    """All fields but the id nested under raw, and the romanised text beside it."""
    docs = t("documents").select("doc_id", "lang", "text")
    nested = docs.select("doc_id", F.struct("lang", "text").alias("raw"), F.struct(F.translate("text", "äöüßéèñ", "aouseen").alias("text")).alias("roman"))
    return nested.select("doc_id", F.col("raw.lang").alias("raw_lang"), F.col("raw.text").alias("raw_text"), F.col("roman.text").alias("roman_text"), F.lit(len([c for c in nested.columns if c != "doc_id"])).alias("views"))


@bind("proj_messages", "SELECT doc_id, CAST(to_json([{'role': 'system', 'content': 'Language: ' || lang}, {'role': 'user', 'content': text}]) AS VARCHAR) AS messages FROM documents WHERE text IS NOT NULL AND lang IS NOT NULL")
def _(t):
    """A system and a user message as JSON, escaped as JSON asks for."""
    system, user = F.concat(F.lit("Language: "), "lang"), F.col("text")
    both = F.array(*(F.struct(F.lit(r).alias("role"), c.alias("content")) for r, c in (("system", system), ("user", user))))
    return t("documents").where("text IS NOT NULL AND lang IS NOT NULL").select("doc_id", F.to_json(both).alias("messages"))


@bind("mix_budget_guard", "SELECT * FROM (VALUES (0, true), (1, true), (2, false)) AS v(large, allowed)")
def _(t):
    """Which numbers of sources with the large budget are allowed."""
    from ..operators.mixture import guard_budgets

    rows = []
    for n in range(3):
        try:
            guard_budgets({f"s{i}": 500_000_000 if i < n else 1 for i in range(3)})
            rows.append((n, True))
        except ValueError:
            rows.append((n, False))
    return t.spark.createDataFrame(rows, "large int, allowed boolean")


@bind("llm_batch_call", "SELECT conv_id, turn, CASE WHEN length(text) % 5 = 0 THEN 'too long' END AS error, CASE WHEN length(text) % 5 <> 0 THEN CAST(length(text) AS VARCHAR) END AS n FROM conversations WHERE role = 'user' AND turn > 0")
def _(t):
    """A model that fails on some requests: results and rejects apart; first turns are done already."""
    from ..operators import models

    def model(prompts: list[str]) -> list[str]:
        if any(len(p) % 5 == 0 for p in prompts):
            raise RuntimeError("too long")
        return ["Sure: " + json.dumps({"n": len(p)}) for p in prompts]

    asked = t("conversations").where("role = 'user' AND text IS NOT NULL").withColumn("id", F.concat_ws(":", "conv_id", "turn"))
    path = S.scratch(t.spark)  # results and rejects are read from what was answered once
    models.call_model(asked, "id", "text", model, models.Pace(batch=8, most=3), done=asked.where("turn = 0")).write.parquet(path)
    out = t.spark.read.parquet(path)
    parsed, _ = models.parse_responses(out.where("error IS NULL"), "n bigint")
    key = lambda i: F.split_part("id", F.lit(":"), F.lit(i)).cast("bigint")
    return out.where("error IS NOT NULL").select(key(1).alias("conv_id"), key(2).alias("turn"), "error", F.lit(None).cast("string").alias("n")).unionByName(parsed.select(key(1).alias("conv_id"), key(2).alias("turn"), F.lit(None).cast("string").alias("error"), F.col("parsed.n").cast("string").alias("n")))
