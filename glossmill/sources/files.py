"""Scans and sinks of record files. Bad lines are never lost: tolerant scans return them as a reject table."""

from __future__ import annotations

import ast
import atexit
import hashlib
import io
import json
import shutil
import sqlite3
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager, suppress
from contextvars import ContextVar
from xml.etree import ElementTree

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


_SCRATCH: dict[str, SparkSession] = {}
#: The scratch paths made within an open temporary(), by thread.
_OWN: ContextVar[list[str] | None] = ContextVar("_OWN", default=None)


def scratch(spark: SparkSession, keep: bool = False) -> str:
    """A new path in the folder that driver and executors share (spark.checkpoint.dir); only a local master may have none.

    What is written there is deleted when the driver's process ends, unless it is to be kept.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="glossmill-")
        atexit.register(shutil.rmtree, base, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/files-{uuid.uuid4().hex}"
    if not keep:
        if not _SCRATCH:
            atexit.register(_drop_scratch)
        _SCRATCH[path] = spark
        if (own := _OWN.get()) is not None:
            own.append(path)
    return path


@contextmanager
def temporary() -> Iterator[None]:
    """For tables that nothing reads afterwards: scratch paths that this thread makes within are deleted at the end."""
    before = _OWN.set(own := [])
    try:
        yield
    finally:
        _OWN.reset(before)
        _drop_scratch(own)


def _drop_scratch(paths: Iterable[str] | None = None) -> None:
    for path in list(_SCRATCH if paths is None else paths):
        spark = _SCRATCH.pop(path)
        with suppress(Exception):  # the session may have ended before
            fs, at = _file_system(spark, path)
            fs.delete(at, True)


def scan_jsonl(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Strict JSONL scan: any malformed line fails the query."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def scan_jsonl_tolerant(spark: SparkSession, path: str, schema: T.StructType | str) -> tuple[DataFrame, DataFrame]:
    """(rows, rejects): lines that parse as an object, and the other non-blank lines as they are."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    parsed = lines.select("value", F.from_json("value", _with_corrupt(schema), {"columnNameOfCorruptRecord": "_bad", "mode": "PERMISSIVE"}).alias("r"))
    bad = F.col("r").isNull() | F.col("r._bad").isNotNull()
    return parsed.where(~bad).select("r.*").drop("_bad"), parsed.where(bad).select("value")


def _with_corrupt(schema: T.StructType | str) -> T.StructType:
    if isinstance(schema, str):
        schema = T._parse_datatype_string(schema)
    return T.StructType([*schema.fields, T.StructField("_bad", T.StringType())])


def _numbered(spark: SparkSession, path: str, start: int = 0, end: int | None = None) -> DataFrame:
    """(line, value): the physical lines start .. end - 1 of a file or of several in the order of their names, from 0.

    The lines of a file's split are read in order by one task, so their order is that of a rising id. Splits are counted
    first (a row per split comes to the driver), and only those that hold a wanted line are numbered: by a window over
    each split. The splits must be the same in both readings, as they are for files that nobody writes to.
    """
    split = [F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_from")]
    lines = spark.read.text(path).select("value", *split, F.monotonically_increasing_id().alias("_id"))
    counts = sorted((r["_file"], r["_from"], r["n"]) for r in lines.groupBy("_file", "_from").agg(F.count(F.lit(1)).alias("n")).collect())
    wanted, total = [], 0
    for file, begin, n in counts:
        if total + n > start and (end is None or total < end):
            wanted.append((file, begin, total))
        total += n
    at = spark.createDataFrame(wanted, "_file string, _from bigint, _before bigint")
    own = F.row_number().over(Window.partitionBy("_file", "_from").orderBy("_id")) - 1
    numbered = lines.join(F.broadcast(at), ["_file", "_from"]).withColumn("line", F.col("_before") + own)  # a row per split
    return numbered.where(F.col("line") >= start if end is None else F.col("line").between(start, end - 1)).select("line", "value")


def scan_line_range(spark: SparkSession, path: str, schema: str, start: int, count: int) -> DataFrame:
    """Parse the physical lines start .. start + count - 1 of a file; malformed lines count, then go."""
    own = _numbered(spark, path, start, start + count)
    parsed = own.select("line", F.from_json("value", _with_corrupt(schema), {"columnNameOfCorruptRecord": "_bad"}).alias("r"))
    return parsed.where(F.col("r").isNotNull() & F.col("r._bad").isNull()).select("line", "r.*").drop("_bad")


def scan_json_object(spark: SparkSession, path: str, create_if_missing: bool = False) -> dict:
    """A whole-file JSON object, for configuration, from anywhere that Spark reads."""
    try:
        rows = spark.read.text(path, wholetext=True).collect()
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e) and create_if_missing:
            return {}
        raise
    return json.loads(rows[0]["value"])


def scan_tsv_fields(spark: SparkSession, path: str, columns: dict[str, int], keywords: str | None = None) -> DataFrame:
    """Tab-separated columns by position; the keywords column is split at `_`."""
    f = F.split("value", "\t")
    out = spark.read.text(path).select(*(F.get(f, F.lit(i)).alias(c) for c, i in columns.items()))
    return out.withColumn(keywords, F.split(keywords, "_")) if keywords else out


def scan_bitext_tsv(spark: SparkSession, path: str, left: int, right: int, score: int, least: float = 0.7) -> DataFrame:
    """Scored bitext: trimmed sides and score, rows below `least` dropped."""
    f = F.split("value", "\t")
    out = spark.read.text(path).select(F.trim(F.get(f, F.lit(left))).alias("left"), F.trim(F.get(f, F.lit(right))).alias("right"), F.get(f, F.lit(score)).try_cast("double").alias("score"))
    return out.where(F.col("score") >= least)


def scan_delimited(spark: SparkSession, path: str, names: list[str], separator: str = "|||", drop_prefixes: Iterable[str] = (), key: str = "docid") -> DataFrame:
    """Fields between a plain separator; rows whose key begins with one of the prefixes go."""
    f = F.split("value", f"\\Q{separator}\\E")
    out = spark.read.text(path).select(*(F.trim(F.get(f, F.lit(i))).alias(c) for i, c in enumerate(names)))
    for p in drop_prefixes:
        out = out.where(~F.startswith(key, F.lit(p)))
    return out


def scan_interleaved_lines(spark: SparkSession, path: str, first: str = "en", second: str = "ja") -> DataFrame:
    """Even lines and odd lines of a file side by side."""
    lines = _numbered(spark, path)
    pair = F.expr("line div 2").alias("pair")
    side = lambda k: F.max(F.when(F.col("line") % 2 == k, F.col("value")))
    return lines.groupBy(pair).agg(side(0).alias(first), side(1).alias(second))


def scan_csv_headered(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with a header; repeated headers and blank lines within the file are dropped."""
    df = spark.read.csv(path, header=True, schema=", ".join(f"{f.split()[0]} string" for f in schema.split(", ")))
    names, kinds = zip(*(f.split() for f in schema.split(", ")), strict=True)
    df = df.where(F.col(names[0]).isNotNull() & (F.lower(F.col(names[0])) != names[0].lower()))
    return df.select(*(F.col(n).try_cast(k).alias(n) for n, k in zip(names, kinds, strict=True)))


def scan_token_info_csv(spark: SparkSession, path: str) -> DataFrame:
    """Headerless (name, path, tokens)."""
    return spark.read.csv(path, schema="name string, path string, tokens bigint")


def scan_many_by_filename(spark: SparkSession, pattern: str, schema: str, number: str = r"iter_(\d+)", least: int = 0, most: int = 1 << 31) -> DataFrame:
    """Headered CSV files of a glob with the number in their names as column `iter`, kept within a range."""
    it = F.regexp_extract(F.input_file_name(), number, 1).cast("int")
    df = spark.read.csv(pattern, header=True, schema=schema).withColumn("iter", it)
    return df.where(F.col("iter").between(least, most) & F.col(df.columns[0]).isNotNull() & (F.col(df.columns[0]) != df.columns[0]))


def scan_loss_dump(spark: SparkSession, pattern: str, dataset: str, ids: DataFrame | None = None, schema: str = "request_id string, losses array<double>, norm_losses array<double>, prediction int, sample struct<dataset: string>") -> DataFrame:
    """Score dumps of checkpoints: one data set's rows, the last line of a request in a file wins.

    Lines are in the order of their file's blocks and within each as they are read.
    """
    at = F.struct(F.col("_metadata.file_block_start"), F.monotonically_increasing_id())
    rows = spark.read.schema(schema).json(pattern).withColumn("at", at).withColumn("file", F.col("_metadata.file_path"))
    rows = rows.where(F.col("sample.dataset") == dataset).withColumn("iter", F.regexp_extract("file", r"iter_(\d+)", 1).try_cast("int"))
    rows = rows.groupBy("file", "iter", "request_id").agg(F.max_by(F.struct("losses", "norm_losses", "prediction"), "at").alias("r")).select("iter", "request_id", "r.*")
    return rows if ids is None else rows.join(ids, "request_id", "left_semi")


@F.pandas_udf(T.StringType())
def _literal(x: pd.Series) -> pd.Series:
    def one(v: str | None) -> str | None:
        try:
            return None if v is None else json.dumps(ast.literal_eval(v), ensure_ascii=False)
        except (ValueError, SyntaxError):
            return None

    return x.map(one)


def scan_python_literal(lines: DataFrame, column: str = "value") -> DataFrame:
    """Python literals (None, True, single quotes) as JSON text, for from_json; null where a line is none."""
    return lines.withColumn("json", _literal(column))


def scan_judgement_md(spark: SparkSession, pattern: str, file: str = r"file=([^/]+)/") -> DataFrame:
    """(file, distractor, criterion, score) from Markdown judgements with `**Score:** n` lines."""
    whole = spark.read.option("recursiveFileLookup", "true").text(pattern, wholetext=True).select(F.regexp_extract(F.col("_metadata.file_path"), file, 1).alias("file"), "value")
    parts = whole.select("file", F.posexplode(F.split("value", r"(?im)^distractor \d+:")).alias("distractor", "part")).where("distractor > 0")
    scores = F.regexp_extract_all("part", F.lit(r"\*\*Score:\*\*\s*(\d)"), F.lit(1))
    return parts.select("file", "distractor", F.posexplode(scores).alias("criterion", "score")).withColumn("score", F.col("score").cast("int"))


def _whole_files(spark: SparkSession, path: str, read: Callable[[bytes], list[tuple]], schema: str) -> DataFrame:
    """Rows of whole binary files, each read by one task."""
    names, types = T._parse_datatype_string(schema).names, T._parse_datatype_string(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        own = to_arrow_schema(types)
        for b in batches:
            for content in b.column(0).to_pylist():
                rows = read(content)
                yield pa.record_batch([pa.array([r[i] for r in rows], own.field(i).type) for i in range(len(names))], schema=own)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, schema)


def scan_sqlite(spark: SparkSession, path: str, query: str, schema: str) -> DataFrame:
    """The rows of a query on an SQLite file (or on each of several); the file may lie wherever Spark reads."""

    def read(content: bytes) -> list[tuple]:
        con = sqlite3.connect(":memory:")
        con.deserialize(content)
        try:
            return con.execute(query).fetchall()
        finally:
            con.close()

    return _whole_files(spark, path, read, schema)


def scan_excel(spark: SparkSession, path: str, columns: list[str], sheet: int = 1) -> DataFrame:
    """The cells of a workbook's sheet as text, by the names in its first row; absent cells are null."""

    def read(content: bytes) -> list[tuple]:
        tag = lambda x: x.tag.rsplit("}", 1)[-1]
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            shared = [] if "xl/sharedStrings.xml" not in z.namelist() else ["".join(y.text or "" for y in x.iter() if tag(y) == "t") for x in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))]
            rows = [x for x in ElementTree.fromstring(z.read(f"xl/worksheets/sheet{sheet}.xml")).iter() if tag(x) == "row"]
        table: list[dict[str, str]] = []
        for row in rows:
            own = {}
            for c in row:
                texts = [y.text or "" for y in c.iter() if tag(y) in ("v", "t")]
                if texts:
                    own["".join(filter(str.isalpha, c.get("r")))] = shared[int(texts[0])] if c.get("t") == "s" else "".join(texts)
            table.append(own)
        names = {v: k for k, v in (table[0] if table else {}).items()}
        return [tuple(row.get(names.get(c, "")) for c in columns) for row in table[1:]]

    return _whole_files(spark, path, read, ", ".join(f"`{c}` string" for c in columns))


def scan_hub_dataset(spark: SparkSession, base: str, name: str, schema: str, split: str | None = None) -> DataFrame:
    """A data set kept as one JSONL file (or folder) for each split, with the split as a column; all splits or one."""
    path = f"{base}/{name}/{split or '*'}.jsonl"
    rows = spark.read.schema(schema).json(path)
    return rows.withColumn("split", F.regexp_extract(F.col("_metadata.file_path"), r"/([^/]+)\.jsonl", 1))


def sink_jsonl(df: DataFrame, path: str) -> None:
    """Overwrite a folder of JSONL parts; nulls are written, so that keys never vanish."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def sink_append_incremental(df: DataFrame, path: str, key: str, batch: str | None = None) -> int:
    """Append the rows whose key no other batch has, as a batch of its own; returns how many they are.

    For one writer at a time: where several may write, or keys are many, use streaming.incremental, whose keys are
    state of a checkpoint.

    A batch that is written again (a retried step names it) replaces what it wrote before, so nothing is doubled. Of
    several rows with a key one is kept. Readers see the batch's name in the column `batch`.
    """
    spark, batch = df.sparkSession, batch or uuid.uuid4().hex
    new, seen = df.dropDuplicates([key]), Observation()
    try:
        done = spark.read.parquet(path)
        new = new.join(done.where(F.col("batch") != batch).select(key), key, "left_anti")
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
    new.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(f"{path}/batch={batch}")
    return seen.get["n"]


def _file_system(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def sink_column_add(spark: SparkSession, path: str, name: str, column: Column) -> DataFrame:
    """A Parquet table with one more column, in place: written beside it, then exchanged with it by renaming.

    The old table is deleted last. If the step fails before that, it still stands: at `path`, or, between the two
    renames, beside it as <path>-before-<id>; a second rename that fails is taken back.
    """
    number = uuid.uuid4().hex
    beside, before = f"{path}-{number}", f"{path}-before-{number}"
    spark.read.parquet(path).withColumn(name, column).write.parquet(beside)
    fs, old = _file_system(spark, path)
    new, aside = (_file_system(spark, x)[1] for x in (beside, before))
    if not fs.rename(old, aside):
        raise OSError(f"could not put {path} aside")
    if not fs.rename(new, old):
        fs.rename(aside, old)
        raise OSError(f"could not put {beside} in the place of {path}")
    fs.delete(aside, True)
    return spark.read.parquet(path)


def sink_md_per_row(df: DataFrame, path: str, index: str, text: str) -> None:
    """A Markdown file for each row, in a folder named file=<index + 2>.md; the rows of one index share a folder."""
    name = F.concat((F.col(index) + 2).cast("string"), F.lit(".md"))
    df.select(F.col(text).alias("value"), name.alias("file")).write.mode("overwrite").partitionBy("file").option("lineSep", "\n").text(path)


def sink_csv_report(df: DataFrame, path: str) -> None:
    """A small metric table as one CSV file with a header."""
    df.coalesce(1).write.mode("overwrite").csv(path, header=True)


def megatron_listing(files: DataFrame, separator: str = " ") -> DataFrame:
    """(path, line, total) from path, tokens, repeat: `<tokens> <path>` with tokens rounded after repeating, and their sum.

    The list of one file system is small (a row per data file), so the total is a window over all rows.
    """
    own = F.round(F.col("tokens") * F.col("repeat")).cast("bigint")
    per = files.select("path", own.alias("n")).groupBy("path").agg(F.sum("n").alias("n"))
    total = per.agg(F.sum("n").alias("total"))
    return per.crossJoin(total).select("path", F.concat_ws(separator, F.col("n").cast("string"), "path").alias("line"), "total")


def sink_pretty_table(df: DataFrame, rows: int = 50) -> str:
    """The first rows of a small report as text; where rows are left out, the last line says so."""
    return df._show_string(rows, False)


def sink_content_addressed(df: DataFrame, recipe: dict, base: str) -> str:
    """Write under the MD5 of the recipe without its zero entries; an existing result is used again."""
    spark = df.sparkSession
    path = f"{base}/{recipe_key(recipe)}"
    fs, done = _file_system(spark, f"{path}/_SUCCESS")
    if not fs.exists(done):
        df.write.mode("overwrite").parquet(path)
    return path


def recipe_key(recipe: dict) -> str:
    clean = drop_zero_entries(recipe)
    return hashlib.md5(json.dumps(clean, sort_keys=True, ensure_ascii=False).encode()).hexdigest()


def drop_zero_entries(recipe: dict) -> dict:
    return {k: (drop_zero_entries(v) if isinstance(v, dict) else v) for k, v in recipe.items() if v != 0}


def merge_config(base: dict, over: dict) -> dict:
    """Recursive override; a scalar in the way of a mapping is replaced."""
    out = dict(base)
    for k, v in over.items():
        out[k] = merge_config(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out
