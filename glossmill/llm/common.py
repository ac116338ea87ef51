"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager, suppress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters of text that one step of a Python operator holds as Python objects.
STEP_CHARS = 1_500_000
#: Rows that Spark hands to a Python worker at once: with long texts, 10,000 would be hundreds of MB.
BATCH_ROWS = 1_000
#: And bytes: Spark's own bound is 64 MB, which the JVM and the worker each hold more than once.
BATCH_BYTES = 4 << 20
#: Deletes the shuffle files of a step when its rows are written, not when the driver's garbage is collected.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_WRITTEN: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """A new path in the folder that driver and executors share (spark.checkpoint.dir).

    Only where the session names none and runs on one machine (local master), as in tests, a local folder stands in.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="glossmill-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/glossmill-{uuid.uuid4().hex}"


def batch_settings(batch_bytes: int = BATCH_BYTES) -> dict[str, str]:
    return {"spark.sql.execution.arrow.maxRecordsPerBatch": str(BATCH_ROWS), "spark.sql.execution.arrow.maxBytesPerBatch": str(batch_bytes)}


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Session settings for one action; afterwards they are as before."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def small_batches(spark: SparkSession) -> SparkSession:
    """For an application's session: bounds the Arrow batches of plans that run when the caller asks for their rows."""
    for k, v in batch_settings().items():
        spark.conf.set(k, v)
    return spark


def store(df: DataFrame, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """Write df to the shared folder as Parquet and read it back: cuts lineage and survives lost executors.

    The step runs with small Arrow batches, and its shuffle files go when it is done. drop() deletes the table; what
    is left is deleted when the driver ends.
    """
    spark, path = df.sparkSession, shared_dir(df.sparkSession)
    with settings(spark, batch_settings(batch_bytes) | {CLEANUP: "true"}):
        df.select("*").write.parquet(path)  # a new plan, so that the settings hold for it
    if not _WRITTEN:
        atexit.register(drop_rest)
    _WRITTEN[path] = spark
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def drop(*tables: DataFrame) -> None:
    """Delete stored tables that no later plan reads."""
    for df in tables:
        _delete(df._stored_at)


def _delete(path: str) -> None:
    spark = _WRITTEN.pop(path, None)
    if spark is not None and (jvm := getattr(spark, "_jvm", None)) is not None:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def drop_rest() -> None:
    for path in list(_WRITTEN):
        with suppress(Exception):  # the session may have ended before
            _delete(path)


def trim() -> None:
    """Give freed memory of a worker back to the system, where the C library can: idle workers stay alive."""
    pa.default_memory_pool().release_unused()
    with suppress(AttributeError, OSError):
        ctypes.CDLL(None).malloc_trim(0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: Column) -> Column:
    """True for the rows kept out of training: crc32 of doc_id as text, modulo 4, is 2 (null id: of the empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def sample_of(key: Column, total: int, bound: int, seed: str) -> Column:
    """True for a fixed pseudo-random choice of rows by key, about `bound` of `total` (all if there are fewer)."""
    if total <= bound:
        return F.lit(True)
    return F.pmod(F.xxhash64(F.lit(seed), key), F.lit(1 << 40)) < int((1 << 40) * bound / total)


def steps(batches: Iterator[pa.RecordBatch], column: str, chars: int = STEP_CHARS) -> Iterator[pa.RecordBatch]:
    """Cut record batches into pieces of about `chars` bytes of `column` (at least a row each)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        i = batch.schema.get_field_index(column)
        sizes = pc.fill_null(pc.binary_length(batch.column(i)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes, dtype=np.int64)
        start = 0
        while start < batch.num_rows:
            before = int(ends[start - 1]) if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + chars, "right")))
            yield batch.slice(start, stop - start)
            start = stop


def map_arrow(df: DataFrame, fn: Callable, schema: str, *columns: str) -> DataFrame:
    """mapInArrow over the named columns only, so that the scan reads no others; afterwards a worker frees its memory."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from fn(batches)
        trim()

    return df.select(*columns).mapInArrow(run, schema)


def fresh(columns: list[str], name: str) -> str:
    """A column name that none of `columns` has, whatever its case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name
