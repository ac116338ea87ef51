"""Incremental processing: new files are read as a stream, each key once; Spark's checkpoint remembers files and keys."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

#: Keys that were seen are kept on disk, not in the executors' heaps.
STATE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Session settings for what runs inside; afterwards they are as before."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def feed(stream: DataFrame, sink: str, checkpoint: str, partition_by: list[str] | None = None) -> StreamingQuery:
    """Append what is new in a stream to a Parquet sink, and stop when all is read.

    The sink is Spark's own: its log and the checkpoint make each batch appear once, whole or not at all, after a
    failure as well. Read it as a folder, so that the log counts.
    """
    writer = stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True)
    with settings(stream.sparkSession, STATE):
        return (writer.partitionBy(*partition_by) if partition_by else writer).start(sink)


def resume_stream(spark: SparkSession, source: str, schema: str, key: str, sink: str, checkpoint: str, transform: Callable[[DataFrame], DataFrame] = lambda df: df) -> StreamingQuery:
    """Append the transformed rows of new JSON files to a Parquet sink, each key once, and stop when all is read.

    Keys are held as state in the checkpoint, partitioned by key, so that a batch costs what it brings, not what the
    sink holds. Of several rows with a key the first to arrive is kept; a null key is one key.
    """
    stream = spark.readStream.schema(schema).json(source).dropDuplicates([key])
    return feed(transform(stream), sink, checkpoint)
