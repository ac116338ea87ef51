"""Places in a global order, without one task that sorts everything."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.files import scratch

#: The low bits of a row number hold the place within a range, the others the range (Spark's monotonically_increasing_id).
PLACE_BITS = 33


def stored_order(rows: DataFrame, *order: Column | str, name: str = "_row") -> DataFrame:
    """rows, written once to the shared folder in an order over all of them, with a number that rises in that order.

    Spark draws the bounds of ranges anew each time a plan runs, so what is counted by range in one run says nothing
    about the ranges of another. Here the ranged rows and their numbers are written in one run; all later steps read
    the same files. Rows that tie in the order are numbered too, in an order that the files fix.
    """
    path = scratch(rows.sparkSession)
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(name, F.monotonically_increasing_id())
    ranged.write.parquet(path)
    return rows.sparkSession.read.schema(ranged.schema).parquet(path)


def numbered(rows: DataFrame, name: str = "_row") -> DataFrame:
    """rows, written once to the shared folder, each with a number of its own.

    A number that a plan makes is another one where the plan runs in a second branch; those of a stored table stay.
    """
    path = scratch(rows.sparkSession)
    own = rows.withColumn(name, F.monotonically_increasing_id())
    own.write.parquet(path)
    return rows.sparkSession.read.schema(own.schema).parquet(path)


def range_of(row: Column | str) -> Column:
    """The range that a row number of stored_order lies in."""
    return F.shiftrightunsigned(row, PLACE_BITS).cast("int")


def global_places(rows: DataFrame, *order: Column | str, name: str = "place", first: int = 1) -> DataFrame:
    """rows with their places (from `first`, without gaps or doubles) in an order over all of them.

    The rows are stored in order (stored_order); each range counts its rows, the counts of the ranges before it (a row
    per range) are its offset, and a row's place is that offset and its number within the range: no further shuffle.
    The order must be unique for places that do not depend on the run. An empty table has no rows.
    """
    stored = stored_order(rows, *order)
    own = F.col("_row").bitwiseAND((1 << PLACE_BITS) - 1)
    counts = sorted((r["part"], r["n"]) for r in stored.groupBy(range_of("_row").alias("part")).agg(F.count(F.lit(1)).alias("n")).collect())
    offsets, total = [], first
    for part, n in counts:
        offsets.append((part, total))
        total += n
    at = rows.sparkSession.createDataFrame(offsets, "_part int, _offset bigint")
    # a row per range: its number is bounded by the partitions
    placed = stored.withColumn("_part", range_of("_row")).join(F.broadcast(at), "_part")
    return placed.withColumn(name, F.col("_offset") + own).drop("_part", "_offset", "_row")


def first_by(value: Column | str, *keys: Column | str) -> Column:
    """An aggregate: the value of the row with the least keys."""
    return F.min_by(value, F.struct(*keys))


def overlap_order(rows: DataFrame, overlap: Column, is_base: Column, key: str) -> tuple[DataFrame, DataFrame]:
    """(high, low): base rows first by key, then the others by falling and by rising overlap, with their places.

    The rising order is the exact reverse of the falling one.
    """
    base = F.when(is_base, 0).otherwise(1)
    none = F.when(is_base, F.lit(0.0)).otherwise(overlap)
    k = F.col(key)
    signed = F.when(is_base, k).otherwise(-k)
    return global_places(rows, base, none.desc(), k), global_places(rows, base, none, signed)
