"""Token-budgeted mixtures."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ranking import global_places, range_of, stored_order


#: A budget in tokens, or how to work it out from all tokens of a source.
Budget = int | Callable[[int], int]


def percent(n: int) -> Callable[[int], int]:
    """A budget of n hundredths of a source's tokens; more than 100 reads it again."""
    return lambda total: -(-total * n // 100)


def budget_prefixes(rows: DataFrame, source: str, tokens: str, budgets: dict[str, Budget], order: str) -> DataFrame:
    """For each source, its rows in order until their tokens reach its budget; the row that crosses it is included.

    Returns the rows with `cycle` (0 for the first reading): a source whose tokens do not suffice is read again. Rows
    of other sources are left out. All sources are stored in one order (source, order), so that the token sums by
    range (a few thousand numbers) and the rows that are taken come from the same ranges, and a large source lies in
    many of them. Ranges that end within the budget are taken as they are, without a shuffle; only the range of a
    source in which its budget is crossed is summed row by row. Whole cycles below the last are copies. `order` must
    be unique within a source. Null tokens count as none; a source without tokens raises.
    """
    spark = rows.sparkSession
    stored = stored_order(rows.where(F.col(source).isin(list(budgets))), source, order).withColumn("_part", range_of("_row"))
    sums = sorted((r[source], r["_part"], r["n"] or 0) for r in stored.groupBy(source, "_part").agg(F.sum(tokens).alias("n")).collect())
    totals: dict[str, int] = dict.fromkeys(budgets, 0)
    for name, _, n in sums:
        totals[name] += n
    if lacking := sorted(k for k, n in totals.items() if n <= 0):
        raise ValueError(f"sources without tokens, whose budgets cannot be reached: {lacking}")
    plan, before = [], dict.fromkeys(budgets, 0)
    for name, part, n in sums:
        budget = budgets[name]
        cycles, rest = divmod(budget(totals[name]) if callable(budget) else budget, totals[name])
        plan.append((name, part, cycles, rest - before[name], n))
        before[name] += n
    # a row per range and source: bounded by the partitions
    at = F.broadcast(spark.createDataFrame(plan, f"`{source}` string, _part int, _cycles int, _left bigint, _sum bigint"))
    placed = stored.join(at, [source, "_part"])
    again = placed.where("_cycles > 0").select(*rows.columns, F.explode(F.sequence(F.lit(0), F.col("_cycles") - 1)).alias("cycle"))
    inside = placed.where("_sum < _left").select(*rows.columns, F.col("_cycles").alias("cycle"))
    so_far = F.coalesce(F.sum(tokens).over(Window.partitionBy(source, "_part").orderBy("_row").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    crossing = placed.where("_left > 0 AND _sum >= _left").withColumn("_so_far", so_far).where("_so_far < _left")
    return again.unionByName(inside).unionByName(crossing.select(*rows.columns, F.col("_cycles").alias("cycle")))


def last_places(chosen: DataFrame, source: str, order: str) -> dict[str, list[tuple[int, str]]]:
    """For each source, (cycle, the last `order` that is read in it), of the rows of budget_prefixes.

    A row of a source is in a cycle if its order is not beyond that, so rows need not be stored in order with their
    texts. A row per source and cycle comes to the driver.
    """
    out: dict[str, list[tuple[int, str]]] = {}
    for r in chosen.groupBy(source, "cycle").agg(F.max(order).alias("last")).collect():
        out.setdefault(r[source], []).append((r["cycle"], r["last"]))
    return {k: sorted(x) for k, x in out.items()}


def budget_prefix(rows: DataFrame, tokens: str, budget: Budget, order: str) -> DataFrame:
    """budget_prefixes of one source."""
    return budget_prefixes(rows.withColumn("_source", F.lit("")), "_source", tokens, {"": budget}, order).drop("_source")


def exclude(rows: DataFrame, key: str, held: DataFrame) -> DataFrame:
    """Rows whose key is not among the held ones (evaluation items must not leak into training)."""
    return rows.join(held.select(key).distinct(), key, "left_anti")


def restrict(rows: DataFrame, key: str, allowed: DataFrame) -> DataFrame:
    return rows.join(allowed.select(key).distinct(), key, "left_semi")


def mix(sources: dict[str, tuple[DataFrame, Budget]], tokens: str, order: str) -> DataFrame:
    """The budgeted prefixes of several sources, tagged with their names."""
    parts = (rows.withColumn("data_type", F.lit(name)) for name, (rows, _) in sources.items())
    return budget_prefixes(reduce(DataFrame.unionByName, parts), "data_type", tokens, {k: b for k, (_, b) in sources.items()}, order)


def tuning_head(rows: DataFrame, n: int, key: str, allowed: DataFrame | None = None) -> DataFrame:
    """(key, type, place): the first n rows by key, of allowed keys if any are named, tagged as tuning."""
    if allowed is not None:
        rows = restrict(rows, key, allowed)
    return global_places(rows, F.col(key)).where(F.col("place") <= n).select(key, F.lit("tuning").alias("type"), "place")


def first_seen(rows: DataFrame, n: int, order: str, key: str) -> DataFrame:
    """(key, pos): the distinct keys of the first n rows by `order` and the place where each is first seen."""
    return global_places(rows, F.col(order)).where(F.col("place") <= n).groupBy(key).agg(F.min("place").alias("pos"))


def shared_prefixes(texts: DataFrame, n: int, key: str) -> DataFrame:
    """(key, sharing): texts of n characters or more whose first n also begin other texts, and how many. Counted by prefix."""
    own = texts.where(F.length("text") >= n).select(key, F.substring("text", 1, n).alias("_prefix"))
    shared = own.groupBy("_prefix").agg(F.count_distinct(key).alias("_n")).where("_n > 1")
    return own.distinct().join(shared, "_prefix").select(key, (F.col("_n") - 1).alias("sharing"))


def guard_budgets(budgets: dict[str, int], large: int = 500_000_000) -> None:
    """Only one knowledge source may have the large budget."""
    if sum(b >= large for b in budgets.values()) > 1:
        raise ValueError("more than one source has the large budget")
