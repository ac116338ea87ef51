"""All queries with their oracles: plans that are one statement for both engines, and bound operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bound_files, bound_operators, bound_texts, texts  # noqa: F401  (they register what they hold)
from .bound import BOUND, ORACLES, TABLES, Tables, run_sql
from .catalog import PLANS
from .dialect import Duck, Spark

__all__ = ["TABLES", "oracles", "queries", "run_sql"]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    stated = {name: (lambda spark, sf_dir, fn=fn: run_sql(spark, sf_dir, fn(Spark()))) for name, fn in PLANS.items()}
    return stated | {name: (lambda spark, sf_dir, fn=fn: fn(Tables(spark, sf_dir))) for name, fn in BOUND.items()}


def oracles() -> dict[str, str]:
    return {name: fn(Duck()) for name, fn in PLANS.items()} | ORACLES
