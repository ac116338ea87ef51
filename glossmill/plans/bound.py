"""Queries that apply the library's operators to the driver tables, each with an oracle written on its own.

A query gets a Tables object: t("name") is a table, t.sql(text) runs Spark SQL over them. Its oracle is DuckDB SQL that
states the same semantics in another way; where SQL cannot, there is none and a test holds the operator against brute force.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
_NAME = re.compile(r"\b(FROM|JOIN)\s+(" + "|".join(TABLES) + r")\b")

#: What Spark hands to a Python worker at once: of long texts, its own 10,000 rows or 64 MB are held several times over by
#: each of an executor's workers.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20)}

BOUND: dict[str, Callable[[Tables], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def run_sql(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """Run Spark SQL in which table names stand for the Parquet tables of sf_dir; only these are read."""
    names = {m[1] for m in _NAME.findall(text)}
    escaped = text.replace("{", "{{").replace("}", "}}")
    return spark.sql(_NAME.sub(lambda m: f"{m[1]} {{{m[2]}}}", escaped), **{n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names})


@dataclass(frozen=True)
class Tables:
    spark: SparkSession
    sf_dir: str

    def __post_init__(self):
        for k, v in BATCHES.items():
            self.spark.conf.set(k, v)  # plans run when the caller asks for their rows

    def __call__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def sql(self, text: str) -> DataFrame:
        return run_sql(self.spark, self.sf_dir, text)


def bind(name: str, oracle: str | None = None) -> Callable:
    """Register a query under a name, with its oracle."""

    def put(fn: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        if name in BOUND:
            raise ValueError(f"{name} is bound twice")
        BOUND[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return put
