"""What the jobs share: config files, logging, and a session for the command line."""

from __future__ import annotations

import argparse
import json
import logging
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import SparkSession

LOG = logging.getLogger("jobs")


def read_config(spark: SparkSession, path: str, known: dict) -> dict:
    """A JSON object over the defaults in `known`, read through Spark; an unknown name raises."""
    given = json.loads(spark.read.text(path, wholetext=True).first()["value"])
    if unknown := sorted(set(given) - set(known)):
        raise ValueError(f"{path} has unknown settings: {unknown}")
    return known | given


def command_line(about: str, config: Path, paths: dict[str, str], run: Callable[..., object], known: dict, argv: list[str] | None = None) -> None:
    """Parse paths and the config's place, start a session, run, stop the session."""
    parser = argparse.ArgumentParser(description=about)
    for name, what in paths.items():
        parser.add_argument(f"--{name}", required=True, help=what)
    parser.add_argument("--config", default=str(config), help="JSON file (default: %(default)s)")
    args = parser.parse_args(argv)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(levelname)s %(message)s")
    spark = SparkSession.builder.appName(config.stem).getOrCreate()
    try:
        run(spark, *(getattr(args, name) for name in paths), read_config(spark, args.config, known))
    finally:
        spark.stop()
