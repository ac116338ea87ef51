"""Build a bilingual training corpus: documents without evaluation passages, as instructions, mixed by token budgets.

    python -m jobs.training_mixture --documents DIR --benchmark DIR --output DIR [--config FILE]

documents (doc_id, text, lang) and benchmark (text) are Parquet tables. Documents that share a run of leak_words words
with a benchmark text are left out, as are those without an id, a text, a configured language or least_sentences
sentences; of several texts of a doc_id the least is kept. Each language is read in an order drawn by the seed until
its instructions have `percent` hundredths of all its tokens (words); over 100, it is read again.

Written under the output folder, each time anew and as a whole, so that a rerun gives the same:
  records/lang=…              doc_id, abstract, title, sentences
  mixture/lang=…/mode=…       doc_id, text, tokens, cycle
  report                      rows, tokens and documents by language and mode, as JSON
"""

from __future__ import annotations

from functools import reduce
from operator import or_
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossmill.functions import structure
from glossmill.operators import instructions, leakage, mixture
from glossmill.sources.files import scratch, temporary

from .common import LOG, command_line

CONFIG = Path(__file__).with_suffix(".json")
DEFAULTS = {"percent": {}, "modes": ["pure_text"], "least_sentences": 1, "leak_words": 13, "seed": "mixture"}
#: Of all that is written: what is read again stands next to its first reading, and takes little room so.
WRITTEN = {"compression": "zstd"}
MIXTURE = "doc_id bigint, text string, tokens bigint, cycle int, lang string, mode string"


def with_sentences(texts: DataFrame, least: int) -> DataFrame:
    """texts with the sentences of their abstracts, where there are so many; a generator keeps the filter above it, so that a text is cut once."""
    cut = F.explode(F.array(structure.sentences(F.col("abstract")))).alias("sentences")
    return texts.select("*", cut).where(F.size("sentences") >= least)


def write_records(spark: SparkSession, documents: str, benchmark: str, output: str, config: dict) -> DataFrame:
    docs = spark.read.parquet(documents)
    held = spark.read.parquet(benchmark)
    LOG.info("read %d documents from %s and %d benchmark texts from %s", docs.count(), documents, held.count(), benchmark)
    usable = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull() & F.col("lang").isin(list(config["percent"])))
    clean = mixture.exclude(usable, "doc_id", leakage.leaking(usable, "doc_id", held, config["leak_words"]))
    one = clean.groupBy("lang", "doc_id").agg(F.min("text").alias("abstract"))
    parts = with_sentences(one, config["least_sentences"])
    path = f"{output}/records"
    parts.withColumn("title", F.get("sentences", F.lit(0))).write.mode("overwrite").partitionBy("lang").parquet(path, **WRITTEN)
    records = spark.read.schema("abstract string, title string, sentences array<string>, doc_id bigint, lang string").parquet(path)
    LOG.info("wrote %d records to %s", records.count(), path)
    return records


def run(spark: SparkSession, documents: str, benchmark: str, output: str, config: dict) -> DataFrame:
    """Write records, mixture and report; returns the mixture as it stands."""
    records = write_records(spark, documents, benchmark, output, config)
    named = records.withColumn("docid", F.concat_ws(":", "lang", "doc_id"))
    made = instructions.dispatch(named, config["modes"])
    rows = made.select(
        F.substring_index("docid", ":", 1).alias("lang"),
        F.substring_index("docid", ":", -1).cast("bigint").alias("doc_id"),
        "mode",
        "text",
        F.size(F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)"))).cast("bigint").alias("tokens"),
        F.md5(F.concat_ws(":", F.lit(config["seed"]), "docid", "mode")).alias("place"),
    )
    budgets = {lang: mixture.percent(n) for lang, n in config["percent"].items()}
    with temporary():
        # the order is of counts alone; texts are made again for the rows that it takes, and stored in the mixture only
        path = scratch(spark)
        counts = rows.select("lang", "tokens", "place")
        counts.write.parquet(path, **WRITTEN)
        last = mixture.last_places(mixture.budget_prefixes(spark.read.schema(counts.schema).parquet(path), "lang", "tokens", budgets, "place"), "lang", "place")
    read = F.lit(None).cast("array<int>")  # the cycles that a row is read in
    for lang, cycles in last.items():
        read = F.when(F.col("lang") == lang, F.filter(F.array(*(F.when(F.col("place") <= end, F.lit(n)) for n, end in cycles)), lambda n: n.isNotNull())).otherwise(read)
    inside = reduce(or_, ((F.col("lang") == lang) & (F.col("place") <= max(end for _, end in cycles)) for lang, cycles in last.items()), F.lit(False))
    mixed = rows.where(inside).withColumn("cycle", F.explode(read))
    path = f"{output}/mixture"
    mixed = mixed.sortWithinPartitions("lang", "mode", "place", "cycle").select("doc_id", "text", "tokens", "cycle", "lang", "mode")
    mixed.write.mode("overwrite").partitionBy("lang", "mode").parquet(path, **WRITTEN)
    out = spark.read.schema(MIXTURE).parquet(path)
    report = out.groupBy("lang", "mode").agg(F.count(F.lit(1)).alias("rows"), F.sum("tokens").alias("tokens"), F.count_distinct("doc_id").alias("documents"))
    report.coalesce(1).write.mode("overwrite").json(f"{output}/report")
    for r in spark.read.json(f"{output}/report").orderBy("lang", "mode").collect():  # a row per configured language and mode
        LOG.info("wrote %s %s: %d rows, %d tokens, %d documents", r["lang"], r["mode"], r["rows"], r["tokens"], r["documents"])
    return out


if __name__ == "__main__":
    command_line(__doc__.split("\n")[0], CONFIG, {"documents": "Parquet table of documents", "benchmark": "Parquet table of evaluation texts", "output": "folder to write"}, run, DEFAULTS)
