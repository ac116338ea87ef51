"""Feed new documents to annotation: their sentences, with request ids, each document once.

    python -m jobs.sentence_feed --documents DIR --output DIR --checkpoint DIR [--config FILE]

documents (doc_id, text, lang) is a Parquet table to which files are added, given as its folder or a pattern. Each run reads the files that no run
before has read, drops documents whose id came before (in an earlier file or run), cuts the others into sentences, and
appends those of least_words words or more, partitioned by language, as requests that a model or an annotator works
through. Documents without an id, a text or a configured language are left out. What was read and which ids were seen
is in the checkpoint alone; a run that fails is taken up where it stopped, and a run without new files adds nothing.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossmill.functions import structure
from glossmill.streaming.incremental import feed

from .common import LOG, command_line

CONFIG = Path(__file__).with_suffix(".json")
DEFAULTS = {"languages": [], "least_words": 1, "files_per_batch": 64}
DOCUMENTS = "doc_id bigint, text string, lang string"
SENTENCES = "request_id string, doc_id bigint, sentid int, sentence string, words int, lang string"


def sentences(docs: DataFrame, config: dict) -> DataFrame:
    each = docs.select("doc_id", "lang", F.posexplode(structure.sentences(F.col("text"))).alias("sentid", "sentence"))
    words = F.size(F.regexp_extract_all("sentence", F.lit(r"([^\x20\x09-\x0D]+)")))
    named = F.concat(F.col("doc_id").cast("string"), F.lit("_sentid:"), F.col("sentid").cast("string"))
    return each.select(named.alias("request_id"), "doc_id", "sentid", "sentence", words.alias("words"), "lang").where(F.col("words") >= config["least_words"])


def run(spark: SparkSession, documents: str, output: str, checkpoint: str, config: dict) -> DataFrame:
    """Take what is new, wait until it is written, and return the whole output as it stands."""
    stream = spark.readStream.schema(DOCUMENTS).option("maxFilesPerTrigger", config["files_per_batch"]).parquet(documents)
    fit = F.coalesce(F.col("doc_id").isNotNull() & F.col("text").isNotNull() & F.col("lang").isin(config["languages"]), F.lit(False))
    seen = stream.observe("input", F.count_if(~fit).alias("left_out"))
    query = feed(sentences(seen.where(fit).dropDuplicates(["doc_id"]), config), output, checkpoint, ["lang"])
    query.awaitTermination()
    read = sum(p.numInputRows for p in query.recentProgress)
    new = sum(s.numRowsUpdated for p in query.recentProgress for s in p.stateOperators)
    left_out = sum(p.observedMetrics["input"]["left_out"] for p in query.recentProgress if p.numInputRows and "input" in p.observedMetrics)
    out = spark.read.schema(SENTENCES).parquet(output)
    LOG.info("read %d new rows from %s: %d new documents, %d rows left out; %s now has %d sentences", read, documents, new, left_out, output, out.count())
    return out


if __name__ == "__main__":
    command_line(__doc__.split("\n")[0], CONFIG, {"documents": "Parquet table that grows", "output": "folder to append to", "checkpoint": "folder of the stream's checkpoint"}, run, DEFAULTS)
