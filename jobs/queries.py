"""The jobs as queries on the whole driver tables, with their SQL.

Each runs its job twice into one new folder, which stays, and returns the output as it stands after the second run.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from glossmill.plans.bound_operators import template_sql, uniform_sql
from glossmill.plans.bound_texts import SENTENCES
from glossmill.sources.files import scratch

from . import sentence_feed, training_mixture
from .common import read_config


def job1_training_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    config = read_config(spark, str(training_mixture.CONFIG), training_mixture.DEFAULTS)
    output = scratch(spark, keep=True)
    for _ in range(2):
        out = training_mixture.run(spark, f"{sf_dir}/documents.parquet", f"{sf_dir}/benchmark.parquet", output, config)
    return out


def job2_sentence_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    config = read_config(spark, str(sentence_feed.CONFIG), sentence_feed.DEFAULTS)
    folder = scratch(spark, keep=True)
    for _ in range(2):
        # a pattern: the table may be one file, which a stream reads by a pattern only
        out = sentence_feed.run(spark, f"{sf_dir}/documents.parquet*", f"{folder}/sentences", f"{folder}/checkpoint", config)
    return out


#: Hundredths of each language's tokens, as in training_mixture.json.
_PERCENT = {"en": 40, "de": 150, "fr": 150, "es": 250}
_KEY = "docid"

MIXTURE = f"""
WITH grams AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 12], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM (
    SELECT doc_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') AS w FROM documents WHERE text IS NOT NULL) AS d) AS e
), held AS (
  SELECT DISTINCT array_to_string(w[i:i + 12], ' ') AS g FROM (SELECT w, unnest(range(1, len(w) - 11)) AS i FROM (
    SELECT regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') AS w FROM benchmark WHERE text IS NOT NULL) AS d) AS e
), rec AS (
  SELECT x.doc_id, d.lang, d.lang || ':' || x.doc_id AS docid, x.s, x.s[1] AS title, d.text AS abstract
  FROM (SELECT DISTINCT doc_id, s FROM ({SENTENCES}) AS s) AS x JOIN documents AS d ON d.doc_id = x.doc_id
  WHERE d.text IS NOT NULL AND len(x.s) >= 2 AND d.lang IN ('en', 'de', 'fr', 'es') AND d.doc_id NOT IN (SELECT doc_id FROM grams JOIN held USING (g) WHERE doc_id IS NOT NULL)
), cut AS (
  SELECT *, 1 + CAST(floor({uniform_sql(_KEY)} * (len(s) - 1)) AS INT) AS i FROM rec
), made AS (
  SELECT doc_id, lang, docid, 'summarization' AS mode, {template_sql("summarization", _KEY, a="abstract", b="title")} AS text FROM rec
  UNION ALL SELECT doc_id, lang, docid, 'completion', {template_sql("completion", _KEY, a="array_to_string(s[1:i], ' ')", b="array_to_string(s[i + 1:], ' ')")} FROM cut
  UNION ALL SELECT doc_id, lang, docid, 'pure_text', abstract FROM rec
), counted AS (
  SELECT *, len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS tokens, md5('mixture:' || docid || ':' || mode) AS place FROM made
), budgets AS (
  SELECT lang, (sum(tokens) * max(CASE lang {" ".join(f"WHEN '{k}' THEN {n}" for k, n in _PERCENT.items())} END) + 99) // 100 AS budget FROM counted GROUP BY lang
), running AS (
  SELECT c.*, r.cycle, b.budget, coalesce(sum(tokens) OVER (PARTITION BY c.lang ORDER BY r.cycle, c.place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM counted AS c JOIN budgets AS b ON b.lang = c.lang CROSS JOIN range(3) AS r(cycle)
)
SELECT doc_id, text, CAST(tokens AS BIGINT) AS tokens, CAST(cycle AS INT) AS cycle, lang, mode FROM running WHERE before < budget
"""

FEED = f"""
WITH one AS (SELECT doc_id, min(lang) AS lang FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL AND lang IN ('en', 'de', 'fr', 'es') GROUP BY doc_id),
each AS (SELECT doc_id, CAST(unnest(range(len(s))) AS INT) AS sentid, unnest(s) AS sentence FROM ({SENTENCES}) AS x),
counted AS (SELECT *, CAST(len(regexp_extract_all(sentence, '[^\\x20\\x09-\\x0D]+')) AS INT) AS words FROM each)
SELECT c.doc_id || '_sentid:' || c.sentid AS request_id, c.doc_id, c.sentid, c.sentence, c.words, o.lang FROM counted AS c JOIN one AS o ON o.doc_id = c.doc_id WHERE c.words >= 3
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (job1_training_mixture, job2_sentence_feed)}
ORACLES = {"job1_training_mixture": MIXTURE, "job2_sentence_feed": FEED}
