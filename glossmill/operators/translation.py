"""BLEU of translations: counts of n-grams that add up over rows, so that a row, a group or a corpus is scored alike."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ORDER = 4
COUNTS = {"hits": "array<bigint>", "totals": "array<bigint>", "candidate_length": "bigint", "reference_length": "bigint"}
#: Rows that become Python objects at once.
ROWS = 64
#: Fixed values of the 13a rules: what goes, entities, and marks that stand alone (but for . , and - between digits).
GONE = ["<skipped>", "-\n"]
ENTITIES = {"&quot;": '"', "&amp;": "&", "&lt;": "<", "&gt;": ">"}
RULES = [
    (r"([\x7b-\x7e\x5b-\x60\x20-\x26\x28-\x2b\x3a-\x40\x2f])", " $1 "),
    (r"([^0-9])([.,])", "$1 $2 "),
    (r"([.,])([^0-9])", " $1 $2"),
    (r"([0-9])(-)", "$1 $2 "),
]


def words_13a(text: Column) -> Column:
    """Tokens as the 13a rules cut them; a null text has none."""
    out = F.coalesce(text, F.lit(""))
    for x in GONE:
        out = F.replace(out, F.lit(x), F.lit(""))
    out = F.replace(out, F.lit("\n"), F.lit(" "))
    for x, y in ENTITIES.items():
        out = F.replace(out, F.lit(x), F.lit(y))
    out = F.concat(F.lit(" "), out, F.lit(" "))
    for pattern, by in RULES:
        out = F.regexp_replace(out, pattern, by)
    return F.regexp_extract_all(out, F.lit(r"(\S+)"), F.lit(1))


def characters(text: Column) -> Column:
    """Each character that is no white space: for languages without blanks."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(\S)"), F.lit(1))


def ngram_counts(rows: DataFrame, keys: list[str], candidate: Column, reference: Column) -> DataFrame:
    """keys, hits and totals (arrays by n), candidate_length, reference_length, for each row of rows.

    candidate and reference are arrays of tokens. A row is counted by itself, where it lies: its n-grams are neither
    rows nor shuffled. A hit is counted as often as both sides have it. Empty sides count 0.
    """

    def counted(c: list[str], r: list[str]) -> tuple[list[int], list[int]]:
        hits = []
        for n in range(1, ORDER + 1):
            own, other = (Counter(zip(*(w[k:] for k in range(n)), strict=False)) for w in (c, r))
            hits.append(sum(min(x, other[g]) for g, x in own.items() if g in other))
        return hits, [max(0, len(c) - k) for k in range(ORDER)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, ROWS):
                part = b.slice(at, ROWS)
                c, r = ([x or [] for x in part.column(len(keys) + k).to_pylist()] for k in (0, 1))
                hits, totals = zip(*map(counted, c, r), strict=True)
                lengths = (pa.array(map(len, x), pa.int64()) for x in (c, r))
                yield pa.record_batch([*part.columns[: len(keys)], *(pa.array(x, pa.list_(pa.int64())) for x in (hits, totals)), *lengths], names=[*keys, *COUNTS])

    own = rows.select(*keys, candidate.alias("_c"), reference.alias("_r"))
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema.fields[: len(keys)]]
    return own.mapInArrow(run, ", ".join([*kinds, *(f"{x} {kind}" for x, kind in COUNTS.items())]))


def summed(counts: DataFrame, *keys: str, more: list[Column] = ()) -> DataFrame:
    """Counts added up by keys: those of a group or, without keys, of a corpus; with `more` aggregates of the same rows."""
    arrays = [F.array(*(F.sum(F.col(a)[i]) for i in range(ORDER))).alias(a) for a in ("hits", "totals")]
    return counts.groupBy(*keys).agg(*arrays, *(F.sum(c).alias(c) for c in ("candidate_length", "reference_length")), *more)


def bleu(hits: Column, totals: Column, candidate_length: Column, reference_length: Column) -> Column:
    """BLEU in percent of counts. The k-th order without a hit counts as a 2 ** k-th of a hit; without any hit, or with
    fewer than ORDER tokens, it is 0."""
    logs, misses = F.lit(0.0), F.lit(0)
    for n in range(ORDER):
        miss = hits[n] == 0
        misses = misses + F.when(miss, 1).otherwise(0)
        share = F.when(miss, 1 / F.pow(F.lit(2.0), misses)).otherwise(hits[n]) / F.when(totals[n] > 0, totals[n])
        logs = logs + F.log(share)
    brevity = F.when(candidate_length < reference_length, F.exp(1 - reference_length / candidate_length)).otherwise(F.lit(1.0))
    return F.when((hits[0] > 0) & (totals[ORDER - 1] > 0), 100 * brevity * F.exp(logs / ORDER)).otherwise(F.lit(0.0))


def score(counts: DataFrame) -> DataFrame:
    return counts.withColumn("bleu", bleu(*(F.col(c) for c in ("hits", "totals", "candidate_length", "reference_length"))))
