"""Chinese texts in Latin letters, word by word: the best path through a lattice of a lexicon's words.

The lexicon is a table (word, reading, weight) of any size. Each distinct run of Han characters is looked up once,
however many texts have it: its substrings meet the lexicon by a join, and the words found in a run are the edges of a
small lattice, in which a short pass finds the path of the largest product of weights.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranking import numbered

HAN = r"\p{IsHan}"


def best_path(run: str, edges: list[dict], unknown: float) -> list[str]:
    """The readings of a run's words on the cheapest path; characters of no word stay, neighbours together.

    edges: i, n, reading, cost. A character of no word costs `unknown`. Of equal paths the one with the longer last
    words wins, then the first reading.
    """
    at: dict[int, list[tuple]] = {}
    for e in edges:
        at.setdefault(e["i"] + e["n"], []).append((e["cost"], -e["n"], e["reading"]))
    best: list[tuple] = [(0.0, 0, None)]
    for end in range(1, len(run) + 1):
        options = [(best[end - 1][0] + unknown, 1, 1, "")]
        options += [(best[end + back][0] + cost, 0, back, reading) for cost, back, reading in at.get(end, ())]
        cost, is_unknown, back, reading = min(options)
        best.append((cost, 1 if is_unknown else -back, None if is_unknown else reading))
    out: list[str] = []
    end, open_ = len(run), False
    while end:
        _, n, reading = best[end]
        if reading is not None:
            out.append(reading)
        elif open_:
            out[-1] = run[end - 1] + out[-1]
        else:
            out.append(run[end - 1])
        open_ = reading is None
        end -= n
    return out[::-1]


def _paths(run: Column, edges: Column, unknown: float) -> Column:
    @F.pandas_udf("string")
    def paths(runs: pd.Series, found: pd.Series) -> pd.Series:
        return pd.Series([" ".join(best_path(r, [] if e is None else list(e), unknown)) for r, e in zip(runs, found, strict=True)], dtype=object)

    return paths(run, edges)


def romanized(rows: DataFrame, text: str, lexicon: DataFrame, name: str = "roman") -> DataFrame:
    """rows with `name`: the text with each run of Han characters read word by word, words apart by blanks.

    Other characters stay; white space before a mark goes. A word with several readings has that of the largest
    weight; weights are counts. A character of no word stays as it is. A null text gives null.
    """
    one = lexicon.where("word <> '' AND weight > 0").groupBy("word").agg(F.max_by("reading", F.struct("weight", "reading")).alias("reading"), F.max("weight").alias("weight"))
    stats = one.agg(F.max(F.length("word")).alias("longest"), F.sum("weight").alias("total")).collect()[0]
    longest, total = stats["longest"] or 1, float(stats["total"] or 1)
    own = numbered(rows)
    pieces = own.select("_row", F.col(text).alias("_text")).select("_row", F.posexplode(F.regexp_extract_all("_text", F.lit(f"([{HAN}]+|[^{HAN}]+)"))).alias("_i", "_piece"))
    runs = pieces.where(F.regexp_like("_piece", F.lit(f"^[{HAN}]"))).select("_piece").distinct()
    starts = runs.select("_piece", F.explode(F.sequence(F.lit(0), F.length("_piece") - 1)).alias("i"))
    words = starts.withColumn("n", F.explode(F.sequence(F.lit(1), F.least(F.lit(longest), F.length("_piece") - F.col("i"))))).withColumn("word", F.substring("_piece", F.col("i") + 1, F.col("n")))
    cost = (F.lit(math.log(total)) - F.log("weight")).alias("cost")
    edges = words.join(one, "word").groupBy("_piece").agg(F.collect_list(F.struct("i", "n", "reading", cost)).alias("_edges"))
    read = runs.join(edges, "_piece", "left").select("_piece", _paths(F.col("_piece"), F.col("_edges"), math.log(total) + 5.0).alias("_read"))
    whole = pieces.join(read, "_piece", "left").groupBy("_row").agg(F.array_sort(F.collect_list(F.struct("_i", F.coalesce("_read", "_piece").alias("_x")))).alias("_parts"))
    said = F.regexp_replace(F.array_join(F.transform("_parts", lambda x: x["_x"]), " "), r"(?U)\s+([^\w\s])", "$1")
    out = own.join(whole.select("_row", said.alias("_said")), "_row", "left")
    return out.withColumn(name, F.when(F.col(text).isNotNull(), F.coalesce("_said", F.lit("")))).drop("_row", "_said")
