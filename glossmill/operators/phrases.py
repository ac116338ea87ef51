"""Phrases of a lexicon in texts of any length: words are rows, and each sees only the few words ahead of it.

Entries are cut by their first word. A word of a text meets the lengths of the entries that begin with it, puts that
many words together, and meets the entry itself by a join; nothing carries a whole text. Of overlapping hits the
leftmost stays, and of those that begin together the longest: a walk over each text's hits in order, one in memory.
With a lexicon that is known to be small, only those words become rows that an entry may begin with.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranking import numbered

#: A lexicon of up to so many entries is sent to every task; the words of the texts are shuffled to a larger one.
BROADCAST_ENTRIES = 200_000
#: Of one of up to so many entries, tasks may know the first words before words become rows; so many rows go out at once.
KNOWN_ENTRIES, WORD_ROWS = 10_000, 20_000


def ahead(words: DataFrame, row: str, place: str, value: Column, longest: int, name: str) -> DataFrame:
    """words with `name`: the values from a row's own place on, `longest` at most, within its text."""
    w = Window.partitionBy(row).orderBy(place).rowsBetween(0, max(0, longest - 1))
    return words.withColumn(name, F.collect_list(value).over(w))


def leftmost_longest(hits: DataFrame, row: str, start: str, size: str, *ties: str) -> DataFrame:
    """The hits (start and size in words) of each text that a walk from the left takes; of equal ones the first by ties."""
    columns = hits.columns
    r, s, n = (columns.index(c) for c in (row, start, size))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, free = None, 0
        for b in batches:
            keep = []
            for text, first, many in zip(*(b.column(k).to_pylist() for k in (r, s, n)), strict=True):
                if text != at:
                    at, free = text, 0
                keep.append(first >= free)
                if first >= free:
                    free = first + many
            yield b.filter(pa.array(keep, pa.bool_()))

    ordered = hits.repartition(row).sortWithinPartitions(row, start, F.col(size).desc(), *ties)
    return ordered.mapInArrow(walk, hits.schema)


def annotate(texts: DataFrame, lexicon: DataFrame, key: str = "id", row: str | None = None, known: int = 0) -> DataFrame:
    """(key, start, end, text, label): where entries of a lexicon (surface, label) stand in a text, by whole words.

    Case counts for nothing, nor does the kind of white space between words; marks that close a hit (.,;:!?)]) are no
    part of it. Places count characters from 0. Of overlapping hits the leftmost stays, then the longest, then the
    first label. A text without entries, and a null one, has no rows; rows that repeat a key are texts of their own.
    The texts are stored with numbers, unless `row` names a column of a stored table that is unique. Phrases of a
    lexicon of up to `known` entries pass through the driver, and other words do not become rows then.
    """
    phrase = F.array_join(F.split(F.trim(F.regexp_replace(F.lower("surface"), r"\s+", " ")), " "), " ")
    entries = lexicon.select(phrase.alias("_phrase"), "label").where("_phrase <> ''").distinct()
    size = F.size(F.split("_phrase", " "))
    about = entries.agg(F.max(size).alias("n"), F.count(F.lit(1)).alias("rows")).collect()[0]
    longest = about["n"] or 1
    sent = F.broadcast if about["rows"] <= BROADCAST_ENTRIES else (lambda df: df)
    own = texts.select(key, "text").transform(numbered) if row is None else texts.select(key, F.col(row).alias("_row"), "text")
    if about["rows"] <= known:
        words = _first_words(own, [r["_phrase"] for r in entries.select("_phrase").distinct().collect()], longest, key)
    else:
        words = _every_word(own, longest, key)
    heads = entries.where(size > 1).groupBy(F.substring_index("_phrase", " ", 1).alias("_first")).agg(F.collect_set(size).alias("_sizes"))
    fitting = F.filter(F.coalesce("_sizes", F.array().cast("array<int>")), lambda n: n <= F.size("_ahead"))
    spans = words.join(sent(heads), "_first", "left").withColumn("_n", F.explode(F.concat(F.array(F.lit(1)), fitting)))
    whole = F.regexp_replace(F.array_join(F.slice("_ahead", F.lit(1), F.col("_n")), ""), r"^\s+", "")
    spans = spans.select(key, "_row", "_i", "_n", "start", F.regexp_replace(whole, r"[.,;:!?)\]]+$", "").alias("text"))
    spans = spans.withColumn("_phrase", F.regexp_replace(F.lower("text"), r"\s+", " "))
    hits = spans.join(sent(entries), "_phrase").select(key, "_row", "_i", "_n", "start", (F.col("start") + F.length("text")).alias("end"), "text", "label")
    return leftmost_longest(hits, "_row", "_i", "_n", "label").select(key, "start", "end", "text", "label")


def _first_words(own: DataFrame, phrases: list[str], longest: int, key: str) -> DataFrame:
    """(key, _row, _i, start, _first, _ahead) of the words that an entry may begin with.

    Of words beyond ASCII, whose lower case is Spark's to say, all.
    """
    firsts, singles = {p.split(" ")[0] for p in phrases if " " in p}, {p for p in phrases if " " not in p}
    pieces = re.compile(r"[ \t\n\x0b\f\r]*([^ \t\n\x0b\f\r]+)")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple[int, int, int, str, list[str]]] = []

            def sent(out=out, b=b) -> pa.RecordBatch:
                of, i, start, word, ahead = zip(*out, strict=True)
                at = pa.array(of, pa.int32())
                out.clear()
                return pa.record_batch([b.column(0).take(at), b.column(1).take(at), pa.array(i, pa.int32()), pa.array(start, pa.int32()), pa.array(word), pa.array(ahead, pa.list_(pa.string()))], names=["key", "_row", "_i", "start", "_word", "_ahead"])

            for of in range(b.num_rows):
                found = list(pieces.finditer(b.column(2)[of].as_py() or ""))
                for i, m in enumerate(found):
                    word = m[1]
                    low = word.lower()
                    if low in firsts or low.rstrip(".,;:!?)]") in singles or not word.isascii():
                        out.append((of, i, m.start(1), word, [x[0] for x in found[i : i + longest]]))
                        if len(out) >= WORD_ROWS:
                            yield sent()
            if out:
                yield sent()

    kinds = own.schema
    schema = f"`key` {kinds[key].dataType.simpleString()}, _row {kinds['_row'].dataType.simpleString()}, _i int, start int, _word string, _ahead array<string>"
    words = own.select(key, "_row", "text").mapInArrow(run, schema)
    return words.select(F.col("key").alias(key), "_row", "_i", "start", F.lower("_word").alias("_first"), "_ahead")


def _every_word(own: DataFrame, longest: int, key: str) -> DataFrame:
    """_first_words of any lexicon: all words."""
    pieces = F.regexp_extract_all("text", F.lit(r"(\s*\S+)"), F.lit(1))
    # texts are dealt out whole, so that their words, many times the bytes, lie where the windows below want them
    words = own.repartition("_row").select(key, "_row", F.posexplode(pieces).alias("_i", "_piece"))
    word = F.regexp_replace("_piece", r"^\s+", "")
    before = F.sum(F.length("_piece")).over(Window.partitionBy("_row").orderBy("_i").rowsBetween(Window.unboundedPreceding, -1))
    words = words.withColumn("start", (F.coalesce(before, F.lit(0)) + F.length("_piece") - F.length(word)).cast("int"))
    return ahead(words.withColumn("_first", F.lower(word)), "_row", "_i", F.col("_piece"), longest, "_ahead").drop("_piece")


def code_index(tokens: DataFrame, entries: DataFrame) -> DataFrame:
    """(id, pos, code): where the words of an entry stand in a row, by the entry's first word.

    tokens: id, words array<string>, tags array<string>; entries: words array<string>, code. A match that begins with
    a verb (tag V) is skipped; of several at a place, the longest wins, then the first code.
    """
    known = entries.select(F.col("words").alias("_entry"), F.get("words", F.lit(0)).alias("_word"), "code")
    longest = known.agg(F.max(F.size("_entry")).alias("n")).collect()[0]["n"] or 1
    rows = tokens.select("id", F.monotonically_increasing_id().alias("_row"), F.arrays_zip(F.col("words").alias("w"), F.col("tags").alias("t")).alias("_both"))
    each = rows.select("id", "_row", F.posexplode("_both").alias("pos", "x"))  # after the rows have their numbers
    each = ahead(each.select("id", "_row", "pos", F.col("x.w").alias("_word"), F.col("x.t").alias("_tag")), "_row", "pos", F.coalesce("_word", F.lit("")), longest, "_ahead")
    hits = each.where(F.coalesce("_tag", F.lit("")) != "V").join(known, "_word").where(F.slice("_ahead", F.lit(1), F.size("_entry")) == F.col("_entry"))
    return hits.groupBy("id", "pos").agg(F.min_by("code", F.struct(-F.size("_entry"), F.col("code"))).alias("code"))
