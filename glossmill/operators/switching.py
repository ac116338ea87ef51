"""Code switching: words and entities of a text replaced by names in another language."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.structure import greedy_spans, let, spans_replaced, uniform

CANDIDATES = ("max_score", "random", "all", "threshold")
ALIASES = ("random", "max_diff", "min_diff")


def name_words(name: Column) -> Column:
    """The distinct lower-cased words of a name."""
    return F.array_distinct(F.filter(F.split(F.lower(name), r"\s+"), lambda w: w != ""))


def token_distance(x: Column, y: Column) -> Column:
    """1 - intersection / union of the words of two names (name_words); 0 for two without words."""

    def of(common: Column) -> Column:
        union = F.size(x) + F.size(y) - common
        return F.when(union > 0, 1 - common / union).otherwise(F.lit(0.0))

    return let(F.size(F.array_intersect(x, y)), of)


def good_aliases(aliases: Column, source: Column, blocked: list[str]) -> Column:
    """Aliases without half-width katakana, not equal to the source in any case, without a blocked part."""
    fine = lambda a: (~F.regexp_like(a, F.lit("[･-ﾟ]"))) & (F.lower(a) != F.lower(source))
    part = lambda a: F.lit(False) if not blocked else F.exists(F.array(*map(F.lit, blocked)), lambda b: F.contains(F.lower(a), F.lower(b)))
    return F.filter(aliases, lambda a: fine(a) & ~part(a))


def entity_aliases(mentions: DataFrame, lexicon: DataFrame, candidates: str = "max_score", alias: str = "random", threshold: float = 0.8, exact: bool = False, seed: str = "alias") -> DataFrame:
    """An alias for each mention that has one: (mention, cui, code).

    mentions: mention, text, cands array<struct<cui, score, name>>; lexicon: cui, aliases array<string>.
    candidates chooses among a mention's: the one with the largest score, one at random, all, or all from a score on;
    `exact` lets pass only candidates whose name is the text in any case. alias chooses among the names of those that
    are left: at random, or the one with the most or the fewest other words. Ties go by cui and name. Candidates are
    joined by cui and meet the names of their entry within the row; nothing is collected.
    """
    if candidates not in CANDIDATES or alias not in ALIASES:
        raise ValueError(f"candidates: {CANDIDATES}; alias: {ALIASES}")
    each = mentions.select("mention", "text", F.explode("cands").alias("c")).select("mention", "text", "c.cui", "c.score", "c.name")
    if exact:
        each = each.where(F.lower("name") == F.lower("text"))
    if candidates == "threshold":
        each = each.where(F.col("score") >= threshold)
    elif candidates != "all":
        rank = -F.col("score") if candidates == "max_score" else uniform(seed, F.lit("cand"), F.col("mention"), F.col("cui"))
        best = each.groupBy("mention").agg(F.min_by(F.struct("text", "cui"), F.struct(rank, "cui")).alias("x"))
        each = best.select("mention", "x.text", "x.cui")
    if alias == "random":
        names, words = F.col("aliases"), F.lit(None)
        ranked = lambda a: F.struct(uniform(seed, F.lit("name"), F.col("mention"), a).alias("rank"), a.alias("code"))
    else:
        names, words = F.transform("aliases", lambda a: F.struct(a.alias("code"), name_words(a).alias("words"))), name_words(F.col("text"))
        sign = -1 if alias == "max_diff" else 1
        ranked = lambda a: F.struct((sign * token_distance(F.col("words"), a["words"])).alias("rank"), a["code"].alias("code"))
    # the best name of an entry is found within the row: a row for each name would be sorted by mention
    named = each.select("mention", "cui", words.alias("words")).join(lexicon.select("cui", names.alias("names")), "cui")
    best = named.select("mention", "cui", F.array_min(F.transform("names", ranked)).alias("best")).where("best IS NOT NULL")
    return best.groupBy("mention").agg(F.min_by(F.struct("cui", "best.code"), F.struct("best.rank", "cui", "best.code")).alias("x")).select("mention", "x.cui", "x.code")


def switch_entities(docs: DataFrame, entities: DataFrame, ratio: float, key: str = "doc_id", copies: int = 1, seed: str = "switch") -> DataFrame:
    """(key, copy, noisy, recipe): entities of a text replaced by their codes.

    docs: key, text; entities: key, start, end, code. In the order of their starts (then ends, then codes), an entity
    that overlaps none accepted before is accepted; of these each is kept with probability ratio; the kept ones are the
    recipe. `copies` draws so many versions. Texts without entities stay as they are.
    """
    spans = entities.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("start", "end", "code"))).alias("spans"))
    rows = docs.select(key, "text").join(spans, key, "left").withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
    free = greedy_spans(F.coalesce("spans", F.array().cast(dict(spans.dtypes)["spans"])))
    rows = rows.withColumn("_free", free)
    kept = F.filter("_free", lambda s, _: uniform(seed, F.col(key), F.col("copy"), s["start"]) < ratio)
    rows = rows.withColumn("recipe", kept)
    return rows.select(key, "copy", spans_replaced(F.col("text"), F.col("recipe")).alias("noisy"), "recipe")


def lemma_codes(tokens: DataFrame, dictionary: DataFrame, seed: str = "lemma") -> DataFrame:
    """(id, pos, raw, code, lang): a synonym for each noun, verb, adjective or adverb that has one.

    tokens: id, pos, raw, lemma, tag; dictionary: lemma, tag, lang, synonym. Synonyms equal to the lemma count for
    nothing; a language is drawn evenly, then a synonym of it.
    """
    known = dictionary.where(F.lower("synonym") != F.lower("lemma")).distinct()
    hits = tokens.where(F.col("tag").isin("N", "V", "A", "R")).join(known, ["lemma", "tag"])
    lang = uniform(seed, F.lit("lang"), F.col("id"), F.col("pos"), F.col("lang"))
    word = uniform(seed, F.lit("word"), F.col("id"), F.col("pos"), F.col("synonym"))
    best = hits.groupBy("id", "pos", "raw").agg(F.min_by(F.struct(F.col("synonym").alias("code"), "lang"), F.struct(lang, "lang", word, "synonym")).alias("x"))
    return best.select("id", "pos", "raw", "x.code", "x.lang")


def greedy_columns(spans: DataFrame, key: str, order: str) -> DataFrame:
    """(key, start, end) of the spans of each key that the greedy walk in `order` accepts."""
    every = spans.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(order, "start", "end"))).alias("s"))
    return every.select(key, F.explode(greedy_spans(F.col("s"))).alias("x")).select(key, F.col(f"x.{order}"), "x.start", "x.end")


def synonyms_until(links: DataFrame, more_than: int = 3) -> DataFrame:
    """(word, synonyms): synset by synset (in order), until more than so many synonyms are known.

    links: word, place (of the synset), synonym. The word itself counts for nothing, nor does a leading or closing +.
    """
    clean = F.regexp_replace("synonym", r"^\++|\++$", "")
    own = links.select("word", "place", clean.alias("synonym")).where((F.lower("synonym") != F.lower("word")) & (F.col("synonym") != ""))
    first = own.groupBy("word", "synonym").agg(F.min("place").alias("place"))
    per = first.groupBy("word", "place").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("word").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    open_ = per.withColumn("before", before).where(F.col("before") <= more_than).select("word", "place")
    return first.join(open_, ["word", "place"]).groupBy("word").agg(F.sort_array(F.collect_list("synonym")).alias("synonyms"))


def synset_expand(words: DataFrame, senses: DataFrame, lang: str | None = None) -> DataFrame:
    """(wordid, lang, synonyms): the other words of each word's synsets, by language; `_` is a blank in English.

    words: wordid, lemma, lang; senses: synset, wordid. Synsets are small by nature: rows grow with the square of theirs.
    """
    other = senses.select("synset", F.col("wordid").alias("otherid"))
    names = words.select(F.col("wordid").alias("otherid"), "lemma", "lang")
    if lang:
        names = names.where(F.col("lang") == lang)
    pairs = senses.join(other, "synset").where(F.col("wordid") != F.col("otherid")).join(names, "otherid")
    lemma = F.when(F.col("lang") == "eng", F.replace("lemma", F.lit("_"), F.lit(" "))).otherwise(F.col("lemma"))
    return pairs.groupBy("wordid", "lang").agg(F.array_sort(F.collect_set(lemma)).alias("synonyms"))
