"""Instructions from records: a builder for each mode, and templates drawn by a hash of the record's id.

A record has docid, and as far as a mode needs them: title, abstract, sentences array<string>, keywords array<string>,
qa array<struct<q, a>>, causal array<struct<relation, a, b>>, gmrc array<struct<section, text>>, conclu struct<before,
conclusion>; each of title, abstract, sentences and qa also as roman_… and noisy_…; and en_title, en_abstract, the same
text in English. Instructions are (docid, text, type).
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.structure import prefix_suffix, uniform

#: Templates by kind. {a} and {b} are the two sides; where {b} comes first, the task is the other way round.
TEMPLATES = {
    "summarization": ["Abstract: {a}\nGive it a title: {b}", "Title: {b}\nWrite its abstract: {a}"],
    "completion": ["Go on with this text: {a}\n{b}", "What follows on: {a}\nIt goes on: {b}"],
    "conclusion": ["What is to be concluded from this? {a}\n{b}"],
    "qa": ["Question: {a}\nAnswer: {b}", "Asked: {a}\nSaid: {b}"],
    "qa_context": ["Read: {c}\nQuestion: {a}\nAnswer: {b}"],
    "text2key": ["Text: {a}\nIts keywords: {b}"],
    "key2text": ["Keywords: {b}\nA text with them: {a}"],
    "causal-entail": ["If: {a}\nThen: {b}"],
    "causal-contradict": ["One side: {a}\nThe other side: {b}"],
    "causal-neutral": ["First: {a}\nBesides: {b}"],
    "gmrc-goal": ["Given: {a}\nThe goal was: {b}"],
    "gmrc-method": ["Given: {a}\nThe method was: {b}"],
    "gmrc-result": ["Given: {a}\nThe result was: {b}"],
    "gmrc-conclu": ["Given: {a}\nThe conclusion was: {b}"],
    "romanization": ["Write in Latin letters: {a}\n{b}"],
    "deromanization": ["Write in the native script: {a}\n{b}"],
    "translation": ["Native: {a}\nEnglish: {b}", "English: {b}\nNative: {a}"],
    "denoise": ["Repair this: {a}\nRepaired: {b}", "Broken: {a}\nWhole: {b}"],
}


def filled(kind: str | Column, key: Column, seed: str = "template", templates: dict[str, list[str]] = TEMPLATES, **sides: Column) -> Column:
    """A template of the kind, drawn evenly by the key, with its placeholders filled; a side's own braces stay as they are."""
    if isinstance(kind, Column):
        out = None
        for k in templates:
            own = filled(k, key, seed, templates, **sides)
            out = F.when(kind == k, own) if out is None else out.when(kind == k, own)
        return out
    pick = (uniform(seed, key) * len(templates[kind])).cast("int")
    out = None
    for i, t in enumerate(templates[kind]):
        pieces = re.split(r"\{(" + "|".join(sides) + r")\}", t)  # every other piece is a placeholder
        own = F.concat(*(sides[x] if k % 2 else F.lit(x) for k, x in enumerate(pieces) if x))
        out = F.when(pick == i, own) if out is None else out.when(pick == i, own)
    return out


def view(record: str, name: str) -> Column:
    """A column of a record in the view raw, roman or noisy."""
    if name not in ("raw", "roman", "noisy"):
        raise ValueError(f"no view {name}")
    return F.col(record if name == "raw" else f"{name}_{record}")


def views(mode: str) -> tuple[str, str]:
    """The (input, output) views that a mode's prefix names: raw, roman2raw, raw2roman, noisy2raw, …"""
    first, _, second = mode.partition("2")
    return first, second or first


def _one(records: DataFrame, text: Column, kind: str | Column, where: Column) -> DataFrame:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    return records.where(where).select("docid", text.alias("text"), kind.alias("type"))


def summarization(records: DataFrame, given: str = "raw", wanted: str = "raw") -> DataFrame:
    a, b = view("abstract", given), view("title", wanted)
    return _one(records, filled("summarization", F.col("docid"), a=a, b=b), "summarization", a.isNotNull() & b.isNotNull())


def completion(records: DataFrame, given: str = "raw", wanted: str = "raw") -> DataFrame:
    """The first sentences to the rest, cut at a place drawn by the docid; two sentences at least."""
    a, b = (prefix_suffix(view("sentences", v), F.col("docid")) for v in (given, wanted))
    return _one(records, filled("completion", F.col("docid"), a=a["prefix"], b=b["suffix"]), "completion", a.isNotNull() & b.isNotNull())


def conclusion(records: DataFrame) -> DataFrame:
    return _one(records, filled("conclusion", F.col("docid"), a=F.col("conclu.before"), b=F.col("conclu.conclusion")), "conclusion", F.col("conclu").isNotNull())


def _pairs(records: DataFrame, given: str, wanted: str, *keep: str) -> DataFrame:
    both = F.zip_with(view("qa", given), view("qa", wanted), lambda x, y: F.struct(x["q"].alias("a"), y["a"].alias("b")))
    return records.select("docid", *keep, F.posexplode(both).alias("i", "x")).where("x.a IS NOT NULL AND x.b IS NOT NULL")


def qa(records: DataFrame, given: str = "raw", wanted: str = "raw") -> DataFrame:
    """One for each pair."""
    each = _pairs(records, given, wanted)
    return _one(each, filled("qa", F.concat_ws(":", "docid", "i"), a=F.col("x.a"), b=F.col("x.b")), "qa", F.lit(True))


def qa_context(records: DataFrame, given: str = "raw", wanted: str = "raw") -> DataFrame:
    each = _pairs(records.withColumn("_context", view("abstract", given)), given, wanted, "_context").where("_context IS NOT NULL")
    return _one(each, filled("qa_context", F.concat_ws(":", "docid", "i"), a=F.col("x.a"), b=F.col("x.b"), c=F.col("_context")), "qa_context", F.lit(True))


def _text_and_keys(records: DataFrame, kind: str, least: int = 3) -> DataFrame:
    text, keys = F.concat_ws(". ", "title", "abstract"), F.array_join("keywords", ", ")
    return _one(records, filled(kind, F.col("docid"), a=text, b=keys), kind, F.size("keywords") >= least)


def text2key(records: DataFrame) -> DataFrame:
    return _text_and_keys(records, "text2key")


def key2text(records: DataFrame) -> DataFrame:
    return _text_and_keys(records, "key2text")


def causal(records: DataFrame) -> DataFrame:
    """One for each pair of a relation, with the relation's own templates."""
    each = records.select("docid", F.posexplode("causal").alias("i", "x"))
    kind = F.concat(F.lit("causal-"), F.col("x.relation"))
    return _one(each, filled(kind, F.concat_ws(":", "docid", "i"), a=F.col("x.a"), b=F.col("x.b")), kind, F.lit(True))


def gmrc(records: DataFrame) -> DataFrame:
    """One for each section: the other sections, in order, to this one."""
    each = records.select("docid", "gmrc", F.posexplode("gmrc").alias("i", "x"))
    others = F.array_join(F.transform(F.filter("gmrc", lambda y: y["section"] != F.col("x.section")), lambda y: y["text"]), " ")
    kind = F.concat(F.lit("gmrc-"), F.col("x.section"))
    return _one(each, filled(kind, F.concat_ws(":", "docid", "i"), a=others, b=F.col("x.text")), kind, F.size("gmrc") > 1)


def _sides(records: DataFrame, given: str, wanted: str, kind: str) -> DataFrame:
    """One for each sentence and the title."""
    every = lambda v: F.concat(F.array(view("title", v)), view("sentences", v))
    both = F.zip_with(every(given), every(wanted), lambda x, y: F.struct(x.alias("a"), y.alias("b")))
    each = records.select("docid", F.posexplode(both).alias("i", "x")).where("x.a IS NOT NULL AND x.b IS NOT NULL")
    return _one(each, filled(kind, F.concat_ws(":", "docid", "i"), a=F.col("x.a"), b=F.col("x.b")), kind, F.lit(True))


def romanization(records: DataFrame) -> DataFrame:
    return _sides(records, "raw", "roman", "romanization")


def deromanization(records: DataFrame) -> DataFrame:
    return _sides(records, "roman", "raw", "deromanization")


def medical_translation(records: DataFrame, given: str = "raw") -> DataFrame:
    """Title and abstract, in the view and in English; records without English are left out."""
    both = F.array(F.struct(view("title", given).alias("a"), F.col("en_title").alias("b")), F.struct(view("abstract", given).alias("a"), F.col("en_abstract").alias("b")))
    each = records.select("docid", F.posexplode(both).alias("i", "x")).where("x.a IS NOT NULL AND x.b IS NOT NULL")
    return _one(each, filled("translation", F.concat_ws(":", "docid", "i"), a=F.col("x.a"), b=F.col("x.b")), "medical_translation", F.lit(True))


def bitext_translation(pairs: DataFrame) -> DataFrame:
    """docid, native, english sentences: one for each pair."""
    return _one(pairs, filled("translation", F.col("docid"), a=F.col("native"), b=F.col("english")), "bitext_translation", F.col("native").isNotNull() & F.col("english").isNotNull())


def bitext_romanization(pairs: DataFrame) -> DataFrame:
    """docid, native, roman sentences."""
    return _one(pairs, filled("romanization", F.col("docid"), a=F.col("native"), b=F.col("roman")), "bitext_romanization", F.col("native").isNotNull() & F.col("roman").isNotNull())


def pure_text(records: DataFrame, given: str = "raw") -> DataFrame:
    """The abstract as it is."""
    a = view("abstract", given)
    return _one(records, a, "pure_text", a.isNotNull())


def denoise(records: DataFrame, tuning: bool = False) -> DataFrame:
    """Noisy to raw, for each sentence and each side of a pair, where the two differ.

    In the tuning form the columns are docid, template, noise, raw instead of the filled text.
    """
    said = lambda v: F.concat(view("sentences", v), F.flatten(F.transform(F.coalesce(view("qa", v), F.array().cast("array<struct<q:string,a:string>>")), lambda x: F.array(x["q"], x["a"]))))
    both = F.zip_with(said("noisy"), said("raw"), lambda x, y: F.struct(x.alias("a"), y.alias("b")))
    each = records.select("docid", F.posexplode(both).alias("i", "x")).where("x.a <> x.b")
    return _denoised(each, tuning)


def denoise_abstract(records: DataFrame, tuning: bool = False) -> DataFrame:
    each = records.select("docid", F.lit(0).alias("i"), F.struct(F.col("noisy_abstract").alias("a"), F.col("abstract").alias("b")).alias("x")).where("x.a <> x.b")
    return _denoised(each, tuning)


def _denoised(each: DataFrame, tuning: bool) -> DataFrame:
    key = F.concat_ws(":", "docid", "i")
    if tuning:
        return each.select("docid", filled("denoise", key, a=F.lit("{noise}"), b=F.lit("{raw}")).alias("template"), F.col("x.a").alias("noise"), F.col("x.b").alias("raw"))
    return _one(each, filled("denoise", key, a=F.col("x.a"), b=F.col("x.b")), "denoise", F.lit(True))


#: What each mode builds. Modes that differ in views alone are made by rule.
MODES: dict[str, Callable[[DataFrame], DataFrame]] = {
    "conclusion": conclusion,
    "text2key": text2key,
    "key2text": key2text,
    "causal": causal,
    "gmrc": gmrc,
    "romanization": romanization,
    "deromanization": deromanization,
    "denoise": denoise,
    "denoise_abstract": denoise_abstract,
    "medical_translation": medical_translation,
    "roman_medical_translation": lambda r: medical_translation(r, "roman"),
    "pure_text": pure_text,
    "roman_pure_text": lambda r: pure_text(r, "roman"),
}
for _view in ("raw", "roman", "noisy2raw"):
    for _build in (summarization, completion, qa, qa_context):
        MODES[_build.__name__ if _view == "raw" else f"{_view}_{_build.__name__}"] = lambda r, b=_build, v=_view: b(r, *views(v))


def dispatch(records: DataFrame, modes: list[str]) -> DataFrame:
    """(docid, text, type, mode) of several modes, each a part of one table; an unknown or repeated mode raises."""
    unknown = [m for m in modes if m not in MODES]
    if unknown or len(set(modes)) < len(modes) or not modes:
        raise ValueError(f"modes must be distinct and among {sorted(MODES)}: {modes}")
    return reduce(DataFrame.unionByName, (MODES[m](records).withColumn("mode", F.lit(m)) for m in modes))
