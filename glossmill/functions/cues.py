"""Headings, conclusions and causal cues of Japanese, Chinese and English texts, and sentence ends of the first two.

All words of a list are found in one pass by an automaton (Aho-Corasick), in Arrow batches; what they mean where they
stand (brackets, boundaries, the order of the list) is decided on the hits alone. Lists are parameters, {language:
{label: words}}; a text is read in the language that its row names.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from typing import NamedTuple

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

Lists = dict[str, dict[str, list[str]]]


def _words(text: str) -> list[str]:
    return text.split("|")


# The words below must be these, in this order.
SECTIONS: Lists = {
    "en": {
        "goal": _words("Objective|Objectives|Purpose|Purposes|Background|Backgrounds|Aim|Aims"),
        "method": _words("Method|Methods|Patients and Methods"),
        "result": _words("Result|Results"),
        "conclu": _words("Conclusion|Conclusions"),
    },
    "zh": {
        "goal": _words("目的：|目的:|目的 |目　的|目的|背景: |背景 "),
        "method": _words("方法：|方法:|方法 |方 法|方法|対象和方法"),
        "result": _words("结果：|结果:|结果 |结 果|结果|结果与结论"),
        "conclu": _words("结论：|结论:|结论 |结 论|结论"),
    },
    "ja": {
        "goal": _words("目的|背景|目　的"),
        "method": _words("方法|方　法|対象と方法"),
        "result": _words("実験結果|実験　結果|結果|結　果"),
        "conclu": _words("結論|考察|結　論|考　察|結果、結論|結果,結論|まとめ"),
    },
}
#: How a heading is written: in brackets, with white space inside, or with a mark after it. An opening bracket's second
#: form has a colon after it.
BRACKETS = _words("[]|[]:|【】|()|（）|「」")
MARKS = _words(":|：|　| ")
#: What may follow a cue: one of these goes with it.
SUFFIXES = _words(",|、|，|:|：| |　")
CONCLUSION_STEMS = {
    "zh": _words("结论"),
    "ja": _words(
        "以上の結果から|以上の結果に基づき|以上の結果|これらの結果から|以上の考察から|以上の考察に基づき|以上の考察|これらの考察から|本研究を通して|本研究をとおして|それに基づいた考察において|結論として|結論について"
        "|結論|考察|結　論|考　察|結果、結論|結果,結論|まとめ"
    ),
}
CONCLUSION_BRACKETED = _words("結論|考察|結　論|考　察|結果、結論|結果,結論|まとめ")
CONCLUSION_EN = _words(
    "In conclusion: |In conclusion, |To conclude: |To conclude, |Conclusion: |Conclusion, |As a result, |As the result, |As a result: |As the result: |Major results are "
    "|As a result of the study, |As a result of this study, |As the result of this study, |Viewpoints of this study are |This study reveals that |By way of conclusion, "
    "|The following findings are obtained|Here is the conclusion, |Here is the result, |Here are the results, |Here are the conclusions, |We conclude that |In short, |In short: "
    "|As one of the conclusions, |The main conclusion is, "
)
RELATIONS: Lists = {
    "zh": {
        "entail": _words("所以|因此|相应地|因而|于是|由此可见|从而|这样一来|结果|最终"),
        "contradict": _words("与此相反地|与此相反|但是|然而|不过|尽管如此|却|反倒|反而|而|虽说"),
        "neutral": _words("除此之外|此外|另外|同时|而且|并且|不仅如此|更重要的是|值得一提的是|除此之外还"),
    },
    "ja": {
        "entail": _words(
            "したがって|そのため|ゆえに|よって|これにより|以上の所見より|この結果より|この結果により|こうして|結論として|総じて言うと|総じて|必然的に|これらの結果より調査の結果"
            "|以上の結果より|その結果|以上のことから|分析の結果|この結果|このことから|以上より|以上から|原因として|この実験から|この事実より|結論"
        ),
        "contradict": _words("しかしながら|それに対して|しかし|一方で|とはいえ|それにもかかわらず|ところが|むしろ|逆に|対照的に|とは反対に"),
        "neutral": _words("加えて述べると|加えて考慮すると|加えて言えば|加えて|さらに|また|同時に|併せて|一方|付け加えると|言い換えると|なお"),
    },
    "en": {
        "entail": _words("so|therefore|thus|hence|as a result|consequently|accordingly|because of this|for this reason|this means that|which implies|resulting in|leading to|it follows that"),
        "contradict": _words("however|but|on the contrary|in contrast|conversely|nevertheless|nonetheless|yet|despite this|although|even though|whereas|while|on the other hand|instead"),
        "neutral": _words("additionally|furthermore|moreover|also|in addition|besides|as well as|not only|apart from this|similarly|likewise|at the same time|meanwhile|in the meantime|on top of that|what's more"),
    },
}
# End of the fixed values.

#: Cues of a conclusion: in Japanese also in two kinds of brackets, and in both languages with what follows.
CONCLUSIONS: dict[str, list[str]] = {
    "en": CONCLUSION_EN,
    "zh": [w + s for w in CONCLUSION_STEMS["zh"] for s in SUFFIXES],
    "ja": [w + s for w in [*CONCLUSION_STEMS["ja"], *(a + w + b for a, b in ("【】", "（）") for w in CONCLUSION_BRACKETED)] for s in SUFFIXES],
}


def cue_table(spark, lists: Lists) -> DataFrame:
    """(lang, label, place, cue): lists as a table, to be kept and changed where other tables are."""
    rows = [(lang, label, i, w) for lang, by in lists.items() for label, words in by.items() for i, w in enumerate(words)]
    return spark.createDataFrame(rows, "lang string, label string, place int, cue string")


def lists_of(table: DataFrame) -> Lists:
    """Lists from such a table (a few hundred rows by nature); labels in the order of their first cue."""
    out: Lists = {}
    for r in table.orderBy("place", "label").collect():
        out.setdefault(r["lang"], {}).setdefault(r["label"], []).append(r["cue"])
    return out


@lru_cache(maxsize=64)
def _automaton(words: tuple[str, ...]) -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    for k, w in enumerate(words):
        if w not in out:  # the first of equal words counts
            out.add_word(w, k)
    out.make_automaton()
    return out


def hits(words: tuple[str, ...], text: str) -> list[tuple[int, int, int]]:
    """(start, place in the list, end) of every occurrence of every word."""
    if not words:
        return []
    return [(end + 1 - len(words[k]), k, end + 1) for end, k in _automaton(words).iter(text)]


def apart(found: Iterable[tuple]) -> Iterator[tuple]:
    """Hits that do not overlap, from the left; of those that start together the first in order (start, order, …, end)."""
    at = 0
    for hit in sorted(found):
        if hit[0] >= at:
            yield hit
            at = hit[-1]


_LOWER = {c: c + 32 for c in range(65, 91)}


def ascii_lower(text: str) -> str:
    """A-Z lower-cased, so that places stay what they are."""
    return text.lower() if text.isascii() else text.translate(_LOWER)


_BEFORE = re.compile(r"\s*\Z")
_SPACE = re.compile(r"\s*")


def forms(text: str, start: int, end: int) -> Iterator[tuple[int, int, int]]:
    """(start, form, end) of each way in which the word at start..end is a heading."""
    left = start
    while left and text[left - 1].isspace():
        left -= 1
    after = _SPACE.match(text, end).end()
    if left and after < len(text):
        for k, (opening, closing, *colon) in enumerate(BRACKETS):
            if text[left - 1] == opening and text[after] == closing and text.startswith("".join(colon), after + 1):
                yield left - 1, k, after + 1 + len(colon)
    for k, mark in enumerate(MARKS, len(BRACKETS)):
        if text.startswith(mark, end):
            yield start, k, end + len(mark)


def _flat(lists: dict[str, list[str]]) -> tuple[tuple[str, ...], tuple[str, ...]]:
    """(labels, words) of all lists, one after another."""
    return tuple(label for label, own in lists.items() for _ in own), tuple(w for own in lists.values() for w in own)


def find_headings(text: str, sections: dict[str, list[str]]) -> list[tuple[int, str, int]]:
    """(start, section, end) of the headings of sections that have exactly one, in the order of the text."""
    return _headings(text, *_flat(sections))


def _headings(text: str, labels: tuple[str, ...], words: tuple[str, ...]) -> list[tuple[int, str, int]]:
    found: dict[str, list[tuple]] = {}
    for start, k, end in _all(words, labels, text):
        for a, form, b in forms(text, start, end):
            found.setdefault(labels[k], []).append((a, k, form, b))
    out = []
    for label, own in found.items():
        headings = list(apart(own))
        if len(headings) == 1:
            out.append((headings[0][0], label, headings[0][-1]))
    return sorted(out)


@lru_cache(maxsize=64)
def _owners(words: tuple[str, ...], labels: tuple[str, ...]) -> dict[str, list[int]]:
    """The places of each word, one for each label that has it."""
    out: dict[str, list[int]] = {}
    for k, w in enumerate(words):
        own = out.setdefault(w, [])
        if all(labels[j] != labels[k] for j in own):
            own.append(k)
    return out


def _all(words: tuple[str, ...], labels: tuple[str, ...], text: str) -> Iterator[tuple[int, int, int]]:
    """Hits of each label's own words: a word that two labels have is a hit of both."""
    owners = _owners(words, labels)
    for start, k, end in hits(words, text):
        for j in owners[words[k]]:
            yield start, j, end


#: Rows and characters that a task holds as Python objects at once; the rest of a batch stays in Arrow.
STEP_ROWS, STEP_CHARS = 64, 1 << 20


def _steps(values: pa.Array) -> Iterator[tuple[int, int]]:
    """(start, end) of pieces of an array of texts, or of lists of them, of so many rows and bytes (a row at least)."""
    texts = values.flatten() if pa.types.is_list(values.type) else values
    sizes = np.concatenate([[0], np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)])
    if texts is not values:
        rows = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(values), 0).to_numpy(zero_copy_only=False), dtype=np.int64)])
        sizes = sizes[rows]
    start = 0
    while start < len(values):
        end = max(start + 1, min(start + STEP_ROWS, int(np.searchsorted(sizes, sizes[start] + STEP_CHARS, "right")) - 1))
        yield start, min(end, len(values))
        start = end


def _by_language(fn: Callable[[object, str], object], kind: str) -> Callable[[Column, Column], Column]:
    """An Arrow-batched column function of a value and its language; null or of an unknown language gives null."""
    arrow = to_arrow_type(DataType.fromDDL(kind))

    @F.arrow_udf(kind)
    def run(values: pa.Array, langs: pa.Array) -> pa.Array:
        done = []
        for start, end in _steps(values):
            own = zip(values[start:end].to_pylist(), langs[start:end].to_pylist(), strict=True)
            done.append(pa.array([None if v is None or lang is None else fn(v, lang) for v, lang in own], arrow))
        return pa.concat_arrays(done) if done else pa.array([], arrow)

    return run.asNondeterministic()  # so that a filter on what it gives does not run it once more below


def section_spans(text: Column, lang: Column, sections: Lists = SECTIONS) -> Column:
    """array<struct<pos, section, heading, text>> in the order of the text.

    A section whose heading occurs exactly once, in whichever of its words and forms, runs from there to the next such
    heading, or to the end; text is without the heading and without white space around it. Fewer than two sections
    are none: an empty array. A null text gives null, as does a language without lists.
    """
    strip = lambda x: x.strip(" \t\r\n\f　")
    flat = {name: _flat(own) for name, own in sections.items()}

    def spans(x: str, name: str) -> list | None:
        if name not in flat:
            return None
        found = _headings(x, *flat[name])
        if len(found) < 2:
            return []
        ends = [h[0] for h in found[1:]] + [len(x)]
        return [{"pos": a + 1, "section": s, "heading": x[a:b], "text": strip(x[b:end])} for (a, s, b), end in zip(found, ends, strict=True)]

    return _by_language(spans, "array<struct<pos:int,section:string,heading:string,text:string>>")(text, lang)


def conclusion_split(text: Column, lang: Column, cues: dict[str, list[str]] = CONCLUSIONS) -> Column:
    """struct<before, conclusion>: cut at the first cue that stands after the text's beginning, in any case; else null."""

    lowered = {name: tuple(map(ascii_lower, own)) for name, own in cues.items()}

    def cut(x: str, name: str) -> list:
        at = next((h[0] for h in apart(hits(lowered.get(name, ()), ascii_lower(x))) if h[0]), None)
        return [] if at is None else [{"before": x[:at], "conclusion": x[at:]}]

    return F.get(_by_language(cut, "array<struct<before:string,conclusion:string>>")(text, lang), F.lit(0))


def _without_mark(x: str) -> str:
    """Without one of the marks that may follow a cue, and then without white space around it."""
    return x[1:].strip() if x[:1] in SUFFIXES else x


class _Cues(NamedTuple):
    """The cues of a language's relations as they are sought: lower-cased, at a beginning and after a comma."""

    labels: tuple[str, ...]
    first: tuple[str, ...]
    within: tuple[str, ...]
    #: What a sentence with a cue begins with, and the longest cue.
    letters: frozenset[str]
    longest: int


def _cues(relations: dict[str, list[str]]) -> _Cues:
    labels, words = _flat(relations)
    first = tuple(map(ascii_lower, words))
    return _Cues(labels, first, tuple(", " + w for w in first), frozenset(w[:1] for w in first), max(map(len, first), default=0))


def _starting(parts: list[str], own: _Cues, blank: bool) -> Iterator[tuple]:
    """(pos, relation, a, b): sentences that begin with a relation's cue (the first in its list), with the one before."""
    for i in range(1, len(parts)):
        x = parts[i]
        begin = ascii_lower(x[: own.longest])
        if begin[:1] not in own.letters and "" not in own.letters:
            continue
        first: dict[str, tuple[int, int]] = {}
        for start, k, end in _all(own.first, own.labels, begin):
            if not start:
                first[own.labels[k]] = min(first.get(own.labels[k], (k, end)), (k, end))
        for label, (_, end) in first.items():
            rest = x[end:].lstrip() if blank else x[end:]
            yield i, label, parts[i - 1], _without_mark(rest)


def _within(parts: list[str], own: _Cues) -> Iterator[tuple]:
    """(pos, relation, a, b): sentences cut at `, cue` as whole words; of a relation the first cue in its list that occurs."""
    word = lambda c: c.isalnum() or c == "_"
    for i, x in enumerate(parts):
        if ", " not in x:
            continue
        where: dict[int, list[tuple[int, int]]] = {}
        for start, k, end in _all(own.within, own.labels, ascii_lower(x)):
            if start and word(x[start - 1]) and (end == len(x) or not word(x[end])):
                where.setdefault(k, []).append((start, end))
        done: set[str] = set()
        for k in sorted(where):
            if own.labels[k] in done:
                continue
            done.add(own.labels[k])
            (start, end), *more = where[k]
            a, b = x[:start].strip(), x[end : more[0][0] if more else len(x)].strip()
            if a and b:
                yield i, own.labels[k], a, _without_mark(b)


PAIRS = "array<struct<pos:int,relation:string,a:string,b:string>>"


def causal_pairs(sentences: Column, lang: Column, relations: Lists = RELATIONS) -> Column:
    """array<struct<pos, relation, a, b>>: what the cues of a text's language say about its sentences.

    A sentence that begins with a cue is paired with the one before it; each relation may have its own cue there, and
    the first in its list counts. In English a sentence is also cut at a comma and a cue. The cue and one mark after
    it go. Case counts for nothing. Pairs come by place, those within a sentence before those with the one before it.
    """

    ready = {name: (_cues(own), {label: k for k, label in enumerate(own)}) for name, own in relations.items()}

    def pairs(parts, name: str) -> list | None:
        if name not in ready:
            return None
        (own, order), parts = ready[name], [x or "" for x in parts]
        found = [(i, 1, order[r], r, a, b) for i, r, a, b in _starting(parts, own, name == "en")]
        if name == "en":
            found += [(i, 0, order[r], r, a, b) for i, r, a, b in _within(parts, own)]
        return [{"pos": i, "relation": r, "a": a, "b": b} for i, _, _, r, a, b in sorted(found)]

    return _by_language(pairs, PAIRS)(sentences, lang)


#: What opens and closes a quotation or an aside, and what ends a sentence outside of them.
OPENING, CLOSING, ENDS = "「『（(【〈《“", "」』）)】〉》”", "。！？!?．\n"
_SIGNS = re.compile(f"[{re.escape(OPENING + CLOSING + ENDS)}]")


def cut_sentences(text: str) -> list[str]:
    """Parts whose concatenation is the text, each ending after a sentence's end and what closes or repeats it.

    Signs go over a stack: an end between an opening sign and its closing one ends nothing. An opening sign that is
    never closed, and a closing one that was never opened, count for nothing. White space after an end stays with it.
    """
    signs = [(m.start(), m[0]) for m in _SIGNS.finditer(text)]
    stack: list[tuple[int, str]] = []
    pair: dict[int, int] = {}
    for at, c in signs:
        if c in OPENING:
            stack.append((at, c))
        elif c in CLOSING:
            want = OPENING[CLOSING.index(c)]
            for k in range(len(stack) - 1, max(-1, len(stack) - 9), -1):  # signs that are open across it were never closed
                if stack[k][1] == want:
                    pair[stack[k][0]] = at
                    del stack[k:]
                    break
    out, start, inside = [], 0, -1
    for at, c in signs:
        if at <= inside or at < start:
            continue
        if at in pair:
            inside = pair[at]
        elif c in ENDS:
            end = at + 1
            while end < len(text) and (text[end] in ENDS or text[end] in CLOSING or text[end].isspace()):
                end += 1
            out.append(text[start:end])
            start = end
    if start < len(text):
        out.append(text[start:])
    return out


def sentences_cjk(text: Column) -> Column:
    """Japanese or Chinese sentences (cut_sentences); a null text gives null."""

    @F.pandas_udf("array<string>")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else cut_sentences(x) for x in texts], dtype=object)

    return run(text)
