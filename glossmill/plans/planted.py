"""Headings and cues of three languages, planted into the documents' texts: they have none of their own.

A document's number gives its language, and which words and forms it has; over the table all of them occur. Texts are
SQL that both engines run; sentences are planted by an expression of each engine.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import cues

LANGS = ("en", "zh", "ja")
LANG = "CASE doc_id % 3 WHEN 0 THEN 'en' WHEN 1 THEN 'zh' ELSE 'ja' END"
SPACE = r"[\s\x{a0}\x{3000}]"


def quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def pick(words: list[str], number: str) -> str:
    """The word whose place is the number modulo the list's length."""
    return f"CASE ({number}) % {len(words)} " + " ".join(f"WHEN {i} THEN {quoted(w)}" for i, w in enumerate(words)) + " END"


def over(n: int) -> str:
    return f"CAST(floor(doc_id / {n}) AS BIGINT)"


FORMS = ["'[ ' || {w} || ']'", "'[' || {w} || ' ]:'", "'【' || {w} || '　】'", "'(' || {w} || ')'", "'（ ' || {w} || '）'", "'「' || {w} || '」'", "{w} || ':'", "{w} || '：'", "{w} || '　'", "{w} || ' '"]


def _heading(section: str, shift: int) -> str:
    return f"CASE ({over(7)} + {shift}) % {len(FORMS)} " + " ".join(f"WHEN {i} THEN {f.format(w=section + str(shift % 2))}" for i, f in enumerate(FORMS)) + " END"


def _kept(columns: tuple[str, ...]) -> str:
    return "".join(f", {c}" for c in columns)


def abstracts(parts: str, keep: tuple[str, ...] = ()) -> str:
    """doc_id, lang, abstract: sections in order, out of order, with one repeated, and with one alone; and what is to be kept."""
    h = _heading
    more = _kept(tuple(c for c in keep if c not in ("s1", "s2", "s3", "s4")))
    word = ", ".join(
        "CASE " + " ".join(f"WHEN lang = '{lang}' THEN {pick(cues.SECTIONS[lang][s], f'{over(5)} + {k}')}" for lang in LANGS) + f" END AS {s}{k}" for s in cues.SECTIONS["en"] for k in (0, 1)
    )
    return f"""SELECT doc_id, lang, CASE {over(3)} % 4
  WHEN 0 THEN {h("goal", 0)} || s1 || '. ' || {h("method", 1)} || s2 || '. ' || {h("result", 2)} || s3 || '. ' || {h("conclu", 3)} || s4 || '.'
  WHEN 1 THEN 'Before. ' || {h("result", 1)} || s1 || '. ' || {h("goal", 0)} || s2 || '.'
  WHEN 2 THEN {h("goal", 0)} || s1 || '. ' || {h("method", 2)} || s2 || '. ' || {h("goal", 3)} || s3 || '. ' || {h("result", 0)} || s4
  ELSE {h("method", 1)} || s1 END AS abstract{_kept(keep)} FROM (SELECT doc_id, lang, s1, s2, s3, s4, {word}{more} FROM (SELECT doc_id, {LANG} AS lang, s1, s2, s3, s4{more} FROM ({parts}) AS p) AS q) AS r"""


def _escaped(x: str) -> str:
    return re.sub(r"([\\.+*?()|\[\]{}^$])", r"\\\1", x)


def _heads(words: list[str]) -> str:
    """Any form of any word, first words first."""
    s = SPACE + "*"
    forms = [rf"\[{s}{{w}}{s}\]", rf"\[{s}{{w}}{s}\]:", f"【{s}{{w}}{s}】", rf"\({s}{{w}}{s}\)", f"（{s}{{w}}{s}）", f"「{s}{{w}}{s}」", "{w}:", "{w}：", "{w}　", "{w} "]
    return "|".join(f.replace("{w}", _escaped(w)) for w in words for f in forms)


def sections_oracle(parts: str) -> str:
    """s (doc_id, section, pos, text): found by one pattern for each language and section."""
    each = " UNION ALL ".join(
        f"SELECT doc_id, abstract, '{s}' AS section, regexp_extract_all(abstract, {quoted(_heads(words))}) AS heads FROM a WHERE lang = '{lang}'" for lang, by in cues.SECTIONS.items() for s, words in by.items()
    )
    edge = r"[ \t\r\n\f\x{3000}]+"
    return f"""a AS ({abstracts(parts)}), found AS ({each}),
    placed AS (SELECT doc_id, abstract, section, heads[1] AS head, strpos(abstract, heads[1]) AS pos FROM found WHERE len(heads) = 1),
    cut AS (SELECT *, lead(pos) OVER (PARTITION BY doc_id ORDER BY pos) AS next, count(*) OVER (PARTITION BY doc_id) AS n FROM placed),
    s AS (SELECT doc_id, section, pos, regexp_replace(substring(abstract, pos + length(head), greatest(0, coalesce(next, length(abstract) + 1) - pos - length(head))), '^{edge}|{edge}$', '', 'g') AS text FROM cut WHERE n > 1)"""


def concluded(parts: str, keep: tuple[str, ...] = ()) -> str:
    """doc_id, lang, text: a conclusion's cue within the text, at its beginning alone, and at both places; and what is to be kept."""
    more = _kept(keep)
    ja = pick(cues.CONCLUSION_STEMS["ja"], over(5))
    boxed = pick([a + w + b for a, b in ("【】", "（）") for w in cues.CONCLUSION_BRACKETED], over(5))
    suffix = pick(cues.SUFFIXES, over(4))
    cue = f"CASE WHEN lang = 'en' AND {over(9)} % 2 = 0 THEN upper({pick(cues.CONCLUSION_EN, over(3))}) WHEN lang = 'en' THEN {pick(cues.CONCLUSION_EN, over(3))} WHEN lang = 'zh' THEN {pick(cues.CONCLUSION_STEMS['zh'], over(5))} || {suffix} WHEN {over(3)} % 3 = 0 THEN {boxed} || {suffix} ELSE {ja} || {suffix} END"
    return f"""SELECT doc_id, lang, CASE {over(3)} % 4 WHEN 0 THEN cue || s1 WHEN 1 THEN cue || s1 || '. ' || cue || s2 ELSE s1 || '. ' || cue || s2 || '. ' || s3 END AS text{more}
  FROM (SELECT doc_id, lang, s1, s2, s3, {cue} AS cue{more} FROM (SELECT doc_id, {LANG} AS lang, s1, s2, s3{more} FROM ({parts}) AS p) AS q) AS r"""


def concluded_oracle(table: str) -> str:
    """c (doc_id, lang, text, n): how many characters stand before the first cue that is not at the beginning."""
    each = " UNION ALL ".join(
        f"SELECT *, length(regexp_extract(text, {quoted(f'(?is)^(?:{alt})')})) AS first, {quoted(lang)} AS l, "
        f"CASE WHEN length(regexp_extract(text, {quoted(f'(?is)^(?:{alt})')})) = 0 THEN 0 ELSE length(regexp_extract(text, {quoted(f'(?is)^(?:{alt})')})) END AS skip, "
        f"regexp_extract(substring(text, 1 + length(regexp_extract(text, {quoted(f'(?is)^(?:{alt})')}))), {quoted(f'(?is)^(.*?)(?:{alt})')}, 0) AS whole, "
        f"regexp_extract(substring(text, 1 + length(regexp_extract(text, {quoted(f'(?is)^(?:{alt})')}))), {quoted(f'(?is)^(.*?)(?:{alt})')}, 1) AS before FROM t WHERE lang = '{lang}'"
        for lang, alt in ((x, "|".join(map(_escaped, cues.CONCLUSIONS[x]))) for x in LANGS)
    )
    return f"t AS ({table}), e AS ({each}), c AS (SELECT doc_id, lang, text, skip + length(before) AS n FROM e WHERE whole <> '' AND skip + length(before) > 0)"


def flat(lang: str) -> list[str]:
    return [w for words in cues.RELATIONS[lang].values() for w in words]


def cued(sentences: Column, key: Column, lang: Column) -> Column:
    """Every third sentence begins with a cue of the language; in English every other third has one within."""

    def planted(name: str, x: Column, i: Column) -> Column:
        words = F.array(*map(F.lit, flat(name)))
        cue = F.get(words, (key + i).cast("int") % len(flat(name)))
        if name != "en":
            return F.when(i % 3 == 1, F.concat(cue, F.lit("、"), x)).otherwise(x)
        return F.when(i % 3 == 1, F.concat(F.when(i % 2 == 0, F.upper(cue)).otherwise(cue), F.lit(", "), x)).when(i % 3 == 2, F.concat(x, F.lit(" end, "), cue, F.lit(", "), x)).otherwise(x)

    def every(name: str) -> Column:
        return F.transform(sentences, lambda x, i: planted(name, x, i))

    return F.when(lang == "en", every("en")).when(lang == "zh", every("zh")).otherwise(every("ja"))


def causal_oracle(sentences: str, langs: tuple[str, ...] = LANGS) -> str:
    """c (doc_id, pos, kind, k, relation, a, b): kind 0 within a sentence, 1 with the one before; k is the relation's place.

    sentences: doc_id, s (a list) of documents in these languages.
    """
    def stripped(x: str) -> str:
        return f"regexp_replace({x}, '^{SPACE}+|{SPACE}+$', '', 'g')"

    def unmarked(x: str) -> str:
        return f"CASE WHEN regexp_matches({x}, '^[,、，:：　 ]') THEN {stripped(f'substring({x}, 2)')} ELSE {x} END"

    plant, starts, within = [], [], []
    for lang in langs:
        words = flat(lang)
        cue = "[" + ", ".join(map(quoted, words)) + f"][1 + CAST((doc_id + i) % {len(words)} AS INT)]"
        if lang == "en":
            x = f"CASE i % 3 WHEN 1 THEN CASE WHEN i % 2 = 0 THEN upper({cue}) ELSE {cue} END || ', ' || x WHEN 2 THEN x || ' end, ' || {cue} || ', ' || x ELSE x END"
        else:
            x = f"CASE i % 3 WHEN 1 THEN {cue} || '、' || x ELSE x END"
        plant.append(f"SELECT doc_id, '{lang}' AS lang, i, {x} AS x FROM p WHERE lang = '{lang}'")
        for k, (relation, own) in enumerate(cues.RELATIONS[lang].items()):
            listed = "[" + ", ".join(map(quoted, own)) + "]"
            rest = "ltrim(substring(x, 1 + length(cue)))" if lang == "en" else "substring(x, 1 + length(cue))"
            starts.append(
                f"SELECT doc_id, i AS pos, 1 AS kind, {k} AS k, '{relation}' AS relation, prev AS a, {unmarked('rest')} AS b FROM (SELECT *, {rest} AS rest FROM (SELECT *, list_filter({listed}, lambda c: starts_with(lower(x), c))[1] AS cue FROM l WHERE lang = '{lang}' AND i > 0) AS f WHERE cue IS NOT NULL) AS g"
            )
            if lang != "en":
                continue
            more = "CASE WHEN more <> '' THEN more ELSE rest END"
            word, other = r"[\p{L}\p{N}_]", r"[^\p{L}\p{N}_]"
            for j, c in enumerate(own):
                p = _escaped(", " + c)
                pattern = quoted(f"(?is)^(.*?{word}){p}(?:$|{other})")
                rest = f"substring(x, 1 + length(a) + {len(c) + 2})"
                within.append(
                    f"SELECT doc_id, pos, {k} AS k, {j} AS j, '{relation}' AS relation, {stripped('a')} AS a, {stripped(more)} AS b FROM (SELECT *, regexp_extract(rest, {pattern}, 1) AS more FROM (SELECT *, {rest} AS rest FROM (SELECT doc_id, i AS pos, x, regexp_extract(x, {pattern}, 1) AS a FROM l WHERE lang = 'en' AND contains(lower(x), {quoted(', ' + c)})) AS f WHERE a <> '') AS g) AS h"
                )
    ctes = [f"p AS (SELECT doc_id, {LANG} AS lang, unnest(range(len(s))) AS i, unnest(s) AS x FROM ({sentences}) AS q)", f"e AS ({' UNION ALL '.join(plant)})", "l AS (SELECT *, lag(x) OVER (PARTITION BY doc_id ORDER BY i) AS prev FROM e)"]
    parts = starts
    if within:
        ctes.append(f"w AS ({' UNION ALL '.join(within)})")
        parts = [*starts, f"SELECT doc_id, pos, 0 AS kind, k, relation, a, {unmarked('b')} AS b FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, pos, k ORDER BY j) AS first FROM w) AS f WHERE first = 1 AND a <> '' AND b <> ''"]
    ctes.append(f"c AS ({' UNION ALL '.join(parts)})")
    return ", ".join(ctes)
