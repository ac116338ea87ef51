"""Text functions for which Spark has no built-in: Arrow-batched, each a pure function of its input."""

from __future__ import annotations

import json
import re
import unicodedata

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

_LITERALS = {"NULL": "null", "TRUE": "true", "FALSE": "false", "None": "null", "True": "true", "False": "false"}
#: What bears on strings, and literals in another language's case.
_STRINGS = re.compile(r"""\\.|"|\b(?:""" + "|".join(_LITERALS) + r")\b", re.S)


def first_block(text: str | None, opening: str = "{", closing: str = "}") -> str | None:
    """The balanced block whose opening bracket stands first; brackets within strings count for nothing.

    One pass over the text from its first opening bracket, with a stack of those that are open: brackets that are never
    closed stay there. A quotation mark that is never closed opens no string.
    """
    start = (text or "").find(opening)
    if start < 0:
        return None
    open_: list[int] = []
    best: tuple[int, int] | None = None
    brackets = re.escape(opening + closing)
    signs = re.compile(rf'\\.|["{brackets}]', re.S)
    while True:
        quote = None
        for m in signs.finditer(text, start):
            x = m[0]
            if quote is not None:
                if x == '"':
                    quote = None
                continue
            c = x[-1]
            if c == opening:
                open_.append(m.end() - 1)
            elif c == '"':
                quote = m.end() - 1
            elif c == closing and open_:
                own = open_.pop()
                if best is None or own < best[0]:
                    best = own, m.end()
                if not open_:  # nothing that stands before it is still open
                    return text[best[0] : best[1]]
        if quote is None:
            break
        signs, start = re.compile(f"[{brackets}]"), quote + 1
    return None if best is None else text[best[0] : best[1]]


def json_literals(block: str) -> str:
    """Literals in JSON's case, but not within strings."""
    out, at, inside = [], 0, False
    for m in _STRINGS.finditer(block):
        if m[0] == '"':
            inside = not inside
        elif m[0][0] == "\\":
            if not inside and m[0] == '\\"':
                inside = True
        elif not inside:
            out += [block[at : m.start()], _LITERALS[m[0]]]
            at = m.end()
    return "".join([*out, block[at:]])


def robust_json(text: str | None) -> str | None:
    """A model's answer as JSON text: the first block, literals in JSON's case (not within strings); null if it doesn't parse."""
    block = first_block(re.sub(r"```(?:json)?", "", text or ""))
    try:
        return None if block is None else json.dumps(json.loads(json_literals(block)), ensure_ascii=False)
    except (ValueError, RecursionError):
        return None


#: Basic Hepburn syllables, by rows of the kana table.
_VOWELS = "aiueo"
_ROWS = {"": "あいうえお", "k": "かきくけこ", "s": "さしすせそ", "t": "たちつてと", "n": "なにぬねの", "h": "はひふへほ", "m": "まみむめも", "r": "らりるれろ", "g": "がぎぐげご", "z": "ざじずぜぞ", "d": "だぢづでど", "b": "ばびぶべぼ", "p": "ぱぴぷぺぽ"}
_OTHER = {"し": "shi", "ち": "chi", "つ": "tsu", "ふ": "fu", "じ": "ji", "ぢ": "ji", "づ": "zu", "や": "ya", "ゆ": "yu", "よ": "yo", "わ": "wa", "を": "o", "ん": "n"}
_KANA = {c: row + v for row, cs in _ROWS.items() for c, v in zip(cs, _VOWELS, strict=True)} | _OTHER


def romanize(text: str | None) -> str | None:
    """Kana to Latin letters (small ya/yu/yo, double consonants, long vowels by repetition); the rest stays."""
    if text is None:
        return None
    out: list[str] = []
    double = False
    for c in unicodedata.normalize("NFKC", text):
        h = chr(ord(c) - 0x60) if "ァ" <= c <= "ヶ" else c
        if h == "っ":
            double = True
            continue
        if h in "ゃゅょ" and out and out[-1].endswith("i"):
            stem, v = out[-1][:-1], {"ゃ": "a", "ゅ": "u", "ょ": "o"}[h]
            out[-1] = stem + (v if stem.endswith(("sh", "ch", "j")) else "y" + v)
            continue
        if c == "ー" and out and out[-1][-1:] in _VOWELS:
            out.append(out[-1][-1])
            continue
        x = _KANA.get(h, c)
        out.append(("t" if double and x.startswith("ch") else x[0] if double and x[:1].isalpha() else "") + x)
        double = False
    return "".join(out)


def word_levenshtein(a: list[str], b: list[str]) -> int:
    """Words that must be put in, taken out or changed to make b of a."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def _column(fn, kind: T.DataType):
    @F.pandas_udf(kind)
    def run(x: pd.Series) -> pd.Series:
        return x.map(lambda v: fn(None if v is None else v))

    return run


nfkc_column = _column(lambda x: None if x is None else unicodedata.normalize("NFKC", x), T.StringType())
first_block_column = _column(first_block, T.StringType())
robust_json_column = _column(robust_json, T.StringType())
romanize_column = _column(romanize, T.StringType())
first_array_column = _column(lambda x: first_block(x, "[", "]"), T.StringType())


@F.pandas_udf(T.IntegerType())
def word_distance(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else word_levenshtein(list(x), list(y)) for x, y in zip(a, b, strict=True)])
