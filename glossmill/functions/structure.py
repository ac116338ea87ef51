"""Structure of texts, as expressions of built-in functions: sentences, questions, tokens, spans."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words whose full stop ends no sentence.
ABBREVIATIONS = ["Dr", "Mr", "Mrs", "Ms", "Prof", "Fig", "No", "vs", "etc"]
#: Classes of tokens, the first that fits wins.
TOKENS = [
    r"https?://[^\s]+",
    r"[A-Za-z0-9._]+@[A-Za-z0-9]+(?:\.[A-Za-z0-9]+)+",
    r"[0-9]+(?:[.,][0-9]+)+%?",
    r"[0-9]+%?",
    r"(?:[A-Z]\.){2,}",
    r"\p{L}+(?:['’]\p{L}+)+",
    r"\p{L}+(?:-\p{L}+)+",
    r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}]",
    r"\p{L}+",
    r"\.\.\.",
    r"--+",
    r"[^\s\p{L}0-9]",
]
#: Where a word of any script begins and ends.
BEGIN, END = r"(?<![\p{L}\p{N}])", r"(?![\p{L}\p{N}])"
NO_SPACE_BEFORE, NO_SPACE_AFTER = ".,!?;:%)]}'”’", "([{'“‘"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is worked out once: inside lambdas an expression would be worked out again for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _words(xs: list[str]) -> str:
    return "|".join(re.escape(x) for x in sorted(xs, key=lambda x: (-len(x), x)))


def sentences(text: Column, abbreviations: list[str] = ABBREVIATIONS) -> Column:
    """The text cut after . ! ? and white space (not after an abbreviation), and after 。！？; blank parts go."""
    cut = rf"(?<=[.!?])(?<!(?<![0-9A-Za-z_])(?:{_words(abbreviations)})\.)\s+|(?<=[。！？])"
    return F.filter(F.split(text, cut), lambda x: F.trim(x) != "")


def sentences_lossless(text: Column) -> Column:
    """Sentences whose concatenation is the text: white space stays with the sentence before it."""
    return F.regexp_extract_all(text, F.lit(r"""(?s)(.+?(?:[.!?]["')\]]*\s+|[。！？]|\z))"""), F.lit(1))


# What questions and answers are headed by, and how many questions a response without a mark of its own needs.
QUESTIONS = {
    "ja": "質問|問題|问题|质问|質问|质问|賨問|要問|膪問|贅問|背景的な質問|質急|质询|資問|落川|賶問",
    "zh": "提问|提問|提答|提考|問題|供稿|提請|提交问|问题",
    "en": "question|q",
}
ANSWERS = {"ja": "回答|答案|回應|回问|回问答", "zh": "回答|答案|回應|回问|回问答", "en": "answer|a"}
LEAST_QUESTIONS = {"ja": 2, "zh": 5, "en": 5}
# End of the fixed values.


def qa_heading(words: str, lang: str, more: str = "") -> str:
    """A pattern for a heading. In English it begins a line, in any case and with any marks; in Japanese and Chinese it
    begins with #, a number with a full stop may follow, and `more` may stand before the word."""
    if lang == "en":
        return rf"(?im)^\W*(?:{words})\s*\d*\W*[:：]\W*"
    return rf"#+\s*(?:\d+\.\s*)?{more}(?:{words})\s*\d*\s*[:：](?!\s*\.)\s*"


_CJK_WORDS = r"(?:[\x{3040}-\x{30FF}\x{4E00}-\x{9FAF}\x{FF66}-\x{FF9F}]{2,12}?)?"


def _stripped(x: Column) -> Column:
    return F.regexp_replace(x, r"^\s+|\s+$", "")


def response_body(text: Column) -> Column:
    """What a response says after its thinking: after the last </think>, else its second of two blocks, else all."""
    after = F.element_at(F.split(text, "</think>"), -1)
    blocks = F.split(text, r"\n\n\n")
    return F.when(F.contains(text, F.lit("</think>")), after).when(F.size(blocks) == 2, blocks[1]).otherwise(text)


def qa_pairs(text: Column, lang: Column | str = "en", least: dict[str, int] = LEAST_QUESTIONS) -> Column:
    """struct<qa array<struct<q, a>>, reject>: the pairs of a response, cut at the headings of its language.

    A response needs two questions; one that has neither thinking nor two blocks needs as many as `least` says for its
    language. reject is null, 'headings' (fewer) or 'answers' (no question has an answer); an unknown language gives null.
    """
    lang = F.lit(lang) if isinstance(lang, str) else lang
    body = response_body(text)
    marked = F.contains(text, F.lit("</think>")) | (F.size(F.split(text, r"\n\n\n")) == 2)
    out = None
    for name, n in least.items():
        question = qa_heading(QUESTIONS[name], name, _CJK_WORDS if name == "ja" else "")
        parts = F.split(body, question)
        own = F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))
        cut = _cut(own, qa_heading(ANSWERS[name], name))
        qa = F.transform(F.filter(cut, lambda x: (F.size(x) == 2) & (_stripped(x[0]) != "") & (_stripped(x[1]) != "")), lambda x: F.struct(_stripped(x[0]).alias("q"), _stripped(x[1]).alias("a")))
        reject = F.when(F.size(own) < F.when(marked, 2).otherwise(n), F.lit("headings")).when(F.size(qa) == 0, F.lit("answers"))
        row = F.struct(F.when(reject.isNull(), qa).otherwise(F.slice(qa, 1, 0)).alias("qa"), reject.alias("reject"))
        out = F.when(lang == name, row) if out is None else out.when(lang == name, row)
    return F.when(text.isNotNull(), out)


def _cut(parts: Column, at: str) -> Column:
    return F.transform(parts, lambda x: F.split(x, at, 2))


def translation_parts(text: Column) -> Column:
    """struct<title, abstract> of a response: from JSON-like fields, else from `Title: … Abstract: …`, else null."""
    fields, plain = r'(?s)"title": "(.*?)",\s*"abstract": "(.*?)"', r"(?s)Title:\s*(.*?)\s*Abstract:\s*(.*)"
    out = None
    for p in (fields, plain):
        row = F.struct(F.regexp_extract(text, p, 1).alias("title"), F.regexp_extract(text, p, 2).alias("abstract"))
        fits = F.regexp_like(text, F.lit(p))
        out = F.when(fits, row) if out is None else out.when(fits, row)
    return out


def word_tokens(text: Column) -> Column:
    """Tokens by TOKENS: links, addresses, numbers, words, single ideographs and kana, marks; white space goes."""
    return F.regexp_extract_all(text, F.lit("(" + "|".join(TOKENS) + ")"), F.lit(1))


def detokenized(tokens: Column) -> Column:
    """Tokens joined with blanks, but none before closing marks or after opening ones."""
    before, after = (re.escape(x).replace("'", "\\'") for x in (NO_SPACE_BEFORE, NO_SPACE_AFTER))
    return F.regexp_replace(F.regexp_replace(F.array_join(tokens, " "), f" ([{before}])", "$1"), f"([{after}]) ", "$1")


def char_class(token: Column) -> Column:
    """Japanese, English, or punctuation of either; a blank token is Japanese, as nothing in it is otherwise."""
    return (
        F.when(F.trim(token) == "", "Japanese")
        .when(F.regexp_like(token, F.lit(r"^[\p{IsHan}\p{IsHiragana}\p{IsKatakana}ー々]+$")), "Japanese")
        .when(F.regexp_like(token, F.lit(r"^[A-Za-z0-9]+$")), "English")
        .when(F.regexp_like(token, F.lit(r"^[!-/:-@\[-`{-~]+$")), "En-Punctuation")
        .when(F.regexp_like(token, F.lit(r"^[\p{P}\p{S}]+$")), "Ja-Punctuation")
        .otherwise("Other")
    )


def located(text: Column, tokens: Column) -> Column:
    """array<struct<token, start, end>> from 0: each token is sought from the end of the one found before; misses are skipped."""
    none = F.slice(F.array(F.struct(F.lit("").alias("token"), F.lit(0).alias("start"), F.lit(0).alias("end"))), 1, 0)

    def step(acc: Column, x: Column) -> Column:
        at = F.locate_from(x, text, acc["at"]) if hasattr(F, "locate_from") else F.position(x, text, acc["at"] + 1)
        end = at - 1 + F.length(x)
        row = F.struct(x.alias("token"), (at - 1).alias("start"), end.alias("end"))
        hit = F.struct(end.alias("at"), F.array_append(acc["found"], row).alias("found"))
        return F.when(at > 0, hit).otherwise(acc)

    return F.aggregate(tokens, F.struct(F.lit(0).alias("at"), none.alias("found")), step, lambda acc: acc["found"])


def spans_replaced(text: Column, recipe: Column) -> Column:
    """The text with each (start, end, code) of a recipe, sorted by start and without overlaps, put in place of its span."""

    def step(acc: Column, r: Column) -> Column:
        at = r["start"] + acc["off"]
        new = F.concat(F.substring(acc["text"], F.lit(1), at), r["code"], F.substring(acc["text"], at + (r["end"] - r["start"]) + 1, F.length(acc["text"])))
        return F.struct(new.alias("text"), (acc["off"] + F.length(r["code"]) - (r["end"] - r["start"])).alias("off"))

    return F.aggregate(recipe, F.struct(text.alias("text"), F.lit(0).alias("off")), step, lambda acc: acc["text"])


def greedy_spans(spans: Column) -> Column:
    """The spans (with start and end, in their order) that overlap no span accepted before; touching counts as overlap."""
    none = F.slice(spans, 1, 0)

    def step(acc: Column, x: Column) -> Column:
        free = ~F.exists(acc, lambda y: ~((x["end"] < y["start"]) | (x["start"] > y["end"])))
        return F.when(free, F.array_append(acc, x)).otherwise(acc)

    return F.aggregate(spans, none, step)


def bio_entities(words: Column, tags: Column) -> Column:
    """The entities of B (1), I (2) and O (0) tags, as strings; ["none"] without one. An I without a B before it begins one."""
    w = F.arrays_zip(words.alias("w"), tags.alias("t"))
    empty = F.array().cast("array<string>")

    def step(acc: Column, x: Column) -> Column:
        done = F.when(F.size(acc["open"]) > 0, F.array_append(acc["done"], F.array_join(acc["open"], " "))).otherwise(acc["done"])
        begun = F.struct(done.alias("done"), F.array(x["w"]).alias("open"))
        return (
            F.when(x["t"] == 1, begun)
            .when(x["t"] == 2, F.struct(acc["done"].alias("done"), F.array_append(acc["open"], x["w"]).alias("open")))
            .otherwise(F.struct(done.alias("done"), empty.alias("open")))
        )

    def finish(acc: Column) -> Column:
        done = F.when(F.size(acc["open"]) > 0, F.array_append(acc["done"], F.array_join(acc["open"], " "))).otherwise(acc["done"])
        return F.when(F.size(done) > 0, done).otherwise(F.array(F.lit("none")))

    return F.aggregate(w, F.struct(empty.alias("done"), empty.alias("open")), step, finish)


def abbreviations(text: Column) -> Column:
    """array<struct<short, long>>: `Long Form (LF)`; the long form is the last words before the bracket, as many as the short has letters."""
    hits = F.regexp_extract_all(text, F.lit(r"((?:[\p{L}-]+ ){1,8}\([A-Z]{2,8}\))"), F.lit(1))

    def row(x: Column) -> Column:
        short = F.regexp_extract(x, r"\(([A-Z]+)\)", 1)
        words = F.filter(F.split(F.substring_index(x, "(", 1), " "), lambda w: w != "")
        n = F.least(F.length(short), F.size(words))
        return F.struct(short.alias("short"), F.array_join(F.slice(words, F.size(words) - n + 1, n), " ").alias("long"))

    return F.transform(hits, row)


# --- arrays of scores ------------------------------------------------------------------------------------------------
def argmin(losses: Column) -> Column:
    """The first place (from 0) of the least loss."""
    return (F.array_position(losses, F.array_min(losses)) - 1).cast("int")


def norm_losses(losses: Column, tokens: Column) -> Column:
    """Losses over their numbers of tokens; null as a whole if any number is 0, so that callers fall back to raw losses."""
    return F.when(~F.exists(tokens, lambda n: n == 0), F.zip_with(losses, tokens, lambda x, n: x / n))


def normalized_argmin(losses: Column, tokens: Column) -> Column:
    return F.coalesce(argmin(norm_losses(losses, tokens)), argmin(losses))


def quartile_parts(items: Column, parts: str) -> Column:
    """The items of some quarters: the i-th of n has quarter sorted(i mod 4) at place i; parts names quarters, as in '34'."""
    quarter = F.array_sort(F.transform(items, lambda _, i: i % 4))
    wanted = F.array(*(F.lit(int(p) - 1) for p in parts))
    both = F.zip_with(items, quarter, lambda x, q: F.struct(x.alias("x"), q.alias("q")))
    return F.transform(F.filter(both, lambda y: F.array_contains(wanted, y["q"])), lambda y: y["x"])


def prefix_suffix(items: Column, key: Column) -> Column:
    """struct<prefix, suffix>: sentences cut at a place 1 <= i < n that a hash of the key gives; null below two."""
    n = F.size(items)
    i = (uniform(key) * (n - 1)).cast("int") + 1
    return F.when(n >= 2, F.struct(F.array_join(F.slice(items, F.lit(1), i), " ").alias("prefix"), F.array_join(F.slice(items, i + 1, n), " ").alias("suffix")))


def aligned(a: Column, b: Column) -> Column:
    """array<struct<i, j>>: places of a and b with equal values, greedily from the left."""
    none = F.slice(F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j"))), 1, 0)
    numbered = F.transform(a, lambda x, i: F.struct(x.alias("x"), i.alias("i")))

    def step(b: Column, acc: Column, x: Column) -> Column:
        at = F.array_position(F.slice(b, acc["at"] + 1, F.size(b)), x["x"]).cast("int")
        row = F.struct(x["i"].alias("i"), (acc["at"] + at - 1).alias("j"))
        return F.when(at > 0, F.struct((acc["at"] + at).alias("at"), F.array_append(acc["found"], row).alias("found"))).otherwise(acc)

    start = F.struct(F.lit(0).alias("at"), none.alias("found"))
    return let(b, lambda all_: F.aggregate(numbered, start, lambda acc, x: step(all_, acc, x), lambda acc: acc["found"]))


# --- tokens of a model's answer ----------------------------------------------------------------------------------------
def after_pattern(tokens: Column, pattern: list[str]) -> Column:
    """The places (from 0) of the tokens that follow an occurrence of the pattern."""
    n = len(pattern)
    want = F.array(*map(F.lit, pattern))
    places = F.when(F.size(tokens) > n, F.sequence(F.lit(0), F.size(tokens) - n - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(F.filter(places, lambda i: F.slice(tokens, i + 1, F.lit(n)) == want), lambda i: i + n)


def true_false(tokens: Column, logprobs: Column, pattern: list[str]) -> Column:
    """struct<value, logprob>: whether the token after the pattern says true or false, and its logprob; null if none or both do."""
    row = lambda xs, v: F.struct(F.lit(v).alias("value"), F.get(xs, F.lit(0))["p"].alias("logprob"))

    def judged(said: Column) -> Column:
        both = F.struct(F.filter(said, lambda x: x["t"] == "true").alias("yes"), F.filter(said, lambda x: x["t"] == "false").alias("no"))
        return let(both, lambda x: F.when((F.size(x["yes"]) > 0) & (F.size(x["no"]) == 0), row(x["yes"], True)).when((F.size(x["no"]) > 0) & (F.size(x["yes"]) == 0), row(x["no"], False)))

    def said(every: Column) -> Column:
        return F.transform(after_pattern(every["t"], pattern), lambda i: F.struct(F.lower(F.trim(F.get(every["t"], i))).alias("t"), F.get(every["p"], i).alias("p")))

    return let(F.struct(tokens.alias("t"), logprobs.alias("p")), lambda every: let(said(every), judged))


# --- repeatable chance -------------------------------------------------------------------------------------------------
def uniform(*parts: Column | str) -> Column:
    """A number in [0, 1) from the MD5 digest of the parts joined by colons: the same under any partitioning."""
    text = F.concat_ws(":", *(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))
