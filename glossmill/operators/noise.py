"""Noise on words, tokens and sentences, repeatable by a key: the same under any partitioning."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.structure import detokenized, let, quartile_parts, spans_replaced, uniform, word_tokens
from . import phrases
from .ranking import numbered

#: What stands in the labels of tokens that noise left alone, and in place of a masked token.
PLAIN, MASK = "<token>", "<unk>"


def _hit(key: Column, seed: str, p: float) -> Callable[[Column, Column], Column]:
    """Whether chance p falls on the token at a place; never on the first."""
    return lambda _, i: (i > 0) & (uniform(seed, key, i) < p)


def mask(tokens: Column, key: Column, p: float, seed: str = "mask") -> Column:
    """struct<tokens, labels>: each token but the first becomes MASK with probability p."""
    hit = _hit(key, seed, p)
    return F.struct(F.transform(tokens, lambda x, i: F.when(hit(x, i), MASK).otherwise(x)).alias("tokens"), F.transform(tokens, lambda x, i: F.when(hit(x, i), "<mask>").otherwise(PLAIN)).alias("labels"))


def delete(tokens: Column, key: Column, p: float, seed: str = "delete") -> Column:
    """struct<tokens, labels>: each token but the first goes with probability p; the one after a gap is labelled."""
    hit = _hit(key, seed, p)
    kept = F.filter(F.transform(tokens, lambda x, i: F.struct(x.alias("x"), hit(x, i).alias("gone"), hit(x, i - 1).alias("after"))), lambda y: ~y["gone"])
    return F.struct(F.transform(kept, lambda y: y["x"]).alias("tokens"), F.transform(kept, lambda y: F.when(y["after"], "<delete>").otherwise(PLAIN)).alias("labels"))


def replace(tokens: Column, key: Column, p: float, vocabulary: Column, seed: str = "replace") -> Column:
    """struct<tokens, labels>: each token but the first becomes an entry of the vocabulary with probability p."""
    hit = _hit(key, seed, p)
    entry = lambda i: F.get(vocabulary, (uniform(seed, F.lit("id"), key, i) * F.size(vocabulary)).cast("int"))
    return F.struct(F.transform(tokens, lambda x, i: F.when(hit(x, i), entry(i)).otherwise(x)).alias("tokens"), F.transform(tokens, lambda x, i: F.when(hit(x, i), "<replace>").otherwise(PLAIN)).alias("labels"))


def noise_rate(labels: Column) -> tuple[Column, Column]:
    """(noisy labels, all labels) of a row, for the share over rows."""
    return F.size(F.filter(labels, lambda x: x != PLAIN)), F.size(labels)


def noise_rates(rows: DataFrame, dataset: str, checkpoint: str, labels: str, loss: str) -> DataFrame:
    """(dataset, checkpoint, noise_rate, mean_loss, constant): the share of noisy labels of each data set at each checkpoint.

    The labels of a data set are the same at every checkpoint; constant says whether their shares are (a wrong file of a
    checkpoint shows there). A window over a data set's checkpoints compares them: a row for each.
    """
    noisy, every = noise_rate(F.col(labels))
    per = rows.groupBy(dataset, checkpoint).agg(F.sum(noisy).alias("n"), F.sum(every).alias("m"), F.avg(loss).alias("loss"))
    rate = F.round(F.try_divide("n", "m"), 6)
    w = Window.partitionBy(dataset)
    same = F.min(rate).over(w) == F.max(rate).over(w)
    return per.select(dataset, checkpoint, rate.alias("noise_rate"), F.round("loss", 4).alias("mean_loss"), same.alias("constant"))


def rewrite(sentences: Column, rewrites: Column, key: Column, ratio: float, seed: str = "rewrite") -> Column:
    """struct<sentences, labels>: each sentence becomes one of its rewrites (an array, chosen evenly) with probability ratio.

    A sentence without rewrites stays.
    """
    both = F.zip_with(sentences, rewrites, lambda s, r: F.struct(s.alias("s"), r.alias("r")))

    def one(x: Column, i: Column) -> Column:
        n = F.coalesce(F.size(x["r"]), F.lit(0))
        hit = (n > 0) & (uniform(seed, key, i) < ratio)
        pick = F.get(x["r"], (uniform(seed, F.lit("which"), key, i) * n).cast("int"))
        return F.struct(F.when(hit, pick).otherwise(x["s"]).alias("s"), F.when(hit, "<rewrite>").otherwise(PLAIN).alias("label"))

    done = F.transform(F.filter(both, lambda x: x["s"].isNotNull()), one)
    return F.struct(F.transform(done, lambda y: y["s"]).alias("sentences"), F.transform(done, lambda y: y["label"]).alias("labels"))


def permutation(n: Column, steps: Column, width: Column | int, *seed: Column | str) -> Column:
    """An order of 0..n-1 in which exactly `steps` places (at most n) are displaced; below 2, none.

    The displaced places are neighbours, from a drawn start on. They are dealt into runs of `width` (2 at least; a
    last run of one joins the run before it), and each run is turned by a drawn number of places, so that all of it
    moves, by `width` at most. An expression of built-in functions: draws are hashes of the seed.
    """
    width = F.greatest(F.lit(width) if isinstance(width, int) else width, F.lit(2))
    k = F.least(steps, n)
    start = F.floor(uniform(*seed, F.lit("start")) * (n - k + 1)).cast("int")
    runs = F.ceil(k / width).cast("int")
    runs = F.when((k % width == 1) & (runs > 1), runs - 1).otherwise(runs)

    def moved(fixed: Column) -> Column:
        n, k, start, runs, width = (fixed[x] for x in ("n", "k", "start", "runs", "width"))

        def place(i: Column) -> Column:
            j = i - start
            run = F.least(F.floor(j / width).cast("int"), runs - 1)
            size = F.when(run == runs - 1, k - run * width).otherwise(width)
            turn = 1 + F.floor(uniform(*seed, F.lit("turn"), run) * (size - 1)).cast("int")
            return F.when((k < 2) | (j < 0) | (j >= k), i).otherwise(start + run * width + (j - run * width + turn) % size)

        return F.transform(F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>")), place)

    fixed = F.struct(n.cast("int").alias("n"), k.cast("int").alias("k"), start.alias("start"), runs.alias("runs"), width.cast("int").alias("width"))
    return F.when(n.isNotNull(), let(fixed, moved))


def ordered(items: Column, order: Column) -> Column:
    return let(items, lambda every: F.transform(order, lambda i: F.get(every, i)))


def token_reorder(rows: DataFrame, tokens: str, key: str, rate: float, width: int = 8, seed: str = "reorder") -> DataFrame:
    """rows with `noisy` and `displaced`: max(int(n * rate), 2) tokens are displaced, the first one stays."""
    rest = F.slice(tokens, 2, F.greatest(F.size(tokens) - 1, F.lit(0)))
    n = F.size(rest)
    out = rows.withColumn("_order", permutation(n, F.greatest((n * rate).cast("int"), F.lit(2)), width, seed, F.col(key)))
    moved = F.size(F.filter(F.transform("_order", lambda x, i: x != i), lambda x: x))
    return out.withColumn("noisy", F.concat(F.slice(tokens, 1, 1), ordered(rest, F.col("_order")))).withColumn("displaced", moved).drop("_order")


def sentence_reorder(rows: DataFrame, sentences: str, key: str, rate: float, window: int = 3, seed: str = "sentences") -> DataFrame:
    """rows with `noisy` and `displaced`: max(int(n * rate), 2) sentences are displaced within a window; a lone one stays."""
    n = F.size(sentences)
    out = rows.withColumn("_order", permutation(n, F.greatest((n * rate).cast("int"), F.lit(2)), window, seed, F.col(key)))
    moved = F.size(F.filter(F.transform("_order", lambda x, i: x != i), lambda x: x))
    return out.withColumn("noisy", ordered(F.col(sentences), F.col("_order"))).withColumn("displaced", moved).drop("_order")


def word_syntax(rows: DataFrame, text: str, key: str, rate: float, width: int = 4, seed: str = "syntax") -> DataFrame:
    """rows with `noisy`: tokens of the text, of which int(n * rate) + 1 change places, and of the others each goes with
    probability rate; then joined again."""
    out = rows.withColumn("_t", word_tokens(F.col(text)))
    n = F.size("_t")
    out = out.withColumn("_order", permutation(n, (n * rate).cast("int") + 1, width, seed, F.col(key)))
    stays = lambda x, i: (x != i) | (uniform(seed, F.lit("gone"), F.col(key), i) >= rate)
    placed = let(F.col("_t"), lambda ts: F.transform("_order", lambda x, i: F.struct(F.get(ts, x).alias("t"), stays(x, i).alias("stays"))))
    kept = F.transform(F.filter(placed, lambda y: y["stays"]), lambda y: y["t"])
    return out.withColumn("noisy", F.when(F.col(text).isNotNull(), detokenized(kept))).drop("_t", "_order")


def synonyms(rows: DataFrame, key: str, text: str, lexicon: DataFrame, p: float, seed: str) -> DataFrame:
    """rows with `noisy`, `labels` and `n_noise`: words and phrases of a lexicon (phrase, synonym) replaced with probability p.

    The lexicon is a table of any size that meets the texts by joins (phrases.annotate): of overlapping phrases the
    leftmost stays, then the longest. Marks that close a phrase stay. A phrase's place is its chance. labels has one
    for each word of the noisy text, n_noise counts the replaced phrases.
    """
    kept = numbered(rows)
    found = phrases.annotate(kept.select(F.struct(key, "_row").alias("_of"), F.col(text).alias("text"), "_row"), lexicon.select(F.col("phrase").alias("surface"), F.col("synonym").alias("label")), "_of", "_row", phrases.KNOWN_ENTRIES)
    hit = uniform(seed, F.col("_of")[key], F.col("start")) < p
    recipe = found.where(hit).groupBy("_of").agg(F.array_sort(F.collect_list(F.struct("start", "end", F.col("label").alias("code")))).alias("_recipe"))
    own = kept.join(recipe.select(F.col("_of._row").alias("_row"), "_recipe"), "_row", "left")
    none = F.array().cast("array<struct<start:int,end:int,code:string>>")
    recipe = F.coalesce("_recipe", none)
    return own.withColumns({"noisy": spans_replaced(F.col(text), recipe), "labels": _span_labels(F.col(text), recipe), "n_noise": F.size(recipe)}).drop("_row", "_recipe")


def _span_labels(text: Column, recipe: Column) -> Column:
    """PLAIN for each word between replaced spans, <synonym> for each word that takes the place of one.

    What follows a span without white space belongs to its last word.
    """
    count = lambda x: F.size(F.regexp_extract_all(x, F.lit(r"(\S+)"), F.lit(1)))
    plain = lambda x: F.array_repeat(F.lit(PLAIN), count(x))

    def labels(spans: Column) -> Column:
        def gap(start: Column, end: Column, first: Column) -> Column:
            own = F.substring(text, start + 1, end - start)
            return plain(F.when(first, own).otherwise(F.regexp_replace(own, r"^\S+", "")))

        def one(x: Column, i: Column) -> Column:
            before = F.coalesce(F.get(spans, i - 1)["end"], F.lit(0))
            return F.concat(gap(before, x["start"], i == 0), F.array_repeat(F.lit("<synonym>"), count(x["code"])))

        last = F.coalesce(F.get(spans, F.size(spans) - 1)["end"], F.lit(0))
        return F.concat(F.flatten(F.transform(spans, one)), gap(last, F.length(text), F.size(spans) == 0))

    return F.when(text.isNotNull(), let(recipe, labels))


@dataclass(frozen=True)
class Spec:
    """A parsed noise name: `mask-8`, `retoken-4@3`, `rewrite@syntax-40`, `partial-12`."""

    kind: str
    base: str | None
    percent: int | None
    width: int | None
    parts: str | None


KINDS = {"mask", "delete", "replace", "mono", "multi", "retoken", "resent", "rewrite", "syntax", "partial", "none"}


def parse_spec(spec: str) -> Spec:
    """kind[@base][-number][@width]; for partial the number names quarters of the sentences. Unknown names raise."""
    m = re.fullmatch(r"([a-z]+)(?:@([a-z]+))?(?:-(\d+))?(?:@(\d+))?", spec)
    if not m or m[1] not in KINDS or (m[2] and m[2] not in KINDS):
        raise ValueError(f"unknown noise: {spec}")
    number = int(m[3]) if m[3] else None
    if m[1] == "partial":
        if not m[3] or set(m[3]) - set("1234"):
            raise ValueError(f"partial needs quarters 1 to 4: {spec}")
        return Spec(m[1], m[2], None, None, m[3])
    if m[1] != "none" and number is None:
        raise ValueError(f"{m[1]} needs a number of percent: {spec}")
    return Spec(m[1], m[2], number, int(m[4]) if m[4] else None, None)


#: Noises whose lexicon is a table.
BY_LEXICON = ("mono", "multi")


def dispatch(rows: DataFrame, key: str, sentences: str, spec: str | list[str], vocabulary: Column | None = None, rewrites: str | None = None, lexicon: DataFrame | None = None) -> DataFrame:
    """(key, spec, noisy): the noise that a name calls for, or each of several, over rows with an array of sentences.

    Word noise works on the blank-separated words of all sentences; `rewrite@base` rewrites, then applies base. Noises
    that need no lexicon are made in one pass, so that rows are read, and what they are made of, once for all.
    """
    specs = [spec] if isinstance(spec, str) else spec
    parsed = {x: parse_spec(x) for x in specs}
    parts = []
    if here := [x for x in specs if not {parsed[x].kind, parsed[x].base} & set(BY_LEXICON)]:
        out, columns = rows, []
        for x in here:
            out = _noisy(out, key, sentences, parsed[x], vocabulary, rewrites).withColumnRenamed("noisy", f"_noisy{len(columns)}").select(*rows.columns, *columns, f"_noisy{len(columns)}")
            columns.append(f"_noisy{len(columns)}")
        each = F.explode(F.array(*(F.struct(F.lit(x).alias("spec"), F.col(c).alias("noisy")) for x, c in zip(here, columns, strict=True))))
        parts.append(out.select(key, each.alias("_one")).select(key, "_one.spec", "_one.noisy"))
    for x in specs:
        if x not in here:
            s, own = parsed[x], rows
            if s.kind not in BY_LEXICON:
                own, s = rows.withColumn(sentences, _rewritten(sentences, rewrites, key, s)), parse_spec(f"{s.base}-{s.percent}")
            texts = own.select(key, F.array_join(sentences, " ").alias("_text"))  # the texts are stored
            parts.append(synonyms(texts, key, "_text", lexicon, (s.percent or 0) / 100, s.kind).select(key, F.lit(x).alias("spec"), "noisy"))
    return reduce(DataFrame.unionByName, parts)


def _rewritten(sentences: str, rewrites: str, key: str, s: Spec) -> Column:
    return rewrite(F.col(sentences), F.col(rewrites), F.col(key), (s.percent or 0) / 100)["sentences"]


def _noisy(rows: DataFrame, key: str, sentences: str, s: Spec, vocabulary: Column | None, rewrites: str | None) -> DataFrame:
    """rows with `noisy`, and perhaps more columns: a noise that is made of each row alone."""
    k, words = F.col(key), F.split(F.array_join(sentences, " "), " ")
    p = (s.percent or 0) / 100
    joined = lambda c: F.array_join(c, " ")
    if s.kind in ("mask", "delete", "replace"):
        made = {
            "mask": lambda: mask(words, k, p)["tokens"],
            "delete": lambda: delete(words, k, p)["tokens"],
            "replace": lambda: replace(words, k, p, vocabulary if vocabulary is not None else F.array(F.lit(MASK)))["tokens"],
        }[s.kind]()
        return rows.withColumn("noisy", joined(made))
    if s.kind == "retoken":
        return token_reorder(rows.withColumn("_w", words), "_w", key, p, s.width or 8).withColumn("noisy", joined("noisy"))
    if s.kind == "resent":
        return sentence_reorder(rows, sentences, key, p, s.width or 3).withColumn("noisy", joined("noisy"))
    if s.kind == "syntax":
        return word_syntax(rows.withColumn("_text", joined(sentences)), "_text", key, p, s.width or 4)
    if s.kind == "rewrite" and s.base:
        # beside the sentences, which the noises after this one need
        return _noisy(rows.withColumn("_changed", _rewritten(sentences, rewrites, key, s)), key, "_changed", parse_spec(f"{s.base}-{s.percent}"), vocabulary, rewrites)
    if s.kind == "rewrite":
        return rows.withColumn("noisy", joined(_rewritten(sentences, rewrites, key, s)))
    if s.kind == "partial":
        return rows.withColumn("noisy", joined(quartile_parts(F.col(sentences), s.parts)))
    return rows.withColumn("noisy", joined(sentences))
