"""Evaluation sets and scores: votes, triples, multiple-choice items, prompts, scoring requests, padded batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.structure import uniform
from .ranking import global_places

BLANK = "[BLANK]"
IGNORED = -100


# --- votes and triples --------------------------------------------------------------------------------------------------
def model_votes(answers: DataFrame) -> DataFrame:
    """(request_id, votes, confidence) from request_id, factuality, logprob: true votes and the sum of their probabilities."""
    true = F.col("factuality")
    return answers.groupBy("request_id").agg(F.count_if(true).alias("votes"), F.coalesce(F.sum(F.when(true, F.exp("logprob"))), F.lit(0.0)).alias("confidence"))


def best_triple(triples: DataFrame, preferred: str, least_ratio: float = 0.5) -> DataFrame:
    """(request_id, triple): one of each request's, whatever its struct is.

    triples: request_id, lang, model, s, o, ratio, triple. In English, of those with a lemma match of least_ratio or
    more (of all, if there is none) the one with the least (length of s + length of o) / ratio, a ratio of 0 being the
    worst; elsewhere the preferred model's. Ties go to the first model by name.
    """
    cost = F.when(F.col("ratio") > 0, (F.length("s") + F.length("o")) / F.col("ratio")).otherwise(F.lit(float("inf")))
    en = F.struct((F.col("ratio") < least_ratio).cast("int"), cost, "model")
    rows = triples.where((F.col("lang") == "en") | (F.col("model") == preferred))
    key = F.when(F.col("lang") == "en", en).otherwise(F.struct(F.lit(0), F.lit(0.0).cast("double"), "model"))
    return rows.groupBy("request_id").agg(F.min_by("triple", key).alias("triple"))


def vote_triples(answers: DataFrame, triples: DataFrame, preferred: str, more_than: int = 2) -> DataFrame:
    """(place, request_id, votes, confidence, triple): requests with more than so many true votes, the surest first."""
    votes = model_votes(answers).where(F.col("votes") > more_than).withColumn("confidence", F.round("confidence", 6))
    rows = votes.join(best_triple(triples, preferred), "request_id", "left")
    return global_places(rows, F.col("confidence").desc(), F.col("request_id"))


def bimatch(arguments: DataFrame, entities: DataFrame, least: float = 0.6) -> DataFrame:
    """(request_id, arg, alias): arguments and aliases of the same request of which one contains the other.

    Case and outer blanks count for nothing; empty ones match nothing; entities below the score are left out.
    """
    a, b = F.lower(F.trim("arg")), F.lower(F.trim("alias"))
    own = entities.where(F.col("score") >= least).select("request_id", "alias")
    return arguments.join(own, "request_id").where((a != "") & (b != "") & (F.contains(a, b) | F.contains(b, a))).select("request_id", "arg", "alias")


# --- multiple choice ----------------------------------------------------------------------------------------------------
def valid_mcq(question: Column, options: Column) -> Column:
    """Whether no option is empty and the question has exactly one blank."""
    blanks = (F.length(question) - F.length(F.replace(question, F.lit(BLANK), F.lit("")))) / len(BLANK)
    return ~F.exists(options, lambda o: F.trim(o) == "") & (blanks == 1)


def shuffled_options(item: Column, options: Column, answer: Column) -> Column:
    """struct<options, answer_idx>: options in an order drawn by the item's id, and where the answer is then."""
    keyed = F.transform(options, lambda o, i: F.struct(uniform("options", item, i).alias("u"), i.alias("i"), o.alias("o")))
    own = F.array_sort(keyed)
    return F.struct(F.transform(own, lambda x: x["o"]).alias("options"), (F.array_position(F.transform(own, lambda x: x["i"]), answer) - 1).cast("int").alias("answer_idx"))


def assemble_mcq(items: DataFrame) -> DataFrame:
    """(id, dataset, question, options, answer_idx) of the memorization and the generalization set over the same items.

    items: id, cloze, paraphrase, answer, distractors. Only items valid in both forms are in either.
    """
    options = F.concat(F.array("answer"), "distractors")
    good = items.where(valid_mcq(F.col("cloze"), options) & valid_mcq(F.col("paraphrase"), options))
    own = good.withColumn("x", shuffled_options(F.col("id"), options, F.lit(0)))
    each = own.select("id", "x", F.explode(F.array(F.struct(F.lit("memorization").alias("dataset"), F.col("cloze").alias("question")), F.struct(F.lit("generalization").alias("dataset"), F.col("paraphrase").alias("question")))).alias("y"))
    return each.select("id", "y.dataset", "y.question", "x.options", "x.answer_idx")


def option_lines(options: Column) -> Column:
    """`A. …`, `B. …`, one line each; for up to 26 options."""
    letters = F.array(*(F.lit(chr(65 + i)) for i in range(26)))
    return F.array_join(F.transform(options, lambda o, i: F.concat(F.get(letters, i), F.lit(". "), o)), "\n")


# --- prompts ------------------------------------------------------------------------------------------------------------
def draw_demos(queries: DataFrame, gallery: DataFrame, k: int, seed: str = "demos") -> DataFrame:
    """(id, demos array<string>): k texts of the gallery for each query, in the reverse order of their draws.

    2k places are drawn with replacement, repeated texts are drawn once; fewer remain if too few differ. Places are
    joined, so no query meets the whole gallery. queries: id; gallery: key (unique), text.
    """
    placed = global_places(gallery.select("key", "text"), F.col("key"), name="place", first=0)
    n = gallery.count()
    draws = queries.select("id", F.explode(F.sequence(F.lit(0), F.lit(2 * k - 1))).alias("draw"))
    draws = draws.withColumn("place", F.floor(uniform(seed, F.col("id"), F.col("draw")) * n).cast("bigint"))
    hits = draws.join(placed.select("place", "text"), "place").groupBy("id", "text").agg(F.min("draw").alias("draw"))
    own = hits.groupBy("id").agg(F.slice(F.sort_array(F.collect_list(F.struct("draw", "text"))), 1, k).alias("x"))
    return own.select("id", F.reverse(F.transform("x", lambda y: y["text"])).alias("demos"))


def fewshot_prompts(queries: DataFrame, demos: DataFrame, separator: str = "\n\n") -> DataFrame:
    """(id, prompt): a query's demos (id, demos) and its own text, joined; without demos the text alone."""
    own = queries.join(demos, "id", "left")
    empty = F.array().cast("array<string>")
    return own.select("id", F.array_join(F.concat(F.coalesce("demos", empty), F.array("text")), separator).alias("prompt"))


# --- scoring ------------------------------------------------------------------------------------------------------------
def score_request(context: Column, option: Column, most: int) -> Column:
    """struct<input_ids, labels>: context and option tokens, the context cut from the left so that all fit into `most`.

    Labels are IGNORED on the context, and the option's ids on the option. An option of more than `most` tokens keeps
    its last ones.
    """
    opt = F.slice(option, F.greatest(F.size(option) - most + 1, F.lit(1)), F.lit(most))
    room = F.greatest(F.lit(most) - F.size(opt), F.lit(0))
    ctx = F.slice(context, F.greatest(F.size(context) - room + 1, F.lit(1)), room)
    return F.struct(F.concat(ctx, opt).alias("input_ids"), F.concat(F.transform(ctx, lambda _: F.lit(IGNORED)), opt).alias("labels"))


def pad_batch(rows: DataFrame, batch: str, columns: dict[str, int], side: str = "right") -> DataFrame:
    """rows with each of the columns (arrays, with their filler) padded to the longest of its batch, and attention_mask.

    side: right, as for scoring, or left, as for generating.
    """
    if side not in ("right", "left"):
        raise ValueError(f"no side {side}")
    join = (lambda own, fill: F.concat(own, fill)) if side == "right" else (lambda own, fill: F.concat(fill, own))
    first = next(iter(columns))
    longest = F.max(F.size(first)).over(Window.partitionBy(batch))
    out = rows.withColumn("_gap", longest - F.size(first)).withColumn("_n", F.size(first))
    for c, filler in columns.items():
        out = out.withColumn(c, join(F.col(c), F.array_repeat(F.lit(filler), F.col("_gap"))))
    return out.withColumn("attention_mask", join(F.array_repeat(F.lit(1), F.col("_n")), F.array_repeat(F.lit(0), F.col("_gap")))).drop("_gap", "_n")


def token_losses(rows: DataFrame, key: str, ids: str, model: Callable[[list[list[int]]], list[list[float]]], batch: int = 64) -> DataFrame:
    """(key, losses array<double>, avg_loss): what a model gives for each token, batch by batch of rows.

    The model gets lists of token ids and returns as many losses each. No tokens have no losses and a null mean.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, batch):
                part = b.slice(at, batch)
                tokens = [x or [] for x in part.column(1).to_pylist()]
                losses = model(tokens)
                if [len(x) for x in losses] != [len(x) for x in tokens]:
                    raise ValueError("a model must give one loss for each token")
                yield pa.record_batch({key: part.column(0), "losses": pa.array(losses, pa.list_(pa.float64())), "avg_loss": pa.array([sum(x) / len(x) if x else None for x in losses], pa.float64())})

    return rows.select(key, ids).mapInArrow(run, f"{key} {dict(rows.dtypes)[key]}, losses array<double>, avg_loss double")


def option_loss(losses: Column, labels: Column) -> Column:
    """The sum of the losses where labels are not IGNORED: the negative log likelihood of the option."""
    return F.aggregate(F.zip_with(losses, labels, lambda x, y: F.when(y != IGNORED, x).otherwise(F.lit(0.0))), F.lit(0.0).cast("double"), lambda s, x: s + x)
