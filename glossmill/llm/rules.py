"""Quality rules: text statistics and a learned decision list, with built-in Spark expressions only.

Sequential covering learns the list: a rule is grown condition by condition on two thirds of a labelled sample by
information gain, pruned on the last third, kept if it is precise there, and what it covers is taken out before the
next. Spark counts labels by feature bin; the driver sees these counts alone. The list becomes one ordered CASE.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop, held_out, sample_of, store

#: Fixed values of the contract: word separators, counted symbols, window, and the base limits.
SPACES, SYMBOLS, WINDOW, LEAST_WORDS, MOST_REPEATED = r"[\x20\x09-\x0D]+", r"[#*$%&|<>]", 5, 10, 20
#: Labelled documents to learn from (about), bins per feature, and the limits on rules.
TRAINING_DOCS, BINS, MAX_RULES, MAX_CONDITIONS, PRECISION, LEAST_COVERED = 20_000, 24, 8, 3, 0.97, 3
#: First conditions that may fail for each rule before the search ends.
MAX_FAILURES = 4

FEATURES = {
    "n_words": "n_words",
    "word_length": "100 * word_chars div greatest(n_words, 1)",
    "symbol_rate": "1000 * n_symbols div greatest(n_words, 1)",
    "dup_lines": "n_dup_lines",
    "repeat_rate": "1000 * n_repeat_words div greatest(n_words, 1)",
    "upper_rate": "1000 * n_upper div greatest(word_chars, 1)",
    "bang_rate": "1000 * n_bangs div greatest(n_words, 1)",
    "stop_rate": "1000 * n_stops div greatest(n_words, 1)",
    "digit_rate": "1000 * n_digits div greatest(word_chars, 1)",
    "line_words": "n_words div greatest(n_lines, 1)",
    "distinct_rate": "1000 * n_distinct div greatest(n_words, 1)",
}
#: Characters that the features beyond the contract's counts count.
COUNTED = {"n_bangs": "!?", "n_stops": ".,;:", "n_digits": "0123456789"}


def statistics(docs: DataFrame, *keep: str) -> DataFrame:
    """Statistics of every whole text: the kept columns, the contract's five counts, those of COUNTED, n_upper, n_lines, n_distinct.

    A null or empty text has zeros. Repeated rows are counted each; other columns are ignored. All within the row:
    no shuffle. Windows are compared by 64-bit hashes of their words' hashes; a text with no two equal windows is
    done after one hash-set pass, any other sorts its windows.
    """
    w = docs.select(*keep, F.coalesce("text", F.lit("")).alias("t"))
    w = w.select(*keep, "t", F.filter(F.split("t", SPACES), lambda x: x != "").alias("words"))
    lines = F.filter(F.split("t", "\n"), lambda x: F.regexp_replace(x, SPACES, "") != "")
    w = w.select(
        *keep,
        F.size("words").cast("bigint").alias("n_words"),
        F.length(F.array_join("words", "")).cast("bigint").alias("word_chars"),
        (F.length("t") - F.length(F.regexp_replace("t", SYMBOLS, ""))).cast("bigint").alias("n_symbols"),
        F.length(F.regexp_replace("t", "[^A-Z]+", "")).cast("bigint").alias("n_upper"),
        *((F.length("t") - F.length(F.translate("t", x, ""))).cast("bigint").alias(c) for c, x in COUNTED.items()),
        lines.alias("lines"),
        F.transform("words", lambda x: F.xxhash64(x)).alias("hw"),
    )
    w = w.select(
        *keep, "n_words", "word_chars", "n_symbols", "n_upper", *COUNTED, F.size("lines").cast("bigint").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
        F.size(F.array_distinct("hw")).cast("bigint").alias("n_distinct"),
        F.expr(f"CASE WHEN size(hw) >= {WINDOW} THEN transform(sequence(0, size(hw) - {WINDOW}), i -> xxhash64({', '.join(f'hw[i + {k}]' for k in range(WINDOW))})) ELSE cast(array() AS array<bigint>) END").alias("h"),
    )
    out = [*keep, "n_words", "word_chars", "n_symbols", "n_upper", *COUNTED, "n_lines", "n_dup_lines", "n_distinct"]
    w = w.select(*out, F.expr("CASE WHEN size(array_distinct(h)) < size(h) THEN sort_array(transform(h, (x, i) -> named_struct('h', x, 'i', i))) ELSE cast(array() AS array<struct<h: bigint, i: int>>) END").alias("s"))
    w = w.select(*out, F.expr("sort_array(transform(filter(s, (x, k) -> get(s, k - 1).h <=> x.h OR get(s, k + 1).h <=> x.h), x -> x.i))").alias("starts"))
    repeated = F.expr(f"aggregate(starts, named_struct('n', 0L, 'last', -{WINDOW}), (a, x) -> named_struct('n', a.n + least({WINDOW}, x - a.last), 'last', x)).n")
    done = F.struct("n_words", "word_chars", "n_symbols", "n_dup_lines", repeated.alias("n_repeat_words"), "n_upper", *COUNTED, "n_lines", "n_distinct")
    # a filter on the result must not be pushed below: its copy of the expressions would run once for each window
    return w.select(*keep, F.inline(F.array(done)))


@dataclass
class DecisionList:
    """Ordered rules; a rule is a conjunction of (feature, '<' or '>=', threshold). The first that fits rejects."""

    rules: list[list[tuple[str, str, int]]] = field(default_factory=list)

    def kept(self) -> Column:
        """The list as a CASE over the columns of statistics(): false if a rule fits, else true."""
        if not self.rules:
            return F.lit(True)
        case = None
        for rule in self.rules:
            cond = F.expr(" AND ".join(f"({FEATURES[f]}) {op} {t}" for f, op, t in rule))
            case = F.when(cond, F.lit(False)) if case is None else case.when(cond, F.lit(False))
        return case.otherwise(F.lit(True))


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def _covered(rule: list[tuple[str, str, int]]) -> Column:
    return F.expr(" AND ".join(f"{f} {op} {t}" for f, op, t in rule) or "true")


def _counts(rows: DataFrame, cuts: dict[str, list[int]]) -> dict[tuple[str, int], list[int]]:
    """[good, bad] rows for each feature and bin, where bin b holds the values with b cuts at or below."""
    arms = ", ".join("named_struct('f', '{}', 'b', {})".format(f, " + ".join(f"int({f} >= {c})" for c in cs) or "0") for f, cs in cuts.items())
    got = rows.select("bad", F.expr(f"inline(array({arms}))")).groupBy("f", "b").agg(F.sum(1 - F.col("bad")).alias("good"), F.sum("bad").alias("bad"))
    return {(r["f"], r["b"]): [r["good"], r["bad"]] for r in got.collect()}


def _gain(good: int, bad: int, base: float) -> float:
    return bad * (math.log2((bad + 0.5) / (good + bad + 1)) - base) if bad else 0.0


def _refined(rows: DataFrame, f: str, op: str, cut: int, cuts: list[int], base: float) -> int:
    """The threshold near a cut that gains most: midway between two values that occur, from two cuts below to the next one."""
    k = cuts.index(cut)
    low, high = (cuts[k - 2] if k > 1 else None), (cuts[k + 1] if k + 1 < len(cuts) else None)
    place = F.expr(f"CASE WHEN {f} >= {high} THEN {high} ELSE {f} END" if high is not None else f)
    if low is not None:
        place = F.greatest(place, F.lit(low - 1))
    got = rows.groupBy(place.alias("v")).agg(F.sum(1 - F.col("bad")).alias("good"), F.sum("bad").alias("bad")).orderBy("v").collect()
    best = (float("-inf"), cut)
    for i in range(1, len(got)):
        side = got[i:] if op == ">=" else got[:i]
        gain = _gain(sum(r["good"] for r in side), sum(r["bad"] for r in side), base)
        if gain > best[0] + 1e-9:
            best = (gain, got[i - 1]["v"] + (got[i]["v"] - got[i - 1]["v"] + 1) // 2)
    return best[1]


def _grown(rows: DataFrame, cuts: dict[str, list[int]], banned: set[tuple[str, str]]) -> list[tuple[str, str, int]]:
    """A rule grown on rows: the condition with the largest information gain, again and again; none starts with a banned one."""
    rule: list[tuple[str, str, int]] = []
    while len(rule) < MAX_CONDITIONS:
        own = rows.where(_covered(rule))
        counts = _counts(own, cuts)
        first = next(iter(FEATURES))
        good, bad = (sum(v[i] for (f, _), v in counts.items() if f == first) for i in (0, 1))
        if not bad or bad / (good + bad) >= 0.995:
            break
        best, base = (0.0, None), math.log2(bad / (good + bad))
        for f, cs in cuts.items():
            for k, cut in enumerate(cs):
                over = [sum(v[i] for (g, b), v in counts.items() if g == f and b > k) for i in (0, 1)]
                for op, side in ((">=", over), ("<", [good - over[0], bad - over[1]])):
                    if (rule or (f, op) not in banned) and (gain := _gain(*side, base)) > best[0] + 1e-9:
                        best = (gain, (f, op, cut))
        if best[1] is None:
            break
        f, op, cut = best[1]
        rule.append((f, op, _refined(own, f, op, cut, cuts[f], base)))
    return rule


def _pruned(rest: DataFrame, rule: list[tuple[str, str, int]]) -> list[tuple[str, str, int]] | None:
    """The beginning of a rule that is most precise on the last third, the shortest of equal ones; None if it is not precise."""
    parts = [(k, w) for k in range(len(rule)) for w in ("grow", "NOT grow")]
    cols = [F.count_if(_covered(rule[: k + 1]) & F.expr(f"{w} AND bad = {x}")).alias(f"{w} {k} {x}") for k, w in parts for x in (0, 1)]
    got = rest.agg(*cols).collect()[0]
    worth = [(got[f"NOT grow {k} 1"] + 1) / (got[f"NOT grow {k} 1"] + got[f"NOT grow {k} 0"] + 2) for k in range(len(rule))]
    k = max(range(len(rule)), key=lambda k: (round(worth[k], 3), -k))
    bad, good = (got[f"grow {k} {x}"] + got[f"NOT grow {k} {x}"] for x in (1, 0))
    unseen = got[f"NOT grow {k} 1"] / max(1, got[f"NOT grow {k} 1"] + got[f"NOT grow {k} 0"])
    precise = bad + good >= LEAST_COVERED and bad >= PRECISION * (bad + good) and (unseen >= PRECISION or not got[f"NOT grow {k} 0"])
    return rule[: k + 1] if precise else None


def learn(docs: DataFrame, labels: DataFrame, bound: int = TRAINING_DOCS) -> DecisionList:
    """Learn a list that rejects documents like those labelled quality 0.

    From about `bound` labelled documents outside the held-out quarter that pass the base limits; statistics are taken
    of these alone. A rule that is not precise enough bars its first condition and the search goes on. Null labels and
    null ids are left out; of several labels of an id the largest counts. Without labels of both kinds the list is empty.
    """
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    total = known.agg(F.count(F.lit(1)).alias("n")).collect()[0]["n"]
    pick = sample_of(F.col("doc_id"), total, bound, "rules")
    chosen = docs.select("doc_id", "text").where(pick).join(known.where(pick), "doc_id")
    stats = statistics(chosen, "doc_id", "quality").where(~base_failed())
    rows = store(stats.select((1 - F.col("quality")).cast("bigint").alias("bad"), (F.pmod(F.xxhash64(F.lit("grow"), "doc_id"), F.lit(3)) > 0).alias("grow"), *(F.expr(e).alias(f) for f, e in FEATURES.items())))
    at = [0.005, 0.01, 0.02, *(k / BINS for k in range(1, BINS)), 0.98, 0.99, 0.995]
    out = DecisionList()
    rest, cuts, banned, failures = rows, None, set(), 0
    while len(out.rules) < MAX_RULES and failures < MAX_FAILURES:
        if cuts is None:  # what is left has its own distribution
            q = rest.agg(*(F.percentile(f, F.array(*map(F.lit, at))).alias(f) for f in FEATURES)).collect()[0]
            cuts = {f: sorted({math.ceil(x) for x in q[f] or []}) for f in FEATURES}
        rule = _grown(rest.where("grow"), cuts, banned)
        if not rule:
            break
        kept = _pruned(rest, rule)
        if kept is None:
            banned.add(rule[0][:2])
            failures += 1
            continue
        out.rules.append(kept)
        rest, cuts, failures = rest.where(~_covered(kept)), None, 0
        banned.clear()
    drop(rows)
    return out


def judge(docs: DataFrame, rules: DecisionList) -> DataFrame:
    """doc_id, the contract's counts, base_failed and kept for each row of docs.

    A null text is empty and so fails the base; texts of any length are whole; repeated rows get equal results; a null
    doc_id stays null; an empty table gives an empty result; other columns are ignored. No shuffle, no Python.
    """
    out = statistics(docs, "doc_id").withColumn("base_failed", base_failed())
    out = out.withColumn("kept", ~F.col("base_failed") & rules.kept())
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
