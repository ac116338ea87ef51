"""URL filters: domain and path rules, and a model for the urls that no rule fits.

The model splits the concatenated names of hosts and paths into words with a unigram Viterbi search and scores the
words with multinomial naive Bayes. The words come from the pages' texts and from names in urls that are no compound
of such words; the classes from the urls that a rule decides.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop, map_arrow, steps, store

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Urls that share one look-up of words and weights, characters from which one has its own, and the candidate words that
#: a task holds before it sends them.
CHUNK, LONG, HELD = 2048, 65_536, 100_000
RUNS = re.compile(r"[^\W\d_]+|\d+")


@dataclass(frozen=True)
class Rule:
    verdict: str
    rule: str

    @property
    def host(self) -> str:
        return self.rule.split("/", 1)[0]

    @property
    def path(self) -> str:
        return "/" + self.rule.split("/", 1)[1]


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty for null or without `://`."""
    url = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(url, "://([^/?#]*)", 1), UPPER, LOWER), F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1)


def match_rules(pages: DataFrame, rules: list[Rule]) -> DataFrame:
    """page_id, host, path, rule and rule_verdict (both null where no rule fits); the longest rule that fits wins."""
    host, path = parts(F.col("url"))
    out = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule = verdict = None
    for r in sorted(rules, key=lambda r: (-len(r.rule), r.rule)):
        fits = ((F.col("host") == r.host) | F.endswith("host", F.lit("." + r.host))) & F.startswith("path", F.lit(r.path))
        rule = F.when(fits, r.rule) if rule is None else rule.when(fits, r.rule)
        verdict = F.when(fits, r.verdict) if verdict is None else verdict.when(fits, r.verdict)
    none = F.lit(None).cast("string")
    return out.withColumns({"rule": none if rule is None else rule, "rule_verdict": none if verdict is None else verdict})


@dataclass
class Segmenter:
    """Splits a run of letters into the words with the largest product of unigram probabilities."""

    counts: dict[str, int]
    total: int | None = None  # of all words, if counts has only those that can occur
    memo: dict[str, list[str]] = field(default_factory=dict)

    def __post_init__(self):
        total = (sum(self.counts.values()) if self.total is None else self.total) + 1
        self.cost = {w: math.log(total / n) for w, n in self.counts.items()}
        self.lengths = sorted({len(w) for w in self.counts})
        self.unknown = math.log(total) + 3.0  # for each letter in no word

    def split(self, name: str, without: str | None = None) -> list[str]:
        """The words of a name; `without` is a word that counts for nothing this time."""
        got = self.memo.get(name) if without is None else None
        if got is None:
            best, back = [0.0], [0]
            for i in range(1, len(name) + 1):
                c, k = best[i - 1] + self.unknown, i - 1
                for n in self.lengths:
                    if n > i:
                        break
                    w = name[i - n : i]
                    x = self.cost.get(w)
                    if x is not None and best[i - n] + x < c and w != without:
                        c, k = best[i - n] + x, i - n
                best.append(c)
                back.append(k)
            got, i = [], len(name)
            while i:
                got.append(name[back[i] : i])
                i = back[i]
            got.reverse()
            if without is None:
                if len(self.memo) > 50_000:
                    self.memo.clear()
                self.memo[name] = got
        return got

    def clean(self, name: str, without: str | None = None) -> bool:
        """Whether the name splits into known words of two letters or more."""
        return all(len(w) > 1 and w in self.counts for w in self.split(name, without))

    def tokens(self, host: str, path: str) -> list[str]:
        """Words of the host and of the path, marked h: and p:; digits count as one token."""
        out = []
        for mark, text in (("h:", host), ("p:", path.lower())):
            for run in RUNS.findall(text):
                out += [mark + "0"] if run[0].isdigit() else [mark + w for w in self.split(run)]
        return out


@dataclass
class NaiveBayes:
    """Log odds of block against allow for tokens, add-one smoothed; the prior is that of the decided urls."""

    weights: dict[str, float]
    prior: float = 0.0

    def odds(self, tokens: list[str]) -> float:
        return self.prior + sum(self.weights.get(t, 0.0) for t in tokens)


def page_words(pages: DataFrame) -> DataFrame:
    """w, n: how often each word of letters stands in the pages' visible text and titles, for all words of all pages."""
    plain = F.regexp_replace(F.coalesce("html", F.lit("")), r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>", " ")
    words = pages.select(F.explode(F.regexp_extract_all(F.lower(plain), F.lit(r"(\p{L}+)"), F.lit(1))).alias("w"))
    return words.groupBy("w").agg(F.count(F.lit(1)).alias("n"))


def name_counts(matched: DataFrame) -> DataFrame:
    """run, n: the runs of letters in the urls' hosts and paths, and how often each occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in steps(batches, "path"):
            own: Counter = Counter()
            for host, path in zip(*(b.column(k).to_pylist() for k in range(2)), strict=True):
                own.update(x for text in (host, path.lower()) for x in RUNS.findall(text) if not x[0].isdigit())
            yield pa.record_batch({"run": pa.array(list(own), pa.string()), "n": pa.array(list(own.values()), pa.int64())})

    return map_arrow(matched, run, "run string, n bigint", "host", "path").groupBy("run").agg(F.sum("n").alias("n"))


def candidates(rows: DataFrame, columns: list[str], lengths: list[int]) -> DataFrame:
    """chunk, w: every string of letters in a chunk's columns that is as long as some word; may repeat."""

    def batch(chunk: int, own: set[str]) -> pa.RecordBatch:
        return pa.record_batch({"chunk": pa.array([chunk] * len(own), pa.int64()), "w": pa.array(list(own), pa.string())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in steps(batches, columns[-1]):
            runs: dict[int, set[str]] = {}
            for chunk, *texts in zip(*(b.column(k).to_pylist() for k in range(1 + len(columns))), strict=True):
                runs.setdefault(chunk, set()).update(x for text in texts for x in RUNS.findall(text.lower()) if not x[0].isdigit())
            for chunk, names in runs.items():
                own: set[str] = set()
                for name in names:
                    for n in lengths:
                        for j in range(len(name) - n + 1):
                            own.add(name[j : j + n])
                        if len(own) > HELD:
                            yield batch(chunk, own)
                            own = set()
                yield batch(chunk, own)

    return map_arrow(rows, run, "chunk bigint, w string", "chunk", *columns)


def with_words(rows: DataFrame, columns: list[str], words: DataFrame, fn: Callable[[pa.Table, Segmenter], pa.Table], schema: str) -> DataFrame:
    """fn over each chunk of rows, with a segmenter of all words that occur in the chunk's columns, whatever their length.

    words: w, n. The driver gets their total and the lengths that occur.
    """
    total = words.agg(F.sum("n").alias("n")).collect()[0]["n"] or 0
    lengths = sorted(r["k"] for r in words.select(F.length("w").alias("k")).distinct().collect() if r["k"])
    known = candidates(rows, columns, lengths).join(words, "w").select("chunk", "w", "n").distinct()

    def run(own: pa.Table, seen: pa.Table) -> pa.Table:
        return fn(own, Segmenter(dict(zip(seen.column("w").to_pylist(), seen.column("n").to_pylist(), strict=True)), total))

    return rows.groupBy("chunk").cogroup(known.groupBy("chunk")).applyInArrow(run, schema)


def dictionary(pages: DataFrame, matched: DataFrame) -> DataFrame:
    """w, n: the words of the pages' texts, and the names of urls that are no compound of them.

    A name that does not split into words of the texts is a word itself (`blog`, `spam`), unless it splits into such
    words and other such names (`spamblog`).
    """
    words = store(page_words(pages))
    names = store(name_counts(matched).withColumn("chunk", F.floor(F.monotonically_increasing_id() / CHUNK)))
    kind = _columns(names)

    def unknown(own: pa.Table, s: Segmenter) -> pa.Table:
        return own.filter(pa.array([not s.clean(r) for r in own.column("run").to_pylist()], pa.bool_()))

    odd = store(with_words(names, ["run"], words, unknown, kind))
    both = store(words.unionByName(odd.selectExpr("run AS w", "n")).groupBy("w").agg(F.sum("n").alias("n")))

    def simple(own: pa.Table, s: Segmenter) -> pa.Table:
        return own.filter(pa.array([not s.clean(r, without=r) for r in own.column("run").to_pylist()], pa.bool_()))

    own = store(with_words(odd, ["run"], both, simple, kind))
    out = store(words.unionByName(own.selectExpr("run AS w", "n")).groupBy("w").agg(F.sum("n").alias("n")))
    drop(words, names, odd, both, own)
    return out


def tokenized(matched: DataFrame, words: DataFrame) -> DataFrame:
    """matched with its tokens: each chunk of urls is split with all the words that occur in it."""

    def split(urls: pa.Table, s: Segmenter) -> pa.Table:
        found = [s.tokens(h, p) for h, p in zip(urls.column("host").to_pylist(), urls.column("path").to_pylist(), strict=True)]
        return urls.append_column("tokens", pa.array(found, pa.list_(pa.string())))

    return with_words(matched, ["host", "path"], words, split, f"{_columns(matched)}, tokens array<string>")


def token_counts(urls: DataFrame) -> DataFrame:
    """token, block, allow: how often each token stands in the urls that a rule decides, by verdict, for all tokens."""
    tokens = urls.where("rule IS NOT NULL").select(F.explode("tokens").alias("token"), (F.col("rule_verdict") == "block").alias("b"))
    return tokens.groupBy("token").agg(F.count_if("b").alias("block"), F.count_if(~F.col("b")).alias("allow"))


def judge(urls: DataFrame, counts: DataFrame) -> DataFrame:
    """page_id, host, path, rule, verdict: the rule's verdict, else block if the model's odds are for it.

    Multinomial naive Bayes: the prior is the share of blocked urls among those that a rule decides (add-one smoothed),
    each token's weight that of its counts. Where no rule has decided anything, all is allowed.
    """
    r = counts.agg(F.sum("block").alias("b"), F.sum("allow").alias("a"), F.count(F.lit(1)).alias("n")).collect()[0]
    nb, na = (r["b"] or 0) + r["n"], (r["a"] or 0) + r["n"]
    p = urls.agg(F.count_if(F.col("rule_verdict") == "block").alias("b"), F.count_if(F.col("rule_verdict") == "allow").alias("a")).collect()[0]
    prior = math.log((p["b"] + 1) / (p["a"] + 1))
    undecided = urls.where("rule IS NULL")
    weights = undecided.select(F.col("chunk").alias("own"), F.explode("tokens").alias("token")).distinct().join(counts, "token").select("own", "token", "block", "allow")

    def decide(own: pa.Table, seen: pa.Table) -> pa.Table:
        block, allow = seen.column("block").to_pylist(), seen.column("allow").to_pylist()
        model = NaiveBayes({t: math.log((b + 1) / nb) - math.log((a + 1) / na) for t, b, a in zip(seen.column("token").to_pylist(), block, allow, strict=True)}, prior)
        verdict = ["block" if model.odds(t) > 1e-9 else "allow" for t in own.column("tokens").to_pylist()]
        return own.select(["page_id", "host", "path", "rule"]).append_column("verdict", pa.array(verdict, pa.string()))

    modelled = undecided.groupBy("chunk").cogroup(weights.groupBy("own")).applyInArrow(decide, f"{_columns(urls.select('page_id', 'host', 'path', 'rule'))}, verdict string")
    return urls.where("rule IS NOT NULL").select("page_id", "host", "path", "rule", F.col("rule_verdict").alias("verdict")).unionByName(modelled)


def _columns(df: DataFrame) -> str:
    return ", ".join(f"{name} {kind}" for name, kind in df.dtypes)


def filter_urls(pages: DataFrame, rules: list[Rule]) -> DataFrame:
    """Judge the url of every row of pages (page_id, url, html).

    A null url, or one without `://`, has an empty host and path, fits no rule, and goes to the model, which sees no
    token in it. Repeated rows get equal results; urls of any length are whole; an empty table gives an empty result;
    other columns are ignored. All words of all pages, all names and all tokens count: urls go in chunks of CHUNK rows
    (a very long one alone), and each chunk gets the words and weights that its own urls need by a join, so that no
    process holds the whole dictionary and a frequent word has a row per chunk, not per url.
    """
    row = F.monotonically_increasing_id()
    matched = store(match_rules(pages, rules).withColumn("chunk", F.when(F.length("host") + F.length("path") > LONG, -1 - row).otherwise(F.floor(row / CHUNK))))
    words = dictionary(pages, matched)
    urls = store(tokenized(matched, words))
    drop(matched, words)
    return judge(urls, store(token_counts(urls)))
