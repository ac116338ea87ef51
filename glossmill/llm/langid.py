"""Language identification with hyperdimensional profiles.

Letters are random bipolar vectors. An n-gram is the elementwise product (binding) of its letters' vectors, each
rotated by its place; a text or a language is the sum (bundle) of its n-grams' vectors. A text gets the language
whose prototype has the largest cosine with it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, held_out, map_arrow, sample_of, steps, store, trim

#: Dimensions, letters per n-gram, and the seed of the letter vectors.
DIMENSIONS, SEED = 512, 11
UNKNOWN = "und"
#: Labelled documents from which prototypes are learned, about; of more, a fixed choice by doc_id.
TRAINING_DOCS = 20_000
#: Characters of a text that are looked at together.
PORTION = 1 << 18
#: Unrelated n-grams have a cosine of 0 with a standard deviation of 1 / sqrt(DIMENSIONS); beyond so many it is no chance.
CHANCE = 3.0
#: A text with fewer letters has too few n-grams for a cosine that tells a learned language from chance.
LEAST_LETTERS = 32


@lru_cache(maxsize=1)
def symbol_table() -> np.ndarray:
    """The symbol of each code point: of a letter the code point of its lower case, else 0."""
    out = np.zeros(0x110000, dtype=np.uint32)
    for c in filter(str.isalpha, map(chr, range(0x110000))):
        out[ord(c)] = ord(c.lower()[0])
    return out


@lru_cache(maxsize=1 << 16)
def letter_vector(symbol: int) -> np.ndarray:
    return np.random.default_rng([SEED, symbol]).choice(np.array([-1, 1], dtype=np.int8), DIMENSIONS)


def bind(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The vectors of the n-grams with letter vectors a, b, c."""
    return np.roll(a, 2, axis=-1) * np.roll(b, 1, axis=-1) * c


@lru_cache(maxsize=1)
def frequent_vectors() -> np.ndarray:
    """The vector of each n-gram of a-z (1 to 26) and 0, by a * 27**2 + b * 27 + c."""
    own = np.stack([letter_vector(96 + k if k else 0) for k in range(27)])
    return bind(own[:, None, None, :], own[None, :, None, :], own[None, None, :, :]).reshape(27**3, DIMENSIONS)


def ngram_vectors(grams: np.ndarray) -> np.ndarray:
    """The vectors of n-grams given as a << 42 | b << 21 | c; those beyond a-z are bound on the fly."""
    places = np.stack([grams >> 42, (grams >> 21) & 0x1FFFFF, grams & 0x1FFFFF])
    frequent = ((places == 0) | ((places >= 97) & (places <= 122))).all(axis=0)
    out = np.empty((len(grams), DIMENSIONS), dtype=np.int8)
    a, b, c = np.maximum(places[:, frequent] - 96, 0)
    out[frequent] = frequent_vectors()[(a * 27 + b) * 27 + c]
    if not frequent.all():
        symbols, at = np.unique(places[:, ~frequent], return_inverse=True)
        a, b, c = np.stack([letter_vector(int(x)) for x in symbols])[at.reshape(3, -1)]
        out[~frequent] = bind(a, b, c)
    return out


def bundle(text: str | None) -> np.ndarray | None:
    """The sum of the vectors of a whole text's n-grams; None without a letter."""
    if not text:
        return None
    own, counts = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    table, tail, any_letter = symbol_table(), np.zeros(1, dtype=np.int64), False
    for at in range(0, len(text), PORTION):  # long texts in portions that overlap by two symbols
        part = text[at : at + PORTION].encode("utf-32-le", "surrogatepass")
        s = table[np.frombuffer(part, dtype=np.uint32)].astype(np.int64)
        any_letter |= bool(s.any())
        s = np.concatenate([tail, s, [0]] if at + PORTION >= len(text) else [tail, s])
        s = s[np.concatenate([[True], (s[1:] != 0) | (s[:-1] != 0)])]  # a run of other characters is one gap
        if len(s) >= 3:
            grams, n = np.unique(s[:-2] << 42 | s[1:-1] << 21 | s[2:], return_counts=True)
            own, where = np.unique(np.concatenate([own, grams]), return_inverse=True) if len(own) else (grams, None)
            counts = n if where is None else np.bincount(where, weights=np.concatenate([counts, n])).astype(np.int64)
        tail = s[-2:]
    if not any_letter:
        return None
    out = np.zeros(DIMENSIONS, dtype=np.float32)
    for k in range(0, len(own), 4096):
        part = slice(k, k + 4096)
        out += counts[part].astype(np.float32) @ ngram_vectors(own[part]).astype(np.float32)
    return out


@dataclass
class Profiles:
    languages: list[str]
    prototypes: np.ndarray  # a unit vector for each language

    def cosines(self, v: np.ndarray) -> np.ndarray:
        v = v.astype(np.float64)
        return self.prototypes @ v / max(float(np.linalg.norm(v)), 1e-12)

    def predict(self, text: str | None) -> tuple[str, float]:
        """The language and the cosine with its prototype (at least 0); `und`, 0 without a letter or a language."""
        v = bundle(text)
        if v is None or not self.languages:
            return UNKNOWN, 0.0
        cos = self.cosines(v)
        k = int(np.argmax(cos))
        return self.languages[k], float(min(1.0, max(0.0, cos[k])))


def training(docs: DataFrame, bound: int) -> DataFrame:
    """About `bound` rows of docs with a lang, outside the held-out quarter."""
    known = docs.where(F.col("lang").isNotNull() & ~held_out(F.col("doc_id")))
    total = known.agg(F.count(F.lit(1)).alias("n")).collect()[0]["n"]
    return known.where(sample_of(F.col("doc_id"), total, bound, "langid"))


def fit(docs: DataFrame, bound: int = TRAINING_DOCS) -> Profiles:
    """Learn a prototype for each non-null lang of docs outside the held-out quarter.

    From about `bound` documents, chosen by a hash of doc_id; each document weighs the same (its bundle at length
    1000, rounded). Bundles are summed in the tasks and then by Spark; the driver gets one vector per language. Sums
    of whole numbers don't depend on their order.
    """
    chosen = training(docs, bound)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for b in steps(batches, "text"):
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                v = bundle(text)
                if v is not None and (n := float(np.linalg.norm(v))):
                    sums[lang] = sums.get(lang, 0) + np.rint(v.astype(np.float64) * 1000 / n)
        if sums:
            yield pa.record_batch({"lang": pa.array(list(sums), pa.string()), "v": pa.array([x.tolist() for x in sums.values()], pa.list_(pa.float64()))})

    parts = map_arrow(chosen, run, "lang string, v array<double>", "lang", "text")
    sums = parts.select("lang", F.posexplode("v").alias("at", "x")).groupBy("lang", "at").agg(F.sum("x").alias("x"))
    vectors: dict[str, np.ndarray] = {}
    for r in sums.collect():
        vectors.setdefault(r["lang"], np.zeros(DIMENSIONS))[r["at"]] = r["x"]
    names = sorted(vectors)
    matrix = np.array([vectors[k] for k in names]).reshape(-1, DIMENSIONS)
    return Profiles(names, matrix / np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-12))


def identify(docs: DataFrame, profiles: Profiles) -> DataFrame:
    """doc_id, held_out, lang_pred, score for each row of docs, from its whole text alone.

    Null and letterless texts are `und` with score 0. Repeated rows get equal results; a null doc_id stays null;
    other columns are ignored. No shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in steps(batches, "text"):
            found = [profiles.predict(t) for t in b.column(1).to_pylist()]
            yield pa.record_batch({"doc_id": b.column(0), "lang_pred": pa.array([x[0] for x in found], pa.string()), "score": pa.array([x[1] for x in found], pa.float64())})

    out = map_arrow(docs, run, f"doc_id {dict(docs.dtypes)['doc_id']}, lang_pred string, score double", "doc_id", "text")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def judgeable(text: str | None) -> bool:
    """Whether a text has LEAST_LETTERS letters."""
    return sum(1 for _ in islice(filter(str.isalpha, text or ""), LEAST_LETTERS)) == LEAST_LETTERS


def least_cosine(docs: DataFrame, profiles: Profiles) -> float:
    """The cosine below which a text is in no language that was learned.

    All but a thousandth of the labelled documents that are long enough are at least as near to their own lang; it is
    at most what unrelated n-grams reach by chance (CHANCE standard deviations): a text above that is never dropped.
    Every row of docs with a lang outside the held-out quarter counts. Cosines below chance are stored; the one at the
    wanted place is found by counts in ever smaller ranges, so that the driver gets PARTS rows at a time.
    """
    chance = CHANCE / DIMENSIONS**0.5
    if not profiles.languages:
        return 0.0
    known = docs.where(F.col("lang").isNotNull() & ~held_out(F.col("doc_id")))
    place = {lang: k for k, lang in enumerate(profiles.languages)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judged, below = 0, []
        for b in steps(batches, "text"):
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if lang in place and judgeable(text):
                    cos = float(profiles.cosines(bundle(text))[place[lang]])
                    judged += 1
                    below += [cos] if cos < chance else []
            if len(below) >= 10_000:
                yield pa.record_batch({"n": pa.array([judged], pa.int64()), "below": pa.array([below], pa.list_(pa.float64()))})
                judged, below = 0, []
        yield pa.record_batch({"n": pa.array([judged], pa.int64()), "below": pa.array([below], pa.list_(pa.float64()))})

    found = store(map_arrow(known, run, "n bigint, below array<double>", "lang", "text"))
    try:
        total = found.agg(F.sum("n").alias("n")).collect()[0]["n"] or 0
        return max(0.0, smallest(found.select(F.explode("below").alias("x")), total // 1000, chance)) if total else 0.0
    finally:
        drop(found)


#: Ranges that are counted at a time.
PARTS = 1_000


def smallest(rows: DataFrame, k: int, otherwise: float) -> float:
    """The value at place k (from 0) of the sorted numbers x; `otherwise` if there are no more than k."""
    while True:
        ends = rows.agg(F.count("x").alias("n"), F.min("x").alias("least"), F.max("x").alias("most")).collect()[0]
        if ends["n"] <= k:
            return otherwise
        least, most = ends["least"], ends["most"]
        if least == most:
            return least
        part = F.least(F.floor((F.col("x") - least) / (most - least) * PARTS), F.lit(PARTS - 1))
        for r in rows.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("least"), F.max("x").alias("most")).orderBy("part").collect():
            if k < r["n"]:
                rows = rows.where(F.col("x").between(r["least"], r["most"]))
                break
            k -= r["n"]


def keep_identified(docs: DataFrame, profiles: Profiles, least: float = 0.0) -> DataFrame:
    """The rows of docs, all columns, whose text has a cosine of `least` or more with a language; letterless texts go.

    Where nothing can be decided, a text with a letter stays: if it is short, or if no language was learned. A null or
    empty text goes; lang, doc_id and other columns are passed on and never looked at; repeated rows fare alike; an
    empty table gives an empty result. No shuffle.
    """

    def stays(text: str | None) -> bool:
        if not profiles.languages:
            return bundle(text) is not None
        lang, cos = profiles.predict(text)
        return lang != UNKNOWN and (cos >= least or not judgeable(text))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in steps(batches, "text"):
            texts = b.column(b.schema.get_field_index("text")).to_pylist()
            yield b.filter(pa.array([stays(t) for t in texts], pa.bool_()))
        trim()

    return docs.mapInArrow(run, docs.schema)
