"""Quality classifier: a byte-level convolutional network in numpy.

A text's UTF-8 bytes are cut into overlapping chunks that cover all of it. Filters over a few bytes (each a table of
a weight per place and byte) slide over a chunk and are max-pooled. A document's chunk features are joined by mean,
maximum and minimum, and a small layer makes one probability of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, map_arrow, sample_of, steps, trim

#: The step between chunks is odd, so that filters at every other byte see both parities of places.
CHUNK, OVERLAP = 512, 63
WIDTH, STRIDE, FILTERS, HIDDEN = 6, 2, 16, 16
#: Labelled documents to learn from, about, and the bytes of their whole texts together: a sample that the driver holds.
TRAINING_DOCS, TRAINING_BYTES, EPOCHS = 4_000, 64_000_000, 14
#: Few documents are gone through more often, until the net has had this many steps of BATCH documents.
LEAST_STEPS, BATCH = 660, 64
THRESHOLD = 0.7


def chunks(text: str | None) -> np.ndarray:
    """The chunks of a whole text as a matrix of bytes; the last is filled up with zeros. An empty text has one, of zeros."""
    raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), dtype=np.uint8)
    step = CHUNK - OVERLAP
    n = max(1, -(-(len(raw) - OVERLAP) // step))
    full = np.zeros(n * step + OVERLAP, dtype=np.uint8)
    full[: len(raw)] = raw
    return np.lib.stride_tricks.sliding_window_view(full, CHUNK)[::step]


class ByteConvNet:
    """Weights and the forward and backward pass."""

    def __init__(self, seed: int = 5):
        r = np.random.default_rng(seed)
        self.w = {
            "E": (r.standard_normal((WIDTH, 256, FILTERS)) * 0.3).astype(np.float32),
            "b": np.zeros(FILTERS, np.float32),
            "H": (r.standard_normal((3 * FILTERS, HIDDEN)) * 0.15).astype(np.float32),
            "h": np.zeros(HIDDEN, np.float32),
            "o": (r.standard_normal(HIDDEN) * 0.3).astype(np.float32),
            "c": np.zeros(1, np.float32),
        }

    def pooled(self, x: np.ndarray, where: bool = False):
        """Max-pooled filter outputs of chunks, through tanh; with where, also the places of the maxima.

        Chunks go in portions of 64, so the outputs at all places of many chunks are never held at once.
        """
        n = (CHUNK - WIDTH) // STRIDE + 1
        act = np.empty((min(64, len(x)), n, FILTERS), np.float32)
        top, at = np.empty((len(x), FILTERS), np.float32), np.empty((len(x), FILTERS), np.int64)
        for i in range(0, len(x), 64):
            own = x[i : i + 64]
            part = act[: len(own)]
            np.take(self.w["E"][0], own[:, 0 : n * STRIDE : STRIDE], axis=0, out=part, mode="clip")
            for k in range(1, WIDTH):
                part += np.take(self.w["E"][k], own[:, k : k + n * STRIDE : STRIDE], axis=0, mode="clip")
            if where:
                at[i : i + 64] = part.argmax(axis=1)
                top[i : i + 64] = np.take_along_axis(part, at[i : i + 64, None, :], axis=1)[:, 0]
            else:
                part.max(axis=1, out=top[i : i + 64])
        p = np.tanh(top * 0.5 + self.w["b"])
        return (p, at) if where else p

    @staticmethod
    def joined(p: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
        mean = np.add.reduceat(p, starts) / counts[:, None]
        return np.concatenate([mean, np.maximum.reduceat(p, starts), np.minimum.reduceat(p, starts)], axis=1)

    def head(self, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        hidden = np.maximum(z @ self.w["H"] + self.w["h"], 0)
        return hidden, 1 / (1 + np.exp(-np.clip(hidden @ self.w["o"] + self.w["c"], -30, 30)))

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """A probability for each whole text, in bounded portions of chunks."""
        out = np.zeros(len(texts))
        for i, t in enumerate(texts):
            x = chunks(t)
            total, most, least = np.zeros(FILTERS, np.float64), np.full(FILTERS, -2.0), np.full(FILTERS, 2.0)
            for k in range(0, len(x), 512):
                p = self.pooled(x[k : k + 512])
                total, most, least = total + p.sum(axis=0), np.maximum(most, p.max(axis=0)), np.minimum(least, p.min(axis=0))
            out[i] = self.head(np.concatenate([total / len(x), most, least])[None].astype(np.float32))[1][0]
        return out

    def fit(self, docs: list[np.ndarray], labels: np.ndarray, epochs: int = EPOCHS, rate: float = 0.01, seed: int = 3) -> None:
        """Adam on the log loss; docs are matrices of all chunks of whole texts. At least `epochs` passes, and LEAST_STEPS steps."""
        epochs = max(epochs, -(-LEAST_STEPS // -(-len(docs) // BATCH)))
        r = np.random.default_rng(seed)
        m, v, t = {k: np.zeros_like(x) for k, x in self.w.items()}, {k: np.zeros_like(x) for k, x in self.w.items()}, 0
        for epoch in range(epochs):
            order = r.permutation(len(docs))
            for i in range(0, len(order), BATCH):
                own = order[i : i + BATCH]
                g = self.gradient([docs[k] for k in own], labels[own])
                t += 1
                now = rate * (0.5 * (1 + np.cos(np.pi * epoch / epochs)) + 0.02)
                for k, d in g.items():
                    m[k] = 0.9 * m[k] + 0.1 * d
                    v[k] = 0.99 * v[k] + 0.01 * d * d
                    self.w[k] = (self.w[k] - now * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-6)).astype(np.float32)

    def gradient(self, docs: list[np.ndarray], y: np.ndarray) -> dict[str, np.ndarray]:
        counts = np.array([len(d) for d in docs])
        starts = np.cumsum(counts) - counts
        x, doc = np.concatenate(docs), np.repeat(np.arange(len(docs)), counts)
        p, at = self.pooled(x, where=True)
        z = self.joined(p, starts, counts)
        hidden, prob = self.head(z)
        d = ((prob - y) / len(docs)).astype(np.float32)
        g = {"o": hidden.T @ d, "c": d.sum(keepdims=True)}
        dh = d[:, None] * self.w["o"] * (hidden > 0)
        g |= {"H": z.T @ dh, "h": dh.sum(axis=0)}
        dz = dh @ self.w["H"].T
        mean, most, least = np.split(dz, 3, axis=1)
        _, zmax, zmin = np.split(z, 3, axis=1)
        dp = (mean / counts[:, None])[doc]
        for part, best in ((most, zmax), (least, zmin)):
            hit = p == best[doc]
            dp = dp + hit * (part / np.add.reduceat(hit.astype(np.float32), starts))[doc]
        da = dp * (1 - p * p)
        g["b"] = da.sum(axis=0)
        da = da * 0.5
        f = np.arange(FILTERS)[None]
        rows = np.arange(len(x))[:, None]
        e = [np.bincount((x[rows, at * STRIDE + k].astype(np.int64) * FILTERS + f).ravel(), weights=da.ravel(), minlength=256 * FILTERS).reshape(256, FILTERS) for k in range(WIDTH)]
        return g | {"E": np.stack(e).astype(np.float32)}


def fit(docs: DataFrame, labels: DataFrame, bound: int = TRAINING_DOCS, most_bytes: int = TRAINING_BYTES) -> ByteConvNet:
    """Learn from about `bound` labelled documents outside the held-out quarter, chosen by a hash of doc_id.

    Of these, in the order of the hash, as many as have `most_bytes` bytes together; their texts are whole, and all
    their chunks are learned from. The driver holds no more than that. Null labels and null ids are left out, of
    several labels of an id the largest counts, a null text is empty. Without both labels the net stays untrained but
    for its bias.
    """
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    total = known.agg(F.count(F.lit(1)).alias("n")).collect()[0]["n"]
    pick = sample_of(F.col("doc_id"), total, bound, "quality")
    order = F.xxhash64(F.lit("order"), "doc_id")
    rows = docs.select("doc_id", "text").where(pick).join(known.where(pick), "doc_id").select(order.alias("at"), "doc_id", "quality", F.coalesce("text", F.lit("")).alias("text"))
    sizes = sorted(tuple(r) for r in rows.select("at", F.octet_length("text")).collect())
    ends = np.cumsum([n for _, n in sizes])
    last = sizes[min(len(sizes), max(1, int(np.searchsorted(ends, most_bytes, "right")))) - 1][0] if sizes else 0
    got = sorted((r["doc_id"], r["quality"], r["text"]) for r in rows.where(F.col("at") <= last).select("doc_id", "quality", "text").collect())
    net = ByteConvNet()
    y = np.array([q for _, q, _ in got], dtype=np.float32)
    if len(y) and 0 < y.mean() < 1:
        net.fit([chunks(t) for _, _, t in got], y)
    else:
        net.w["o"][:] = 0
        net.w["c"][:] = 4.0 if not len(y) or y.mean() else -4.0
    return net


def score(docs: DataFrame, net: ByteConvNet) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs, from its whole text alone.

    A null text scores like an empty one. Repeated rows get equal results; a null doc_id stays null; texts of any
    length are whole; an empty table gives an empty result; other columns are ignored. No shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in steps(batches, "text"):
            yield pa.record_batch({"doc_id": b.column(0), "score": pa.array(net.scores(b.column(1).to_pylist()), pa.float64())})

    out = map_arrow(docs, run, f"doc_id {dict(docs.dtypes)['doc_id']}, score double", "doc_id", "text")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, net: ByteConvNet, least: float) -> DataFrame:
    """The rows of docs, all columns, whose text scores at least `least`.

    A null text scores like an empty one; repeated rows fare alike; other columns, whatever their names, are passed on
    and never looked at; an empty table gives an empty result. No shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in steps(batches, "text"):
            yield b.filter(pa.array(net.scores(b.column(b.schema.get_field_index("text")).to_pylist()) >= least, pa.bool_()))
        trim()

    return docs.mapInArrow(run, docs.schema)
