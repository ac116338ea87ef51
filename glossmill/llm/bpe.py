"""Byte-level BPE encoding and decoding.

Two tiers: a minimal perfect hash over the vocabulary resolves pre-tokens that are entries themselves;
the rest are merged with a heap of candidate pairs over a doubly linked list of byte pieces.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame

from .characters import stand_ins, unlike
from .common import map_arrow, steps

#: Bytes that Python keeps of the merged pre-tokens of earlier batches: entries in the memo of a worker.
MEMO = 300_000
#: Bytes from which a pre-token's links are kept in arrays; the low bits of a heap entry are a place.
LONG_PIECE, _PLACE = 65_536, (1 << 40) - 1
_PLACES = list(range(-1, LONG_PIECE + 1))


class MinimalPerfectHash:
    """Maps each of n keys to its own slot of 0..n-1 (hash, then a displacement by bucket).

    A key's 64-bit hash picks a bucket; the bucket's pilot p, found at build time, moves all its keys to free
    slots: slot = ((hash ^ mix(p)) >> 20) mod n. Other strings land on some slot too: compare the key there.
    """

    def __init__(self, keys: list[bytes], per_bucket: int = 4):
        self.n, self.buckets = len(keys), max(1, len(keys) // per_bucket)
        hashes = np.array([xxhash.xxh3_64_intdigest(k) for k in keys], dtype=np.uint64)
        if len(np.unique(hashes)) != self.n:
            raise ValueError("keys are not distinct")
        self.pilots = np.zeros(self.buckets, dtype=np.int64)
        bucket = (hashes % np.uint64(self.buckets)).astype(np.int64) if self.n else np.zeros(0, np.int64)
        order = np.argsort(bucket, kind="stable")
        starts = np.searchsorted(bucket[order], np.arange(self.buckets + 1))
        free, self.slot_of = np.ones(self.n, dtype=bool), np.zeros(self.n, dtype=np.int64)
        for b in np.argsort(-np.diff(starts), kind="stable"):
            own = order[starts[b] : starts[b + 1]]
            if not len(own):
                break
            first = 0
            while True:
                pilots = np.arange(first, first + 256)
                slots = ((hashes[own][:, None] ^ self._mixed(pilots)[None, :]) >> np.uint64(20)) % np.uint64(self.n)
                ok = free[slots].all(axis=0)
                if len(own) > 1:
                    s = np.sort(slots, axis=0)
                    ok &= (s[1:] != s[:-1]).all(axis=0)
                if ok.any():
                    k = int(np.argmax(ok))
                    self.pilots[b] = first + k
                    self.slot_of[own] = slots[:, k]
                    free[slots[:, k]] = False
                    break
                first += 256
        self._mix = self._mixed(self.pilots).tolist()

    @staticmethod
    def _mixed(p: np.ndarray) -> np.ndarray:
        x = (np.asarray(p).astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(29)
        return x * np.uint64(0xBF58476D1CE4E5B9)

    def slot(self, key: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(key)
        return ((h ^ self._mix[h % self.buckets]) >> 20) % self.n


def numbered(pieces: np.ndarray, any_nul: bool) -> tuple[np.ndarray, list[str]]:
    """A number for each string, and the distinct strings by number.

    pandas compares strings up to their first NUL, so those with one are numbered by a dictionary.
    """
    if not any_nul:
        codes, distinct = pd.factorize(pieces)
        return codes, list(distinct)
    own: dict[str, int] = {}
    return np.fromiter((own.setdefault(p, len(own)) for p in pieces), np.int64, len(pieces)), list(own)


class ByteBPE:
    """Encoder and decoder for a vocabulary of byte strings whose ids are their merge ranks."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.pattern, self.ranks = regex.compile(pattern), ranks
        self.entry = dict(zip(ranks.values(), ranks.keys(), strict=True))
        keys = list(ranks)
        self.hash = MinimalPerfectHash(keys)
        self.at: list[tuple[bytes, int]] = [(b"", 0)] * len(keys)
        for key, slot in zip(keys, self.hash.slot_of.tolist(), strict=True):
            self.at[slot] = (key, ranks[key])
        self.size = {r: len(k) for k, r in ranks.items()}
        self.pairs = [ranks.get(bytes((a, b)), -1) for a in range(256) for b in range(256)]
        self.memo: dict[str, tuple[int, ...]] = {}

    @classmethod
    def load(cls, path: str, pattern: str) -> ByteBPE:
        with open(path, "rb") as lines:
            return cls({base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}, pattern)

    def merge(self, piece: bytes) -> tuple[int, ...]:
        """The ids of a pre-token: always joins the neighbours of least rank, the leftmost first.

        A heap entry is one integer, rank above place; end and left link the parts that are left, as places of bytes.
        """
        ranks, size, n = self.ranks, self.size, len(piece)
        get, push, pop = ranks.get, heapq.heappush, heapq.heappop
        if n <= LONG_PIECE:
            end, left = _PLACES[2 : n + 2], _PLACES[:n]
        else:  # a number of its own for each place would take several times the memory
            end, left = array("q", range(1, n + 1)), array("q", range(-1, n - 1))
        heap, i, pairs = [], 0, self.pairs
        for a, b in pairwise(piece):
            if (r := pairs[a << 8 | b]) >= 0:
                heap.append(r << 40 | i)
            i += 1
        heapq.heapify(heap)
        while heap:
            x = pop(heap)
            i, r = x & _PLACE, x >> 40
            j = end[i]
            if not j or j >= n or end[j] - i != size[r]:
                continue  # one of the two has been joined to something else since
            end[i] = k = end[j]
            end[j] = 0
            if k < n:
                left[k] = i
                r = get(piece[i : end[k]])
                if r is not None:
                    push(heap, r << 40 | i)
            h = left[i]
            if h >= 0:
                r = get(piece[h:k])
                if r is not None:
                    push(heap, r << 40 | h)
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : end[i]]])
            i = end[i]
        return tuple(out)

    def resolve(self, piece: str) -> tuple[int, ...]:
        raw = piece.encode("utf-8", "surrogatepass")
        key, rank = self.at[self.hash.slot(raw)]
        return (rank,) if key == raw else self.merge(raw)

    def pieces(self, text: str) -> list[str]:
        """The matches of the pattern, with letters, numbers and white space as tiktoken sees them.

        Where the regex module has another class for a character, a stand-in is matched in its place.
        """
        if text.isascii() or not unlike(text):
            return self.pattern.findall(text)
        return [text[m.start() : m.end()] for m in self.pattern.finditer(text.translate(stand_ins()))]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, and where each text's ids begin and end (n + 1 offsets)."""
        found = [self.pieces(t) for t in texts]
        counts = np.fromiter(map(len, found), np.int64, len(found))
        pieces = np.empty(int(counts.sum()), dtype=object)
        pieces[:] = list(chain.from_iterable(found))
        del found
        codes, distinct = numbered(pieces, any("\0" in t for t in texts))
        if len(self.memo) > MEMO:
            self.memo.clear()
        memo, ids = self.memo, []
        for p in distinct:
            x = memo.get(p)
            if x is None:
                x = self.resolve(p)
                if len(p) < 64:
                    memo[p] = x
            ids.append(x)
        lens = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter(chain.from_iterable(ids), np.uint32, int(lens.sum()))
        starts = np.cumsum(lens) - lens
        n = lens[codes]
        ends = np.cumsum(n)
        out = flat[np.repeat(starts[codes] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)]
        bounds = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])]
        return out, bounds

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.entry.__getitem__, ids.tolist()))


@lru_cache(maxsize=2)
def loaded(path: str, pattern: str) -> ByteBPE:
    return ByteBPE.load(path, pattern)


#: A blank between two other characters that are not white space always begins a pre-token of PATTERN (all libraries
#: agree on white space).
_SAFE = regex.compile(r"(?<=\S) (?=\S)")


def portions(text: str, size: int) -> Iterator[str]:
    """Cut a very long text where pre-tokens begin anyway, so that one text never needs all its pre-tokens at once."""
    start = 0
    while len(text) - start > size:
        m = _SAFE.search(text, start + size)
        if not m:
            break
        yield text[start : m.start()]
        start = m.start()
    yield text[start:]


def encode_texts(bpe: ByteBPE, texts: list[str | None], size: int = 1_000_000) -> list[np.ndarray]:
    """Each text's ids (null: none); long texts are encoded in portions."""
    parts = [list(portions(t or "", size)) for t in texts]
    ids, bounds = bpe.encode(list(chain.from_iterable(parts)))
    at = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(int)
    return [ids[bounds[a] : bounds[b]] for a, b in zip(at[:-1], at[1:], strict=True)]


def bpe_roundtrip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Encode every whole text and decode the ids again.

    Returns doc_id, ids (binary, little-endian unsigned 32-bit), n_tokens, decoded (binary). A null text counts as
    empty: no ids. A null doc_id stays null; texts of any length are encoded in portions; repeated rows give repeated
    results; an empty table gives an empty result; other columns are ignored, whatever their names. One pass over the
    scan's partitions without a shuffle. The vocabulary is a fixed file whose path is a parameter.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path, pattern)
        for b in steps(batches, "text"):
            ids = encode_texts(bpe, b.column(1).to_pylist())
            yield pa.record_batch(
                {
                    "doc_id": b.column(0),
                    "ids": pa.array([x.astype("<u4").tobytes() for x in ids], pa.binary()),
                    "n_tokens": pa.array([len(x) for x in ids], pa.int64()),
                    "decoded": pa.array([bpe.decode(x) for x in ids], pa.binary()),
                }
            )

    return map_arrow(docs, run, f"doc_id {dict(docs.dtypes)['doc_id']}, ids binary, n_tokens bigint, decoded binary", "doc_id", "text")


def bpe_digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, and the SHA-256 digests of the ids and of the decoded bytes, from bpe_roundtrip's output."""
    return bpe_roundtrip(docs, path, pattern).selectExpr("doc_id", "n_tokens", "sha2(ids, 256) AS ids_sha256", "sha2(decoded, 256) AS decoded_sha256")


def digest(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()
