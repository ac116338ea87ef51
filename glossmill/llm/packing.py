"""Hierarchical multi-length packing of token sequences.

Documents are routed to context-size tiers (by default 1024, 512, 256 and 128 tokens). Each tier's documents open
windows of that size; the gaps of longer windows are filled from the shorter tiers, best fit first, and a last gap
by cutting a shorter document. What is left at the end of a group is cut to powers of two. So every sequence has a
power of two as its length and no padding. Step groups of equal size are balanced over the windows.
"""

from __future__ import annotations

import heapq
import json
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_type
from tokenizers import Tokenizer

from .bpe import portions
from .common import map_arrow, steps

TIERS = (1024, 512, 256, 128)
#: Documents packed together in a task, and the tokens that end such a group sooner.
GROUP_DOCS, GROUP_TOKENS = 4096, 4_000_000
#: Characters that are encoded at once.
PORTION = 1_000_000
#: Tokens of one step group.
STEP_TOKENS = 32_768

SCHEMA = "doc_id {id}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, sequence_length bigint, tier int, step_group bigint"


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies: printable Latin-1 stands for itself, the rest from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str) -> tiktoken.Encoding:
    """An encoder of the same ids as `tokenizers` gives for the JSON vocabulary at path (add_special_tokens=False).

    The ids of its entries are their merge ranks. Its added tokens count wherever their strings stand in a text, as
    they do there: the text is cut at them before anything else. Letters, numbers and white space are the same to both
    libraries (tests/llm/test_tokens.py goes through every character).
    """
    with open(path, encoding="utf-8") as f:
        model = json.load(f)
    if model.get("normalizer") or any(x["single_word"] or x["lstrip"] or x["rstrip"] for x in model["added_tokens"]):
        raise ValueError("only plain added tokens and no normalizer are supported")
    added = {x["content"]: x["id"] for x in model["added_tokens"]}
    at = byte_alphabet()
    ranks = {bytes(at[c] for c in k): v for k, v in model["model"]["vocab"].items() if k not in added}
    return tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=ranks, special_tokens=added)


@lru_cache(maxsize=2)
def tokenizer(path: str) -> Tokenizer:
    return Tokenizer.from_file(path)


def ids_of(path: str, pattern: str, text: str | None, end: int = 0) -> np.ndarray:
    """The ids of a whole text (null: none), and the id that ends it.

    Long texts go in portions that begin where pre-tokens do. The encoder gives up on about a million characters of
    white space in a row; `tokenizers` itself encodes such a portion.
    """
    out = []
    for part in portions(text or "", PORTION):
        try:
            ids = encoder(path, pattern).encode_to_numpy(part, allowed_special="all")
        except ValueError:
            ids = np.array(tokenizer(path).encode(part, add_special_tokens=False).ids, dtype=np.uint32)
        out.append(ids)
    return np.concatenate([*out, np.array([end])]).astype(np.uint32)


class _Pool:
    """Pieces by size, with the largest size up to a bound found by the bits of one integer."""

    def __init__(self):
        self.bits, self.by = 0, {}

    def add(self, piece: tuple[int, int, int]) -> None:
        n = piece[2]
        self.by.setdefault(n, []).append(piece)
        self.bits |= 1 << n

    def take(self, most: int, least: int = 1) -> tuple[int, int, int] | None:
        """The largest piece of least..most tokens."""
        n = (self.bits & ((1 << (most + 1)) - 1)).bit_length() - 1
        if n < least:
            return None
        of = self.by[n]
        piece = of.pop()
        if not of:
            self.bits &= ~(1 << n)
        return piece


def pack(sizes: list[int], tiers: tuple[int, ...] = TIERS) -> list[tuple[int, list[tuple[int, int, int]]]]:
    """Sequences as (tier, pieces) of documents with these sizes; a piece is (document, start, length).

    Every sequence's length is a power of two, at most tiers[0]; each token is in one piece.
    """
    top, out, pool = tiers[0], [], _Pool()
    for d, n in enumerate(sizes):
        for s in range(0, n - n % top, top):
            out.append((top, [(d, s, top)]))
        if n % top:
            pool.add((d, n - n % top, n % top))

    def cut(piece: tuple[int, int, int], n: int) -> tuple[int, int, int]:
        """The first n tokens of piece; the rest goes back to the pool."""
        d, s, size = piece
        if size > n:
            pool.add((d, s + n, size - n))
        return d, s, n

    left: list[tuple[int, int, int]] = []
    for k, tier in enumerate(tiers):
        below = tiers[k + 1] if k + 1 < len(tiers) else 0
        while (first := pool.take(tier, below + 1)) is not None:
            window, gap = [first], tier - first[2]
            while gap:
                piece = pool.take(min(gap, below or gap))  # fits as it is
                if piece is None:
                    piece = pool.take(below or tier)  # too long for the gap: cut it
                    if piece is None and below:
                        piece = pool.take(tier)  # no shorter tier is left
                    if piece is None:
                        break
                    piece = cut(piece, gap)
                window.append(piece)
                gap -= piece[2]
            if gap:
                left += window
            else:
                out.append((tier, window))
    size = 1 << max(0, (sum(p[2] for p in left)).bit_length() - 1)
    size = min(size, top)
    queue, total = left[::-1], sum(p[2] for p in left)
    while total:
        while size > total:
            size >>= 1
        window, gap = [], size
        while gap:
            d, s, n = queue.pop()
            if n > gap:
                queue.append((d, s + gap, n - gap))
                n = gap
            window.append((d, s, n))
            gap -= n
        out.append((size, window))
        total -= size
    return out


def step_groups(lengths: list[int], tokens: int) -> list[int]:
    """A group for each sequence so that the groups' token sums are as even as the longest-first rule makes them."""
    n = max(1, round(sum(lengths) / tokens))
    heap, out = [(0, g) for g in range(n)], [0] * len(lengths)
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        total, g = heapq.heappop(heap)
        out[i] = g
        heapq.heappush(heap, (total + lengths[i], g))
    return out


def pack_documents(docs: DataFrame, path: str, pattern: str, tiers: tuple[int, ...] = TIERS) -> DataFrame:
    """Tokenize every whole text, end it with id 0, and pack all ids into sequences of at most tiers[0] tokens.

    Returns a row per piece (SCHEMA). A null or empty text is the id 0 alone; a long one is cut; repeated rows are
    packed as often as they occur; doc_id keeps its type and a null one stays null; an empty table gives no pieces;
    other columns are ignored, whatever their names. Each task packs its own partition in groups of
    bounded size, without a shuffle. sequence_id holds the partition above bit 33 and a running number below it;
    the same partitions give the same sequences, so a rerun task repeats its result.
    """

    schema = SCHEMA.format(id=dict(docs.dtypes)["doc_id"])
    id_type = to_arrow_type(docs.schema["doc_id"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 33
        seq = group = 0
        docs_in: list = []
        ids_in: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            nonlocal seq, group
            sizes = [len(x) for x in ids_in]
            packed = pack(sizes, tiers)
            lengths = [sum(p[2] for p in w) for _, w in packed]
            steps_of = step_groups(lengths, STEP_TOKENS)
            rows: list[tuple] = []
            for i, (tier, window) in enumerate(packed):
                at = 0
                for d, s, n in window:
                    rows.append((docs_in[d], s, n, zlib.crc32(ids_in[d][s : s + n].astype("<u4", copy=False).tobytes()), sizes[d], base + seq, at, lengths[i], tier, base + group + steps_of[i]))
                    at += n
                seq += 1
            group += max(steps_of, default=0) + 1
            docs_in.clear()
            ids_in.clear()
            kinds = [id_type] + [pa.int64()] * 7 + [pa.int32(), pa.int64()]
            return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[x.split()[0] for x in schema.split(", ")])

        total = 0
        for b in steps(batches, "text"):
            for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids = ids_of(path, pattern, t)
                docs_in.append(d)
                ids_in.append(ids)
                total += len(ids)
                if len(docs_in) >= GROUP_DOCS or total >= GROUP_TOKENS:
                    yield flush()
                    total = 0
        if docs_in:
            yield flush()

    return map_arrow(docs, run, schema, "doc_id", "text")
