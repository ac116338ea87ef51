"""N-gram Jaccard join by T-occurrence search (DivideSkip), and the groups that its links form.

1. A task hashes its texts to sets of word shingles, joins equal sets to their smallest doc_id, and cuts each set by
   hash into so many buckets that two linked sets agree in at least one whole bucket (see `signatures`).
2. Sets that agree in a bucket are candidates; their connected components bound the search and are small as a rule.
3. Within a component, an inverted index of the sets answers T-occurrence queries: short lists are merged with a
   heap, long lists are probed by binary search (`SkipIndex`). A component of more than SMALL sets is first searched
   for a few leaders only. What these leave unconnected meets all of it by histograms of shingles, a few bytes in place
   of a set (`_near`): most components hold together by chance, and fall apart there. What remains connected is searched
   in blocks.
"""

from __future__ import annotations

import heapq
import math
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop, map_arrow, sample_of, steps, store, trim
from .components import components

#: Sets of a component that are all searched at once; leaders of a larger one; sets of an index block.
SMALL, LEADERS, BLOCK, OPEN_BLOCK = 16, 6, 256, 1024
#: Shingles of the sets of an open index block: about 100 bytes each are held.
OPEN_TOKENS = 3_000_000
#: Histograms of a block and their bytes; their least number of bins, and shingles a bin, beyond which there are four times as many.
NEAR_BLOCK, NEAR_BYTES, LEAST_BINS, FILL = 16_384, 4 << 20, 64, 6.4
#: Documents whose sets and signatures a task holds at once, and signatures.
FLUSH_DOCS, FLUSH_SIGNATURES = 50_000, 600_000
#: Documents that are looked at (about) for shingles so frequent that signatures do better without them.
FREQUENT_SAMPLE, FREQUENT_SHARE, FREQUENT_MOST = 20_000, 0.00015, 400_000
#: Growth of the size classes, and the bucketings that are tried in turn.
RATIO, TRIES = 1.4, 6
#: Stands for a null doc_id within the tables of this module.
NO_ID = -(1 << 63) + 1

_BASE = 0x9E3779B97F4A7C15
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, *range(9, 14)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values (the finalizer of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base modulo 2**64 and their inverses."""
    if len(_POWERS[0]) < n:
        n = max(n, 1 << 16)
        for k, b in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            p = np.full(n, b, dtype=np.uint64)
            p[0] = 1
            _POWERS[k] = np.multiply.accumulate(p)
    return _POWERS[0][:n], _POWERS[1][:n]


def word_hashes(text: str, portion: int = 1 << 20) -> np.ndarray:
    """A 64-bit hash of each word of a whole text: A-Z lower-cased, words of the bytes that are no white space."""
    raw = text.encode("utf-8", "surrogatepass")
    out, start = [], 0
    while start < len(raw):
        end = min(len(raw), start + portion)
        while end < len(raw) and raw[end] not in b" \t\n\v\f\r":
            end += 1
        b = _LOWER[np.frombuffer(raw, np.uint8, end - start, start)]
        word = ~_SPACE[b]
        edge = np.flatnonzero(np.diff(word, prepend=False, append=False))
        s, e = edge[::2], edge[1::2]
        if len(s):
            p, inverse = _powers(len(b) + 1)
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((b.astype(np.uint64) + np.uint64(1)) * p[: len(b)], dtype=np.uint64)])
            out.append(mix((total[e] - total[s]) * inverse[s] + (e - s).astype(np.uint64)))
        start = end
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def shingles(text: str | None, n: int) -> np.ndarray:
    """The sorted distinct hashes of a text's n-word shingles; fewer words are one shingle; no words give none."""
    w = word_hashes(text or "")
    if not len(w):
        return w
    if len(w) < n:
        parts, x = w, np.full(1, len(w), dtype=np.uint64)
        for h in parts:
            x = mix(x * np.uint64(_BASE) + h)
        return x
    x = np.full(len(w) - n + 1, n, dtype=np.uint64)
    for k in range(n):
        x = mix(x * np.uint64(_BASE) + w[k : len(w) - n + 1 + k])
    return np.unique(x)


@dataclass(frozen=True)
class Similarity:
    """Sets link when den * intersection >= num * union."""

    n: int = 5
    num: int = 8
    den: int = 10

    def linked(self, a: int, b: int, both: int) -> bool:
        return self.den * both >= self.num * (a + b - both)

    def least_overlap(self, a: int, b: int) -> int:
        return -(-self.num * (a + b) // (self.num + self.den))

    def size_classes(self, size: int) -> list[tuple[int, int, int]]:
        """(class, most differing elements, spare buckets) of the classes in which a set of this size meets partners.

        Its own class, and the next one if a larger partner may be in it. Linked sets of which the larger one is in a
        class differ in no more elements than said.
        """
        ratio = max(RATIO, self.den / self.num)
        lo, c = 1, 0
        while (up := int(lo * ratio) + 1) <= size:
            lo, c = up, c + 1
        out = []
        for k in (c, c + 1):
            hi = int(lo * ratio)
            if k == c or size * self.den // self.num >= lo:
                d = 2 * hi * (self.den - self.num) // (self.den + self.num)
                out.append((k, d, 2 + d // 12))
            lo = hi + 1
        return out


def signatures(s: np.ndarray, sim: Similarity, frequent: np.ndarray) -> np.ndarray:
    """64-bit signatures of a set's buckets; two linked, unequal sets have at least one in common.

    With d differing elements at most and d + 1 + spare buckets, two linked sets agree in 1 + spare buckets. Empty
    buckets tell nothing and are left out: as long as one of the two sets has no more than `spare` of them, a bucket
    that is not empty agrees. A set with more of them is bucketed anew, up to TRIES times (at last its empty buckets
    count too), so two such sets meet in a later try. The first try leaves out the frequent shingles: fewer elements
    differ then, not more.
    """
    out = []
    seed = np.uint64
    for c, d, spare in sim.size_classes(len(s)):
        if not d:
            continue  # only equal sets link
        k = d + 1 + spare
        for t in range(TRIES):
            own = s
            if not t and len(frequent):
                at = np.minimum(np.searchsorted(frequent, s), len(frequent) - 1)
                own = s[frequent[at] != s]
            x = mix(own + seed((t * 2 + 1) * _BASE & 0xFFFFFFFFFFFFFFFF))
            bucket = (x >> seed(33)) % seed(k)
            order = np.argsort(bucket, kind="stable")
            at, starts = np.unique(bucket[order], return_index=True)
            sums = np.add.reduceat(mix(x[order] + seed(7)), starts) if len(own) else np.zeros(0, np.uint64)
            tag = (at * seed(TRIES) + seed(t)) * seed(512) + seed(c)
            out.append(mix(sums + mix(tag)))
            empty = k - len(at)
            if empty <= spare:
                break
            if t == TRIES - 1:
                none = np.setdiff1d(np.arange(k, dtype=np.uint64), at)
                out.append(mix(mix((none * seed(TRIES) + seed(t)) * seed(512) + seed(c)) + seed(1)))
    return np.unique(np.concatenate(out)) if out else np.zeros(0, np.uint64)


class SkipIndex:
    """Inverted lists over sets, for T-occurrence queries in the manner of DivideSkip."""

    def __init__(self, sim: Similarity):
        self.sim, self.ids, self.sizes = sim, [], []
        #: The places of a token's sets; most tokens have one, which then stands as a number, without a list around it.
        self.lists: dict[int, int | list[int]] = {}

    def add(self, doc_id: int, tokens: list[int]) -> None:
        k, lists = len(self.ids), self.lists
        self.ids.append(doc_id)
        self.sizes.append(len(tokens))
        for t in tokens:
            x = lists.setdefault(t, k)
            if x is not k and x != k:
                if type(x) is list:
                    x.append(k)
                else:
                    lists[t] = [x, k]

    def search(self, tokens: list[int]) -> list[int]:
        """The places of all indexed sets that link with these tokens."""
        sim, n = self.sim, len(tokens)
        need = -(-sim.num * n // sim.den)  # a union has n elements at least
        lists = sorted((x if type(x) is list else (x,) for t in tokens if (x := self.lists.get(t)) is not None), key=len)
        if not need or len(lists) < need:
            return []
        n_long = min(need - 1, int(need / (0.01 * math.log2(len(lists[-1]) + 1) + 1)))
        short, long = lists[: len(lists) - n_long], lists[len(lists) - n_long :]
        least, out = need - n_long, []
        counts: dict[int, int] = {}
        heap = [(x[0], i, 0) for i, x in enumerate(short)]
        heapq.heapify(heap)
        while heap:
            k, i, at = heap[0]
            counts[k] = counts.get(k, 0) + 1
            at += 1
            if at < len(short[i]):
                heapq.heapreplace(heap, (short[i][at], i, at))
            else:
                heapq.heappop(heap)
        for k, found in counts.items():
            if found < least:
                continue
            goal, rest = sim.least_overlap(n, self.sizes[k]), len(long)
            for x in long:
                if found + rest < goal:
                    break
                at = bisect_left(x, k)
                found += at < len(x) and x[at] == k
                rest -= 1
            if sim.linked(n, self.sizes[k], found):
                out.append(k)
        return out


def _frequent(docs: DataFrame, sim: Similarity) -> np.ndarray:
    """Shingles in many of a few thousand documents. Which they are bears on the speed alone, not on the result."""
    total = docs.select("doc_id").agg(F.count("doc_id").alias("n")).collect()[0]["n"]
    some = docs.where(sample_of(F.col("doc_id"), total, FREQUENT_SAMPLE, "frequent"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in steps(batches, "text"):
            own = [shingles(t, sim.n) for t in b.column(0).to_pylist()]
            yield pa.record_batch({"s": pa.array(np.concatenate(own).view(np.int64), pa.int64())})

    least = max(3, int(FREQUENT_SHARE * min(total, FREQUENT_SAMPLE)))
    top = map_arrow(some, run, "s bigint", "text").groupBy("s").count().where(F.col("count") >= least)
    got = top.orderBy(F.desc("count"), "s").limit(FREQUENT_MOST).select("s").toArrow().column(0).to_numpy()
    return np.sort(got.astype(np.int64).view(np.uint64))


#: Bytes that are sent of a signature and of a doc_id.
SIGNATURE_BYTES, ID_BYTES, BUCKETS_PER_PARTITION = 7, 8, 8


def _planes(x: np.ndarray, k: int) -> bytes:
    """The k low bytes of 64-bit values, one plane of bytes after another: high ones are nearly all zero."""
    return np.ascontiguousarray(x).view(np.uint8).reshape(len(x), 8)[:, :k].T.tobytes()


def _values(blob: bytes, at: int, n: int, k: int) -> np.ndarray:
    full = np.zeros((n, 8), np.uint8)
    full[:, :k] = np.frombuffer(blob, np.uint8, n * k, at).reshape(k, n).T
    return full.view(np.int64).ravel()


def _rows(kind: int, a: np.ndarray, b: np.ndarray, c: np.ndarray) -> pa.RecordBatch:
    return pa.record_batch([pa.array(np.full(len(a), kind, np.int32)), *(pa.array(np.ascontiguousarray(x)) for x in (a, b, c))], names=["kind", "a", "b", "c"])


def _by_signature(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links the sets that share a signature of a bucket to the smallest of them; other kinds pass as they are."""
    at, held = None, []

    def close() -> Iterator[pa.RecordBatch]:
        if held:
            step = SIGNATURE_BYTES + ID_BYTES
            sig = np.concatenate([_values(x, 0, len(x) // step, SIGNATURE_BYTES) for x in held])
            doc = np.concatenate([_values(x, len(x) // step * SIGNATURE_BYTES, len(x) // step, ID_BYTES) for x in held])
            held.clear()
            order = np.lexsort((doc, sig))
            sig, doc = sig[order], doc[order]
            new = np.concatenate([[True], sig[1:] != sig[:-1]])
            pairs = np.stack([doc[new][np.cumsum(new) - 1][~new], doc[~new]], axis=1)
            pairs = pairs[pairs[:, 0] < pairs[:, 1]]
            if len(pairs):
                pairs = np.unique(pairs, axis=0)
                yield _rows(2, pairs[:, 0], pairs[:, 1], np.zeros(len(pairs), np.int64))

    for batch in batches:
        for bucket, kind, blob in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            if bucket != at:
                yield from close()
                at = bucket
            if kind == 1:
                held.append(blob)
            else:
                yield _rows(kind, *np.frombuffer(blob, np.int64).reshape(3, -1))
    yield from close()
    trim()


def _hashed(docs: DataFrame, sim: Similarity, frequent: np.ndarray) -> DataFrame:
    """Rows by kind, written to the shared folder:

    0: a document (a: doc_id or NO_ID, c: size); 2: two sets with a signature in common (a, b); 3: two documents of a
    task with equal sets (a, b); 4: a set (a, c: its hash, b: its first doc_id in the task).
    On their way signatures are packed by bucket; the other kinds travel with them.
    """
    buckets = BUCKETS_PER_PARTITION * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names, turn = ["bucket", "kind", "payload"], [0]

    def sent(ids: list[int], kind: int, blobs: list[bytes]) -> pa.RecordBatch:
        return pa.record_batch([pa.array(ids, pa.int64()), pa.array([kind] * len(ids), pa.int32()), pa.array(blobs, pa.binary())], names=names)

    def rows(kind: int, a, b=None, c=None) -> pa.RecordBatch:
        full = [np.zeros(len(a), np.int64) if x is None else np.asarray(x, dtype=np.int64) for x in (a, b, c)]
        turn[0] += 1
        return sent([-1 - (int(full[0][0]) + turn[0]) % buckets], kind, [np.stack(full).tobytes()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first: dict[tuple[int, int], int] = {}
        sets: dict[int, np.ndarray] = {}
        held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            if first:
                keys = np.array(list(first), dtype=np.uint64).view(np.int64)
                yield rows(4, keys[:, 0], list(first.values()), keys[:, 1])
            own = sorted(sets)
            if any(len(x) for x in sets.values()):
                sig = np.concatenate([sets[d] for d in own])
                doc = np.repeat(np.array(own, dtype=np.int64), [len(sets[d]) for d in own])
                order = np.argsort(sig, kind="stable")  # doc ascends, so the first of a signature is its smallest
                sig, doc = sig[order], doc[order]
                new = np.concatenate([[True], sig[1:] != sig[:-1]])
                lead = doc[new][np.cumsum(new) - 1]
                pairs = np.stack([lead[~new], doc[~new]], axis=1)
                one, of = sig[new] >> np.uint64(64 - 8 * SIGNATURE_BYTES), doc[new]
                at = (one % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(at, kind="stable")
                ids, cut = np.unique(at[order], return_index=True)
                blobs = [_planes(one[x], SIGNATURE_BYTES) + _planes(of[x], ID_BYTES) for x in np.split(order, cut[1:])]
                for k in range(0, len(ids), 256):
                    yield sent(ids[k : k + 256].tolist(), 1, blobs[k : k + 256])
                if len(pairs):
                    pairs = np.unique(pairs, axis=0)
                    yield rows(2, pairs[:, 0], pairs[:, 1])
            first.clear()
            sets.clear()

        for b in steps(batches, "text"):
            docs_out, sizes, equal = [], [], []
            for d, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                s = shingles(text, sim.n)
                docs_out.append(d)
                sizes.append(len(s))
                if not len(s) or d is None:
                    continue
                key = (int(np.add.reduce(s)) & 0xFFFFFFFFFFFFFFFF, int(np.add.reduce(mix(s + np.uint64(len(s))))) & 0xFFFFFFFFFFFFFFFF)
                have = first.get(key)
                if have is None:
                    sig = signatures(s, sim, frequent)
                    first[key] = d
                    sets[d] = np.concatenate([sets[d], sig]) if d in sets else sig
                    held += len(sig)
                elif have != d:
                    equal.append((have, d))
            yield rows(0, [NO_ID if d is None else d for d in docs_out], None, sizes)
            if equal:
                yield rows(3, [x[0] for x in equal], [x[1] for x in equal])
            if held > FLUSH_SIGNATURES or len(sets) > FLUSH_DOCS:
                yield from flush()
                held = 0
                trim()
        yield from flush()
        trim()

    out = map_arrow(docs.selectExpr("cast(doc_id AS bigint) AS doc_id", "text"), run, "bucket bigint, kind int, payload binary", "doc_id", "text")
    return store(out.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_by_signature, "kind int, a bigint, b bigint, c bigint"))


class Joined(dict):
    """Which numbers are connected by now: each has its parent, the smallest at the top."""

    def top(self, x: int) -> int:
        while (up := self.setdefault(x, x)) != x:
            self[x] = x = self[up]
        return x

    def join(self, a: int, b: int) -> bool:
        """Connect a and b; whether they were not connected before."""
        a, b = self.top(a), self.top(b)
        self[max(a, b)] = min(a, b)
        return a != b


def histogram(s: np.ndarray) -> np.ndarray:
    """How many of a set's shingles begin with which bits, 255 at most; the more shingles, the more bins."""
    bins = LEAST_BINS
    while len(s) > FILL * bins:
        bins *= 4
    return np.minimum(np.bincount((s >> np.uint64(65 - bins.bit_length())).astype(np.int64), minlength=bins), 255).astype(np.uint8)


class Histograms:
    """Histograms of sets, to be asked for those that may link with a set.

    Two sets differ in as many elements as their histograms do, at least; so do histograms of wider bins, summed up.
    """

    def __init__(self, sim: Similarity, ids: list[int], parts: list[int], sizes: list[int], histograms: list[bytes]):
        self.sim, self.kinds = sim, {}
        for bins in {len(h) for h in histograms}:
            own = sorted((i for i, h in enumerate(histograms) if len(h) == bins), key=lambda i: sizes[i])
            table = np.frombuffer(b"".join(histograms[i] for i in own), np.uint8).reshape(-1, bins).T
            self.kinds[bins] = (*(np.array([x[i] for i in own], np.int64) for x in (ids, parts, sizes)), {bins: np.ascontiguousarray(table, np.int16)})

    def near(self, part: int, size: int, h: bytes) -> list[int]:
        """The ids of sets of other parts that may link with this one, and of all that do."""
        out, sim = [], self.sim
        for bins, (ids, parts, sizes, tables) in self.kinds.items():
            lo, hi = np.searchsorted(sizes, -(-size * sim.num // sim.den)), np.searchsorted(sizes, size * sim.den // sim.num, "right")
            if lo >= hi:
                continue
            n = min(bins, len(h))
            if n not in tables:
                tables[n] = tables[bins].reshape(n, bins // n, -1).sum(axis=1, dtype=np.int32)
            own = np.frombuffer(h, np.uint8).reshape(n, -1).sum(axis=1, dtype=np.int16 if len(h) == n else np.int32)[:, None]
            both = sizes[lo:hi] + size
            most = both - 2 * -(-sim.num * both // (sim.num + sim.den))
            half = n // 2
            at = np.flatnonzero((np.abs(tables[n][:half, lo:hi] - own[:half]).sum(axis=0, dtype=np.int32) <= most) & (parts[lo:hi] != part))
            if len(at):
                at = at[np.abs(tables[n][:, lo + at] - own).sum(axis=0, dtype=np.int32) <= most[at]]
                out += ids[lo + at].tolist()
        return out


def _search(rows: DataFrame, sim: Similarity, described: bool = False) -> DataFrame:
    """Links (u, v) found in blocks. rows: grp, block, role (0: indexed, 1: a query, 2: both), doc_id, text.

    Rows are streamed by (grp, block, role); only a block's indexed sets are held. Texts travel, not sets, which are
    larger and do not compress. Of the links that a block finds, those go out that connect what its earlier ones have
    not: fewer than its sets and queries, with the same components. If described, each query (role 1) also gives a row
    without v: its doc_id, size and histogram (u, n, h).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, index, joined = None, SkipIndex(sim), Joined()
        for batch in batches:
            out = []
            for g, k, role, d, text in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if (g, k) != at:
                    at, index = (g, k), SkipIndex(sim)
                    joined.clear()
                s = shingles(text, sim.n)
                tokens = s.tolist()
                if role:
                    out += [(d, index.ids[x], None, None) for x in index.search(tokens) if joined.join(d, index.ids[x])]
                if role != 1:
                    index.add(d, tokens)
                elif described:
                    out.append((d, None, len(s), histogram(s).tobytes()))
            if out:
                yield pa.record_batch([pa.array(x, kind) for x, kind in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["u", "v", "n", "h"])
        del index
        trim()

    rows = rows.select("grp", "block", "role", "doc_id", "text").repartition("grp", "block").sortWithinPartitions("grp", "block", "role", "doc_id")
    return rows.mapInArrow(run, "u bigint, v bigint, n bigint, h binary")


def _near(rows: DataFrame, sim: Similarity) -> DataFrame:
    """Pairs (u, v) of different parts that may link, by their histograms, as few as connect all that may.

    rows: grp, block, role (0: held, 1: a query), doc_id, part, n (the set's size), h. As in _search, a block's held
    rows are in memory, and queries are streamed past them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, index, joined = None, [], None, Joined()
        for batch in batches:
            out = []
            for g, k, role, *x in zip(*(batch.column(i).to_pylist() for i in range(7)), strict=True):
                if (g, k) != at:
                    at, held, index = (g, k), [], None
                    joined.clear()
                if not role:
                    held.append(x)
                    continue
                if index is None:
                    index = Histograms(sim, *zip(*held, strict=True)) if held else Histograms(sim, [], [], [], [])
                    held = []
                out += [(x[0], d) for d in index.near(*x[1:]) if joined.join(x[0], d)]
            if out:
                yield pa.record_batch([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], names=["u", "v"])
        del index, held
        trim()

    rows = rows.select("grp", "block", "role", "doc_id", "part", "n", "h").repartition("grp", "block").sortWithinPartitions("grp", "block", "role", "doc_id")
    return rows.mapInArrow(run, "u bigint, v bigint")


def _blocks(rows: DataFrame, most: Column, *columns: str) -> DataFrame:
    """What _search and _near get of rows (grp, doc_id, n, size, asks): held ones in `most` blocks of their size, and queries in all of three sizes."""
    # only sets of about the same size can link: blocks hold one class of sizes, a query visits three
    full = rows.groupBy("grp", "size").agg(most.alias("k"))
    at = F.expr("size * 1000000 + pmod(xxhash64('block', doc_id), k)").alias("block")
    asks = rows.where("asks").select("grp", "doc_id", *columns, F.explode(F.expr("array(size - 1, size, size + 1)")).alias("size"))
    asks = asks.join(full, ["grp", "size"]).select("grp", F.explode(F.expr("transform(sequence(0L, k - 1), i -> size * 1000000 + i)")).alias("block"), F.lit(1).alias("role"), "doc_id", *columns)
    return rows.join(full, ["grp", "size"]).select("grp", at, F.lit(0).alias("role"), "doc_id", *columns).unionByName(asks)


def groups(docs: DataFrame, sim: Similarity | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of docs.

    component_id is the smallest doc_id that is reachable over links, the document's own included. A text without
    words (null, empty, blank) has no shingles and links with nothing, nor does a row with a null doc_id. Rows that
    repeat a doc_id are each returned; a link of one of them counts for the doc_id. Texts of any length are whole; an
    empty table gives no rows; other columns are ignored, whatever their names. Equal
    sets and equal signatures are joined within tasks before any shuffle, so a group of copies of any size sends a
    row per task; no group is collected, expanded into pairs or dropped.
    """
    sim = sim or Similarity()
    hashed = _hashed(docs, sim, _frequent(docs, sim))
    by = lambda k: hashed.where(F.col("kind") == k)
    lead = lambda k, *key: by(k).selectExpr(*key, "b AS v").withColumn("u", F.expr(f"min(v) OVER (PARTITION BY {', '.join(key)})")).where("u < v").select("u", "v")
    used: list[DataFrame] = []

    def step(df: DataFrame) -> DataFrame:
        used.append(store(df))
        return used[-1]

    equal = step(by(3).selectExpr("a AS u", "b AS v").unionByName(lead(4, "a", "c")))
    # a text whose set another document has before is not searched again; of documents with several texts, all are
    several = by(0).groupBy("a").agg(F.count(F.lit(1)).alias("n")).where("n > 1").selectExpr("a AS id")
    copies = equal.selectExpr("v AS id").distinct().join(several.hint("merge"), "id", "left_anti")
    coarse = step(components(by(2).selectExpr("a AS u", "b AS v")).join(copies.hint("merge"), "id", "left_anti"))
    links = equal
    sizes = step(coarse.groupBy("component").agg(F.count(F.lit(1)).alias("g")).where("g > 1").selectExpr("component AS grp", "g"))
    if not sizes.isEmpty():
        # who is indexed and who asks in which block, without the sets; all these tables are ids only
        texts = docs.selectExpr("cast(doc_id AS bigint) AS doc_id", "text")
        # the candidates' ids grow with the data, so they are not broadcast, however few they may be
        with_texts = lambda t: texts.join(t.hint("merge"), "doc_id")

        def by_leaders(who: DataFrame) -> DataFrame:
            """Small components: each set against those before it. Larger ones: every set against a few leaders, chosen
            by a hash (should there be none, a later search finds all)."""
            many, blocks = who.where(F.col("g") > SMALL), f"cast(ceil(g / {BLOCK}) AS bigint)"
            each, own = F.explode(F.expr(f"sequence(0L, {blocks} - 1)")).alias("block"), F.expr(f"pmod(xxhash64('block', doc_id), {blocks})").alias("block")
            tasks = who.where(F.col("g") <= SMALL).selectExpr("grp", "0L AS block", "2 AS role", "doc_id")
            tasks = tasks.unionByName(many.where(f"pmod(xxhash64('leader', doc_id), g) < {LEADERS}").select("grp", each, F.lit(0).alias("role"), "doc_id"))
            return step(tasks.unionByName(many.select("grp", own, F.lit(1).alias("role"), "doc_id")))

        def in_parts(who: DataFrame, links: DataFrame) -> DataFrame:
            """grp, doc_id, part, asks: the large components that links leave in parts; all but the largest part ask."""
            known = components(links).selectExpr("id AS doc_id", "component")
            part = step(who.where(F.col("g") > SMALL).join(known, "doc_id", "left").select("grp", "doc_id", F.coalesce("component", "doc_id").alias("part")))
            parts = part.groupBy("grp", "part").agg(F.count(F.lit(1)).alias("n"))
            largest = step(parts.groupBy("grp").agg(F.max(F.struct("n", (-F.col("part")).alias("m"))).alias("x"), F.count(F.lit(1)).alias("parts")).where("parts > 1").selectExpr("grp", "-x.m AS main"))
            return part.join(largest, "grp").select("grp", "doc_id", "part", F.expr("part <> main").alias("asks"))

        who = step(coarse.selectExpr("id AS doc_id", "component AS grp").join(sizes, "grp"))
        first = step(_search(with_texts(by_leaders(who)), sim, described=True))
        links = step(first.where("v IS NOT NULL").select("u", "v").unionByName(equal))
        if not who.where(F.col("g") > SMALL).isEmpty():
            # what is not connected with the largest part of its component may link with all of it
            told = step(first.where("v IS NULL").selectExpr("u AS doc_id", "n", "h", f"floor(ln(n) / {math.log(sim.den / sim.num * 1.0001)}) AS size"))
            open_ = step(in_parts(who, links).join(told.hint("merge"), "doc_id"))
            near = step(_near(_blocks(open_, F.expr(f"cast(ceil(greatest(count(1) / {NEAR_BLOCK}, sum(length(h)) / {NEAR_BYTES})) AS bigint)"), "part", "n", "h"), sim))
            apart = step(components(near).selectExpr("id AS doc_id", "component AS grp"))
            if not apart.isEmpty():
                # smaller components by now: by leaders again, and what these leave in parts in blocks
                who = step(apart.join(apart.groupBy("grp").agg(F.count(F.lit(1)).alias("g")), "grp"))
                links = step(_search(with_texts(by_leaders(who)), sim).select("u", "v").unionByName(links))
                left = step(in_parts(who, links).join(told.drop("h").hint("merge"), "doc_id"))
                if not left.isEmpty():
                    tasks = _blocks(left, F.expr(f"cast(ceil(greatest(count(1) / {OPEN_BLOCK}, sum(n) / {OPEN_TOKENS})) AS bigint)"))
                    links = step(_search(with_texts(step(tasks.distinct())), sim)).select("u", "v").unionByName(links)
    reached = components(links)
    drop(*used)
    out = by(0).selectExpr(f"nullif(a, {NO_ID}) AS doc_id", "c AS n_shingles").join(reached.selectExpr("id AS doc_id", "component"), "doc_id", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def keep_first(docs: DataFrame, sim: Similarity | None = None) -> DataFrame:
    """The rows of docs, all columns, whose doc_id is the smallest of its component (of several such rows, all).

    Texts without words and rows with a null doc_id stay; an empty table gives an empty result. See groups for the rest.
    """
    found = store(groups(docs.select("doc_id", "text"), sim))
    gone = found.where("component_id < doc_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti")
