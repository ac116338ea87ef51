"""Suffix-array dedup with a run-length index.

Which 50-byte strings of a document also start in an earlier one is found in steps that no group of copies inflates:

1. A task assigns each 50-byte window of a text to its minimizer (the least hash among its 20-byte strings). The
   windows of one minimizer form a fragment. Equal windows have equal minimizers, wherever they stand. Minimizers that
   stand in many documents with ever new surroundings (found on a sample; which they are bears on speed alone) route
   each of their windows by its own hash instead, so that no task gets a share of all documents.
2. Fragments meet by the hash of their minimizer, and equal contents are joined to their first document: copies are
   summed up here and before the shuffle, and one of each content goes on. Contents count as equal if two hashes of 48
   bits, of the minimizer and of the whole fragment, are equal; this decides what exact copies lose, without a look at
   their bytes. Among n different fragments some two are taken for equal with odds of about n * n / 2 ** 97: one in
   ten million for 10 ** 11 fragments (some 2 TB of text).
3. Contents that have no window in common with another of their minimizer, by a hash of windows, are left out here.
   Of the others, those that are the first to have a shared window are joined to one text of which a run-compressed
   Burrows-Wheeler transform with sampled run ends is built; those with a window of an earlier document are streamed
   against it (one may be both). Matching statistics of 50 bytes or more are repeats, if the first document that has
   the matched string, known by runs of rows, is an earlier one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, map_arrow, sample_of, steps, store, trim
from .jaccard import _powers, mix

#: Bytes of a repeated string, and of the strings that minimizers are.
LENGTH, SEED_BYTES = 50, 20
#: Bytes of a text that are hashed at once, and fragments that a task holds before it sends them.
PORTION, FLUSH = 1 << 15, 300_000
#: Buckets of minimizers for each shuffle partition.
BUCKETS_PER_PARTITION = 8
#: Bytes of contents that are indexed and streamed together, so that their index stays in a processor's cache; groups
#: stay whole, one that is larger is taken alone.
INDEXED = 1 << 20
#: Documents that are looked at (about) for minimizers with ever new surroundings, and the contents, absolute and as a
#: share of these documents, from which a minimizer counts as one.
HOT_SAMPLE, HOT_LEAST, HOT_SHARE = 8_000, 48, 0.004

_FRAGMENT = np.dtype([("h", "<u8"), ("f", "<u8"), ("doc", "<i8"), ("key", "<i8"), ("lo", "<i8"), ("n", "<i4")])
#: Bytes of each field that are sent, the lowest first; the two hashes keep 48 bits. A fragment has at most
#: LENGTH - SEED_BYTES + 1 windows, so _sizes() says how many bytes their number takes.
_SENT = {"h": 6, "f": 6, "doc": 8, "key": 8, "lo": 6}
_SPAN = np.dtype([("doc", "<i8"), ("key", "<i8"), ("lo", "<i8"), ("n", "<i8")])


def checked(length: int) -> int:
    """A length of repeats that minimizers of SEED_BYTES bytes can find."""
    if length <= SEED_BYTES:
        raise ValueError(f"repeats must be longer than {SEED_BYTES} bytes")
    return length


def _sizes(length: int) -> dict[str, int]:
    return _SENT | {"n": 1 if length - SEED_BYTES + 1 < 256 else 4}


def _portions(ends: np.ndarray, length: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """(start, stop, ends of texts within): whole texts of PORTION bytes together; a longer one in portions of its own,
    cut at the same places wherever it stands."""
    start, i = 0, 0
    while i < len(ends):
        j = int(np.searchsorted(ends, start + PORTION, "right"))
        if j > i:
            yield start, int(ends[j - 1]), ends[i:j] - start
            i = j
        else:
            for at in range(start, int(ends[i]) - length + 1, PORTION):
                stop = min(int(ends[i]), at + PORTION + length - 1)
                yield at, stop, np.array([stop - at])
            i += 1
        start = int(ends[i - 1])


def fragments(raw: np.ndarray, length: int = LENGTH, seed_bytes: int = SEED_BYTES, hot: np.ndarray | None = None, ends: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The fragments of texts' bytes: minimizer hash, content hash, first window (its place in raw), number of windows.

    raw holds the texts one after another; ends says where each ends (default: one text). No window crosses an end.
    A fragment of a minimizer among `hot` (upper 48 bits, sorted) is cut into its windows, each under its own hash.
    """
    width = length - seed_bytes + 1
    kind, bits = (np.uint32, 16) if PORTION + length <= 1 << 16 else (np.uint64, 32)
    low, drop = kind((1 << bits) - 1), np.uint64(64 - 8 * kind().itemsize)
    out = []
    for begin, stop, until in _portions(np.array([len(raw)]) if ends is None else ends, length):
        windows = stop - begin - length + 1
        if windows <= 0:
            continue
        b = raw[begin:stop].astype(np.uint64)
        b += np.uint64(1)
        p, inverse = _powers(len(b) + 1)
        b *= p[: len(b)]
        total = np.zeros(len(b) + 1, np.uint64)
        np.cumsum(b, out=total[1:])
        seeds = total[seed_bytes:] - total[:-seed_bytes]
        seeds *= inverse[: len(seeds)]
        least = (seeds >> drop).astype(kind)  # seeds are ordered by their upper bits
        least &= ~low
        least |= np.arange(len(seeds), dtype=kind)  # of equal seeds in a window, the first
        span = 1
        while span * 2 <= width:
            least = np.minimum(least[:-span], least[span:])
            span *= 2
        if span < width:
            least = np.minimum(least[: len(least) - (width - span)], least[width - span :])
        least &= low
        edge = np.ones(windows, bool)
        np.not_equal(least[1:], least[:-1], out=edge[1:])
        valid = np.ones(windows, bool)
        if len(until) > 1:
            crossing = (until[:-1, None] - np.arange(1, length)).ravel()
            valid[crossing[(crossing >= 0) & (crossing < windows)]] = False
            edge[1:] |= valid[1:] != valid[:-1]
        lo = np.flatnonzero(edge)
        n = np.diff(np.append(lo, windows))
        own = valid[lo]
        lo, n = lo[own], n[own]
        h = mix(seeds[least[lo]])
        if hot is not None and len(hot):
            own = h >> np.uint64(16)
            among = hot[np.minimum(np.searchsorted(hot, own), len(hot) - 1)] == own
            if among.any():
                times = np.where(among, n, 1)
                first = np.cumsum(times) - times
                lo = np.repeat(lo, times) + np.where(np.repeat(among, times), np.arange(int(times.sum())) - np.repeat(first, times), 0)
                n, h, alone = np.repeat(np.where(among, 1, n), times), np.repeat(h, times), np.repeat(among, times)
                h[alone] = mix((total[lo[alone] + length] - total[lo[alone]]) * inverse[lo[alone]] + np.uint64(length))
        end = lo + n + length - 1
        content = mix((total[end] - total[lo]) * inverse[lo] + n.astype(np.uint64))
        out.append((h, content, lo + begin, n))
    if not out:
        return tuple(np.zeros(0, k) for k in (np.uint64, np.uint64, np.int64, np.int64))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of a column's texts, one after another, and where each starts and ends; null is empty."""
    texts = pc.fill_null(texts, "").cast(pa.large_binary())
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    return raw, at[:-1] - at[0], at[1:] - at[0]


def packed(x: np.ndarray, sizes: dict[str, int]) -> bytes:
    """Fragments as bytes, one plane of bytes after another: the high ones are nearly all zero and compress away."""
    return b"".join(np.ascontiguousarray(x[c]).view(np.uint8).reshape(len(x), -1)[:, :k].T.tobytes() for c, k in sizes.items())


def unpacked(blob: bytes, sizes: dict[str, int]) -> np.ndarray:
    n, at = len(blob) // sum(sizes.values()), 0
    x = np.zeros(n, _FRAGMENT)
    for c, k in sizes.items():
        full = np.zeros((n, _FRAGMENT[c].itemsize), np.uint8)
        full[:, :k] = np.frombuffer(blob, np.uint8, n * k, at).reshape(k, n).T
        x[c] = full.view(_FRAGMENT[c]).ravel()
        at += n * k
    return x


def merged(lo: np.ndarray, n: np.ndarray, more: int = 0) -> np.ndarray:
    """Sorted, disjoint (start, end) of the intervals [lo, lo + n + more); touching ones are joined."""
    order = np.argsort(lo, kind="stable")
    s, e = lo[order], np.maximum.accumulate(lo[order] + n[order] + more)
    new = np.concatenate([[True], s[1:] > e[:-1]]) if len(s) else np.zeros(0, bool)
    last = np.append(np.flatnonzero(new)[1:] - 1, len(s) - 1) if len(s) else np.zeros(0, int)
    return np.stack([s[new], e[last]], axis=1)


def _words(x: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one number, the first lowest (along the last axis)."""
    n = x.shape[-1] - 7
    out = x[..., :n].astype(np.uint64)
    for k in range(1, 8):
        out |= x[..., k : k + n].astype(np.uint64) << np.uint64(8 * k)
    return out


def _common(known: np.ndarray, at: np.ndarray, asked: np.ndarray, text: np.ndarray, col: int, most: np.ndarray) -> np.ndarray:
    """How many bytes agree, up to `most`, from known[at] and from column col of the asked texts on; eight at a time."""
    out = most.copy()
    open_ = np.flatnonzero(most > 0)
    step = 0
    while len(open_):
        x = known[at[open_] + step] ^ asked[text[open_], min(col + step, asked.shape[1] - 1)]
        differ = x != 0
        d = x[differ]
        low = np.log2((d & (~d + np.uint64(1))).astype(np.float64)).astype(np.int64) >> 3
        out[open_[differ]] = np.minimum(most[open_[differ]], step + low)
        step += 8
        open_ = open_[~differ]
        open_ = open_[most[open_] > step]
    return out


class RunLengthIndex:
    """A run-compressed Burrows-Wheeler transform of several byte strings, with suffix samples at the ends of runs.

    Besides the strings themselves (as bytes, as words of eight, and with the way to their ends), what is kept has an
    entry per run: of equal symbols of the transform (with samples and the mapping), and of neighbouring rows whose
    first `length` (8 at least) bytes have the same least owner (`least_start`, `least`; rows with fewer bytes left
    belong to no string of that length and break no run). The suffix array is built and let go.
    """

    def __init__(self, texts: list[bytes], owners: np.ndarray, length: int):
        m = len(texts)
        sizes = np.array([len(t) for t in texts], dtype=np.int64)
        starts = np.cumsum(sizes + 1) - (sizes + 1)
        n = int((sizes + 1).sum())
        sym = np.zeros(n, dtype=np.int64)
        ends = starts + sizes
        is_end = np.zeros(n, dtype=bool)
        is_end[ends] = True
        sym[~is_end] = np.frombuffer(b"".join(texts), np.uint8).astype(np.int64) + m
        sym[ends] = np.arange(m)  # every text has an end mark of its own
        self.n, self.m = n, m
        #: Bytes by position, -1 at end marks and past the end.
        self.text = np.where(is_end, -1, sym - m).astype(np.int16)
        # rows that agree with the row before them in their first bytes have one least owner together
        self.room = np.repeat(ends, sizes + 1) - np.arange(n)  # bytes from here to the end of the string
        order = self._suffixes(self.text, self.room)
        before = sym[order - 1]  # position 0 wraps to the last end mark
        change = np.flatnonzero(np.concatenate([[True], before[1:] != before[:-1]]))
        self.run_start, self.run_sym = change, before[change]
        run_len = np.diff(np.append(change, n))
        #: Samples: the text position of the first and of the last row of each run.
        self.first, self.last = order[change], order[change + run_len - 1]
        is_byte = self.run_sym >= m
        marks, bytes_ = np.flatnonzero(~is_byte), np.flatnonzero(is_byte)
        by = np.concatenate([marks[np.argsort(self.run_sym[marks])], bytes_[np.argsort((self.run_sym[bytes_] - m).astype(np.uint8), kind="stable")]])
        lens = run_len[by]
        self.base = np.empty(len(by), dtype=np.int64)
        self.base[by] = np.cumsum(lens) - lens  # where the run's rows go, as smaller symbols and earlier rows come first
        self.run_key = self.run_sym[by] * (len(by) + 1) + by
        self.run_by = by
        self.run_end = change + run_len - 1
        #: The run that the first row of each run is mapped into; its other rows go there or into the next ones.
        self.base_run = np.searchsorted(change, self.base, side="right") - 1
        self.words = _words(np.concatenate([self.text.clip(0).astype(np.uint8), np.zeros(length + 16, np.uint8)]))
        long = self.room[order] >= length
        rows = np.flatnonzero(long)
        left = rows[1:][rows[1:] == rows[:-1] + 1]
        for k in [*range(0, length - 8, 8), length - 8]:
            left = left[self.words[order[left] + k] == self.words[order[left - 1] + k]]
        new = long.copy()
        new[left] = False
        new[0] = True
        at = np.flatnonzero(new)
        least = np.minimum.reduceat(np.where(long, np.repeat(owners, sizes + 1)[order], np.iinfo(np.int64).max), at)
        go = np.concatenate([[True], least[1:] != least[:-1]])
        self.least_start, self.least = at[go], least[go]

    def least_owner(self, rows: np.ndarray) -> np.ndarray:
        """The least owner of the strings of `length` bytes with which these rows begin."""
        return self.least[np.searchsorted(self.least_start, rows, side="right") - 1]

    @staticmethod
    def _suffixes(text: np.ndarray, room: np.ndarray) -> np.ndarray:
        """The suffix array, by doubling: of equal suffixes, which end at end marks, the earlier one comes first.

        A suffix's rank is its row, or the first row of those not told apart yet; only these are sorted again.
        """
        n = len(text)
        used = np.zeros(257, np.int64)
        used[text + 1] = 1
        used[0] = 0
        dense = np.cumsum(used) * used  # end marks 0, the bytes that occur 1 and up
        bits = int(dense.max(initial=0)).bit_length() or 1
        span = 62 // bits  # as many symbols as fit into a word are compared at first
        of, key, ended = dense[text + 1], np.zeros(n, np.int64), np.zeros(n, bool)
        for k in range(min(span, n)):
            key <<= bits
            ended |= room == k
            key[: n - k] |= np.where(ended[: n - k], 0, of[k:])
        order = np.argsort(key)
        k = key[order]
        new = np.concatenate([[True], k[1:] != k[:-1]])
        rank = np.empty(n, np.int64)
        rank[order] = np.flatnonzero(new)[np.cumsum(new) - 1]
        rows = np.flatnonzero(~(new & np.append(new[1:], True)))
        own = order[rows]
        second = np.where(room[own] < span, own, 0)  # those that end within the span are told apart by their place
        while len(rows):
            key = rank[own] * (n + 1) + second
            by = np.argsort(key)
            own, k = own[by], key[by]
            new = np.concatenate([[True], k[1:] != k[:-1]])
            order[rows] = own
            rank[own] = rows[np.flatnonzero(new)[np.cumsum(new) - 1]]
            left = ~(new & np.append(new[1:], True))
            rows, own = rows[left], own[left]
            second = rank[own + span]  # what is left does not end within the span
            span *= 2
        return order

    def matching_statistics(self, texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """For each place from the right, the texts that have it: (text, place, length, row).

        length is that of the longest string at the place that occurs in the index, row a row that begins with it. All
        texts go in step, from right to left: where the row's preceding byte is the one wanted, the row maps on; else
        the nearest runs of that byte above and below are tried and the one that keeps more is taken.
        """
        sizes = np.array([len(t) for t in texts], dtype=np.int64)
        width = int(sizes.max(initial=0))
        p = np.full((len(texts), width), -2, dtype=np.int16)  # flush right
        for i, t in enumerate(texts):
            if t:
                p[i, width - len(t) :] = np.frombuffer(t, np.uint8)
        asked = _words(np.concatenate([p.clip(0).astype(np.uint8), np.zeros((len(texts), 16), np.uint8)], axis=1))
        known = self.words if len(self.words) > self.n + width else np.concatenate([self.words, np.zeros(width, np.uint64)])
        row, length = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
        run_of = np.zeros(len(texts), np.int64)  # the run of each row
        runs = len(self.run_start)
        for col in range(width - 1, -1, -1):
            own = np.flatnonzero(sizes >= width - col)
            c = p[own, col].astype(np.int64) + self.m
            q, keep, run = row[own], length[own], run_of[own]
            miss = np.flatnonzero(self.run_sym[run] != c)
            if len(miss):
                k = np.searchsorted(self.run_key, c[miss] * (runs + 1) + run[miss])
                best = np.full(len(miss), -1, np.int64)
                to_row, to_run = np.zeros(len(miss), np.int64), np.zeros(len(miss), np.int64)
                for cand, rows_of, sample in ((k - 1, self.run_end, self.last), (k, self.run_start, self.first)):
                    ok = (cand >= 0) & (cand < runs)
                    r = self.run_by[np.clip(cand, 0, runs - 1)]
                    ok &= self.run_sym[r] == c[miss]
                    kept = np.minimum(_common(known, sample[r], asked, own[miss], col + 1, keep[miss]), self.room[sample[r]])
                    better = ok & (kept > best)
                    best[better], to_row[better], to_run[better] = kept[better], rows_of[r][better], r[better]
                q[miss], run[miss] = to_row, to_run
                keep[miss] = best  # -1: the byte is nowhere in the index
            lost = keep < 0
            q = np.where(lost, 0, self.base[run] + q - self.run_start[run])
            keep = keep + 1
            run = np.where(lost, 0, self.base_run[run])
            ahead = np.flatnonzero(self.run_end[run] < q)
            for _ in range(3):
                run[ahead] += 1
                ahead = ahead[self.run_end[run[ahead]] < q[ahead]]
            run[ahead] = np.searchsorted(self.run_start, q[ahead], side="right") - 1
            row[own], length[own], run_of[own] = q, keep, run
            yield own, sizes[own] - (width - col), keep, q


def roles(contents: list[bytes], docs: np.ndarray, groups: np.ndarray, length: int = LENGTH) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(known, asked): places of contents that the index must hold, and of those that must be streamed against it.

    Windows are met by a hash. Held are contents of the first document that has some shared window, streamed those with
    a window that stands in an earlier document; what shares no window is neither. Where one hash has different windows
    (bytes are compared), all their contents are both. Groups go together by INDEXED bytes, and stay whole.
    """
    if not len(docs):
        return
    order = np.argsort(groups, kind="stable")
    own = groups[order]
    sizes = np.array([len(c) for c in contents], np.int64)[order]
    first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
    portion = np.repeat(np.cumsum(np.add.reduceat(sizes, first)) // INDEXED, np.diff(np.append(first, len(own))))
    for part in np.split(np.arange(len(order)), np.flatnonzero(np.diff(portion)) + 1):
        some, n = order[part], sizes[part]
        windows = np.maximum(n - length + 1, 0)
        raw = np.frombuffer(b"".join([contents[i] for i in some]), np.uint8)
        p, inverse = _powers(len(raw) + 1)
        total = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * p[: len(raw)], out=total[1:])
        ends = np.cumsum(windows)
        at = np.arange(ends[-1]) + np.repeat(np.cumsum(n) - n - ends + windows, windows)
        if not len(at):
            continue
        of = np.repeat(np.arange(len(some)), windows)
        h = mix((total[at + length] - total[at]) * inverse[at]) + np.repeat(groups[some].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), windows)
        by = np.argsort(h)
        h, of, at = h[by], of[by], at[by]
        doc = docs[some][of]
        new = np.concatenate([[True], h[1:] != h[:-1]])
        start, run = np.flatnonzero(new), np.cumsum(new) - 1
        least, most = np.minimum.reduceat(doc, start), np.maximum.reduceat(doc, start)
        words = _words(np.concatenate([raw, np.zeros(8, np.uint8)]))
        pair = np.flatnonzero(~new & (least < most)[run])
        unlike = np.zeros(len(pair), bool)
        for k in [*range(0, length - 8, 8), length - 8]:
            unlike |= words[at[pair] + k] != words[at[pair - 1] + k]
        mixed = np.zeros(len(start), bool)
        mixed[run[pair[unlike]]] = True
        shared, mixed, least = (least < most)[run], mixed[run], least[run]
        out = []
        for which in (shared & ((doc == least) | mixed), shared & ((doc > least) | mixed)):
            keep = np.zeros(len(some), bool)
            keep[of[which]] = True
            out.append(some[keep])
        yield tuple(out)


def sharing(contents: list[bytes], groups: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """The places of the contents that may have a window in common with another content of their group."""
    both = [x for pair in roles(contents, np.arange(len(contents)), groups, length) for x in pair]
    return np.unique(np.concatenate(both)) if both else np.zeros(0, np.int64)


def repeated_windows(contents: list[bytes], docs: np.ndarray, groups: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs (content, first window, windows) that also occur in a content of a smaller document.

    Only contents of one group have windows in common.
    """
    hits_t, hits_p = [], []
    for known, asked in roles(contents, docs, groups, length):
        if not len(asked):
            continue
        index = RunLengthIndex([contents[i] for i in known], docs[known], length)
        for text, place, n, row in index.matching_statistics([contents[i] for i in asked]):
            hit = np.flatnonzero(n >= length)
            if len(hit):
                hit = hit[index.least_owner(row[hit]) < docs[asked[text[hit]]]]
                hits_t.append(asked[text[hit]])
                hits_p.append(place[hit])
    t, p = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (hits_t, hits_p))
    if len(t):
        order = np.lexsort((p, t))
        t, p = t[order], p[order]
    at = np.flatnonzero(np.concatenate([[True], (t[1:] != t[:-1]) | (p[1:] != p[:-1] + 1)])) if len(t) else np.zeros(0, np.int64)
    return t[at], p[at], np.diff(np.append(at, len(t)))


def _rows(kind: int, spans: np.ndarray, h: np.ndarray | None = None) -> pa.RecordBatch:
    n = len(spans)
    return pa.record_batch(
        [pa.array(np.full(n, kind, np.int32)), *(pa.array(np.ascontiguousarray(spans[k]).astype(np.int64)) for k in ("doc", "key", "lo", "n")), pa.array(np.zeros(n, np.int64) if h is None else np.ascontiguousarray(h).view(np.int64))],
        names=["kind", "doc", "key", "lo", "n", "h"],
    )


def _hot(docs: DataFrame, length: int) -> np.ndarray:
    """Minimizers that have many contents among about HOT_SAMPLE documents (48 bits of their hashes, sorted).

    The driver gets at most 1 / HOT_SHARE minimizers for each fragment of a mean text.
    """
    total = docs.select("doc_id").agg(F.count("doc_id").alias("n")).collect()[0]["n"]
    some = docs.where(sample_of(F.col("doc_id"), total, HOT_SAMPLE, "hot"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in steps(batches, "text"):
            raw, _, ends = _bytes_of(b.column(0))
            pairs = np.unique(np.stack([x >> np.uint64(16) for x in fragments(raw, length, ends=ends)[:2]]), axis=1)
            yield pa.record_batch({"h": pa.array(pairs[0].view(np.int64)), "f": pa.array(pairs[1].view(np.int64))})

    least = max(HOT_LEAST, int(HOT_SHARE * min(total, HOT_SAMPLE)))
    many = map_arrow(some, run, "h bigint, f bigint", "text").groupBy("h").agg(F.count_distinct("f").alias("n")).where(F.col("n") >= least)
    return np.sort(np.array([r["h"] for r in many.select("h").collect()], dtype=np.int64).astype(np.uint64))


def _first_docs(x: np.ndarray) -> np.ndarray:
    """For each fragment, the least document among those here with its content (both hashes)."""
    h, f, doc = (np.ascontiguousarray(x[k]) for k in ("h", "f", "doc"))
    order = np.argsort(h << np.uint64(16) ^ f)  # equal contents come together; unlike ones may stand between them, which leaves them to step 2
    h, f = h[order], f[order]
    new = np.concatenate([[True], (h[1:] != h[:-1]) | (f[1:] != f[:-1])])
    at = np.flatnonzero(new)
    least = np.empty(len(x), np.int64)
    least[order] = np.minimum.reduceat(doc[order], at)[np.cumsum(new) - 1]
    return least


def _sent(docs: DataFrame, buckets: int, length: int, hot: np.ndarray) -> DataFrame:
    """Step 1: rows (bucket, payload). A bucket of -1 or less holds spans that are known to be repeated already."""
    sizes = _sizes(length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        total = 0

        def flush() -> Iterator[pa.RecordBatch]:
            x = np.concatenate(held) if held else np.zeros(0, _FRAGMENT)
            held.clear()
            if not len(x):
                return
            least = _first_docs(x)
            later = x["doc"] > least  # the same content stands in an earlier document of this task
            ids, blobs = [], []
            if later.any():
                y = x[later]
                s = np.zeros(len(y), _SPAN)
                for k in ("doc", "key", "lo", "n"):
                    s[k] = y[k]
                # neighbouring fragments of a text become one span
                go = np.concatenate([[True], (s["doc"][1:] != s["doc"][:-1]) | (s["key"][1:] != s["key"][:-1]) | (s["lo"][1:] != s["lo"][:-1] + s["n"][:-1])])
                at = np.flatnonzero(go)
                sums = np.add.reduceat(s["n"], at)
                s = s[at]
                s["n"] = sums
                for k in range(0, len(s), 20_000):
                    ids.append(-1 - (int(s["key"][k]) + int(s["lo"][k])) % buckets)
                    blobs.append(s[k : k + 20_000].tobytes())
            x = x[~later]
            b = (x["h"] % np.uint64(buckets)).astype(np.min_scalar_type(buckets))
            order = np.argsort(b, kind="stable")
            own, cut = np.unique(b[order], return_index=True)
            for k, part in zip(own.tolist(), np.split(x[order], cut[1:]), strict=True):
                ids.append(k)
                blobs.append(packed(part, sizes))
            for k in range(0, len(ids), 256):
                yield pa.record_batch({"bucket": pa.array(ids[k : k + 256], pa.int64()), "payload": pa.array(blobs[k : k + 256], pa.binary())})

        for batch in steps(batches, "text"):
            raw, starts, ends = _bytes_of(batch.column(2))
            h, f, lo, n = fragments(raw, length, hot=hot, ends=ends)
            of = np.searchsorted(ends, lo, "right")
            x = np.zeros(len(h), _FRAGMENT)
            x["h"], x["f"], x["lo"], x["n"] = h >> np.uint64(16), f >> np.uint64(16), lo - starts[of], n
            x["doc"], x["key"] = (batch.column(k).to_numpy()[of] for k in (0, 1))
            held.append(x)
            total += len(x)
            if total >= FLUSH:
                yield from flush()
                total = 0
                trim()
        yield from flush()
        trim()

    return docs.where("doc_id IS NOT NULL").select("doc_id", "key", "text").mapInArrow(run, "bucket bigint, payload binary")


def _by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple]]]:
    """The rows of each bucket (first column), which stand together."""
    at, rows = None, []
    for b in batches:
        for r in zip(*(b.column(k).to_pylist() for k in range(b.num_columns)), strict=True):
            if r[0] != at and rows:
                yield at, rows
                rows = []
            at = r[0]
            rows.append(r)
    if rows:
        yield at, rows


def _met(length: int):
    """Step 2: spans that are repeated (kind 0), and fragments that the index must compare (kind 1, with h)."""
    sizes = _sizes(length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _meet(batches, sizes)
        trim()

    return run


def _meet(batches: Iterator[pa.RecordBatch], sizes: dict[str, int]) -> Iterator[pa.RecordBatch]:
    for bucket, rows in _by_bucket(batches):
        if bucket < 0:
            for _, blob in rows:
                yield _rows(0, np.frombuffer(blob, _SPAN))
            continue
        x = np.concatenate([unpacked(blob, sizes) for _, blob in rows])
        rows.clear()
        # only minimizers that stand in two documents matter
        h, doc = np.ascontiguousarray(x["h"]), np.ascontiguousarray(x["doc"])
        order = np.argsort(h)
        h, doc = h[order], doc[order]
        new = np.concatenate([[True], h[1:] != h[:-1]])
        at = np.flatnonzero(new)
        low, high = np.minimum.reduceat(doc, at), np.maximum.reduceat(doc, at)
        x = x[order][(low < high)[np.cumsum(new) - 1]]
        if not len(x):
            continue
        x = x[np.lexsort((x["doc"], x["f"], x["h"]))]
        new_h = np.concatenate([[True], x["h"][1:] != x["h"][:-1]])
        new_f = new_h | np.concatenate([[True], x["f"][1:] != x["f"][:-1]])
        least = x["doc"][new_f][np.cumsum(new_f) - 1]
        contents = np.add.reduceat(new_f.astype(np.int64), np.flatnonzero(new_h))[np.cumsum(new_h) - 1]
        later = x["doc"] > least
        if later.any():
            yield _rows(0, x[later])
        rest = x[~later & (contents > 1)]
        if len(rest):
            yield _rows(1, rest, rest["h"])


def _cut_out(length: int, buckets: int):
    """Fetch the contents of the fragments that must be compared: (bucket, h, doc, key, lo, content)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in steps(batches, "text", 1_000_000):
            cols: list[list] = [[] for _ in range(6)]
            for d, key, t, own in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
                raw = (t or "").encode("utf-8", "surrogatepass")
                for x in own:
                    for c, v in zip(cols, (x["h"] % buckets, x["h"], d, key, x["lo"], raw[x["lo"] : x["lo"] + x["n"] + length - 1]), strict=True):
                        c.append(v)
            for k in range(0, len(cols[0]), 50_000):
                yield pa.record_batch([pa.array(c[k : k + 50_000], kind) for c, kind in zip(cols, (pa.int64(),) * 5 + (pa.binary(),), strict=True)], names=["bucket", "h", "doc", "key", "lo", "content"])
        trim()

    return run


def _indexed(length: int):
    """Step 3: build a bucket's indexes, stream its fragments, and return their repeated spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _by_bucket(batches):
            groups, docs = (np.array([r[k] for r in rows], dtype=np.int64) for k in (1, 2))
            t, p, n = repeated_windows([r[5] for r in rows], docs, groups, length)
            if len(t):
                out = np.zeros(len(t), _SPAN)
                key, lo = (np.array([r[k] for r in rows], dtype=np.int64) for k in (3, 4))
                out["doc"], out["key"], out["lo"], out["n"] = docs[t], key[t], lo[t] + p, n
                yield _rows(0, out)
            trim()

    return run


_SPANS = "kind int, doc bigint, key bigint, lo bigint, n bigint, h bigint"


def with_spans(docs: DataFrame, columns: list[str], length: int = LENGTH, name: str = "spans") -> DataFrame:
    """The columns of docs and (as `name`) spans: (lo, n) runs of windows of `length` bytes that also start in a smaller doc_id.

    Null where there are none. docs must have doc_id (a whole number) and text; a null doc_id has no order: such rows
    neither get spans nor give them to others. Rows that repeat a doc_id do not match each other; each gets its own
    spans (a hash of the text tells them apart). Texts of any length are whole; an empty table gives no rows. Steps are
    written to the shared folder. Buckets follow the session's shuffle partitions.
    """
    checked(length)
    buckets = BUCKETS_PER_PARTITION * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("key"), "text")
    sent = _sent(keyed, buckets, length, _hot(keyed, length)).repartition("bucket").sortWithinPartitions("bucket")
    met = store(sent.mapInArrow(_met(length), _SPANS))
    parts = buckets // BUCKETS_PER_PARTITION
    todo = met.where("kind = 1").groupBy("doc", "key").agg(F.collect_list(F.struct("lo", "n", "h")).alias("own"))
    # lists of spans and fragments grow with the data, so they are not broadcast, however few they may be
    found = keyed.join(todo.withColumnRenamed("key", "_k").hint("merge"), (F.col("doc_id") == F.col("doc")) & (F.col("key") == F.col("_k"))).select("doc_id", "key", "text", "own")
    cut = found.mapInArrow(_cut_out(length, parts), "bucket bigint, h bigint, doc bigint, key bigint, lo bigint, content binary")
    more = store(cut.repartitionById(parts, F.col("bucket").cast("int")).mapInArrow(_indexed(length), _SPANS))
    doc, key, of_doc, of_key = (fresh(columns, x) for x in ("_doc", "_key", "_of_doc", "_of_key"))
    spans = met.where("kind = 0").unionByName(more).groupBy(F.col("doc").alias(of_doc), F.col("key").alias(of_key)).agg(F.collect_list(F.struct("lo", "n")).alias(name))
    full = docs.select(*(F.col(f"`{c}`") for c in columns), F.col("doc_id").cast("bigint").alias(doc), F.xxhash64("text").alias(key))
    out = full.join(spans.hint("merge"), (F.col(doc) == F.col(of_doc)) & (F.col(key) == F.col(of_key)), "left")
    return out.select(*(F.col(f"`{c}`") for c in columns), name)


def _removed(spans: list[dict] | None, length: int) -> np.ndarray:
    if not spans:
        return np.zeros((0, 2), np.int64)
    x = np.array([(s["lo"], s["n"]) for s in spans], dtype=np.int64)
    return merged(x[:, 0], x[:, 1], length - 1)


def remaining(raw: bytes, cuts: np.ndarray) -> bytes:
    at, out = 0, []
    for s, e in cuts.tolist():
        out.append(raw[at:s])
        at = e
    out.append(raw[at:])
    return b"".join(out)


def dedup_digests(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for each row of docs.

    Every byte is removed that a string of `length` bytes covers which also starts in a document with a smaller doc_id.
    A null text is empty; shorter texts never match; other columns are ignored. See with_spans for nulls and repeats.
    `length` must be above SEED_BYTES.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in steps(batches, "text"):
            out = []
            for d, t, spans in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                raw, cuts = (t or "").encode("utf-8", "surrogatepass"), _removed(spans, length)
                out.append((d, len(raw), int((cuts[:, 1] - cuts[:, 0]).sum()), len(cuts), hashlib.sha256(remaining(raw, cuts)).hexdigest()))
            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out, strict=True), (b.schema.field(0).type, pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    kind = dict(docs.dtypes)["doc_id"]
    return with_spans(docs, ["doc_id", "text"], length).mapInArrow(run, f"doc_id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")


def dedup_texts(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """docs with the repeated bytes taken out of its texts. Characters that a cut would split stay whole.

    All columns stay, whatever their names; a null text stays null; an empty table gives an empty result. See
    with_spans for nulls and repeats.
    """
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in steps(batches, "text"):
            i = b.schema.get_field_index("text")
            out = []
            for t, spans in zip(b.column(i).to_pylist(), b.column(b.num_columns - 1).to_pylist(), strict=True):
                if t is not None and spans:
                    raw = t.encode("utf-8", "surrogatepass")
                    cuts = _removed(spans, length)
                    for c in cuts:  # shrink to whole characters
                        while c[0] < c[1] and c[0] < len(raw) and raw[c[0]] & 0xC0 == 0x80:
                            c[0] += 1
                        while c[1] > c[0] and c[1] < len(raw) and raw[c[1]] & 0xC0 == 0x80:
                            c[1] -= 1
                    t = remaining(raw, cuts).decode("utf-8", "surrogatepass")
                out.append(t)
            cols = [pa.array(out, pa.string()) if k == i else b.column(k) for k in range(b.num_columns - 1)]
            yield pa.record_batch(cols, names=schema.names)
        trim()

    return with_spans(docs, docs.columns, length, fresh(docs.columns, "_spans")).mapInArrow(run, schema)
