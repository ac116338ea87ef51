"""WARC archives of pages, and the index of their captures in one global order.

Archives are Spark's text files whose line separator is the end of a WARC record, so that any file system of Spark's
takes them and Spark splits them at records when they are read. Reading gives capture runs that are sorted locally, one
task's captures at a time; an external merge puts them in one order: runs are dealt out by ranges of the index key,
and a loser tree merges the slices of all runs in each range.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_arrow, store

#: Fixed values of the format.
VERSION, BREAK = "WARC/1.1", "\r\n"
END = BREAK * 2
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Archives are cut at version lines when they are read. No part of one begins another, so that finding them needs no
#: going back; nothing else in an archive may look like one.
SEPARATOR = VERSION + BREAK
#: A version, up to what its two halves are cut by in a payload, and one that ends a header's value.
_HALVES = r"(?<=WARC/)(?=1\.1(?:\r\n|\z))"
_LAST = r"WARC/1\.1 *\z"
#: Payloads from this many bytes on are stored once.
LEAST_BYTES = 100
#: Captures of a local run, and about how many captures a merge task gets.
RUN_ROWS, MERGE_ROWS = 50_000, 100_000
#: Payloads that more rows have than this, and more than a 10,000th of all rows, are looked up by broadcast: 10,000 at most.
HOT_ROWS, HOT_SHARE = 1_000, 10_000

INDEX = "url_key string, captured string, page_id string, record_type string, refers_to string, payload_bytes bigint, payload_digest string, archive string"


def payload(pages: DataFrame) -> dict[str, Column]:
    html = F.coalesce(F.col("html"), F.lit(""))
    return {"payload": html, "payload_bytes": F.octet_length(html).cast("bigint"), "payload_digest": F.sha2(html.cast("binary"), 256)}


def with_first(pages: DataFrame) -> DataFrame:
    """page_id, url, captured, payload, payload_bytes, payload_digest, and first: the page a revisit refers to, else null.

    Of the rows with equal payloads of LEAST_BYTES or more, those with the smallest page_id are responses (more than
    one only if the page_id itself repeats), and so is a null page_id among nulls only; the others revisit it.
    """
    rows = pages.select("page_id", "url", "captured", *(c.alias(k) for k, c in payload(pages).items()))
    large = F.col("payload_bytes") >= LEAST_BYTES
    counts = rows.where(large).groupBy("payload_digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
    firsts = store(counts.where("n > 1"))
    total = firsts.agg(F.sum("n").alias("n")).collect()[0]["n"] or 0
    most = max(HOT_ROWS, total // HOT_SHARE)
    # fewer than HOT_SHARE digests can have more rows than that share
    hot = F.broadcast(firsts.where(F.col("n") > most).select("payload_digest", F.col("first").alias("hot")))
    # rows that need no look-up get keys of their own, so that they do not meet in one task
    own = F.concat(F.lit("-"), F.xxhash64("page_id", "url").cast("string"))
    rows = rows.join(hot, "payload_digest", "left").withColumn("key", F.when(large & F.col("hot").isNull(), F.col("payload_digest")).otherwise(own))
    cold = firsts.where(F.col("n") <= most).select(F.col("payload_digest").alias("key"), F.col("first").alias("cold"))
    out = rows.join(cold, "key", "left").withColumn("first", F.coalesce("hot", "cold"))
    return out.withColumn("first", F.when(~F.col("first").eqNullSafe(F.col("page_id")), F.col("first"))).drop("hot", "cold", "key")


def uri(x: Column) -> Column:
    """A value that stays on one header line; one that would end like a version line gets a blank that value_of takes off."""
    line = F.replace(F.replace(x.cast("string"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    return F.when(F.regexp_like(line, F.lit(_LAST)), F.concat(line, F.lit(" "))).otherwise(line)


def value_of(x: str) -> str:
    return x[:-1] if re.search(r"WARC/1\.1 +\Z", x) else x


def lines(*fields: Column) -> Column:
    """Header fields, each on a line; null ones are left out."""
    return F.concat(*(F.coalesce(F.concat(f, F.lit(BREAK)), F.lit("")) for f in fields))


def field(name: str, value: Column | str) -> Column:
    return F.concat(F.lit(f"{name}: "), F.lit(value) if isinstance(value, str) else value)


def chunked(x: Column) -> Column:
    """HTTP's chunked coding, with cuts inside every string that looks like a version line, or would with a line break after it."""
    parts = F.split(x, _HALVES)
    coded = F.transform(parts, lambda p: F.concat(F.lower(F.hex(F.octet_length(p))), F.lit(BREAK), p, F.lit(BREAK)))
    return F.concat(F.array_join(coded, ""), F.lit("0" + END))


def record(row: DataFrame) -> Column:
    """A row of with_first as a WARC record without its end: a response, or a revisit with the HTTP header alone."""
    revisit = F.col("first").isNotNull()
    ends = F.contains("payload", F.lit(SEPARATOR)) | F.endswith("payload", F.lit(VERSION))
    http = lines(
        F.lit("HTTP/1.1 200 OK"),
        F.lit("Content-Type: text/html; charset=utf-8"),
        F.when(ends & ~revisit, F.lit("Transfer-Encoding: chunked")),
        F.when(~ends | revisit, field("Content-Length", F.col("payload_bytes").cast("string"))),
    )
    body = F.when(revisit, F.lit("")).when(ends, chunked(F.col("payload"))).otherwise(F.col("payload"))
    block = F.concat(http, F.lit(BREAK), body)
    named = lambda x: F.concat(F.lit("<urn:page:"), F.coalesce(uri(x), F.lit("")), F.lit(">"))
    head = lines(
        F.lit(VERSION),
        field("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        field("WARC-Record-ID", named(F.col("page_id"))),
        field("WARC-Date", uri(F.coalesce("captured", F.lit("")))),
        field("WARC-Target-URI", uri(F.col("url"))),
        field("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("payload_digest"))),
        F.when(revisit, field("WARC-Refers-To", named(F.col("first")))),
        F.when(revisit, field("WARC-Profile", PROFILE)),
        field("Content-Type", "application/http; msgtype=response"),
    )
    return F.concat(head, field("Content-Length", F.octet_length(block).cast("string")), F.lit(END), block)


def write_archives(pages: DataFrame, path: str) -> None:
    """A WARC record for each row of pages (page_id, url, html, captured), in files of the folder `path`.

    captured is the text of WARC-Date. A null html is an empty payload, a null url leaves its header out; repeated
    rows have a record each; payloads of any length are whole; an empty table writes no record. Other columns are
    ignored. Payloads travel at most once, in the join that finds what a revisit refers to.
    """
    rows = with_first(pages)
    rows.select(record(rows).alias("value")).write.option("lineSep", END).text(path)


def dechunked(body: bytes) -> bytes:
    out, at = [], 0
    while True:
        stop = body.index(b"\r\n", at)
        n = int(body[at:stop], 16)
        if not n:
            return b"".join(out)
        out.append(body[stop + 2 : stop + 2 + n])
        at = stop + 4 + n


@dataclass
class Record:
    fields: dict[str, str]
    http: dict[str, str]
    payload: bytes

    @property
    def kind(self) -> str:
        return self.fields["WARC-Type"]

    @property
    def digest(self) -> str:
        return self.fields["WARC-Payload-Digest"].removeprefix("sha256:")


def _fields(head: bytes) -> dict[str, str]:
    return {k: value_of(v) for k, _, v in (x.partition(": ") for x in head.decode("utf-8", "replace").split(BREAK))}


def parse(data: bytes) -> Record:
    """A record from the bytes between two version lines."""
    head, _, rest = data.partition(END.encode())
    fields = _fields(head)
    size = int(fields["Content-Length"])
    if rest[size:] != END.encode():
        raise ValueError(f"{fields['WARC-Record-ID']} does not end where it says")
    top, _, body = rest[:size].partition(END.encode())
    http = _fields(top)
    out = Record(fields, http, dechunked(body) if http.get("Transfer-Encoding") == "chunked" else body)
    if out.kind == "response" and hashlib.sha256(out.payload).hexdigest() != out.digest:
        raise ValueError(f"{fields['WARC-Record-ID']} has another payload than its digest says")
    return out


def page_of(name: str | None) -> str | None:
    """The page id in a record's name; none if it is empty."""
    return None if name is None else name[len("<urn:page:") : -1] or None


def url_key(url: str | None) -> str:
    """The host's labels from the last to the first, then the rest, A-Z lower-cased: captures of a site lie together."""
    m = re.match(r"[^:/?#]+://([^/?#]*)(.*)", url or "", re.S)
    key = f"{','.join(reversed(m[1].split('.')))}){m[2]}" if m else url or ""
    return "".join(c.lower() if c.isascii() else c for c in key)


def capture(data: bytes, archive: str) -> tuple:
    r = parse(data)
    size = len(r.payload) if r.kind == "response" else int(r.http["Content-Length"])
    return url_key(r.fields.get("WARC-Target-URI")), r.fields["WARC-Date"], page_of(r.fields["WARC-Record-ID"]), r.kind, page_of(r.fields.get("WARC-Refers-To")), size, r.digest, archive


def capture_runs(spark: SparkSession, path: str) -> DataFrame:
    """INDEX and run, at: the captures of all archives, in runs of up to RUN_ROWS that are sorted by index key.

    A run holds what one task has read; a task keeps one run in memory, without payloads.
    """
    files = spark.read.option("lineSep", SEPARATOR).text(path).where("value <> ''")  # a file begins with a version line
    kinds = (pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64())
    names = [x.split()[0] for x in INDEX.split(", ")] + ["run", "at"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, n, held = TaskContext.get().partitionId(), 0, []

        def done() -> pa.RecordBatch:
            held.sort(key=lambda x: (x[0], x[1], x[2] or ""))
            columns = [*zip(*held, strict=True), [(task << 32) + n] * len(held), range(len(held))]
            out = pa.record_batch([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], names=names)
            held.clear()
            return out

        for b in batches:
            for data, archive in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                held.append(capture(data.as_py(), archive))
                if len(held) >= RUN_ROWS:
                    yield done()
                    n += 1
        if held:
            yield done()

    rows = files.select(F.col("value").cast("binary").alias("value"), F.element_at(F.split("_metadata.file_path", "/"), -1).alias("archive"))
    return map_arrow(rows, run, f"{INDEX}, run bigint, at bigint", "value", "archive")


class LoserTree:
    """Merges sorted sequences of unique keys: inner nodes hold the loser of their match, and the winner is on top.

    Taking a key replays the matches on one path, log2 of the number of sequences.
    """

    def __init__(self, runs: Iterable[Iterable[tuple]]):
        self.runs = [iter(r) for r in runs]
        self.heads = [next(r, None) for r in self.runs]
        self.nodes = [-1] * max(1, len(self.runs))
        self.matches = 0
        for i in range(len(self.runs)):
            self._play(i)

    def _play(self, i: int) -> None:
        node = (i + len(self.runs)) // 2
        while node:
            j = self.nodes[node]
            if j < 0:  # the first to come waits for its match
                self.nodes[node] = i
                return
            self.matches += 1
            a, b = self.heads[i], self.heads[j]
            if b is not None and (a is None or b < a):
                self.nodes[node], i = i, j
            node //= 2
        self.nodes[0] = i

    def __iter__(self) -> Iterator[tuple]:
        while (i := self.nodes[0]) >= 0 and (head := self.heads[i]) is not None:
            yield head
            self.heads[i] = next(self.runs[i], None)
            self._play(i)


def merged(runs: DataFrame, ranges: int | None = None) -> DataFrame:
    """INDEX in one order by url_key, captured and page_id: partitions ascend, and so do the rows in each.

    runs must be stored (capture_runs), since their ranges are drawn from them first. A range is a part of the whole
    key, run and place included, so a url with any share of the captures spreads over many; each range has about
    MERGE_ROWS captures, which its task holds as one Arrow table while the tree merges their keys.
    """
    if ranges is None:
        ranges = -(-runs.count() // MERGE_ROWS) or 1
    keys = ["url_key", "captured", "page_id"]

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = pa.Table.from_batches(list(batches), schema=None) if (batches := [b for b in batches if b.num_rows]) else None
        if held is None:
            return
        columns = [held.column(k).to_pylist() for k in keys]
        slices: dict[int, list[tuple]] = {}
        for i, (run, *key) in enumerate(zip(held.column("run").to_pylist(), *columns, strict=True)):
            slices.setdefault(run, []).append((key[0], key[1], key[2] or "", i))
        order = pa.array([key[3] for key in LoserTree(slices.values())], pa.int64())
        yield from held.drop_columns(["run", "at"]).take(order).combine_chunks().to_batches(max_chunksize=10_000)

    dealt = runs.repartitionByRange(ranges, *keys, "run", "at").sortWithinPartitions("run", "at")
    return map_arrow(dealt, merge, INDEX, *dealt.columns)


def capture_index(spark: SparkSession, path: str) -> DataFrame:
    """The captures of all archives in a folder, read back and checked against their digests, in one global order."""
    return merged(store(capture_runs(spark, path)))
