"""Pluggable inference: a batch function over Arrow batches, with results and rejects apart, and resume by key."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from concurrent.futures import FIRST_COMPLETED, Future, ThreadPoolExecutor, wait
from dataclasses import dataclass

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Pace:
    """How a task asks: prompts per call, calls in flight (rising to `most` while the throughput does not fall), and how
    often a call that fails is tried again, waiting `wait` seconds, then twice as long each time, `longest` at most."""

    batch: int = 64
    start: int = 1
    most: int = 4
    step: int = 1
    attempts: int = 1
    wait: float = 0.5
    longest: float = 30.0


def _answer(model: Callable[[list[str]], list[str]], prompts: list[str], pace: Pace) -> tuple[list[str | None], list[str | None]]:
    """Responses and errors of one call; one that fails for good is split into its prompts, each tried as often."""
    error = None
    for attempt in range(pace.attempts):
        if attempt:
            time.sleep(min(pace.longest, pace.wait * 2 ** (attempt - 1)))
        try:
            out = list(model(prompts))
            if len(out) != len(prompts):
                raise ValueError("as many responses as prompts are needed")
            return out, [None] * len(out)
        except Exception as e:
            error = str(e)
    if len(prompts) == 1:
        return [None], [error]
    each = [_answer(model, [p], pace) for p in prompts]
    return [x for r, _ in each for x in r], [x for _, e in each for x in e]


def in_flight(calls: Iterator[tuple], ask: Callable[[tuple], tuple], pace: Pace, clock: Callable[[], float] = time.monotonic) -> Iterator[tuple]:
    """ask(call) of all calls, as they come back; as many at a time as the pace allows.

    After as many calls as were allowed, their throughput is compared with that of the ones before: `step` more are
    allowed if it did not fall, else as many fewer (one at least).
    """
    allowed, before, done, began = max(1, min(pace.start, pace.most)), 0.0, 0, clock()
    with ThreadPoolExecutor(max(1, pace.most)) as pool:
        waiting: set[Future] = set()
        calls = iter(calls)
        while True:
            while len(waiting) < allowed and (call := next(calls, None)) is not None:
                waiting.add(pool.submit(ask, call))
            if not waiting:
                return
            ready, waiting = wait(waiting, return_when=FIRST_COMPLETED)
            for f in ready:
                yield f.result()
            done += len(ready)
            if done >= allowed:
                now = done / max(1e-9, clock() - began)
                allowed = min(pace.most, allowed + pace.step) if now >= before else max(1, allowed - pace.step)
                before, done, began = now, 0, clock()


def call_model(requests: DataFrame, key: str, prompt: str, model: Callable[[list[str]], list[str]], pace: Pace | int = 64, done: DataFrame | None = None) -> DataFrame:
    """(key, response, error) for requests not in `done`. What still fails after all attempts has an error.

    Each task keeps several calls in flight (see Pace; a number is the prompts per call); rows come in the order in
    which calls come back.
    """
    pace = pace if isinstance(pace, Pace) else Pace(batch=pace)
    if done is not None:
        requests = requests.join(done.select(key), key, "left_anti")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        calls = (b.slice(at, pace.batch) for b in batches for at in range(0, b.num_rows, pace.batch))

        def ask(part: pa.RecordBatch) -> tuple:
            return part.column(0), *_answer(model, part.column(1).to_pylist(), pace)

        for keys, out, err in in_flight(calls, ask, pace):
            yield pa.record_batch({key: keys, "response": pa.array(out, pa.string()), "error": pa.array(err, pa.string())})

    return requests.select(key, prompt).mapInArrow(run, f"{key} {dict(requests.dtypes)[key]}, response string, error string")


def call_until_answered(requests: DataFrame, key: str, prompt: str, model: Callable[[list[str]], list[str]], path: str, rounds: int = 3, slices: int = 8, pace: Pace | int = 64) -> DataFrame:
    """(key, response, error) of all requests, from a results table at `path` that is read first and added to.

    What the table has a response for is not asked again, whoever asked it. Each round asks for the rest, slice by slice
    of the keys, and writes a slice's results as a partition of their own (round=…/slice=…) as soon as it is done: a run
    that is killed loses one slice, and the next run repeats none that was stored. After the last round, keys without
    a response have the error of their last attempt.
    """
    spark, kind = requests.sparkSession, f"{key} {dict(requests.dtypes)[key]}, response string, error string, round int, slice int"

    def stored() -> DataFrame:
        try:
            return spark.read.schema(kind).parquet(path)
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return spark.createDataFrame([], kind)

    first = 1 + (stored().agg(F.max("round").alias("n")).collect()[0]["n"] or 0)
    own = requests.select(key, prompt).dropDuplicates([key])
    for number in range(first, first + rounds):
        open_ = own.join(stored().where("error IS NULL").select(key), key, "left_anti").withColumn("_slice", F.pmod(F.xxhash64(key), F.lit(slices)))
        todo = sorted(r["_slice"] for r in open_.select("_slice").distinct().collect())
        for k in todo:
            call_model(open_.where(F.col("_slice") == k), key, prompt, model, pace).write.mode("overwrite").parquet(f"{path}/round={number}/slice={k}")
        if not todo:
            break
    last = stored().groupBy(key).agg(F.max_by(F.struct("response", "error"), F.struct(F.col("error").isNull(), F.col("round"))).alias("x"))
    return own.select(key).join(last.select(key, "x.*"), key)


def embed(rows: DataFrame, key: str, text: str, encoder: Callable[[list[str]], list[list[float]]], batch: int = 64) -> DataFrame:
    """(key, vector array<float>): texts through an encoder, batch by batch; a null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, batch):
                part = b.slice(at, batch)
                yield pa.record_batch({key: part.column(0), "vector": pa.array(encoder([x or "" for x in part.column(1).to_pylist()]), pa.list_(pa.float32()))})

    return rows.select(key, text).mapInArrow(run, f"{key} {dict(rows.dtypes)[key]}, vector array<float>")


def parse_responses(responses: DataFrame, schema: str, column: str = "response") -> tuple[DataFrame, DataFrame]:
    """(parsed, rejects): responses whose first JSON block fits the schema, and the others."""
    from ..functions.texts import robust_json_column

    r = responses.withColumn("parsed", F.from_json(robust_json_column(column), schema))
    return r.where("parsed IS NOT NULL"), r.where("parsed IS NULL").drop("parsed")
