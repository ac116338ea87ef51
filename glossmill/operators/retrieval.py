"""Nearest neighbours by exact distances, and pooled embeddings."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a block of queries and of a block of the gallery, of which a task multiplies one pair at a time.
QUERY_BLOCK, GALLERY_BLOCK = 2_000, 20_000


def knn(queries: DataFrame, gallery: DataFrame, k: int, exclude_same: bool = True) -> DataFrame:
    """(q, g, distance, rank): the k nearest rows of the gallery for each query, by exact L2.

    Both have id (a whole number) and vector array<float>; with exclude_same a row is no neighbour of its own id. Ties
    (equal to six digits) go to the smaller id. Null ids and null vectors are left out. Each pair of blocks is one
    matrix product whose k best per query go on; blocks follow the numbers of rows, and neither side is collected or
    broadcast.
    """
    q = queries.where("id IS NOT NULL AND vector IS NOT NULL").select(F.col("id").cast("bigint").alias("id"), "vector")
    g = gallery.where("id IS NOT NULL AND vector IS NOT NULL").select(F.col("id").cast("bigint").alias("id"), "vector")
    nq, ng = (max(1, -(-df.count() // n)) for df, n in ((q, QUERY_BLOCK), (g, GALLERY_BLOCK)))
    block = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = q.select(block(nq).alias("qb"), "id", "vector").select("qb", every(ng).alias("gb"), "id", "vector")
    right = g.select(block(ng).alias("gb"), "id", "vector").select(every(nq).alias("qb"), "gb", "id", "vector")

    def matrix(t: pa.Table) -> np.ndarray:
        v = t.column("vector").combine_chunks()
        return np.asarray(v.flatten(), dtype=np.float64).reshape(len(v), -1) if len(v) else np.zeros((0, 0))

    def best(both: pa.Table) -> pa.Table:
        own, rows = both.filter(both.column("asks")), both.filter(pc.invert(both.column("asks")))
        out: list[list] = [[], [], []]
        if own.num_rows and rows.num_rows:
            a, b = matrix(own), matrix(rows)
            ids, norms = rows.column("id").to_numpy(), (b * b).sum(axis=1)
            for i, x in enumerate(own.column("id").to_pylist()):
                d = norms - 2 * (b @ a[i]) + a[i] @ a[i]
                if exclude_same:
                    d[ids == x] = np.inf
                near = np.argpartition(d, k)[: k + 1] if len(d) > k + 1 else np.arange(len(d))
                near = np.flatnonzero(np.round(d, 6) <= np.round(d[near].max(), 6)) if len(near) else near
                near = near[np.isfinite(d[near])]
                near = near[np.lexsort((ids[near], np.round(d[near], 6)))][:k]
                exact = ((b[near] - a[i]) ** 2).sum(axis=1)
                out[0] += [x] * len(near)
                out[1] += ids[near].tolist()
                out[2] += exact.tolist()
        return pa.table([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.float64()), strict=True)], names=["q", "g", "distance"])

    both = left.withColumn("asks", F.lit(True)).unionByName(right.withColumn("asks", F.lit(False)))
    found = both.groupBy("qb", "gb").applyInArrow(best, "q bigint, g bigint, distance double")
    w = Window.partitionBy("q").orderBy(F.round("distance", 6), "g")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def vote(neighbours: DataFrame, labels: DataFrame) -> DataFrame:
    """(q, label, votes): the label that most neighbours have; ties go to the smaller label. labels: id, label."""
    each = neighbours.join(labels.select(F.col("id").alias("g"), "label"), "g").groupBy("q", "label").agg(F.count(F.lit(1)).alias("votes"))
    best = each.groupBy("q").agg(F.min_by(F.struct("label", "votes"), F.struct(-F.col("votes"), "label")).alias("x"))
    return best.select("q", "x.label", "x.votes")


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0).cast("double"), lambda s, x: s + x)


def pooled(tokens: Column, mask: Column) -> Column:
    """The mean of the token vectors (array<array>) whose mask is 1, at length 1; null if there is none or it is zero."""
    kept = F.transform(F.filter(F.arrays_zip(tokens.alias("v"), mask.alias("m")), lambda x: x["m"] == 1), lambda x: F.transform(x["v"], lambda y: y.cast("double")))
    n = F.size(kept)
    total = F.aggregate(F.slice(kept, F.lit(2), F.greatest(n - 1, F.lit(0))), F.get(kept, F.lit(0)), lambda s, x: F.zip_with(s, x, lambda a, b: a + b))
    mean = F.transform(total, lambda x: x / n)
    norm = F.sqrt(_dot(mean, mean))
    return F.when((n > 0) & (norm > 0), F.transform(mean, lambda x: x / norm))


def cosine_percent(a: Column, b: Column) -> Column:
    """100 times the cosine of two vectors of length 1."""
    return 100 * _dot(a, b)
