"""Connected components of an edge table, by rounds of contraction within Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, store

ROUNDS = 60


def components(edges: DataFrame) -> DataFrame:
    """(id, component) for every id on an edge (u, v); component is the smallest id that is reachable.

    In each round every node takes its smallest neighbour (itself included) as its parent, parents are followed twice,
    and edges are rewritten to parents; edges within one parent go. The number of edges falls by a factor each round.
    Nothing but row counts reaches the driver. Minima are summed up before the shuffle, and parents are written to the
    shared folder before they are joined, so that Spark can split the rows of a node with very many edges. Loops,
    repeated edges and nulls are allowed (nulls are dropped); no edges give no rows.
    """
    e = store(edges.selectExpr("greatest(u, v) AS u", "least(u, v) AS v").where("u <> v AND u IS NOT NULL AND v IS NOT NULL").distinct())
    rounds: list[DataFrame] = []
    for _ in range(ROUNDS):
        if e.isEmpty():
            break
        both = e.unionByName(e.selectExpr("v AS u", "u AS v"))
        parent = store(both.groupBy("u").agg(F.min("v").alias("p")).select("u", F.least("u", "p").alias("p")))
        for _ in range(2):  # follow the parents' parents; any rest is left to the next round
            above, below = parent.selectExpr("u AS p", "p AS pp"), parent
            parent = store(below.join(above, "p", "left").select("u", F.coalesce("pp", "p").alias("p")))
            drop(below)
        rounds.append(parent)
        moved = e.join(parent, "u").selectExpr("p AS u", "v")
        moved = moved.join(parent.selectExpr("u AS v", "p AS q"), "v").selectExpr("greatest(u, q) AS u", "least(u, q) AS v")
        before, e = e, store(moved.where("u <> v").distinct())
        drop(before)
    else:
        raise RuntimeError("components did not converge")
    drop(e)
    if not rounds:
        return edges.sparkSession.createDataFrame([], "id bigint, component bigint")
    out = rounds.pop()
    found = out.selectExpr("u AS id", "p AS component")
    for parent in reversed(rounds):
        # an id of this round has its parent's component of the later rounds, if the parent still had edges then
        last = out
        out = store(parent.join(found.selectExpr("id AS p", "component"), "p", "left").select(F.col("u").alias("id"), F.coalesce("component", "p").alias("component")))
        found = out
        drop(last, parent)
    return found
