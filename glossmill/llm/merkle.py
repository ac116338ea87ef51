"""Merkle manifest of a dataset: a hash tree for each group of rows, and one over the groups.

Levels are windows: the nodes of a level are partitioned by group and parent index, and an ordered list over the whole
frame (at most FAN_OUT nodes) is both the parent's preimage and what each node's siblings are taken from. Parents are
deduplicated (a run's first node stands for it) before they are the next level. Paths go down again from the roots, so
only the last step touches all leaves, with one row of path for each run of FAN_OUT leaves.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import drop, store

#: Fixed value of the format: consecutive nodes under one parent.
FAN_OUT = 8
#: Bits of a stored row number below its range (Spark's monotonically_increasing_id).
PLACE_BITS = 33
#: First places by range and group are broadcast up to this many rows (about 10 MB); beyond that they are joined by key.
BROADCAST_ROWS = 100_000
PATH = "array<struct<before:string,after:string>>"


def digest(x: Column) -> Column:
    return F.sha2(x.cast("binary"), 256)


def field(x: Column) -> Column:
    """A value as it enters a leaf: `-` if null, else its length in UTF-8 bytes, a colon and the value."""
    x = x.cast("string")
    return F.coalesce(F.concat(F.octet_length(x).cast("string"), F.lit(":"), x), F.lit("-"))


def leaf(**values: Column) -> Column:
    return digest(F.concat(*(field(v) for v in values.values())))


def fold(own: Column, path: Column) -> Column:
    """The root that a node and its path (siblings before and after, level by level) lead to."""
    return F.aggregate(path, own, lambda d, s: digest(F.concat(s["before"], d, s["after"])))


def siblings_digest(path: Column) -> Column:
    """Digest of all siblings of a path, level by level, left to right."""
    return digest(F.array_join(F.transform(path, lambda s: F.concat(s["before"], s["after"])), ""))


def placed(nodes: DataFrame, group: str, *order: str) -> DataFrame:
    """nodes (group, *order, ...) stored with `place` (from 0 within the group by order) and `n`, the group's nodes.

    One range exchange over group and order, so that a group of any share of the rows lies in many ranges. The stored
    row numbers give the rest: counts by range (a row per partition) and first places by range and group.
    """
    ranged = nodes.repartitionByRange(group, *order).sortWithinPartitions(group, *order)
    stored = store(ranged.withColumn("_row", F.monotonically_increasing_id()))
    part = F.shiftrightunsigned("_row", PLACE_BITS)
    runs = store(stored.groupBy(part.alias("_part"), group).agg(F.min("_row").alias("_first"), F.count(F.lit(1)).alias("_n")))
    # first places within the group: a window over the ranges of a group, a row per range
    w = Window.partitionBy(group).orderBy("_part")
    first = F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1))
    starts = runs.select("_part", group, "_first", F.coalesce(first, F.lit(0)).alias("_start"), F.sum("_n").over(Window.partitionBy(group)).alias("n"))
    if runs.count() <= BROADCAST_ROWS:
        starts = F.broadcast(starts)
    out = stored.withColumn("_part", part).join(starts, ["_part", group])
    return out.withColumn("place", F.col("_row") - F.col("_first") + F.col("_start")).drop("_part", "_row", "_first", "_start")


def runs(nodes: DataFrame, group: str) -> DataFrame:
    """Nodes of groups that still have several, with their run: parent (its index), run (digests of all its nodes)."""
    w = Window.partitionBy(group, "parent").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    several = nodes.where("n > 1").withColumn("parent", F.floor(F.col("place") / FAN_OUT))
    return several.withColumn("run", F.collect_list("node").over(w))


def parents(nodes: DataFrame, group: str) -> DataFrame:
    """(group, place, node, n): the next level; each run's first node stands for it."""
    first = runs(nodes, group).where(F.col("place") % FAN_OUT == 0)
    return first.select(group, F.col("parent").alias("place"), digest(F.array_join("run", "")).alias("node"), F.ceil(F.col("n") / FAN_OUT).alias("n"))


def step(run: Column, place: Column) -> Column:
    """What stands before and after a node in its run."""
    at = (place % FAN_OUT).cast("int")
    return F.struct(F.array_join(F.slice(run, 1, at), "").alias("before"), F.array_join(F.slice(run, at + 2, FAN_OUT), "").alias("after"))


@dataclass
class Tree:
    """Levels of the trees of all groups: level 0 has the leaves, the last level one node for each of the largest groups."""

    levels: list[DataFrame]
    group: str

    def tops(self) -> DataFrame:
        """(group, top): the remaining node of each group."""
        out = None
        for nodes in self.levels:
            own = nodes.where("n = 1").select(self.group, F.col("node").alias("top"))
            out = own if out is None else out.unionByName(own)
        return out

    def paths(self, above: DataFrame | None = None) -> DataFrame:
        """Level 0's rows with `path`, from the row up to its group's top, then what `above` (group, path) adds.

        Columns of `above` besides are given to the rows. It has a row for each group.
        """
        if above is None:
            above = self.tops().select(self.group, F.array().cast(PATH).alias("path"))
        carried = [c for c in above.columns if c != self.group]
        down: DataFrame | None = None
        for k in range(len(self.levels) - 1, -1, -1):
            nodes = self.levels[k]
            # a group that ends here: one node, which is its top
            out = nodes.where("n = 1").join(above, self.group)
            if down is not None:
                own = F.array(step(F.col("run"), F.col("place")))
                keys = [self.group, "parent"]
                under = runs(nodes, self.group).join(down, keys).withColumn("path", F.concat(own, F.col("path"))).drop("parent", "run")
                out = under.unionByName(out)
            if k:
                down = store(out.select(self.group, F.col("place").alias("parent"), *carried))
        return out


def build(leaves: DataFrame, group: str) -> Tree:
    """The trees over placed leaves (group, place, n, node, ...). Each level is stored; a level is an eighth of the one below."""
    levels = [leaves]
    most = leaves.agg(F.max("n").alias("n")).collect()[0]["n"] or 0
    while most > 1:
        levels.append(store(parents(levels[-1], group)))
        most = -(-most // FAN_OUT)
    return Tree(levels, group)


def manifest(docs: DataFrame, columns: list[str], group: str, key: str, tampered: dict[str, Column] | None = None, where: Column | None = None) -> DataFrame:
    """key, leaf, subroot, root, path (to the root), and given: the leaf of the tampered row, else the leaf.

    A row's leaf is the digest of `columns` (see field). Within a group (null is one, and comes first) leaves ascend
    by key, nulls first; rows with equal keys by their leaf, so that equal rows lie side by side in any order. The
    root is over the groups' tops, by group bytewise. `tampered` replaces columns of the rows that `where` names.
    Empty texts are values; a group or table of one row has that leaf as its top; an empty table has no rows; texts
    of any length are hashed whole, and other columns are ignored. A group of any share of the rows spreads over all
    tasks; no task holds more than a run of a parent.
    """
    values = {c: F.col(c) for c in columns}
    given = F.lit(None).cast("string") if tampered is None else F.when(where, leaf(**(values | tampered)))
    named = F.coalesce(F.concat(F.lit("+"), F.col(group).cast("string")), F.lit(""))  # keeps the order, and no null to join on
    own = store(docs.select(named.alias("grp"), F.col(key).alias("key"), leaf(**values).alias("node"), given.alias("given")))
    tree = build(placed(own, "grp", "key", "node"), "grp")
    tops = store(tree.tops().select(F.lit("").alias("all"), F.col("grp"), F.col("top").alias("node")))
    upper = build(placed(tops, "all", "grp"), "all")
    roots = upper.tops().collect()  # one row, or none if the table is empty
    above = store(upper.paths().select("grp", "path", F.col("node").alias("subroot")))
    rows = tree.paths(above)
    drop(own, tops)
    root = roots[0]["top"] if roots else None
    return rows.select("key", F.col("node").alias("leaf"), "subroot", F.lit(root).alias("root"), "path", F.coalesce("given", "node").alias("given"))


def verify(rows: DataFrame, key: str) -> DataFrame:
    """key, leaf, subroot, root, proof_sha256, folded_root, verified: each given leaf folded up its path to a root."""
    out = rows.select(F.col("key").alias(key), "leaf", "subroot", "root", siblings_digest(F.col("path")).alias("proof_sha256"), fold(F.col("given"), F.col("path")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
