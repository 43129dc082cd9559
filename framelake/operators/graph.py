"""Connected components and leader sets on edge tables, as contraction in tasks and rounds of joins and grouped minima."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelake.operators.skew import join_group_value
from framelake.sources.scratch import drop, materialise

#: Edges that one task contracts, about; at most PARTS times as many, however many of them share an end.
TASK_EDGES, PARTS = 1 << 18, 64


def _star(edges: DataFrame, larger: bool, total: int) -> DataFrame:
    """One star step over (a, b) with a > b: every neighbour on one side of a node is linked to the node's minimum.
    The grouped minimum is combined before the shuffle and sent to a hub's neighbours by broadcast, so a node with very
    many neighbours costs one row a task."""
    both = edges.select("a", "b")
    if larger:
        both = both.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("degree")).withColumn("m", F.least("m", "a"))
    linked = join_group_value(both, low, ["a"], "degree", total * (1 + larger))
    if larger:
        out = linked.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = linked.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
    return out.filter(F.col("a") != F.col("b")).distinct()


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (id, smallest id of its component) of the graph of these edges alone: roots hook onto smaller ones, then all
    paths are halved, until both ends of every edge have one root."""
    ids, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b, root = ends[: len(a)], ends[len(a) :], np.arange(len(ids))
    while len(a):
        np.minimum.at(root, np.maximum(root[a], root[b]), np.minimum(root[a], root[b]))
        while (root[root] != root).any():
            root = root[root]
        apart = root[a] != root[b]
        a, b = a[apart], b[apart]
    moved = np.flatnonzero(root != np.arange(len(ids)))
    return ids[moved], ids[root[moved]]


def _contracted(edges: DataFrame, parts: int) -> DataFrame:
    """Each part's edges as a forest of stars. Parts go by the smaller end; of one end's edges no part gets more than its
    share of all, divided by PARTS, so an end with very many edges is dealt to several."""
    def run(table: pa.Table) -> pa.Table:
        a, b = forest(np.asarray(table.column("a")), np.asarray(table.column("b")))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    salt = F.pmod(F.xxhash64("a"), F.lit(-(-parts // PARTS)))
    return edges.select("a", "b", F.pmod(F.xxhash64("b", salt), F.lit(parts)).alias("part")).groupBy("part").applyInArrow(run, "a long, b long")


def _settled(edges: DataFrame) -> bool:
    """Has every larger end one edge, and is none of them a smaller end."""
    ends = edges.select(F.col("a").alias("id"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("b").alias("id"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    odd = ends.groupBy("id").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter((F.col("up") > 1) | ((F.col("up") > 0) & (F.col("down") > 0)))
    return odd.isEmpty()


def connected_components(edges: DataFrame, max_rounds: int = 60, task_edges: int = TASK_EDGES) -> DataFrame:
    """(a, b) edges of any orderable id type -> (id, component), component = the smallest id reachable.

    Edges of long ids are first contracted in tasks of a bounded number of edges; with one task that settles all. Then
    large-star and small-star steps alternate until every node points to a root; each round is written to the shared
    checkpoint folder. Edges with nulls and self loops add no link; isolated ids (only self loops) are returned as their
    own component. Repeated edges are harmless.
    """
    present = edges.filter(F.col("a").isNotNull() & F.col("b").isNotNull())
    loops = present.filter(F.col("a") == F.col("b")).select(F.col("a").alias("id"))
    current = materialise(
        present.filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(),
        "edges",
    )
    total, settled = current.count(), False
    if current.dtypes == [("a", "bigint"), ("b", "bigint")]:
        parts = max(1, -(-total // task_edges))
        contracted = materialise(_contracted(current, parts), "edges")
        drop(current)
        current, settled = contracted, parts == 1
    for _ in range(max_rounds):
        if settled or _settled(current):
            break
        total = current.count()
        wide = materialise(_star(current, True, total), "edges")
        after = materialise(_star(wide, False, wide.count()), "edges")
        drop(wide)
        drop(current)
        current = after
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = current.select(F.col("b").alias("id")).distinct()
    labelled = current.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(roots.select("id", F.col("id").alias("component")))
    alone = loops.distinct().join(labelled.select("id"), "id", "left_anti")
    return labelled.unionByName(alone.select("id", F.col("id").alias("component")))
