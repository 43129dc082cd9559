"""Matching found masks to labelled ones and scoring the match."""

from __future__ import annotations

import math
from collections import defaultdict
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framelake.operators.graph import connected_components
from framelake.sources.scratch import materialise

#: Groups that components of several candidates are dealt to.
GROUPS = 256


def iou_candidates(gt: DataFrame, found: DataFrame, threshold: float, key: list[str]) -> DataFrame:
    """(key, gt_id, mask_id, iou) with iou >= threshold; gt (key, gt_id, p), found (key, mask_id, p)."""
    a, b = gt.groupBy(*key, "gt_id").agg(F.count("*").alias("na")), found.groupBy(*key, "mask_id").agg(F.count("*").alias("nb"))
    inter = gt.join(found, [*key, "p"]).groupBy(*key, "gt_id", "mask_id").agg(F.count("*").alias("inter"))
    both = inter.join(a, [*key, "gt_id"]).join(b, [*key, "mask_id"])
    return both.withColumn("iou", F.col("inter") / (F.col("na") + F.col("nb") - F.col("inter"))).filter(F.col("iou") >= threshold).select(*key, "gt_id", "mask_id", "iou")


def assign(rows: np.ndarray, columns: np.ndarray, gain: np.ndarray) -> np.ndarray:
    """Numbers of the candidates (row, column, gain > 0) of a one-to-one assignment of largest total gain. Shortest augmenting
    paths with potentials over the candidates alone, so memory follows their number, not rows times columns; a row may
    stay without a pair, at a column of its own that gains nothing."""
    edges: list[list[tuple[int, float, int]]] = [[] for _ in range(int(rows.max(initial=-1)) + 1)]
    for k, (r, c, g) in enumerate(zip(rows.tolist(), columns.tolist(), gain.tolist(), strict=True)):
        edges[r].append((c, -g, k))
    u = [min((cost for _, cost, _ in e), default=0.0) for e in edges]
    v, owner, taken = defaultdict(float), {}, [(-1, -1)] * len(edges)
    for start in range(len(edges)):
        dist, back, done, heap, at, far = {}, {}, [], [], start, 0.0
        while True:
            for c, cost, k in [*edges[at], (-1 - at, 0.0, -1)]:
                d = far + cost - u[at] - v[c]
                if d < dist.get(c, math.inf):
                    dist[c], back[c] = d, (at, k)
                    heappush(heap, (d, c))
            far, c = heappop(heap)
            while far > dist[c]:
                far, c = heappop(heap)
            if c not in owner:
                break
            done.append(c)
            at = owner[c]
        u[start] += far
        for x in done:
            u[owner[x]] += far - dist[x]
            v[x] -= far - dist[x]
        while True:
            r, k = back[c]
            owner[c], before, taken[r] = r, taken[r], (c, k)
            if r == start:
                break
            c = before[0]
    return np.array(sorted(k for _, k in taken if k >= 0), np.int64)


def one_to_one(candidates: DataFrame, key: list[str]) -> DataFrame:
    """(key, gt_id, mask_id) of the assignment of least cost. Components of the candidate graph are independent, for
    non-candidates all cost the same: pairs that have no other candidate match, other components are solved many to a group."""
    candidates = materialise(candidates, "candidates")
    alone = lambda c: F.count("*").over(Window.partitionBy(*key, c)) == 1
    candidates = candidates.withColumn("single", alone("gt_id") & alone("mask_id"))
    single, candidates = candidates.filter("single").select(*key, "gt_id", "mask_id"), materialise(candidates.filter(~F.col("single")).drop("single"), "several")
    node = lambda kind, c: F.xxhash64(*key, F.lit(kind), c)
    comp = connected_components(candidates.select(node(0, "gt_id").alias("a"), node(1, "mask_id").alias("b")))
    labelled = candidates.withColumn("id", node(0, "gt_id")).join(comp, "id")

    def solve(table: pa.Table) -> pa.Table:
        table = table.sort_by([("hash", "ascending")])
        cut = [k for k, (x, y) in enumerate(zip([None, *table.column("hash").to_pylist()], table.column("hash").to_pylist(), strict=False)) if x != y]
        return pa.concat_tables([one(table.slice(a, b - a)) for a, b in zip(cut, [*cut[1:], table.num_rows], strict=True)])

    def one(table: pa.Table) -> pa.Table:
        codes = [pa.compute.dictionary_encode(table.column(c).combine_chunks()).indices for c in ("gt_id", "mask_id")]
        return table.select([*key, "gt_id", "mask_id"]).take(pa.array(assign(*map(np.asarray, codes), 1 + np.asarray(table.column("iou")))))

    types = dict(candidates.dtypes)
    schema = ", ".join(f"{c} {types[c]}" for c in [*key, "gt_id", "mask_id"])
    dealt = labelled.withColumn("hash", F.xxhash64("component")).withColumn("part", F.pmod("hash", F.lit(GROUPS))).drop("component", "id")
    return single.unionByName(dealt.groupBy("part").applyInArrow(solve, schema))


def scores(gt: DataFrame, found: DataFrame, threshold: float = 0.5, key: list[str] = ["video_id"]) -> DataFrame:  # noqa: B006
    """(key, n_gt, n_found, n_match, recall, precision, f1); all 0 if nothing matches."""
    match = one_to_one(iou_candidates(gt, found, threshold, key), key).groupBy(*key).agg(F.count("*").alias("n_match"))
    a, b = gt.groupBy(*key).agg(F.countDistinct("gt_id").alias("n_gt")), found.groupBy(*key).agg(F.countDistinct("mask_id").alias("n_found"))
    all_ = a.join(b, key, "full").join(match, key, "left").fillna(0, ["n_gt", "n_found", "n_match"])
    return with_f1(all_)


def with_f1(counts: DataFrame) -> DataFrame:
    """recall, precision and f1 from n_match, n_gt and n_found."""
    hit = F.col("n_match") > 0
    recall, precision = F.when(hit, F.col("n_match") / F.col("n_gt")).otherwise(0.0), F.when(hit, F.col("n_match") / F.col("n_found")).otherwise(0.0)
    return counts.withColumns({"recall": recall, "precision": precision, "f1": F.when(hit, 2 * recall * precision / (recall + precision)).otherwise(0.0)})
