"""Merging the same region across frames.

segments (video_id, id, cx, cy, area, whole), pixels (video_id, id, p, w), times (video_id, id, t). id follows the order
of (t, seg); all merges give the same three tables, keyed by the leaders' ids.
"""

from __future__ import annotations

from collections import Counter
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framelake.operators.graph import connected_components
from framelake.operators.joins import as_masks, best_match, class_pairs
from framelake.operators.leaders import leaders, members
from framelake.operators.temporal import has_run
from framelake.sources.scratch import materialise


class Masks(NamedTuple):
    pixels: DataFrame
    times: DataFrame


def numbered(regions: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """M1: region pixels of all frames -> (segments, pixels, times). ids are (t, seg) packed in order, 2**31 pixels a frame."""
    at = regions.withColumn("id", F.shiftleft(F.col("t").cast("long"), 31) + F.col("seg"))
    segments = at.groupBy("video_id", "id").agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"), F.count("*").alias("area"), F.lit(True).alias("whole"))
    return segments, at.select("video_id", "id", "p", F.lit(1.0).alias("w")), at.select("video_id", "id", "t").distinct()


def gather(pixels: DataFrame, times: DataFrame, membership: DataFrame) -> Masks:
    """Sum the members' pixel weights and unite their times. membership (video_id, id, leader)."""
    to = ["video_id", "leader"]
    px = pixels.join(membership, ["video_id", "id"]).groupBy(*to, "p").agg(F.sum("w").alias("w"))
    ts = times.join(membership, ["video_id", "id"]).select(*to, "t").distinct()
    return Masks(px.withColumnRenamed("leader", "id"), ts.withColumnRenamed("leader", "id"))


def cluster(segments: DataFrame, radius: float | Column, nearest: bool) -> DataFrame:
    """M2, M3: (video_id, id, leader). Leaders come from whole segments; every segment joins its smallest (M2) or its
    nearest (M3; ties to the smaller) leader within the radius, or is dropped if there is none. radius may be a column of
    video_id."""
    points = materialise(segments.select("video_id", "id", "cx", "cy", "whole", F.lit(radius).cast("double").alias("r")), "points")
    lead = leaders(points.filter("whole"))
    return members(points.drop("whole"), lead, nearest)


def binarised(pixels: DataFrame, threshold: float) -> DataFrame:
    """Pixels of at least `threshold` times their mask's largest weight."""
    top = F.max("w").over(Window.partitionBy("video_id", "id"))
    return pixels.withColumn("_top", top).filter(F.col("w") >= F.col("_top") * threshold).drop("_top")


def centres(pixels: DataFrame, ly: int) -> DataFrame:
    """Unweighted centres and areas of binarised masks."""
    return pixels.groupBy("video_id", "id").agg(F.avg(F.expr(f"p div {ly}")).alias("cx"), F.avg(F.expr(f"p % {ly}")).alias("cy"), F.count("*").alias("area"), F.lit(True).alias("whole"))


def classes(pairs: DataFrame, member: DataFrame) -> DataFrame:
    """(video_id, id, leader): connected sets of pairs of representatives, with all masks `member` (video_id, id, rep) that are
    equal to one of them; rep is its class's smallest id. Nodes are 64-bit hashes of video and id."""
    edges = pairs.select(F.xxhash64("video_id", "a").alias("a"), F.xxhash64("video_id", "b").alias("b"))
    nodes = pairs.select("video_id", F.explode(F.array("a", "b")).alias("rep")).distinct().withColumn("node", F.xxhash64("video_id", "rep"))
    labelled = nodes.join(connected_components(edges).toDF("node", "component"), "node")
    leader = labelled.groupBy("component").agg(F.min("rep").alias("leader"))
    found = labelled.join(leader, "component").select("video_id", "rep", "leader")
    return member.select("video_id", "id", "rep").join(found, ["video_id", "rep"], "left").select("video_id", "id", F.coalesce("leader", "rep").alias("leader"))


def as_rows(m: Masks, key: list[str]) -> DataFrame:
    """(key, id, p, w, times), a row a mask, p ascending."""
    px = m.pixels.groupBy(*key, "id").agg(F.sort_array(F.collect_list(F.struct(F.col("p").cast("long").alias("p"), F.col("w").cast("double").alias("w")))).alias("px"))
    ts = m.times.groupBy(*key, "id").agg(F.sort_array(F.collect_set(F.col("t").cast("long"))).alias("times"))
    return px.join(ts, [*key, "id"]).select(*key, "id", "px.p", "px.w", "times")


def from_rows(rows: DataFrame) -> Masks:
    """The tables of masks (video_id, id, p, w, times)."""
    px = rows.select("video_id", "id", F.explode(F.arrays_zip("p", "w")).alias("x"))
    return Masks(px.select("video_id", "id", F.col("x.p").alias("p"), F.col("x.w").alias("w")), rows.select("video_id", "id", F.explode("times").alias("t")))


def _as_masks(pixels: DataFrame) -> DataFrame:
    return as_masks(pixels.withColumnRenamed("id", "mask_id"))


def iou_merge(m: Masks, threshold_mask: float, threshold_iou: float) -> Masks:
    """M4: masks joined by chains of IoU >= threshold become one, led by the smallest id."""
    masks = materialise(_as_masks(binarised(m.pixels, threshold_mask)), "masks")
    pairs, member = class_pairs(masks, threshold_iou, "iou", links=True)
    return gather(m.pixels, m.times, classes(materialise(pairs, "pairs"), member))


def contained(pairs: DataFrame, member: DataFrame, avg_area: float | Column) -> DataFrame:
    """M5: (video_id, id, leader) of masks `member` (joins.copies()), given the containment pairs of their representatives. Of a
    pair the larger mask is dropped if it is above avg_area (equal ones both, and so all of a class of equal masks); pairs of
    smaller masks join. avg_area may be a column of video_id."""
    drop = pairs.filter(F.greatest("area_a", "area_b") > avg_area).select("video_id", F.when(F.col("area_b") > F.col("area_a"), F.col("b")).otherwise(F.col("a")).alias("rep"))
    drop = drop.unionByName(member.filter((F.col("copies") > 1) & (F.col("area") > avg_area)).select("video_id", "rep")).distinct()
    gone = member.join(drop, ["video_id", "rep"], "left_semi").select("video_id", "id")
    joined = pairs.filter(F.greatest("area_a", "area_b") <= avg_area)
    return classes(joined, member).join(gone, ["video_id", "id"], "left_anti")


def containment_classes(masks: DataFrame, avg_area: float, threshold: float) -> DataFrame:
    """M5 over masks: pairs with inter / area_b >= threshold."""
    pairs, member = class_pairs(masks, threshold, "contain", links=True, top=avg_area)
    return contained(materialise(pairs, "contain"), materialise(member, "members"), avg_area)


def containment_merge(m: Masks, threshold_mask: float, avg_area: float, threshold: float) -> Masks:
    masks = materialise(_as_masks(binarised(m.pixels, threshold_mask)), "masks")
    return gather(m.pixels, m.times, containment_classes(masks, avg_area, threshold))


def run_filter(m: Masks, threshold_mask: float, cons: int) -> Masks:
    """M6: masks with `cons` consecutive active frames, binarised."""
    good = has_run(m.times, ["video_id", "id"], cons)
    return Masks(binarised(m.pixels.join(good, ["video_id", "id"], "left_semi"), threshold_mask), m.times.join(good, ["video_id", "id"], "left_semi"))


def complete(regions: DataFrame, ly: int, params: dict) -> Masks:
    """M7: all merges over the regions of a batch of frames, then the run filter; without regions the result is empty."""
    return run_filter(merged(regions, ly, params), params["thresh_mask"], params["cons"])


def merged(regions: DataFrame, ly: int, params: dict) -> Masks:
    """M8: the merges without the run filter, for one window of frames."""
    segments, pixels, times = numbered(regions)
    segments = materialise(segments.filter(F.col("area") > params["min_area"]), "segments")
    m = gather(pixels, times, cluster(segments, params["thresh_com0"], nearest=False))
    m = Masks(materialise(m.pixels, "pixels"), materialise(m.times, "times"))
    real = binarised(m.pixels, params["thresh_mask"])
    m = gather(m.pixels, m.times, cluster(centres(real, ly), params["thresh_com"], nearest=True))
    m = iou_merge(Masks(materialise(m.pixels, "pixels"), materialise(m.times, "times")), params["thresh_mask"], params["thresh_iou"])
    m = Masks(materialise(m.pixels, "pixels"), materialise(m.times, "times"))
    m = containment_merge(m, params["thresh_mask"], params["avg_area"], params.get("thresh_consume", (1 + params["thresh_iou"]) / 2))
    return Masks(materialise(m.pixels, "pixels"), materialise(m.times, "times"))


def matches(new: DataFrame, old: DataFrame, threshold_iou: float, threshold_consume: float) -> DataFrame:
    """J6 for M9, M13: (video_id, id, mask_id) the old mask of largest IoU for each new one, of those with IoU or
    inter / smaller area above the thresholds. new (video_id, id, px), old (video_id, mask_id, px)."""
    rows = new.select("video_id", "id", F.size("px").alias("na"), F.explode("px").alias("p")).join(old.select("video_id", "mask_id", F.size("px").alias("nb"), F.explode("px").alias("p")), ["video_id", "p"])
    both = rows.groupBy("video_id", "id", "mask_id", "na", "nb").agg(F.count("*").alias("inter"))
    iou = F.col("inter") / (F.col("na") + F.col("nb") - F.col("inter"))
    fit = both.withColumn("score", iou).filter((F.col("score") >= threshold_iou) | (F.col("inter") / F.least("na", "nb") >= threshold_consume))
    return best_match(fit, ["video_id", "id"])


def merge_into(old: Masks, new: Masks, params: dict, only: DataFrame | None = None) -> Masks:
    """New masks join their best old mask (of `only`, the unconfirmed, if given); the rest are appended."""
    base = old.pixels if only is None else old.pixels.join(only, ["video_id", "id"], "left_semi")
    px = lambda m: as_masks(binarised(m, params["thresh_mask"]).withColumnRenamed("id", "mask_id"))
    found = matches(px(new.pixels).withColumnRenamed("mask_id", "id"), px(base), params["thresh_iou"], (1 + params["thresh_iou"]) / 2).select("video_id", "id", F.col("mask_id").alias("leader"))
    ids = new.pixels.select("video_id", "id").distinct()
    member = ids.join(found, ["video_id", "id"], "left").withColumn("leader", F.coalesce("leader", "id"))
    added = gather(new.pixels, new.times, member)
    return Masks(old.pixels.unionByName(added.pixels).groupBy("video_id", "id", "p").agg(F.sum("w").alias("w")), old.times.unionByName(added.times).distinct())


def merge_windows(rows: DataFrame, key: list[str], threshold_mask: float) -> DataFrame:
    """M9 for a block of windows: masks (key, window, id, p, w, times), p and w arrays, of which window -1 holds those found before
    -> (key, id, p, w, times). Windows follow each other inside the group of a key, which has thresh_iou; each new
    mask joins its best old one of those before its window, by the rules of matches(), or is appended."""
    def fold(k: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        named = dict(zip(key, k, strict=True))
        iou = named["thresh_iou"]
        masks: dict[int, tuple] = {}
        shown: dict[int, list[int]] = {}
        owners: dict[int, set[int]] = {}

        def keep(i: int, m: tuple) -> None:
            for p in shown.get(i, ()):
                owners[p].discard(i)
            masks[i], shown[i] = m, _shown(m, threshold_mask)
            for p in shown[i]:
                owners.setdefault(p, set()).add(i)

        for window, own in pdf.sort_values("id").groupby("window", sort=True):
            joins: dict[int, list[tuple]] = {}
            for i, p, w, t in zip(own["id"].tolist(), own["p"], own["w"], own["times"], strict=True):
                m = (np.asarray(p, np.int64), np.asarray(w, float), set(np.asarray(t).tolist()))
                to = None if window < 0 else _best(_shown(m, threshold_mask), owners, shown, iou)
                joins.setdefault(i if to is None else to, []).append(m)
            for i, parts in joins.items():
                parts = [*([masks[i]] if i in masks else []), *parts]
                px, at = np.unique(np.concatenate([m[0] for m in parts]), return_inverse=True)
                keep(i, (px, np.bincount(at, np.concatenate([m[1] for m in parts]), len(px)), set().union(*(m[2] for m in parts))))
        ids = list(masks)
        return pd.DataFrame({**{c: [v] * len(ids) for c, v in named.items()}, "id": ids, "p": [masks[i][0] for i in ids], "w": [masks[i][1] for i in ids], "times": [sorted(masks[i][2]) for i in ids]})

    types = dict(rows.dtypes)
    return rows.groupBy(*key).applyInPandas(fold, ", ".join(f"{c} {types[c]}" for c in key) + ", id long, p array<long>, w array<double>, times array<long>")


def _shown(m: tuple, threshold: float) -> list[int]:
    """Pixels of a mask (p, w, ..) of at least `threshold` times its largest weight."""
    return m[0][m[1] >= m[1].max() * threshold].tolist()


def _best(px: list[int], owners: dict[int, set[int]], shown: dict[int, list[int]], threshold_iou: float) -> int | None:
    """Of the masks that share a pixel and fit, the one of largest IoU; of equal ones the smallest id."""
    inter = Counter(i for p in px for i in owners.get(p, ()))
    fit = []
    for i, n in inter.items():
        score = n / (len(px) + len(shown[i]) - n)
        if score >= threshold_iou or n / min(len(px), len(shown[i])) >= (1 + threshold_iou) / 2:
            fit.append((-score, i))
    return min(fit)[1] if fit else None


def confirmed(m: Masks, cons: int) -> DataFrame:
    """Ids with a long enough run."""
    return has_run(m.times, ["video_id", "id"], cons)


def final_merge(m: Masks, params: dict) -> Masks:
    """M4, M5, M6 on the state; times are distinct and sorted by their windows."""
    m = iou_merge(m, params["thresh_mask"], params["thresh_iou"])
    m = Masks(materialise(m.pixels, "pixels"), materialise(m.times, "times"))
    return run_filter(containment_merge(m, params["thresh_mask"], params["avg_area"], (1 + params["thresh_iou"]) / 2), params["thresh_mask"], params["cons"])


def track(regions: DataFrame, masks: DataFrame, ly: int, params: dict) -> DataFrame:
    """Each frame's new region goes to the confirmed mask that contains its centre and fits best: (video_id, t, id,
    mask_id), null for none. regions (video_id, t, id, cx, cy, px), masks (video_id, mask_id, px)."""
    pixel = (F.bround("cx") * ly + F.bround("cy")).cast("long")
    rows = masks.select("video_id", "mask_id", F.col("px").alias("old"), F.explode("px").alias("p"))
    hit = regions.withColumn("p", pixel).join(rows, ["video_id", "p"])
    inter, na, nb = F.size(F.array_intersect("px", "old")), F.size("px"), F.size("old")
    fit = hit.withColumns({"score": inter / (na + nb - inter), "cover": inter / F.least(na, nb)}).filter((F.col("score") >= params["thresh_iou"]) | (F.col("cover") >= (1 + params["thresh_iou"]) / 2))
    best = best_match(fit, ["video_id", "t", "id"]).select("video_id", "t", "id", "mask_id")
    return regions.select("video_id", "t", "id").join(best, ["video_id", "t", "id"], "left")
