"""A sweep of parameters as a tree of stages.

A node is a distinct list of the parameters that its stage and those before it read; the key (video_id) is a struct of the
video and that list. A stage's children share all that their parent has computed: what is compared (centres, overlaps) is
found once a parent, for the widest of the children's parameters, and only the small tables of it fan out. Pixels meet
a child's memberships by a join on the parent's key, so the rows of a stage don't grow with the lists of later stages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelake.operators import merge
from framelake.operators.joins import as_masks, class_pairs
from framelake.operators.merge import Masks
from framelake.sources.scratch import drop, materialise

#: Parameters in the order in which stages first read them: segmentation, small and larger radius, overlap, containment.
ORDER = ["thresh_pmap", "min_area", "thresh_com", "thresh_iou", "avg_area"]


def fields(nodes: DataFrame) -> list[str]:
    return nodes.schema["video_id"].dataType.names


def children(nodes: DataFrame, name: str, values: list) -> DataFrame:
    """Rows of each node for each of its children, which have `name` as a further part of the key."""
    key = [F.col(f"video_id.{k}").alias(k) for k in fields(nodes)]
    return nodes.withColumn("_value", F.explode(F.array(*map(F.lit, values)))).withColumn("video_id", F.struct(*key, F.col("_value").alias(name))).drop("_value")


def _gathered(m: Masks, member: DataFrame) -> Masks:
    """The parents' masks put together by the children's memberships (video_id, id, leader)."""
    key = [F.col(f"video_id.{k}").alias(k) for k in fields(m.pixels)]
    member = member.withColumn("parent", F.struct(*key))
    px = m.pixels.withColumnRenamed("video_id", "parent").join(member, ["parent", "id"]).groupBy("video_id", F.col("leader").alias("id"), "p").agg(F.sum("w").alias("w"))
    ts = m.times.withColumnRenamed("video_id", "parent").join(member, ["parent", "id"]).select("video_id", F.col("leader").alias("id"), "t").distinct()
    return Masks(materialise(px, "pixels"), materialise(ts, "times"))


def _next(m: Masks, member: DataFrame) -> Masks:
    out = _gathered(m, member)
    for t in m:
        drop(t)
    return out


def by_small_radius(regions: DataFrame, min_areas: list, radius: float) -> Masks:
    """M1 once a node, M2 a child."""
    segments, pixels, times = merge.numbered(regions)
    segments = children(materialise(segments, "segments"), "min_area", min_areas).filter(F.col("area") > F.col("video_id.min_area"))
    return _gathered(Masks(pixels, times), merge.cluster(segments, radius, nearest=False))


def by_larger_radius(m: Masks, radii: list, ly: int, threshold_mask: float) -> Masks:
    """M3: centres are taken once a node."""
    points = materialise(merge.centres(merge.binarised(m.pixels, threshold_mask), ly), "centres")
    return _next(m, merge.cluster(children(points, "thresh_com", radii), F.col("video_id.thresh_com"), nearest=True))


def _overlaps(m: Masks, threshold_mask: float, threshold: float | Column, measure: str) -> tuple[DataFrame, DataFrame]:
    """(pairs, members) of the nodes' classes of equal masks."""
    masks = materialise(as_masks(merge.binarised(m.pixels, threshold_mask).withColumnRenamed("id", "mask_id")), "masks")
    pairs, member = class_pairs(masks, threshold, measure)
    return materialise(pairs, "pairs"), materialise(member, "members")


def by_overlap(m: Masks, thresholds: list, threshold_mask: float) -> Masks:
    """M4: pairs are found once a node, at the lowest threshold."""
    pairs, member = _overlaps(m, threshold_mask, min(thresholds), "iou")
    mine = children(pairs, "thresh_iou", thresholds).filter(F.col("score") >= F.col("video_id.thresh_iou"))
    return _next(m, merge.classes(mine, children(member, "thresh_iou", thresholds)))


def by_containment(m: Masks, avg_areas: list, threshold_mask: float, threshold: float | Column) -> Masks:
    """M5: pairs are found once a node; the area decides what becomes of them."""
    pairs, member = _overlaps(m, threshold_mask, threshold, "contain")
    return _next(m, merge.contained(children(pairs, "avg_area", avg_areas), children(member, "avg_area", avg_areas), F.col("video_id.avg_area")))


def merged(regions: DataFrame, ly: int, lists: dict[str, list], base: dict) -> Masks:
    """M1-M5 for every combination of lists over regions whose key ends with thresh_pmap; base has thresh_mask, thresh_com0 and
    perhaps thresh_consume."""
    consume = base.get("thresh_consume", (1 + F.col("video_id.thresh_iou")) / 2)
    m = by_small_radius(regions, lists["min_area"], base["thresh_com0"])
    m = by_larger_radius(m, lists["thresh_com"], ly, base["thresh_mask"])
    m = by_overlap(m, lists["thresh_iou"], base["thresh_mask"])
    return by_containment(m, lists["avg_area"], base["thresh_mask"], consume)
