"""Set-similarity, radius and lookup joins between masks.

masks: (video_id, mask_id, px: sorted array of pixel numbers).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framelake.operators.tiles import tile_pairs
from framelake.sources.scratch import materialise

MASK = ["video_id", "mask_id"]
#: Masks that hold one pixel up to which all of their pairs are made by a join.
FEW = 64


def as_masks(pixels: DataFrame) -> DataFrame:
    """(video_id, mask_id, p) -> masks."""
    return pixels.groupBy(*MASK).agg(F.sort_array(F.collect_set("p")).alias("px"))


def _rare_first(masks: DataFrame) -> DataFrame:
    """Each mask's pixels (f, p) from the rarest on, f masks having them: (video_id, mask_id, copies, px)."""
    rows = masks.select(*MASK, "copies", F.explode("px").alias("p"))
    freq = rows.groupBy("video_id", "p").agg(F.count("*").alias("f"))
    return rows.join(freq, ["video_id", "p"]).groupBy(*MASK, "copies").agg(F.sort_array(F.collect_list(F.struct("f", "p"))).alias("px"))


def copies(masks: DataFrame) -> DataFrame:
    """(video_id, id, rep, copies, area): each mask's class of equal pixel sets, led by the smallest id `rep`."""
    each = masks.groupBy("video_id", "px").agg(F.min("mask_id").alias("rep"), F.count("*").alias("copies"))
    return masks.join(each, ["video_id", "px"]).select("video_id", F.col("mask_id").alias("id"), "rep", "copies", F.size("px").alias("area"))


def _different(masks: DataFrame) -> DataFrame:
    """One mask of each class of equal ones, with their number."""
    return masks.groupBy("video_id", "px").agg(F.min("mask_id").alias("mask_id"), F.count("*").alias("copies"))


def class_pairs(masks: DataFrame, threshold: float | Column, measure: str, links: bool = False, top: float | Column | None = None) -> tuple[DataFrame, DataFrame]:
    """J3, J4 by classes of equal masks: (pairs of their representatives, copies()). Work grows with different masks, not with
    pairs of copies; equal masks overlap wholly, so a class with several members links them all. Thresholds are at most 1.
    links, top: as in different_pairs()."""
    return different_pairs(_different(masks), threshold, measure, links=links, top=top), copies(masks)


def overlap_pairs(masks: DataFrame, threshold: float | Column, measure: str) -> DataFrame:
    """Pairs with overlap of at least `threshold`, at most 1: 'iou' gives a < b with inter / union, 'contain' gives
    (a, b) both ways with inter / area of b. Pairs of different masks are found once a class of equal ones, and only those
    of masks with copies meet the classes' members. What is as long as the result is made last and never shuffled."""
    different, member = _different(masks), copies(masks)
    ranked = materialise(_rare_first(different), "ranked")
    pairs = lambda several: different_pairs(different, threshold, measure, ranked, several)
    of = lambda rep, c: member.select("video_id", F.col("rep").alias(rep), F.col("id").alias(c))
    each = pairs(True).withColumnsRenamed({"a": "rep_a", "b": "rep_b"}).join(of("rep_a", "a"), ["video_id", "rep_a"]).join(of("rep_b", "b"), ["video_id", "rep_b"])
    if measure == "iou":
        turned = F.col("a") > F.col("b")
        swap = lambda c, d: F.when(turned, F.col(d)).otherwise(F.col(c)).alias(c)
        each = each.select("video_id", swap("a", "b"), swap("b", "a"), swap("area_a", "area_b"), swap("area_b", "area_a"), "inter", "score")
    else:
        each = each.select("video_id", "a", "b", "area_a", "area_b", "inter", "score")
    many = member.filter("copies > 1")
    equal = many.select("video_id", "rep", F.col("id").alias("a"), F.col("area").alias("area_a"), F.col("area").alias("area_b"), F.col("area").alias("inter")).join(many.select("video_id", "rep", F.col("id").alias("b")), ["video_id", "rep"])
    equal = equal.filter(F.col("a") < F.col("b") if measure == "iou" else F.col("a") != F.col("b")).withColumn("score", F.lit(1.0))
    return each.unionByName(equal.select(*each.columns)).unionByName(pairs(False).select(*each.columns))


def different_pairs(masks: DataFrame, threshold: float | Column, measure: str, ranked: DataFrame | None = None, several: bool | None = None, links: bool = False, top: float | Column | None = None) -> DataFrame:
    """The pairs of overlap_pairs(), of masks (with copies) that all differ.

    Candidates share one of the rare pixels that a mask can't do without: all but its share of (1 - threshold) pixels. Up
    to FEW masks that hold a pixel are paired by a join, and pixel arrays are intersected exactly. Pixels of more masks
    come last in the order; what shares no others is found by blocks of masks (tiles.tile_pairs). threshold may be
    a column of video_id. ranked: _rare_first(masks), if that is there. several: only pairs in which a mask has copies, or
    (False) none has. links: of pairs found by blocks only enough to link what all do, without inter and score; for
    'contain' of masks of at most `top` pixels, and of larger pairs as many as name all of their larger masks.
    """
    ranked = materialise(_rare_first(masks), "ranked") if ranked is None else ranked
    n = F.size("px")
    need = (n - F.ceil(F.lit(threshold) * n - 1e-9) + 1).alias("need")
    places = ranked.select(*MASK, "copies", n.alias("n"), need, F.posexplode("px").alias("place", "at")).select("*", "at.f", "at.p")
    rows = places.filter(F.col("f") <= FEW)
    few = rows.filter("place < need")
    right = few.select("video_id", "p", F.col("mask_id").alias("b"), F.col("n").alias("nb"), F.col("copies").alias("copies_b"))
    left = (few if measure == "iou" else rows).select("video_id", "p", F.col("mask_id").alias("a"), F.col("n").alias("na"), F.col("copies").alias("copies_a"))
    pairs = left.join(right, ["video_id", "p"])
    if several is not None:
        pairs = pairs.filter((F.greatest("copies_a", "copies_b") > 1) == F.lit(several))
    if measure == "iou":
        pairs = pairs.filter((F.col("a") < F.col("b")) & (F.least("na", "nb") >= F.lit(threshold) * F.greatest("na", "nb") - 1e-9))
    else:
        pairs = pairs.filter((F.col("a") != F.col("b")) & (F.col("na") >= F.lit(threshold) * F.col("nb") - 1e-9))
    pairs = pairs.select("video_id", "a", "b").distinct()
    of = lambda c: masks.select("video_id", F.col("mask_id").alias(c), F.col("px").alias(f"px_{c}"))
    both = pairs.join(of("a"), ["video_id", "a"]).join(of("b"), ["video_id", "b"])
    both = both.select("video_id", "a", "b", F.size("px_a").alias("area_a"), F.size("px_b").alias("area_b"), F.size(F.array_intersect("px_a", "px_b")).alias("inter"))
    score = F.col("inter") / (F.col("area_a") + F.col("area_b") - F.col("inter")) if measure == "iou" else F.col("inter") / F.col("area_b")
    both = both.withColumn("score", score).filter(F.col("score") >= threshold)
    # The last pixel of a mask is its most frequent one.
    if ranked.filter(F.element_at("px", -1).f > FEW).isEmpty():
        return both
    held = ranked.select(*MASK, (F.col("copies") > 1).alias("several"), F.transform("px", lambda x: x.p.cast("long")).alias("px"), F.posexplode("px").alias("before", "at"), n.alias("n"), need)
    held = held.filter(F.col("at.f") > FEW).withColumns({"f": F.col("at.f"), "p": F.col("at.p").cast("long"), "threshold": F.lit(threshold).cast("double"), "top": F.coalesce(F.lit(top).cast("double"), F.lit(float("inf")))})
    can = F.col("before") < F.col("need")
    held = held.withColumn("side", F.lit(0)).filter(can) if measure == "iou" else held.withColumn("side", F.explode(F.when(can, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    found = tile_pairs(held.select("video_id", "p", "f", "side", F.col("mask_id").cast("long").alias("mask_id"), "several", "before", "px", "threshold", "top"), measure, several, links)
    return both.unionByName(found.withColumn("score", score))


def radius_pairs(points: DataFrame, radius: float | Column, key: list[str] = ["video_id"]) -> DataFrame:  # noqa: B006
    """(key, a, b, dist) with a < b and dist <= radius, for points (key, id, cx, cy). Cells as wide as the radius; each
    point meets the 3 by 3 cells around it. radius may be a column of the key."""
    side = F.when(F.lit(radius) > 0, F.lit(radius)).otherwise(1.0)
    cells = points.withColumns({"gx": F.floor(F.col("cx") / side), "gy": F.floor(F.col("cy") / side)})
    around = F.array(*[F.struct(F.lit(i).alias("dx"), F.lit(j).alias("dy")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    near = cells.withColumn("d", F.explode(around)).select(*key, (F.col("gx") + F.col("d.dx")).alias("gx"), (F.col("gy") + F.col("d.dy")).alias("gy"), F.col("id").alias("b"), F.col("cx").alias("bx"), F.col("cy").alias("by"))
    pairs = cells.join(near, [*key, "gx", "gy"]).filter(F.col("id") < F.col("b"))
    dist = F.sqrt(F.pow(F.col("cx") - F.col("bx"), 2) + F.pow(F.col("cy") - F.col("by"), 2))
    return pairs.select(*key, F.col("id").alias("a"), "b", dist.alias("dist")).filter(F.col("dist") <= radius)


def point_in_mask(points: DataFrame, pixels: DataFrame, ly: int) -> DataFrame:
    """(video_id, id, mask_id): the pixel nearest a point's centre (halves to even) lies in the mask."""
    at = points.select("video_id", "id", (F.bround("cx") * ly + F.bround("cy")).cast("long").alias("p"))
    return at.join(pixels.select("video_id", "mask_id", "p"), ["video_id", "p"]).select("video_id", "id", "mask_id")


def best_match(candidates: DataFrame, key: list[str], score: str = "score", old: str = "mask_id") -> DataFrame:
    """Each key's candidate of the highest score; of equal ones the lowest old id."""
    w = Window.partitionBy(*key).orderBy(F.col(score).desc(), old)
    return candidates.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def label_pixels(active: DataFrame, pixels: DataFrame) -> DataFrame:
    """(video_id, t, p) of all pixels of masks that are active in a frame."""
    return active.select(*MASK, "t").join(pixels.select(*MASK, "p"), MASK).select("video_id", "t", "p").distinct()


def silenced(active: DataFrame, masks: DataFrame) -> DataFrame:
    """Active (video_id, mask_id, t) without frames in which an overlapping mask is active too.

    Such a frame holds, in one of the mask's pixels, another active mask. So each pixel of a frame tells which masks are
    active on it, of which the smallest and largest say whether there is another: no pairs of masks, only pixels of active
    masks, combined before the shuffle.
    """
    on = active.select(*MASK, "t").distinct().join(masks.select(*MASK, "px"), MASK).select(*MASK, "t", F.explode("px").alias("p"))
    held = on.groupBy("video_id", "t", "p").agg(F.min("mask_id").alias("low"), F.max("mask_id").alias("high")).filter("low <> high")
    busy = on.join(held, ["video_id", "t", "p"], "left_semi").select(*MASK, "t").distinct()
    return active.join(busy, [*MASK, "t"], "left_anti")
