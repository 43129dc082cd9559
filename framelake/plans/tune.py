"""Parameter grids, folds and the choice of the best parameters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from framelake.functions.scalar import bucket
from framelake.operators.evaluate import scores, with_f1
from framelake.operators.merge import Masks, as_rows, binarised, final_merge, from_rows, merge_windows
from framelake.operators.score import score_frames
from framelake.operators.segment import frame_regions
from framelake.operators.temporal import block_of, runs
from framelake.plans import stages
from framelake.sources.frames import unpack
from framelake.sources.scratch import drop, materialise

GRID = ["min_area", "avg_area", "thresh_pmap", "thresh_com", "thresh_iou", "cons"]


#: Parts that videos are dealt to when each meets every fold.
SALTS = 32

#: Windows that are joined into the masks before in one job: a group holds a video's masks and those of so many windows.
BLOCK_WINDOWS = 64


def grid(spark: SparkSession, **lists: list) -> DataFrame:
    """One row a combination of small lists (parameters, so bounded by what a user types)."""
    out = spark.range(1).select(*[F.array(*map(F.lit, v)).alias(k) for k, v in lists.items()])
    for k in lists:
        out = out.withColumn(k, F.explode(k))
    return out


def folds(videos: DataFrame, strategy: str) -> DataFrame:
    """(cv, video_id, trains) of leave_one_out, train_1_test_rest or use_all (one fold, all train)."""
    strategy = strategy.replace("-", "_")
    if strategy == "use_all":
        return videos.select(F.lit(0).cast("long").alias("cv"), F.col("video_id").cast("long").alias("video_id"), F.lit(True).alias("trains")).distinct()
    if strategy not in ("leave_one_out", "train_1_test_rest"):
        raise ValueError(f"no such strategy: {strategy}")
    v = videos.select(F.col("video_id").cast("long").alias("video_id")).distinct()
    # Every video with every fold is the result; folds are repeated for each of SALTS parts, so that many tasks share it.
    part = v.select(F.col("video_id").alias("cv"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("k"))
    every = v.withColumn("k", F.pmod(F.xxhash64("video_id"), F.lit(SALTS)).cast("int")).join(part, "k")
    trains: Column = F.col("video_id") != F.col("cv") if strategy == "leave_one_out" else F.col("video_id") == F.col("cv")
    return every.select("cv", "video_id", trains.alias("trains"))


def sweep_cons(active: DataFrame, cons: list[int], key: list[str]) -> DataFrame:
    """(key, cons) of all run lengths at once, from the longest run of each key."""
    longest = runs(active, key).groupBy(*key).agg(F.max("length").alias("max_run"))
    return longest.withColumn("cons", F.explode(F.array(*map(F.lit, cons)))).filter(F.col("max_run") >= F.col("cons"))


def threshold_scores(signal: DataFrame, labels: DataFrame, thresholds: list[float], cons: list[int], key: list[str] = []) -> DataFrame:  # noqa: B006
    """T1-T3, T8 for one-pixel masks: scores of every (threshold, cons) of a signal (key, id, t, z) against labelled
    (key, id); with a key (videos), of each that has labels. The signal is thresholded once by a small explode; each
    threshold's longest run serves all cons."""
    hot = signal.withColumn("threshold", F.explode(F.array(*map(F.lit, thresholds)))).filter(F.col("z") > F.col("threshold"))
    found = sweep_cons(hot, cons, [*key, "threshold", "id"])
    n_gt = labels.select(*key, "id").distinct().groupBy(*key).agg(F.count("*").alias("n_gt"))
    counts = found.join(labels.select(*key, "id", F.lit(1).alias("hit")).distinct(), [*key, "id"], "left").groupBy(*key, "threshold", "cons").agg(F.count("*").alias("n_found"), F.count("hit").alias("n_match"))
    cells = n_gt.withColumn("threshold", F.explode(F.array(*map(F.lit, thresholds)))).withColumn("cons", F.explode(F.array(*map(F.lit, cons))))
    return with_f1(cells.join(counts, [*key, "threshold", "cons"], "left").fillna(0, ["n_found", "n_match"]))


def mean_over_training(scores: DataFrame, fold: DataFrame, params: list[str]) -> DataFrame:
    """Mean score of each combination over a fold's training videos."""
    return scores.join(fold.filter("trains"), "video_id").groupBy("cv", *params).agg(*[(F.sum(c) / F.count("*")).alias(c) for c in ("recall", "precision", "f1")])


def best(scores: DataFrame, params: list[str], by: list[str] = ["cv"]) -> DataFrame:  # noqa: B006
    """The combination of the highest F1 of each fold; of equal ones the first in the order of the parameters."""
    w = Window.partitionBy(*by).orderBy(F.col("f1").desc(), *params)
    return scores.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def marginals(scores: DataFrame, params: list[str]) -> DataFrame:
    """Best F1 over all combinations of fixed and free parameters."""
    return scores.cube(*params).agg(F.max("f1").alias("best_f1"))


def sparse_enough(pmap: DataFrame, thresholds: list[float], most: float = 0.1) -> DataFrame:
    """(video_id, threshold, ratio) of thresholds above which at most `most` of the pixels are active."""
    share = [F.avg((F.col("p") > t).cast("double")) for t in thresholds]
    wide = pmap.groupBy("video_id").agg(F.array(*[F.struct(F.lit(t).alias("threshold"), s.alias("ratio")) for t, s in zip(thresholds, share, strict=True)]).alias("s"))
    return wide.select("video_id", F.inline("s")).filter(F.col("ratio") <= most)


def _regions_by_cut(pmap: DataFrame, ly: int, cuts: list) -> DataFrame:
    """Regions of every video and thresh_pmap, which together are the key. Of a video whose frames are too full above a
    threshold (A16) there are none."""
    usable = sparse_enough(pmap, [(c + 1) / 256 for c in cuts]).select("video_id", F.col("threshold").alias("level"))
    cut = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit((c + 1) / 256).alias("level")) for k, c in enumerate(cuts)]))
    active = pmap.withColumn("cut", cut).filter(F.col("p") > F.col("cut.level")).withColumn("level", F.col("cut.level"))
    active = active.join(F.broadcast(usable), ["video_id", "level"], "left_semi")  # a row a video and threshold
    found = frame_regions(active.withColumn("video_id", F.col("video_id").cast("long") * len(cuts) + F.col("cut.k")), ly)
    which = F.array(*map(F.lit, cuts))[F.pmod("video_id", F.lit(len(cuts))).cast("int")]
    return found.withColumn("video_id", F.struct(F.floor(F.col("video_id") / len(cuts)).alias("video_id"), which.alias("thresh_pmap")))


def _grid_scores(found: Masks, gt: DataFrame, lists: dict[str, list]) -> DataFrame:
    """Scores of every video and combination; those without any mask score 0."""
    ids = found.pixels.select("video_id", F.col("id").alias("mask_id"), "p")
    passing = sweep_cons(found.times, lists["cons"], ["video_id", "id"]).select("video_id", F.col("id").alias("mask_id"), "cons")
    wanted = gt.select(F.col("video_id").cast("long").alias("video_id"), "gt_id", "p")
    for k in GRID:
        wanted = wanted.withColumn(k, F.explode(F.array(*map(F.lit, lists[k]))))
    wanted = wanted.select(F.struct("video_id", *stages.ORDER).alias("video_id"), "cons", "gt_id", "p")
    got = scores(wanted, ids.join(passing, ["video_id", "mask_id"]), 0.5, ["video_id", "cons"]).filter("n_gt > 0")
    return got.select("video_id.*", "cons", "recall", "precision", "f1")


def grid_search(pmap: DataFrame, gt: DataFrame, ly: int, lists: dict[str, list], base: dict) -> DataFrame:
    """Scores of every combination of lists (GRID) as a tree of stages (stages.merged); run lengths are swept last.
    pmap (video_id, t, x, y, p), gt (video_id, gt_id, p)."""
    m = stages.merged(materialise(_regions_by_cut(pmap, ly, lists["thresh_pmap"]), "regions"), ly, lists, base)
    return _grid_scores(Masks(binarised(m.pixels, base["thresh_mask"]), m.times), gt, lists)


def scored_grid_search(packed: DataFrame, scorer, gt: DataFrame, ly: int, lists: dict[str, list], base: dict) -> DataFrame:
    """T4: from packed SNR frames (video_id, t, px) to scores of every combination: a user's scorer gives probabilities (N1),
    which are put into 256 steps (P6) and swept. thresh_pmap counts in those steps."""
    scored = unpack(score_frames(packed, scorer), ly)
    p = (bucket(F.col("v")) + F.lit(0.5)) / 256
    return grid_search(scored.select("video_id", "t", "x", "y", p.alias("p")), gt, ly, lists, base)


def online_grid_search(pmap: DataFrame, gt: DataFrame, ly: int, lists: dict[str, list], base: dict, first: int, every: int) -> DataFrame:
    """As grid_search(), with frames merged window by window (the first `first`, then `every` at a time), and once more at
    the end. The windows' own merges (M8) are one tree of stages, with the window in the key; then BLOCK_WINDOWS windows at a
    time, a folder of their own, join the masks before, one after the other inside the group of a video and combination."""
    regions = _regions_by_cut(pmap, ly, lists["thresh_pmap"]).withColumn("window", block_of(F.col("t"), first, every))
    regions = materialise(regions.withColumn("video_id", F.struct("video_id.video_id", "window", "video_id.thresh_pmap")).drop("window"), "regions")
    m = stages.merged(regions, ly, lists, base)
    key = ["video_id", *stages.ORDER]
    flat = [materialise(t.select(*[F.col(f"video_id.{k}").alias(k) for k in (*key, "window")], *[c for c in t.columns if c != "video_id"]), "windows") for t in m]
    rows = as_rows(Masks(*flat), [*key, "window"]).withColumn("block", F.expr(f"window div {BLOCK_WINDOWS}"))
    rows, state = materialise(rows, "windows", by="block"), None
    for k in range(int(rows.agg(F.max("block")).first()[0] or 0) + 1):
        block = rows.filter(F.col("block") == k).drop("block")
        joined = merge_windows(block if state is None else block.unionByName(state.withColumn("window", F.lit(-1).cast("long"))), key, base["thresh_mask"])
        after = materialise(joined, "masks")
        if state is not None:
            drop(state)
        state = after
    params = base | {"thresh_iou": F.col("video_id.thresh_iou"), "avg_area": F.col("video_id.avg_area"), "cons": 1}
    found = from_rows(state.withColumn("video_id", F.struct(*key)))
    return _grid_scores(final_merge(Masks(*(materialise(t, "masks") for t in found)), params), gt, lists)


def cross_validated(each: DataFrame, strategy: str, params: list[str]) -> DataFrame:
    """T5: from scores of every video and combination, the best combination of each fold by its training videos' mean."""
    return best(mean_over_training(each, folds(each, strategy), params).withColumn("f1", F.round("f1", 9)), params)
