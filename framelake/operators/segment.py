"""Connected regions of active pixels in each frame."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

REGION = ["video_id", "t", "seg"]


def region_labels(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Index of the first pixel, in raster order, of each pixel's 4-connected region; x, y sorted in raster order."""
    width = int(y.max()) + 2
    p = x * width + y
    down = np.searchsorted(p, p + width)
    down = np.where((down < len(p)) & (p[np.minimum(down, len(p) - 1)] == p + width), down, -1)
    right = np.concatenate([p[1:] == p[:-1] + 1, [False]])
    a = np.concatenate([np.flatnonzero(right), np.flatnonzero(down >= 0)])
    b = np.concatenate([np.flatnonzero(right) + 1, down[down >= 0]])
    label = np.arange(len(p))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def frame_regions(active: DataFrame, ly: int) -> DataFrame:
    """G1: active pixels (video_id, t, x, y, ..) -> (video_id, t, seg, x, y, p), seg being the smallest p of the region. A
    frame is bounded by the sensor's size, so one task labels a frame."""
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("x", "ascending"), ("y", "ascending")])
        x, y = (np.asarray(table.column(c)).astype(np.int64) for c in ("x", "y"))
        p = x * ly + y
        n = len(p)
        return pa.table({"video_id": table.column("video_id"), "t": table.column("t"), "seg": pa.array(p[region_labels(x, y)]), "x": pa.array(x), "y": pa.array(y), "p": pa.array(p)}) if n else table

    cells = active.select(F.col("video_id").cast("long").alias("video_id"), F.col("t").cast("long").alias("t"), F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y")).distinct()
    return cells.groupBy("video_id", "t").applyInArrow(run, "video_id long, t long, seg long, x long, y long, p long")


def region_stats(pixels: DataFrame) -> DataFrame:
    """Area, centre and bounding box of each region."""
    return pixels.groupBy(*REGION).agg(F.count("*").alias("area"), F.avg("x").alias("cx"), F.avg("y").alias("cy"), F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1"))


def larger(stats: DataFrame, grid: DataFrame) -> DataFrame:
    """Regions segmented once, then kept for each min_area of a grid that they exceed."""
    return stats.join(F.broadcast(grid.select("min_area")), F.col("area") > F.col("min_area"))


def _around(grid: np.ndarray) -> list[np.ndarray]:
    """The inner cells of a grid and their four neighbours."""
    return [grid[1:-1, 1:-1], grid[:-2, 1:-1], grid[2:, 1:-1], grid[1:-1, :-2], grid[1:-1, 2:]]


def core_labels(x: np.ndarray, y: np.ndarray, ly: int) -> np.ndarray:
    """For each pixel of a region, the smallest pixel number of the core that reaches it first (of several at once, of the
    largest such number). Cores are the connected sets of pixels whose distance to the edge is above 0.7 of the largest."""
    shape = int(x.max() - x.min()) + 3, int(y.max() - y.min()) + 3
    i, j = x - x.min() + 1, y - y.min() + 1
    grid, inside, depth = np.zeros(shape, np.int64), np.zeros(shape, bool), np.zeros(shape, np.int64)
    inside[i, j] = True
    left = inside
    while left.any():
        depth += left
        inner = left.copy()
        inner[1:-1, 1:-1] = np.all(_around(left), 0)
        left = inner
    core = depth[i, j] > 0.7 * depth.max()
    p = x * ly + y
    grid[i[core], j[core]] = p[np.flatnonzero(core)[region_labels(x[core], y[core])]] + 1
    while True:
        new = grid.copy()
        new[1:-1, 1:-1] = np.where(inside[1:-1, 1:-1] & (grid[1:-1, 1:-1] == 0), np.max(_around(grid), 0), grid[1:-1, 1:-1])
        if (new == grid).all():
            return grid[i, j] - 1
        grid = new


def pieces(x: np.ndarray, y: np.ndarray, ly: int, min_area: int, avg_area: int) -> list[tuple[int, np.ndarray]]:
    """(label, pixel indices) of the pieces of a region: whatever is above avg_area is split again, until it has one core or all
    of its parts would be of at most min_area; then it stays as it is. Other parts of at most min_area go."""
    todo, out = [(int(x[0] * ly + y[0]), np.arange(len(x)))], []
    while todo:
        label, own = todo.pop()
        if len(own) > avg_area:
            found = core_labels(x[own], y[own], ly)
            parts = [(int(k), own[found == k]) for k in np.unique(found)]
            good = [part for part in parts if len(part[1]) > min_area]
            if len(parts) > 1 and good:
                todo += good
                continue
        out.append((label, own))
    return out


def split_large(pixels: DataFrame, min_area: int, avg_area: int, ly: int) -> DataFrame:
    """Regions above avg_area are split around their inner cores, and their pieces again (pieces()). Pieces weigh 1/4 and
    aren't whole; a region that isn't split stays whole. One group is a frame,
    as in frame_regions(), so its shuffle serves both. (video_id, t, seg, piece, x, y, p, w, whole)."""
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("seg", "ascending"), ("x", "ascending"), ("y", "ascending")])
        seg, x, y = (np.asarray(table.column(c)).astype(np.int64) for c in ("seg", "x", "y"))
        at, piece, whole = [], [], []
        cut = [0, *(np.flatnonzero(np.diff(seg)) + 1).tolist(), len(seg)]
        for a, b in zip(cut, cut[1:], strict=False):
            found = pieces(x[a:b], y[a:b], ly, min_area, avg_area)
            whole.append(np.full(sum(len(own) for _, own in found), len(found) == 1 and len(found[0][1]) == b - a))
            for label, own in found:
                at.append(a + own)
                piece.append(np.full(len(own), label))
        at, piece, whole = np.concatenate(at), np.concatenate(piece), np.concatenate(whole)
        table, x, y = table.take(pa.array(at)), x[at], y[at]
        w = np.where(whole, 1.0, 0.25)
        return pa.table({"video_id": table.column("video_id"), "t": table.column("t"), "seg": table.column("seg"), "piece": pa.array(piece), "x": pa.array(x), "y": pa.array(y), "p": pa.array(x * ly + y), "w": pa.array(w), "whole": pa.array(whole)})

    return pixels.groupBy("video_id", "t").applyInArrow(run, "video_id long, t long, seg long, piece long, x long, y long, p long, w double, whole boolean")
