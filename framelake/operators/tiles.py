"""Pairs of masks that share a pixel which very many masks hold, by blocks of masks: a task takes two blocks, counts shared
pixels as a product of matrices and gives out what reaches the threshold. No pairs are shuffled, nor candidates written."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelake.operators.graph import forest

#: Masks of a block, about; masks and pixels whose dense counts a task holds at a time.
BLOCK_MASKS, STEP_MASKS, STEP_PIXELS = 8192, 1024, 4096
#: Above this number of pixels sums of 32-bit floats could be off by more than the slack.
EXACT_PIXELS = 1 << 17


class Block(NamedTuple):
    """Masks of a block: ids, whether each has copies, numbers of pixels, of those before the block's pixel in the order of all,
    and the pixels themselves, mask after mask."""
    ids: np.ndarray
    several: np.ndarray
    n: np.ndarray
    before: np.ndarray
    px: np.ndarray

    def rows(self, keep: np.ndarray) -> Block:
        return Block(self.ids[keep], self.several[keep], self.n[keep], self.before[keep], self.px[np.repeat(keep, self.n)])


FIELDS = {"ids": "<i8", "several": "?", "n": "<i8", "before": "<i8", "px": "<i8"}


def _pack(key: list[str]) -> Callable[[pa.Table], pa.Table]:
    def run(table: pa.Table) -> pa.Table:
        px = table.column("px").combine_chunks()
        flat = {"ids": table.column("mask_id"), "several": table.column("several"), "n": pa.compute.list_value_length(px), "before": table.column("before"), "px": px.flatten()}
        return pa.table({**{c: table.column(c).slice(0, 1) for c in key}, **{c: pa.array([np.asarray(x).astype(FIELDS[c]).tobytes()], pa.binary()) for c, x in flat.items()}})

    return run


def _dense(b: Block, a: int, z: int, cols: np.ndarray, weight: float, first: float, kind: type) -> np.ndarray:
    """Masks a to z by the pixels `cols`: `weight` where a mask holds one, `first` if that is before the block's pixel."""
    ends = np.cumsum(b.n)
    lo, n = int(ends[a] - b.n[a]), b.n[a:z]
    px, row = b.px[lo : int(ends[z - 1])], np.repeat(np.arange(z - a), n)
    place = np.arange(len(px)) - np.repeat(np.cumsum(n) - n, n)
    at = np.minimum(np.searchsorted(cols, px), len(cols) - 1)
    held = cols[at] == px
    out = np.zeros((z - a, len(cols)), kind)
    out[row[held], at[held]] = np.where(place[held] < np.repeat(b.before[a:z], n)[held], first, weight)
    return out


def block_pairs(a: Block, b: Block, threshold: float, iou: bool, same: bool) -> Iterator[tuple[np.ndarray, ...]]:
    """(row of a, row of b, shared pixels) of pairs that reach the threshold and share no pixel before the blocks' own one.
    same: a and b are one block, of which each pair comes once."""
    if not len(a.ids) or not len(b.ids):
        return
    top = int(max(a.n.max(), b.n.max()))
    kind = np.float32 if top < EXACT_PIXELS else np.float64
    slack, far = 1e-3 + 1e-5 * top, -4.0 * top - 10
    cols = np.intersect1d(a.px, b.px)
    of_a, of_b = (threshold if iou else 0.0) * a.n, threshold * b.n
    for x in range(0, len(a.ids), STEP_MASKS):
        z = min(x + STEP_MASKS, len(a.ids))
        for y in range(x if same else 0, len(b.ids), STEP_MASKS):
            w = min(y + STEP_MASKS, len(b.ids))
            # The margin is the number of shared pixels above what the threshold asks for, times 1 + threshold for IoU.
            margin = np.stack([-of_a[x:z], np.ones(z - x)], 1).astype(kind) @ np.stack([np.ones(w - y), -of_b[y:w]]).astype(kind)
            for c in range(0, len(cols), STEP_PIXELS):
                some = cols[c : c + STEP_PIXELS]
                margin += _dense(a, x, z, some, 1 + threshold if iou else 1.0, far, kind) @ _dense(b, y, w, some, 1.0, 1.0, kind).T
            hit = np.flatnonzero(margin.ravel() >= -slack)
            i, j = hit // (w - y), hit % (w - y)
            inter = margin.ravel()[hit].astype(float) + of_a[x:z][i] + of_b[y:w][j]
            inter = np.rint(inter / (1 + threshold) if iou else inter).astype(np.int64)
            i, j = i + x, j + y
            keep = inter / (a.n[i] + b.n[j] - inter if iou else b.n[j]) >= threshold
            keep &= i < j if same else a.ids[i] != b.ids[j]
            yield i[keep], j[keep], inter[keep]


def _choices(a: Block, b: Block | None, copies: bool | None) -> list[tuple[Block, Block, bool]]:
    """The blocks to compare: all of them, or pairs of masks without copies, or those of which one has."""
    same = b is None
    b = a if b is None else b
    if copies is None:
        return [(a, b, same)]
    one, other = (x.rows(~x.several) for x in (a, b))
    if not copies:
        return [(one, other, same)]
    many, others = (x.rows(x.several) for x in (a, b))
    return [(many, others, same), (many, other, False), *([] if same else [(one, others, False)])]


def _fewer(a: Block, b: Block, i: np.ndarray, j: np.ndarray, top: float) -> tuple[np.ndarray, ...]:
    """Pairs (id, id, pixels, pixels) in place of these that connect the same masks, of those with at most `top` pixels, and of
    which the larger (of equal ones the first) are the same masks, of those with more."""
    ia, ib, na, nb = a.ids[i], b.ids[j], a.n[i], b.n[j]
    big = np.maximum(na, nb) > top
    _, first = np.unique(np.where(nb > na, ib, ia)[big], return_index=True)
    ends = [x[big][first] for x in (ia, ib, na, nb)]
    ids, at = np.unique(np.concatenate([ia, ib]), return_index=True)
    n = np.concatenate([na, nb])[at]
    low, high = forest(ia[~big], ib[~big])
    return tuple(np.concatenate([x, y]) for x, y in zip(ends, (low, high, n[np.searchsorted(ids, low)], n[np.searchsorted(ids, high)]), strict=True))


def tile_pairs(postings: DataFrame, measure: str, copies: bool | None = None, links: bool = False) -> DataFrame:
    """postings (video_id, p, f, side, mask_id, several, before, px, threshold, top): for each pixel p its f masks, of side 0 and,
    for 'contain', those of side 1 that can be contained; px all pixels of a mask in an order of the whole video, `before`
    of them before p -> (video_id, a, b, area_a, area_b, inter). For 'iou' a < b. A pair comes once, at its first shared
    pixel. copies: None for all pairs, or those in which a mask has copies, or those in which none has. links: pairs that
    _fewer() leaves, without inter."""
    iou, key = measure == "iou", ["video_id", "p", "side", "block", "n_blocks", "threshold", "top"]
    spark, kind = postings.sparkSession, dict(postings.dtypes)["video_id"]
    n_blocks = F.ceil(F.col("f") / BLOCK_MASKS).cast("long")
    dealt = postings.withColumns({"n_blocks": n_blocks, "block": F.pmod(F.xxhash64("mask_id"), n_blocks)})
    schema = f"video_id {kind}, p long, side int, block long, n_blocks long, threshold double, top double, " + ", ".join(f"{c} binary" for c in FIELDS)
    blocks = dealt.groupBy(*key).applyInArrow(_pack(key), schema)
    last, tile = F.col("n_blocks") - 1, ["video_id", "p", "i", "j"]
    # For IoU a block meets itself and those after it; a side of its own meets all blocks of the other.
    partner = F.explode(F.sequence(F.col("block") if iou else F.lit(0).cast("long"), last))
    left = blocks.filter("side = 0").withColumn("j", partner).withColumnRenamed("block", "i")
    others = F.explode(F.filter(F.sequence(F.lit(0).cast("long"), last), lambda k: (k < F.col("block")) if iou else F.lit(True)))
    right = blocks.filter("side = 0" if iou else "side = 1").withColumn("i", others).withColumnRenamed("block", "j")
    n_parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    # Blocks are small and their comparison long, so the parts' number is given: it must not follow from their bytes.
    left = left.repartition(n_parts, *tile).select(*tile, "threshold", "top", *[F.col(c).alias(f"{c}_a") for c in FIELDS])
    right = right.repartition(n_parts, *tile).select(*tile, *[F.col(c).alias(f"{c}_b") for c in FIELDS])
    tiles = left.join(right.hint("merge"), tile, "left" if iou else "inner")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                one, other = ([batch.column(f"{c}_{s}")[k].as_py() for c in FIELDS] for s in "ab")
                one, other = (None if x[0] is None else Block(*map(np.frombuffer, x, FIELDS.values())) for x in (one, other))
                threshold, top = batch.column("threshold")[k].as_py(), batch.column("top")[k].as_py()
                for a, b, same in _choices(one, other, copies):
                    held = []
                    for i, j, inter in block_pairs(a, b, threshold, iou, same):
                        if links:
                            held.append(_fewer(a, b, i, j, top))
                        elif len(i):
                            yield _rows(batch.column("video_id").slice(k, 1), a.ids[i], b.ids[j], a.n[i], b.n[j], inter)
                    if held:
                        yield _rows(batch.column("video_id").slice(k, 1), *(np.concatenate(x) for x in zip(*held, strict=True)), None)

    def _rows(video: pa.Array, a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, inter: np.ndarray | None) -> pa.RecordBatch:
        if iou:
            turned = a > b
            a, b, na, nb = np.where(turned, b, a), np.where(turned, a, b), np.where(turned, nb, na), np.where(turned, na, nb)
        shared = pa.nulls(len(a), pa.int32()) if inter is None else pa.array(inter, pa.int32())
        return pa.RecordBatch.from_arrays([video.take(pa.array(np.zeros(len(a), np.int64))), pa.array(a), pa.array(b), pa.array(na, pa.int32()), pa.array(nb, pa.int32()), shared], names=["video_id", "a", "b", "area_a", "area_b", "inter"])

    return tiles.mapInArrow(run, f"video_id {kind}, a long, b long, area_a int, area_b int, inter int")
