"""Traces of masks, their background, activity labels and delta F."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelake.functions.scalar import QUARTILE_SIGMA
from framelake.operators.joins import MASK


def mask_traces(frames: DataFrame, pixels: DataFrame, ly: int, dx: int = 0, dy: int = 0) -> DataFrame:
    """(video_id, mask_id, t, raw), the mean over a mask's pixels; dx, dy shift masks onto a cropped video."""
    at = frames.select("video_id", "t", ((F.col("x") + dx) * ly + F.col("y") + dy).cast("long").alias("p"), "v")
    return at.join(pixels.select(*MASK, "p"), ["video_id", "p"]).groupBy(*MASK, "t").agg(F.avg("v").alias("raw"))


def background_pixels(pixels: DataFrame, grid: DataFrame, ly: int, factor: float = 1.5) -> DataFrame:
    """Pixels nearer than round(sqrt(mean area) * factor) to a mask's centre that aren't the mask's own. A mask meets only
    the cells of the square around its centre, by equi-join on the pixel."""
    shape = pixels.groupBy(*MASK).agg(F.avg(F.expr(f"p div {ly}")).alias("cx"), F.avg(F.expr(f"p % {ly}")).alias("cy"), F.count("*").alias("n"))
    reach = shape.groupBy("video_id").agg(F.round(F.sqrt(F.avg("n")) * factor).alias("r"))
    around = lambda c: F.sequence(F.floor(F.col(c) - F.col("r")).cast("long"), F.ceil(F.col(c) + F.col("r")).cast("long"))
    square = shape.join(F.broadcast(reach), "video_id").withColumn("x", F.explode(around("cx"))).withColumn("y", F.explode(around("cy")))
    near = square.filter(F.sqrt(F.pow(F.col("x") - F.col("cx"), 2) + F.pow(F.col("y") - F.col("cy"), 2)) < F.col("r"))
    cells = near.select(*MASK, F.col("x"), F.col("y"), (F.col("x") * ly + F.col("y")).alias("p")).join(grid.select("video_id", F.col("x").cast("long"), F.col("y").cast("long")).distinct(), ["video_id", "x", "y"], "left_semi")
    return cells.join(pixels.select(*MASK, "p"), [*MASK, "p"], "left_anti").select(*MASK, "p")


def background_traces(frames: DataFrame, pixels: DataFrame, ly: int, factor: float = 1.5) -> DataFrame:
    """(video_id, mask_id, t, bg), the median over the surrounding pixels."""
    around = background_pixels(pixels, frames.select("video_id", "x", "y"), ly, factor)
    at = frames.select("video_id", "t", (F.col("x") * ly + F.col("y")).cast("long").alias("p"), "v")
    return at.join(around, ["video_id", "p"]).groupBy(*MASK, "t").agg(F.percentile("v", 0.5).alias("bg"))


def unmixed(raw: DataFrame, bg: DataFrame) -> DataFrame:
    """Raw minus background (0 where a mask has no surroundings)."""
    return raw.join(bg, [*MASK, "t"], "left").withColumn("unmixed", F.col("raw") - F.coalesce("bg", F.lit(0.0)))


def region_traces(frames: DataFrame, pixels: DataFrame, ly: int, sectors: int = 4, reach: float = 5.0) -> DataFrame:
    """(video_id, mask_id, region, t, v): region 0 is the mask, 1..sectors the ring around it cut by angle."""
    ring = background_pixels(pixels, frames.select("video_id", "x", "y"), ly, reach / 2)
    centre = pixels.groupBy(*MASK).agg(F.avg(F.expr(f"p div {ly}")).alias("cx"), F.avg(F.expr(f"p % {ly}")).alias("cy"))
    angle = F.atan2(F.expr(f"p % {ly}") - F.col("cy"), F.expr(f"p div {ly}") - F.col("cx"))
    part = F.least(F.floor((angle + np.pi) / (2 * np.pi) * sectors), F.lit(sectors - 1)) + 1
    own = pixels.select(*MASK, "p", F.lit(0).cast("long").alias("region"))
    cells = ring.join(centre, MASK).select(*MASK, "p", part.cast("long").alias("region")).unionByName(own)
    at = frames.select("video_id", "t", (F.col("x") * ly + F.col("y")).cast("long").alias("p"), "v")
    return at.join(cells, ["video_id", "p"]).groupBy(*MASK, "region", "t").agg(F.avg("v").alias("v"))


def factorised(s: np.ndarray, tol: float, max_rounds: int, seed: int) -> tuple[np.ndarray, np.ndarray, int, bool]:
    """Non-negative w, h with w @ h near s, by multiplicative updates: (w, h, rounds, converged). Every tenth round asks whether the
    error fell by less than tol of the first error, or is nothing beside the data."""
    w, h, rounds, converged = factorised_all(s[None], tol, max_rounds, seed)
    return w[0], h[0], int(rounds[0]), bool(converged[0])


def factorised_all(s: np.ndarray, tol: float, max_rounds: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """factorised() of each of many matrices of one shape, side by side; each stops by itself."""
    def norms(x: np.ndarray) -> np.ndarray:
        return np.sqrt(np.square(x).reshape(len(x), -1).sum(1))

    n, rows, width = s.shape
    rng = np.random.default_rng(seed)
    w, h = (np.repeat(x[None], n, 0) for x in (rng.random((rows, rows)) + 0.1, rng.random((rows, width)) + 0.1))
    out_w, out_h, rounds, converged = np.empty_like(w), np.empty_like(h), np.full(n, max_rounds), np.zeros(n, bool)
    first = last = norms(s - w @ h)
    size, at = norms(s), np.arange(n)
    for k in range(1, max_rounds + 1):
        wt = w.swapaxes(1, 2)
        h *= (wt @ s) / np.maximum(wt @ w @ h, 1e-12)
        ht = h.swapaxes(1, 2)
        w *= (s @ ht) / np.maximum(w @ (h @ ht), 1e-12)
        if k % 10 == 0:
            error = norms(s - w @ h)
            done = (last - error <= tol * first) | (error <= 1e-12 * size)
            last = error
            if done.any():
                out_w[at[done]], out_h[at[done]], rounds[at[done]], converged[at[done]] = w[done], h[done], k, True
                s, w, h, first, last, size, at = (x[~done] for x in (s, w, h, first, last, size, at))
                if not len(at):
                    break
    out_w[at], out_h[at] = w, h
    return out_w, out_h, rounds, converged


#: Values of masks, about, that components() factorises together.
CHUNK_ROWS = 40_000


def components(traces: DataFrame, tol: float = 1e-4, max_rounds: int = 20_000, seed: int = 0) -> DataFrame:
    """The traces (video_id, mask_id, region, t, v) of each mask's regions as sums of non-negative components, ranked by
    their share in the mask: (video_id, mask_id, rank, share, t, part, level, rounds, converged).

    Traces are shifted to be >= 0 and divided by their median; mixing columns sum to 1, so a share says how much of a component lies
    in region 0; equal shares are ranked by the component's number. part is what the component adds to the mask's own trace,
    in its units: the parts of all ranks plus level, the shift, are the factorised trace. Frames that a region lacks count as
    the lowest value; null values are left out; masks without region 0 give no rows. A task takes its masks one after the
    other, and factorises about CHUNK_ROWS of their values together; a mask's few regions are held whole, a value a frame and
    region.
    """
    OUT = pa.schema([("video_id", pa.int64()), ("mask_id", pa.int64()), ("rank", pa.int64()), ("share", pa.float64()), ("t", pa.int64()), ("part", pa.float64()), ("level", pa.float64()), ("rounds", pa.int64()), ("converged", pa.bool_())])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
        """Columns of rows in the order of their masks, cut between masks."""
        held, n_held, last = [], 0, None
        for batch in batches:
            x = [np.asarray(c) for c in batch.columns]
            if not len(x[0]):
                continue
            new = np.flatnonzero((np.diff(x[0]) != 0) | (np.diff(x[1]) != 0)) + 1
            new = new if last in (None, (x[0][0], x[1][0])) else np.append(0, new)
            last = x[0][-1], x[1][-1]
            if n_held + len(x[0]) >= CHUNK_ROWS and len(new):
                held.append([c[: new[-1]] for c in x])
                yield [np.concatenate(c) for c in zip(*held, strict=True)]
                x, held, n_held = [c[new[-1] :] for c in x], [], 0
            held.append(x)
            n_held += len(x[0])
        if held:
            yield [np.concatenate(c) for c in zip(*held, strict=True)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for video, mask, region, frame, value in whole(batches):
            cuts = np.concatenate([[0], np.flatnonzero((np.diff(video) != 0) | (np.diff(mask) != 0)) + 1, [len(video)]])
            alike = defaultdict(list)
            for x, y in zip(cuts[:-1], cuts[1:], strict=True):
                t, ti = np.unique(frame[x:y], return_inverse=True)
                r, ri = np.unique(region[x:y], return_inverse=True)
                if r[0] == 0:
                    v = value[x:y]
                    level = v.min()
                    s = np.zeros((len(r), len(t)))
                    s[ri, ti] = v - level
                    scale = float(np.median(s)) or 1.0
                    alike[s.shape].append((s / scale, x, t, scale, level))
            for (m, n), found in alike.items():
                s, at, t, scale, level = (np.stack(x) for x in zip(*found, strict=True))
                w, h, rounds, converged = factorised_all(s, tol, max_rounds, seed)
                share = w[:, 0] / np.maximum(w.sum(1), 1e-300)
                order = np.argsort(-share, axis=1, kind="stable")
                part = np.take_along_axis(w[:, 0], order, 1)[:, :, None] * np.take_along_axis(h, order[:, :, None], 1) * scale[:, None, None]
                each = lambda x: np.repeat(x, m * n)  # noqa: B023, E731
                columns = [
                    each(video[at]), each(mask[at]), np.tile(np.repeat(np.arange(m), n), len(at)), np.repeat(np.take_along_axis(share, order, 1).ravel(), n),
                    np.repeat(t[:, None], m, 1).ravel(), part.ravel(), each(level), each(rounds), each(converged),
                ]
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(columns, OUT, strict=True)], schema=OUT)

    typed = traces.filter("v is not null").select(*[F.col(c).cast("long") for c in (*MASK, "region", "t")], F.col("v").cast("double"))
    return typed.repartition(*MASK).sortWithinPartitions(*MASK).mapInArrow(run, "video_id long, mask_id long, rank long, share double, t long, part double, level double, rounds long, converged boolean")


def separate(traces: DataFrame, tol: float = 1e-4, max_rounds: int = 20_000, seed: int = 0) -> DataFrame:
    """(video_id, mask_id, t, unmixed), the component with the largest share in the mask, at the trace's level."""
    return components(traces, tol, max_rounds, seed).filter("rank = 0").select(*MASK, "t", (F.col("part") + F.col("level")).alias("unmixed"))


def activity(traces: DataFrame, ratios: list[float]) -> DataFrame:
    """(video_id, mask_id, t, ratio) of frames whose unmixed value exceeds its median by ratio times the raw noise."""
    q = traces.groupBy(*MASK).agg(F.percentile("unmixed", 0.5).alias("mu"), F.percentile("raw", [0.5, 0.25]).alias("q"))
    sigma = (F.col("q")[0] - F.col("q")[1]) / QUARTILE_SIGMA
    each = traces.join(q, MASK).withColumn("ratio", F.explode(F.array(*map(F.lit, ratios))))
    return each.filter(F.col("unmixed") > F.col("mu") + F.col("ratio") * sigma).select(*MASK, "t", "ratio")


def delta_f(traces: DataFrame, column: str = "raw", key: list[str] = MASK) -> DataFrame:
    """(F - F0) / F0 with F0 the 5th percentile, by mask or by mask and trial; null where F0 is 0. By trial, a negative F0
    counts as 0."""
    low = F.percentile(column, 0.05)
    f0 = traces.groupBy(*key).agg((low if key == MASK else F.greatest(low, F.lit(0.0))).alias("f0"))
    return traces.join(f0, key).withColumn("df", F.when(F.col("f0") != 0, (F.col(column) - F.col("f0")) / F.col("f0")))
