"""Frame scoring, training of a pixel scorer, and its losses."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Clip of probabilities in logarithms.
TINY = 1e-7


def score_frames(packed: DataFrame, scorer: Callable[[np.ndarray], np.ndarray], batch: int = 200) -> DataFrame:
    """Apply a user's scorer to packed frames (video_id, t, px), up to `batch` frames of one length at a time."""
    def run(batches):
        for b in batches:
            px = b.column("px").to_pylist()
            out: list = [None] * len(px)
            for size in set(map(len, px)):
                own = [k for k, x in enumerate(px) if len(x) == size]
                for i in range(0, len(own), batch):
                    part = own[i : i + batch]
                    for k, y in zip(part, scorer(np.array([px[k] for k in part], float)), strict=True):
                        out[k] = np.asarray(y, float)
            yield pa.RecordBatch.from_arrays([b.column("video_id"), b.column("t"), pa.array(out, pa.list_(pa.float64()))], names=["video_id", "t", "px"])

    types = dict(packed.dtypes)
    return packed.select("video_id", "t", "px").mapInArrow(run, f"video_id {types['video_id']}, t {types['t']}, px array<double>")


def high_pass(packed: DataFrame, lx: int, ly: int, gauss: float, pad: tuple[int, int] | None = None) -> DataFrame:
    """exp of the high-passed log(1 + v): one minus a Gaussian in frequency whose width is rows / (2 pi gauss)."""
    px, py = pad or (lx, ly)

    def scorer(frames: np.ndarray) -> np.ndarray:
        f = np.zeros((len(frames), px, py))
        f[:, :lx, :ly] = np.log1p(frames.reshape(-1, lx, ly))
        u, v = np.fft.fftfreq(px) * px, np.arange(py // 2 + 1)
        g = np.exp(-0.5 * (u / (lx / (2 * np.pi * gauss))) ** 2)[:, None] * np.exp(-0.5 * (v / (ly / (2 * np.pi * gauss))) ** 2)[None]
        return np.exp(np.fft.irfft2(np.fft.rfft2(f) * (1 - g), s=(px, py))[:, :lx, :ly]).reshape(len(frames), -1)

    return score_frames(packed, scorer)


def losses(pairs: DataFrame, dl: float = 1.0, bce: float = 20.0, fl: float = 0.0, gamma: float = 1.0, alpha: float = 0.25, key: list[str] = []) -> DataFrame:  # noqa: B006
    """Dice, cross entropy, focal and weighted total loss over (y, p)."""
    y, p = F.col("y").cast("double"), F.greatest(F.lit(TINY), F.least(F.lit(1 - TINY), F.col("p")))
    dice = (2 * F.sum(y * F.col("p")) + 1) / (F.sum(y * y) + F.sum(F.col("p") * F.col("p")) + 1)
    cross = -F.avg(y * F.log(p) + (1 - y) * F.log(1 - p))
    focal = -F.avg(alpha * y * F.pow(1 - p, gamma) * F.log(p) + (1 - alpha) * (1 - y) * F.pow(p, gamma) * F.log(1 - p))
    return pairs.groupBy(*key).agg(dice.alias("dice"), (1 - dice).alias("dice_loss"), cross.alias("bce"), focal.alias("focal"), (dl * (1 - dice) + bce * cross + fl * focal).alias("total"))


def sampled(frames: DataFrame, start: int, every: int, count: int) -> DataFrame:
    """Every `every`-th frame from `start`, at most `count` of them."""
    k = F.col("t") - start
    return frames.filter((k >= 0) & (k % every == 0) & (k < every * count))


def shuffled(frames: DataFrame, seed: int) -> DataFrame:
    """Frames in an order that the seed fixes."""
    return frames.orderBy(F.xxhash64("video_id", "t", F.lit(seed)), "video_id", "t", "x", "y")


def neighbourhood(snr: DataFrame) -> DataFrame:
    """Features of a pixel and its eight neighbours (0 outside): window functions along columns, then along rows."""
    w = lambda by: Window.partitionBy("video_id", "t", by)
    col = {f"c{d + 1}": F.sum("snr").over(w("x").orderBy("y").rangeBetween(d, d)) for d in (-1, 0, 1)}
    wide = snr.withColumns(col)
    rows = {f"f{d + 1}{k}": F.coalesce(F.sum(f"c{k}").over(w("y").orderBy("x").rangeBetween(d, d)), F.lit(0.0)) for d in (-1, 0, 1) for k in (0, 1, 2)}
    return wide.withColumns(rows).drop("c0", "c1", "c2")


def train_scorer(labelled: DataFrame):
    """Logistic regression on the neighbourhood features of (video_id, t, x, y, snr, y_true); distributed fit."""
    features = VectorAssembler(inputCols=[f"f{i}{j}" for i in range(3) for j in range(3)], outputCol="features")
    data = features.transform(neighbourhood(labelled))
    return LogisticRegression(labelCol="y_true", regParam=1e-4, maxIter=50).fit(data), features
