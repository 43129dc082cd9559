"""Column arithmetic on pixel values, kernels and coordinates."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: sqrt(2) times the inverse error function of 1/2: quartile distance of a unit normal.
QUARTILE_SIGMA = 0.6744897501960817


def log1p(v: Column) -> Column:
    return F.log1p(v)


def exp(v: Column) -> Column:
    return F.exp(v)


def bucket(p: Column) -> Column:
    """Probability -> 0..255."""
    return F.least(F.floor(p * 256), F.lit(255)).cast("int")


def bucket_threshold(thresh_pmap: Column | int) -> Column:
    """The probability above which a bucket exceeds thresh_pmap."""
    return (F.lit(thresh_pmap) + 1) / 256


def masked(frames: DataFrame, mask: DataFrame) -> DataFrame:
    """V times its pixel's weight in mask (x, y, w); pixels without weight become 0."""
    return frames.join(mask, ["x", "y"], "left").withColumn("v", F.col("v") * F.coalesce("w", F.lit(0.0))).drop("w")


def logistic_score(snr: Column, centre: float = 3.0, scale: float = 1.0) -> Column:
    """A score frame without any model: logistic in the SNR."""
    return 1 / (1 + F.exp(-(snr - centre) / scale))


def distance(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return F.sqrt(F.pow(ax - bx, 2) + F.pow(ay - by, 2))


def kernel_from_template(template: DataFrame) -> DataFrame:
    """P10: (l, w) above 1/e, normalised to sum 1; positions closed up."""
    w = template.filter(F.col("w") > math.exp(-1))
    return w.select((F.row_number().over(Window.orderBy("l")) - 1).alias("l"), (F.col("w") / F.sum("w").over(Window.partitionBy())).alias("w"))


def exponential_kernel(rate_hz: float, decay: float) -> list[float]:
    """exp(-i / rate / decay) for i = 0..ceil(rate * decay), normalised."""
    w = [math.exp(-i / rate_hz / decay) for i in range(math.ceil(rate_hz * decay) + 1)]
    return [x / sum(w) for x in w]


def resample_kernel(kernel: list[float], rate: float, to_rate: float) -> list[float]:
    """Linear interpolation to another frame rate, aligned at the peak (a kernel is a short parameter list)."""
    peak = max(range(len(kernel)), key=kernel.__getitem__)
    step, out = rate / to_rate, []
    first, last = -math.floor(peak / step), math.floor((len(kernel) - 1 - peak) / step)
    for k in range(first, last + 1):
        at = peak + k * step
        i = min(int(at), len(kernel) - 1)
        after = kernel[min(i + 1, len(kernel) - 1)]
        out.append(kernel[i] + (after - kernel[i]) * (at - i))
    return out


def scaled(params: DataFrame, mag: str = "mag") -> DataFrame:
    """Areas by the square of the magnification, rounded half to even; distances by it."""
    m = F.col(mag)
    return params.withColumns({c: F.bround(F.col(c) * m * m).cast("long") for c in ("min_area", "avg_area") if c in params.columns} | {c: F.col(c) * m for c in ("thresh_com0", "thresh_com") if c in params.columns})


def augmented(frames: DataFrame, lx: int, ly: int, seed: int = 0) -> DataFrame:
    """Each frame flipped and, if square, turned, as a hash of (video, frame, seed) says; coordinates only."""
    return moved(frames, lx, ly, [F.pmod(F.xxhash64("video_id", "t", F.lit(seed), F.lit(k)), F.lit(2)) == 1 for k in range(3)])


def moved(frames: DataFrame, lx: int, ly: int, coins: list[Column]) -> DataFrame:
    """P15 with coins (flip rows, flip columns, turn) that don't depend on x and y."""
    x, y = F.when(coins[0], lx - 1 - F.col("x")).otherwise(F.col("x")), F.when(coins[1], ly - 1 - F.col("y")).otherwise(F.col("y"))
    out = frames.withColumns({"x": x, "y": y})
    return out.withColumns({"x": F.when(coins[2], ly - 1 - F.col("y")).otherwise(F.col("x")), "y": F.when(coins[2], F.col("x")).otherwise(F.col("y"))}) if lx == ly else out
