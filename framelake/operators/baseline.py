"""Robust baselines over time and the normalisations built on them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelake.functions.scalar import QUARTILE_SIGMA
from framelake.operators.quantiles import exact_quantiles
from framelake.sources.frames import PIXEL


def baseline(frames: DataFrame, key: list[str] = PIXEL, every: int = 1) -> DataFrame:
    """A1-A3: (key, med, noise). noise is the quartile distance over QUARTILE_SIGMA; if 0, the population deviation of all
    frames; if that is 0 too, null. With every > 1 the quantiles use each every-th frame."""
    v = F.col("v") if every == 1 else F.when(F.col("t") % every == 0, F.col("v"))
    got = frames.groupBy(*key).agg(F.percentile(v, [0.5, 0.25]).alias("q"), F.stddev_pop("v").alias("sd"))
    noise = (F.col("q")[0] - F.col("q")[1]) / QUARTILE_SIGMA
    return got.select(*key, F.col("q")[0].alias("med"), F.when(noise != 0, noise).when(F.col("sd") > 0, F.col("sd")).alias("noise"))


def long_baseline(frames: DataFrame, key: list[str] = PIXEL) -> DataFrame:
    """A1, A2 for groups of any length, as baseline(): the quantiles come by selection, not from a map of a group's values."""
    q = exact_quantiles(frames, key, "v", [0.5, 0.25])
    got = q.join(frames.groupBy(*key).agg(F.stddev_pop("v").alias("sd")), key)
    noise = (F.col("q")[0] - F.col("q")[1]) / QUARTILE_SIGMA
    return got.select(*key, F.col("q")[0].alias("med"), F.when(noise != 0, noise).when(F.col("sd") > 0, F.col("sd")).alias("noise"))


def snr(frames: DataFrame, every: int = 1) -> DataFrame:
    """A4: z-scores of each pixel against its own baseline; 0 where it never changes."""
    z = F.when(F.col("noise").isNull(), F.lit(0.0)).otherwise((F.col("v") - F.col("med")) / F.col("noise"))
    return frames.join(baseline(frames, every=every), PIXEL).withColumn("snr", z).drop("med", "noise")


def median_normalise(frames: DataFrame) -> DataFrame:
    """A5: v over max(1, mean over pixels of the median over time), a level for each video."""
    level = frames.groupBy(*PIXEL).agg(F.percentile("v", 0.5).alias("m")).groupBy("video_id").agg(F.avg("m").alias("level"))
    return frames.join(F.broadcast(level), "video_id").withColumn("v", F.col("v") / F.greatest(F.lit(1.0), "level")).drop("level")


def frame_median_subtract(frames: DataFrame, dec: int = 2) -> DataFrame:
    """V minus the frame's median over every dec-th row of the row medians over every dec-th column."""
    rows = frames.filter((F.col("y") % dec == 0) & (F.col("x") % dec == 0)).groupBy("video_id", "t", "x").agg(F.percentile("v", 0.5).alias("m"))
    level = rows.groupBy("video_id", "t").agg(F.percentile("m", 0.5).alias("level"))
    return frames.join(level, ["video_id", "t"]).withColumn("v", F.col("v") - F.col("level")).drop("level")


def mean_image(frames: DataFrame) -> DataFrame:
    """A17."""
    return frames.groupBy(*PIXEL).agg(F.avg("v").alias("v"))


def mad_snr(traces: DataFrame, key: list[str]) -> DataFrame:
    """(x - median) over median absolute deviation / QUARTILE_SIGMA; null where the deviation is 0."""
    f0 = traces.groupBy(*key).agg(F.percentile("v", 0.5).alias("f0"))
    off = traces.join(f0, key)
    mad = off.groupBy(*key).agg(F.percentile(F.abs(F.col("v") - F.col("f0")), 0.5).alias("mad"))
    return off.join(mad, key).withColumn("snr", F.when(F.col("mad") > 0, (F.col("v") - F.col("f0")) / (F.col("mad") / QUARTILE_SIGMA))).drop("f0", "mad")
