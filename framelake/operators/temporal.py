"""Windows over frames: filters, runs, lagged baselines, spikes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framelake.sources.frames import PIXEL


def fir_filter(frames: DataFrame, kernel: list[float]) -> DataFrame:
    """v[t] = sum of v[t + l] * kernel[l] where all of it exists. Frames must be dense in t."""
    w = Window.partitionBy(*PIXEL).orderBy("t")
    total = sum((F.lead("v", l).over(w) * k for l, k in enumerate(kernel) if l), F.col("v") * kernel[0])
    return frames.withColumns({"_v": total, "_last": F.lead("t", len(kernel) - 1).over(w)}).filter("_last is not null").drop("v", "_last").withColumnRenamed("_v", "v")


def fir_filter_long(frames: DataFrame, kernel: DataFrame, length: int) -> DataFrame:
    """W1 for long kernels: kernel (l, w) joined on t + l, partial sums before the shuffle."""
    moved = frames.join(F.broadcast(kernel.filter(F.col("l") < length)), F.lit(True)).select(*PIXEL, (F.col("t") - F.col("l")).alias("t"), (F.col("v") * F.col("w")).alias("v"))
    return moved.groupBy(*PIXEL, "t").agg(F.sum("v").alias("v"), F.count("*").alias("n")).filter(F.col("n") == length).drop("n")


def runs(active: DataFrame, key: list[str]) -> DataFrame:
    """Maximal runs of consecutive distinct t a key: (key, start, length)."""
    w = Window.partitionBy(*key).orderBy("t")
    return active.select(*key, "t").distinct().withColumn("_island", F.col("t") - F.row_number().over(w)).groupBy(*key, "_island").agg(F.min("t").alias("start"), F.count("*").alias("length")).drop("_island")


def has_run(active: DataFrame, key: list[str], cons: int) -> DataFrame:
    """Keys with `cons` consecutive t."""
    w = Window.partitionBy(*key).orderBy("t")
    return active.select(*key, "t").distinct().withColumn("_b", F.lag("t", cons - 1).over(w)).filter(F.col("t") - F.col("_b") == cons - 1).select(*key).distinct()


def newly_confirmed(active: DataFrame, confirmed: DataFrame, key: list[str], cons: int) -> DataFrame:
    """The run test only for keys that aren't confirmed yet."""
    return has_run(active.join(confirmed.select(*key).distinct(), key, "left_anti"), key, cons)


def block_of(t: Column, first: int, size: int) -> Column:
    """Block 0 is t < first; then blocks of `size` frames."""
    return F.when(t < first, 0).otherwise(1 + F.floor((t - first) / size)).cast("long")


def lagged_block_normalise(frames: DataFrame, baseline, first: int, size: int) -> DataFrame:
    """Block b is normalised with block b-1's median and noise, block 0 with its own."""
    blocked = frames.withColumn("block", block_of(F.col("t"), first, size))
    stats = baseline(blocked, [*PIXEL, "block"]).select(*PIXEL, F.explode(F.when(F.col("block") == 0, F.array(F.lit(0), F.lit(1)).cast("array<long>")).otherwise(F.array(F.col("block") + 1))).alias("block"), "med", "noise")
    z = F.when(F.col("noise").isNull(), F.lit(0.0)).otherwise((F.col("v") - F.col("med")) / F.col("noise"))
    return blocked.join(stats, [*PIXEL, "block"]).withColumn("snr", z)


def lagged_level(frames: DataFrame, first: int, size: int) -> DataFrame:
    """Block b is divided by the mean pixel median of block max(b-1, 0), taken before any division, at least 1."""
    blocked = frames.withColumn("block", block_of(F.col("t"), first, size))
    med = blocked.groupBy(*PIXEL, "block").agg(F.percentile("v", 0.5).alias("med"))
    level = med.groupBy("video_id", "block").agg(F.avg("med").alias("level"))
    level = level.select("video_id", F.explode(F.when(F.col("block") == 0, F.array(F.lit(0), F.lit(1)).cast("array<long>")).otherwise(F.array(F.col("block") + 1))).alias("block"), "level")
    return blocked.join(F.broadcast(level), ["video_id", "block"]).withColumn("v", F.col("v") / F.greatest(F.lit(1.0), "level"))


def spikes(traces: DataFrame, key: list[str], low: float, high: float, before: int, after: int) -> DataFrame:
    """Islands of low < snr < high that stand at least before + after frames from other islands and from both ends of
    the trace, with no sample above `high` in between, and hold exactly one strict peak: (key, t, peak). With a column
    `quiet`, all frames of an island must be quiet."""
    w, whole = Window.partitionBy(*key).orderBy("t"), Window.partitionBy(*key)
    f = traces.withColumns({"in": (F.col("snr") > low) & (F.col("snr") < high), "from": F.min("t").over(whole), "to": F.max("t").over(whole)})
    f = f.withColumns({"first": F.col("in") & ~F.coalesce(F.lag("in").over(w), F.lit(False)), "over": F.col("snr") > high})
    f = f.withColumns({"island": F.sum(F.col("first").cast("int")).over(w), "top": F.col("in") & (F.col("snr") > F.lag("snr").over(w)) & (F.col("snr") > F.lead("snr").over(w))})
    quiet = F.min(F.when(F.col("in"), F.col("quiet").cast("int"))) if "quiet" in traces.columns else F.lit(1)
    inside = lambda c: F.when(F.col("in"), F.col(c))
    spans = f.groupBy(*key, "island", "from", "to").agg(F.min(inside("t")).alias("a"), F.max(inside("t")).alias("b"), F.max(F.col("over").cast("int")).alias("over_after"), F.sum(F.col("top").cast("int")).alias("tops"), F.max(F.when(F.col("top"), F.struct("snr", "t"))).alias("top"), quiet.alias("quiet"))
    v = Window.partitionBy(*key).orderBy("island")
    spans = spans.withColumns({"gap_before": F.col("a") - F.coalesce(F.lag("b").over(v), F.col("from")), "gap_after": F.coalesce(F.lead("a").over(v), F.col("to")) - F.col("b"), "over_before": F.lag("over_after").over(v)})
    far = before + after
    alone = (F.col("gap_before") >= far) & (F.col("gap_after") >= far) & (F.coalesce("over_before", F.lit(0)) == 0) & (F.col("over_after") == 0)
    return spans.filter((F.col("island") > 0) & alone & (F.col("tops") == 1) & (F.col("quiet") == 1)).select(*key, F.col("top.t").alias("t"), F.col("top.snr").alias("peak"))


def aligned_waveforms(traces: DataFrame, peaks: DataFrame, key: list[str], before: int, after: int, value: str = "snr") -> DataFrame:
    """Samples from -before to +after around each peak over the peak's value: (key, peak_t, rel, v). An equi-join on
    the exploded sample times, no range join."""
    wanted = peaks.select(*key, F.col("t").alias("peak_t"), F.explode(F.sequence(F.lit(-before), F.lit(after))).alias("rel"))
    around = wanted.withColumn("t", F.col("peak_t") + F.col("rel")).join(traces.select(*key, "t", F.col(value).alias("v")), [*key, "t"])
    tops = around.filter("rel = 0").select(*key, "peak_t", F.col("v").alias("top"))
    return around.join(tops, [*key, "peak_t"]).filter(F.col("top") != 0).select(*key, "peak_t", "rel", (F.col("v") / F.col("top")).alias("v"))


def average_waveform(waves: DataFrame, video: str = "video_id") -> DataFrame:
    """Mean over events of a video, then over videos."""
    return waves.groupBy(video, "rel").agg(F.avg("v").alias("v")).groupBy("rel").agg(F.avg("v").alias("v"))


def decay_time(wave: DataFrame, level: float, key: list[str]) -> DataFrame:
    """Last tenth of a frame at which the linearly interpolated wave exceeds `level`, counted from the peak."""
    w = Window.partitionBy(*key).orderBy("rel")
    # Ten points a frame; of the last frame only its own.
    seg = wave.withColumn("_next", F.lead("v").over(w))
    seg = seg.withColumn("_k", F.explode(F.when(F.col("_next").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.lit(9)))))
    at = seg.select(*key, (F.col("rel") + F.col("_k") / 10).alias("at"), (F.col("v") + F.coalesce((F.col("_next") - F.col("v")) * F.col("_k") / 10, F.lit(0.0))).alias("v"))
    return at.filter(F.col("v") > level).groupBy(*key).agg(F.max("at").alias("decay"))
