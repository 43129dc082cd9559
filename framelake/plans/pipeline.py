"""The batch pipeline: preprocess, score, segment, merge."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelake.functions.scalar import logistic_score
from framelake.operators.baseline import frame_median_subtract, mad_snr, median_normalise, snr
from framelake.operators.joins import MASK, silenced
from framelake.operators.merge import Masks, complete
from framelake.operators.score import high_pass
from framelake.operators.segment import frame_regions
from framelake.operators.temporal import aligned_waveforms, average_waveform, decay_time, fir_filter, spikes
from framelake.sources.frames import clipped, pack, unpack

DEFAULTS = {"min_area": 30, "avg_area": 177, "thresh_mask": 0.5, "thresh_com0": 2.0, "thresh_com": 6.0, "thresh_iou": 0.5, "cons": 1}


def preprocess(frames: DataFrame, kernel: list[float] | None = None, gauss: float | None = None, dims: tuple[int, int] | None = None, subtract: bool = False, use_snr: bool = True, every: int = 1) -> DataFrame:
    """spatial filter, temporal filter, frame median and SNR (or median level), each optional; column snr."""
    out = clipped(frames)
    if gauss is not None:
        if subtract:
            raise ValueError("the frame median is for videos without spatial filter")
        out = unpack(high_pass(pack(out, dims[1]), dims[0], dims[1], gauss), dims[1])
    if kernel is not None:
        out = fir_filter(out, kernel)
    if subtract:
        out = frame_median_subtract(out)
    return snr(out, every) if use_snr else median_normalise(out).withColumn("snr", F.col("v"))


def find_regions(frames: DataFrame, ly: int, params: dict, kernel: list[float] | None = None, probability: float = 0.5) -> Masks:
    """All steps from frames to merged masks with their active times."""
    ready = preprocess(frames, kernel)
    active = ready.filter(logistic_score(F.col("snr")) > probability)
    return complete(frame_regions(active, ly), ly, DEFAULTS | params)


def build_template(traces: DataFrame, masks: DataFrame, low: float = 5.0, high: float = 6.0, before: int = 5, after: int = 20) -> tuple[DataFrame, DataFrame]:
    """(waveform (rel, v), decay (video_id, tau, half_life)): the mean shape of lone spikes of masks that no overlapping
    mask disturbs. traces (video_id, mask_id, t, v), masks (video_id, mask_id, px)."""
    z = mad_snr(traces, MASK).filter("snr is not null")
    quiet = silenced(z.filter(F.col("snr") > low).select(*MASK, "t"), masks).withColumn("quiet", F.lit(True))
    marked = z.join(quiet, [*MASK, "t"], "left").withColumn("quiet", F.coalesce("quiet", F.lit(False)))
    waves = aligned_waveforms(z, spikes(marked, MASK, low, high, before, after).select(*MASK, "t"), MASK, before, after)
    by_video = waves.groupBy("video_id", "rel").agg(F.avg("v").alias("v"))
    tau = decay_time(by_video, 0.36787944117144233, ["video_id"]).withColumnRenamed("decay", "tau")
    half = decay_time(by_video, 0.5, ["video_id"]).select("video_id", (F.col("decay") / F.log(F.lit(2.0))).alias("half_life"))
    return average_waveform(waves), tau.join(half, "video_id", "left")
