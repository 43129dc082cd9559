"""Frame tables: sources, limits, packing, dense grids and sinks.

frames: (video_id, t, x, y, v), one row a pixel and frame; x is the row, y the column, p = x * ly + y the pixel's number.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PIXEL = ["video_id", "x", "y"]


def read_frames(spark: SparkSession, path: str, clip: bool = True, frames: int | None = None) -> DataFrame:
    """A Parquet frame table; the frame limit reaches the scan, negatives become 0 if asked."""
    df = spark.read.parquet(path)
    if frames is not None:
        df = df.filter(F.col("t") < frames)
    return clipped(df) if clip else df


def clipped(frames: DataFrame) -> DataFrame:
    return frames.withColumn("v", F.greatest("v", F.lit(0.0)))


def events_as_frames(events: DataFrame, seconds: int, width: int = 15) -> DataFrame:
    """Bin an event stream into a dense video: a user is a pixel, a frame is `seconds` long, v sums the values (0 if none).
    Frames run from the start of the first event's day to the end of the last event's day."""
    day = F.unix_timestamp(F.date_trunc("day", F.col("ts").cast("timestamp")))
    low, high = events.agg(F.min(day), F.max(day)).first()
    n_frames = (high - low + 86400) // seconds if low is not None else 0
    at = F.col("ts").cast("timestamp")
    t = F.floor((F.unix_timestamp(at) - F.lit(low or 0)) / seconds)
    binned = events.select(F.col("user_id").alias("pix"), t.alias("t"), "value").groupBy("pix", "t").agg(F.sum("value").alias("v"))
    grid = events.select(F.col("user_id").alias("pix")).distinct().select("pix", F.explode(F.sequence(F.lit(0), F.lit(max(n_frames, 1) - 1)).cast("array<long>")).alias("t"))
    dense = grid.join(binned, ["pix", "t"], "left")
    return dense.select(F.lit(0).alias("video_id"), "t", F.expr(f"pix div {width}").alias("x"), F.expr(f"pix % {width}").alias("y"), F.round(F.coalesce("v", F.lit(0.0)), 6).alias("v"), "pix")


def unpack(packed: DataFrame, ly: int) -> DataFrame:
    """S3: (video_id, t, px array) -> frames."""
    rows = packed.select("video_id", "t", F.posexplode("px").alias("p", "v"))
    return rows.select("video_id", "t", F.expr(f"p div {ly}").alias("x"), F.expr(f"p % {ly}").alias("y"), F.col("v").cast("double").alias("v"))


def pack(frames: DataFrame, ly: int) -> DataFrame:
    """S3: dense frames -> (video_id, t, px), pixels in raster order."""
    cells = F.sort_array(F.collect_list(F.struct((F.col("x") * ly + F.col("y")).alias("p"), "v")))
    return frames.groupBy("video_id", "t").agg(F.transform(cells, lambda c: c["v"]).alias("px"))


def sparse_masks(frames: DataFrame, ly: int) -> DataFrame:
    """S3: dense masks (video_id, mask_id, x, y, w) -> the pixels that aren't 0."""
    return frames.filter(F.col("w") != 0).select("video_id", "mask_id", (F.col("x") * ly + F.col("y")).alias("p"), "w")


def densify(frames: DataFrame, multiple: int = 8) -> DataFrame:
    """All cells of each video's grid, its sides rounded up to `multiple`, with 0 where there was none."""
    dims = video_dims(frames)
    up = lambda c: (F.ceil(F.col(c) / multiple) * multiple - 1).cast("int")
    grid = dims.select("video_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("nt").cast("long") - 1)).alias("t"), "lx", "ly")
    grid = grid.select("video_id", "t", F.explode(F.sequence(F.lit(0), up("lx"))).alias("x"), "ly").select("video_id", "t", "x", F.explode(F.sequence(F.lit(0), up("ly"))).alias("y"))
    return grid.join(frames.select("video_id", "t", F.col("x").cast("int"), F.col("y").cast("int"), "v"), ["video_id", "t", "x", "y"], "left").fillna(0.0, ["v"])


def crop(frames: DataFrame, lx: int, ly: int) -> DataFrame:
    return frames.filter((F.col("x") < lx) & (F.col("y") < ly))


def transpose(masks: DataFrame) -> DataFrame:
    """Swap the axes."""
    return masks.withColumns({"x": F.col("y"), "y": F.col("x")})


def video_dims(frames: DataFrame) -> DataFrame:
    """(video_id, nt, lx, ly)."""
    return frames.groupBy("video_id").agg((F.max("t") + 1).alias("nt"), (F.max("x") + 1).alias("lx"), (F.max("y") + 1).alias("ly"))


def save_by(df: DataFrame, path: str, *keys: str) -> None:
    """SNR, traces, temporal masks (by threshold), results and best parameters, partitioned by key."""
    df.write.mode("overwrite").partitionBy(*keys).parquet(path)


def unfinished(plan: DataFrame, done: DataFrame, keys: list[str], max_eid: int | None = None) -> DataFrame:
    """Planned work without stored results, up to an experiment number."""
    left = plan.join(done.select(*keys).distinct(), keys, "left_anti")
    return left if max_eid is None else left.filter(F.col("eid") <= max_eid)
