"""Structured Streaming: per-frame filtering with state, tumbling merges, sessions, late data."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from framelake.functions.scalar import QUARTILE_SIGMA
from framelake.operators.baseline import baseline
from framelake.operators.joins import as_masks
from framelake.operators.merge import Masks, binarised, confirmed, final_merge, merge_into, merged, track
from framelake.operators.segment import frame_regions, region_stats
from framelake.sources.frames import PIXEL
from framelake.sources.scratch import materialise


def event_stream(spark: SparkSession, path: str, schema, files_per_trigger: int | None = None) -> DataFrame:
    """A file stream of events with ts as an event-time column."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling_activity(events: DataFrame, size: str, watermark: str, key: str = "event_type") -> DataFrame:
    """Counts and sums of each window; rows later than the watermark are dropped."""
    return events.withWatermark("ts", watermark).groupBy(F.window("ts", size), key).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), key, "n", "total")


def session_activity(events: DataFrame, gap: str, watermark: str, key: str = "user_id") -> DataFrame:
    """Runs of activity with pauses shorter than the gap."""
    return events.withWatermark("ts", watermark).groupBy(F.session_window("ts", gap).alias("s"), key).agg(F.count("*").alias("n")).select(key, F.col("s.start").alias("start"), "n")


#: The event clock has a second a frame; frame 0 comes at its first, as a watermark begins at 0.
FRAME_MS = 1000


def in_frame_time(frames: DataFrame, delay: int) -> DataFrame:
    """Frames with an event clock: a frame may come up to `delay` frames after later ones. What hasn't come by then never
    does: its rows are dropped, and a gap is filled with zeros."""
    return frames.withColumn("_at", F.timestamp_millis((F.col("t").cast("long") + 1) * FRAME_MS)).withWatermark("_at", f"{delay} seconds")


def in_order(next_t: int, times: np.ndarray, values: np.ndarray, watermark_ms: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(values of the frames from next_t on that are complete, and what must wait: times and values). Of one frame that comes
    twice the first counts; frames below next_t are late. A missing frame is 0 once the watermark has passed it; nothing is
    filled in beyond the last frame that came."""
    times, first = np.unique(times, return_index=True)
    values, new = values[first], times >= next_t
    times, values = times[new], values[new]
    final = watermark_ms // FRAME_MS - 1
    before = np.concatenate([[next_t - 1], times[:-1]])
    held = np.flatnonzero((times > before + 1) & (times - 1 > final))
    n = int(held[0]) if len(held) else len(times)
    ready = np.zeros(int(times[n - 1]) - next_t + 1 if n else 0)
    ready[times[:n] - next_t] = values[:n]
    return ready, times[n:], values[n:]


#: Groups of keys that share a row of state, if the caller knows no better number: a call of Python a group, not a key.
BUCKETS = 1024


def _ordered(frames: DataFrame, key: list[str], delay: int, name: str, state: str, begin: tuple, work: Callable[[tuple, int, np.ndarray], tuple[tuple, int, np.ndarray]], buckets: int) -> DataFrame:
    """(key, t, name) of frames (key, t, v) in their order. A key's state is what `work` keeps and the frames that wait for
    earlier ones; keys are dealt by hash to `buckets` groups, whose state is a list a column with an entry a key.
    work(kept, t, values from t on) -> (kept, first t, values out). A timer wakes a group when a gap in it has become final."""
    types = dict(frames.dtypes)
    columns = [*[(c, types[c]) for c in key], *[x.split(" ", 1) for x in f"{state}, next_t long, times array<long>, waiting array<double>".split(", ")]]

    def step(_: tuple, pdfs: Iterator[pd.DataFrame], group: GroupState) -> Iterator[pd.DataFrame]:
        known = [list(x) for x in group.get] if group.exists else [[] for _ in columns]
        named, kept = known[: len(key)], [tuple(x) for x in zip(*known[len(key) :], strict=True)]
        new = pd.concat([x for x in pdfs if len(x)] or [pd.DataFrame(columns=[*key, "t", "v"])])
        # Keys by their first appearance, so those of the state keep their places.
        rows = pd.concat([pd.DataFrame(dict(zip(key, named, strict=True))), new[key]]) if kept and len(new) else new[key]
        place = rows.groupby(key, sort=False, dropna=False).ngroup().to_numpy()[len(kept) :] if len(new) else np.empty(0, np.int64)
        if len(kept) <= (top := int(place.max(initial=-1))):
            at = np.unique(place, return_index=True)
            first = at[1][at[0] >= len(kept)]
            for names, c in zip(named, key, strict=True):
                # Beside nulls pandas has whole numbers as floats.
                names += [None if pd.isna(x) else int(x) if types[c] in ("tinyint", "smallint", "int", "bigint") else x for x in new[c].iloc[first].tolist()]
            kept += [(*begin, 0, [], [])] * (top + 1 - len(kept))
        order = np.argsort(place, kind="stable")
        new_t, new_v, edges = new["t"].to_numpy(np.int64)[order], new["v"].to_numpy(float)[order], np.searchsorted(place[order], np.arange(len(kept) + 1))
        watermark, found = group.getCurrentWatermarkMs(), []
        for k, (*own, next_t, times, values) in enumerate(kept):
            a, b = edges[k], edges[k + 1]
            if a == b and not times:
                continue
            times, values = np.concatenate([np.array(times, np.int64), new_t[a:b]]), np.concatenate([np.array(values, float), new_v[a:b]])
            ready, times, values = in_order(next_t, times, values, watermark)
            own, start, out = work(tuple(own), next_t, ready)
            kept[k] = (*own, next_t + len(ready), times.tolist(), values.tolist())
            if len(out):
                found.append((k, start, out))
        group.update((*named, *map(list, zip(*kept, strict=True))))
        held = [k[-2][0] for k in kept if k[-2]]
        if held:
            group.setTimeoutTimestamp(min(held) * FRAME_MS)
        if found:
            n = [len(out) for _, _, out in found]
            t = np.concatenate([np.arange(start, start + len(out)) for _, start, out in found])
            own = np.repeat([k for k, _, _ in found], n)
            yield pd.DataFrame({**{c: pd.Series(x).take(own).to_numpy() for c, x in zip(key, named, strict=True)}, "t": t, name: np.concatenate([out for _, _, out in found])})

    schema = ", ".join(f"{c} {types[c]}" for c in key) + f", t long, {name} double"
    kept = ", ".join(f"_{k} array<{kind}>" for k, (_, kind) in enumerate(columns))
    dealt = frames.select(*key, "t", "v", F.pmod(F.xxhash64(*key), F.lit(buckets)).alias("_bucket"))
    return in_frame_time(dealt, delay).groupBy("_bucket").applyInPandasWithState(step, schema, kept, "append", GroupStateTimeout.EventTimeTimeout)


def streaming_fir(frames: DataFrame, kernel: list[float], key: list[str], delay: int = 0, buckets: int = BUCKETS) -> DataFrame:
    """The temporal filter over frames (key, t, v), t from 0, as they come, up to `delay` frames out of order. A
    key's state is its last len(kernel) - 1 frames and those that wait; output equals fir_filter() of the frames with
    gaps as zeros."""
    taps, n = np.array(kernel, float), len(kernel)

    def work(own: tuple, t: int, values: np.ndarray) -> tuple[tuple, int, np.ndarray]:
        held = np.concatenate([np.array(own[0], float), values])
        out = np.correlate(held, taps, "valid") if len(held) >= n and len(values) else np.empty(0)
        return (held[len(held) - min(n - 1, len(held)) :].tolist(),), t - len(own[0]), out

    return _ordered(frames, key, delay, "v", "held array<double>", ([],), work, buckets)


def _quartile_baseline(values: np.ndarray) -> tuple[float, float | None]:
    """Median and noise of one pixel's block, by the rules of baseline()."""
    high, low = np.percentile(values, [50, 25])
    noise = (high - low) / QUARTILE_SIGMA or float(np.std(values))
    return float(high), float(noise) or None


def streaming_lagged_snr(frames: DataFrame, key: list[str], first: int, size: int, delay: int = 0, buckets: int = BUCKETS) -> DataFrame:
    """Z-scores of frames (key, t, v), t from 0, as they come, up to `delay` frames out of order: each block against
    the baseline of the block before (block 0, the first `first` frames, against its own, and so only when it is
    complete). A key's state is one block of values, one baseline and the frames that wait; output equals
    lagged_block_normalise() of the frames with gaps as zeros."""
    def z(x: np.ndarray, med: float, noise: float | None) -> np.ndarray:
        return np.zeros(len(x)) if noise is None else (x - med) / noise

    def work(own: tuple, t: int, values: np.ndarray) -> tuple[tuple, int, np.ndarray]:
        held, med, noise = np.array(own[0], float), own[1], own[2]
        # Values at hand begin with the open block's; block 0 is put out when it is whole.
        at, start, out = np.concatenate([held, values]), t - len(held), []
        out_from = start if start < first else t
        while True:
            block_end = first if start < first else start + size - (start - first) % size
            take = at[: block_end - start]
            whole = len(take) == block_end - start
            if start < first:
                if not whole:
                    break
                med, noise = _quartile_baseline(take)
                out.append(z(take, med, noise))
            else:
                out.append(z(take[max(0, t - start) :], med, noise))
                if not whole:
                    break
                med, noise = _quartile_baseline(take)
            at, start = at[len(take) :], block_end
        return (at.tolist(), med, noise), out_from, np.concatenate([*out, np.empty(0)])

    return _ordered(frames, key, delay, "snr", "held array<double>, med double, noise double", ([], 0.0, None), work, buckets)


def run_available(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Run a stream over what is there and wait for its end; Parquet sink, exactly once."""
    stream.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def merge_windows(stream: DataFrame, merge_batch, checkpoint: str) -> None:
    """Each micro-batch of frames is merged into a state table by merge_batch(batch, batch_id), which must write
    under the batch's id, so that a batch that runs again replaces its own result."""
    stream.writeStream.foreachBatch(merge_batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def initial_baseline(frames: DataFrame, first_frames: int) -> DataFrame:
    """Medians and noise of the first frames, to normalise the stream by (a stream-static join)."""
    return baseline(frames.filter(F.col("t") < first_frames))


def online_snr(stream: DataFrame, known: DataFrame) -> DataFrame:
    """R2: z-scores of streamed frames against a fixed baseline."""
    z = F.when(F.col("noise").isNull(), F.lit(0.0)).otherwise((F.col("v") - F.col("med")) / F.col("noise"))
    return stream.join(known, PIXEL).withColumn("snr", z).drop("med", "noise")


class OnlineMasks:
    """Masks found so far, as a table with one version a window. Each window's frames are segmented and merged (M8),
    and the result joins the version before (M9). A window that runs again writes the same version again."""

    def __init__(self, spark: SparkSession, folder: str, ly: int, params: dict, active: Callable[[DataFrame], DataFrame]):
        self.spark, self.folder, self.ly, self.params, self.active = spark, folder.rstrip("/"), ly, params, active

    def version(self, k: int) -> Masks:
        return Masks(self.spark.read.parquet(f"{self.folder}/pixels/{k}"), self.spark.read.parquet(f"{self.folder}/times/{k}"))

    def merge_batch(self, frames: DataFrame, k: int) -> None:
        new = merged(frame_regions(self.active(frames), self.ly), self.ly, self.params)
        self.write(merge_into(self.version(k - 1), new, self.params) if k else new, k)

    def write(self, out: Masks, k: int) -> None:
        out.pixels.write.mode("overwrite").parquet(f"{self.folder}/pixels/{k}")
        out.times.write.mode("overwrite").parquet(f"{self.folder}/times/{k}")

    def finish(self, k: int) -> Masks:
        """M11 on the last version."""
        return final_merge(self.version(k), self.params)


class OnlineTracker(OnlineMasks):
    """As OnlineMasks, but each region of a frame first goes to the confirmed mask that contains its centre and fits it
    best (M13). At the end of its window such regions are added to their masks; all others are merged with each other and
    then with the masks that aren't confirmed yet (M10)."""

    def merge_batch(self, frames: DataFrame, k: int) -> None:
        regions = materialise(frame_regions(self.active(frames), self.ly), "regions")
        if not k:
            return self.write(merged(regions, self.ly, self.params), k)
        old = self.version(k - 1)
        sure = materialise(confirmed(old, self.params["cons"]), "confirmed")
        masks = as_masks(binarised(old.pixels.join(sure, ["video_id", "id"], "left_semi"), self.params["thresh_mask"]).withColumnRenamed("id", "mask_id"))
        key = ["video_id", "t", "seg"]
        px = regions.groupBy(*key).agg(F.sort_array(F.collect_set("p")).alias("px"))
        large = region_stats(regions).filter(F.col("area") > self.params["min_area"])
        found = materialise(track(large.join(px, key).withColumnRenamed("seg", "id"), masks, self.ly, self.params).filter("mask_id is not null").withColumnRenamed("id", "seg"), "tracked")
        added = regions.join(found, key)
        tracked = Masks(added.groupBy("video_id", F.col("mask_id").alias("id"), "p").agg(F.count("*").cast("double").alias("w")), added.select("video_id", F.col("mask_id").alias("id"), "t").distinct())
        rest = merged(regions.join(found, key, "left_anti"), self.ly, self.params)
        unsure = old.pixels.select("video_id", "id").distinct().join(sure, ["video_id", "id"], "left_anti")
        out = merge_into(old, rest, self.params, only=unsure)
        pixels = out.pixels.unionByName(tracked.pixels).groupBy("video_id", "id", "p").agg(F.sum("w").alias("w"))
        self.write(Masks(pixels, out.times.unionByName(tracked.times).distinct()), k)
