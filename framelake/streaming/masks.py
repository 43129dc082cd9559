"""Masks of live videos in keyed state.

A video's masks are one entry each of a map state, so a window writes the masks that it changes and nothing else, and only
these go out. Frames come as rows of their regions; they may come out of order, and a gap is a frame without regions once
the watermark has passed it. Each window's regions are merged with each other (M8) and then into the masks (M9, M10). With
tracking (R5), a region first goes to the confirmed mask that contains its centre and fits it best (M13); such a mask is
active, and takes up all that it was given when a frame comes without a region for it.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from framelake.operators.graph import forest
from framelake.operators.leaders import LEADER, scan
from framelake.operators.merge import Masks
from framelake.operators.segment import region_labels
from framelake.streaming.online import FRAME_MS, in_frame_time

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: A changed mask as it goes out: version counts the frames that the video's state has seen.
CHANGED = "video_id long, version long, id long, p array<long>, w array<double>, times array<long>, confirmed boolean"


class Mask(NamedTuple):
    """Pixels, ascending, their weights, and active frames; what an active mask has been given since it became so."""

    p: np.ndarray
    w: np.ndarray
    times: tuple = ()
    confirmed: bool = False
    active: bool = False
    pending: tuple = ()
    pending_times: tuple = ()


STATE = "p array<long>, w array<double>, times array<long>, confirmed boolean, active boolean, pending array<long>, pending_times array<long>"


def added(*parts: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The sum of weighted pixel sets."""
    p, at = np.unique(np.concatenate([np.asarray(x[0], np.int64) for x in parts]), return_inverse=True)
    return p, np.bincount(at, np.concatenate([np.asarray(x[1], float) for x in parts]), len(p))


def real(m: tuple, threshold: float) -> np.ndarray:
    """A mask's pixels of at least `threshold` times its largest weight."""
    return m[0][m[1] >= m[1].max() * threshold]


def overlaps(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Common pixels of every two of a few pixel sets."""
    known, at = np.unique(np.concatenate([*a, *b, np.empty(0, np.int64)]), return_inverse=True)
    grid = np.zeros((len(a) + len(b), len(known)), np.int32)
    grid[np.repeat(np.arange(len(a) + len(b)), [len(x) for x in (*a, *b)]), at] = 1
    return grid[: len(a)] @ grid[len(a) :].T


def _grouped(ids: list[int], masks: list[tuple], leader: list[int | None]) -> tuple[list[int], list[tuple]]:
    """Masks (p, w, times) summed by leader; those without one are left out."""
    out: dict[int, list[tuple]] = {}
    for m, to in zip(masks, leader, strict=True):
        if to is not None:
            out.setdefault(to, []).append(m)
    ids = sorted(out)
    return ids, [(*added(*((m[0], m[1]) for m in out[i])), tuple(sorted({t for m in out[i] for t in m[2]}))) for i in ids]


def _led(ids: list[int], at: np.ndarray, radius: float, nearest: bool) -> list[int | None]:
    """M2, M3: each point's leader, for points in the order of their ids, by the rules of leaders.members()."""
    lead = np.flatnonzero(scan(at[:, 0], at[:, 1], np.ones(len(at), bool), radius) == LEADER)
    d = np.sqrt(((at[:, None] - at[lead]) ** 2).sum(axis=2))
    pick = np.argmin(np.where(d <= radius, np.round(d, 9), np.inf), axis=1) if nearest else np.argmax(d <= radius, axis=1)
    return [ids[lead[k]] if d[i, k] <= radius else None for i, k in enumerate(pick)]


def _joined(ids: list[int], a: np.ndarray, b: np.ndarray) -> list[int]:
    """The smallest id of each one's connected set."""
    roots = dict(zip(*(x.tolist() for x in forest(np.array(ids)[a], np.array(ids)[b])), strict=True))
    return [roots.get(i, i) for i in ids]


def merge_window(regions: list[tuple[int, int, np.ndarray]], ly: int, params: dict) -> tuple[list[int], list[tuple]]:
    """M8: the regions (id, t, pixels) of one window's frames as masks (p, w, times), by their ids."""
    regions = sorted((r for r in regions if len(r[2]) > params["min_area"]), key=lambda r: r[0])
    ids, masks = [r[0] for r in regions], [(np.sort(r[2]), np.ones(len(r[2])), (r[1],)) for r in regions]
    for radius, nearest in ((params["thresh_com0"], False), (params["thresh_com"], True)):
        if not ids:
            return [], []
        px = [real(m, params["thresh_mask"]) for m in masks]
        centre = np.array([[np.mean(x // ly), np.mean(x % ly)] for x in px])
        ids, masks = _grouped(ids, masks, _led(ids, centre, radius, nearest))
    px = [real(m, params["thresh_mask"]) for m in masks]
    area, inter = np.array([len(x) for x in px]), overlaps(px, px)
    a, b = np.nonzero(np.triu(inter / (area[:, None] + area - inter) >= params["thresh_iou"], 1))
    ids, masks = _grouped(ids, masks, _joined(ids, a, b))
    px = [real(m, params["thresh_mask"]) for m in masks]
    area, inter = np.array([len(x) for x in px]), overlaps(px, px)
    a, b = np.nonzero((inter / area >= (1 + params["thresh_iou"]) / 2) & ~np.eye(len(ids), dtype=bool))
    big = np.maximum(area[a], area[b]) > params["avg_area"]
    gone = set(np.where(area[b] > area[a], b, a)[big].tolist())
    leader = _joined(ids, a[~big], b[~big])
    return _grouped(ids, masks, [None if k in gone else x for k, x in enumerate(leader)])


def best_old(px: np.ndarray, old: dict[int, np.ndarray], params: dict) -> int | None:
    """Of the masks that fit, the one of largest IoU; of equal ones the smallest id."""
    ids = sorted(old)
    if not ids:
        return None
    inter, area = overlaps([px], [old[i] for i in ids])[0], np.array([len(old[i]) for i in ids])
    iou = inter / (len(px) + area - inter)
    fit = (iou >= params["thresh_iou"]) | (inter / np.minimum(len(px), area) >= (1 + params["thresh_iou"]) / 2)
    return ids[int(np.argmax(np.where(fit, iou, -1.0)))] if fit.any() else None


def has_run(times: tuple, cons: int) -> bool:
    t = np.unique(times)
    return len(t) >= cons and bool((t[cons - 1 :] - t[: len(t) - cons + 1] == cons - 1).any())


class Video:
    """One video's masks while its frames are worked on: the rules of a frame and of a window's end. `changed` gathers ids."""

    def __init__(self, masks: dict[int, Mask], window: list[tuple[int, int, np.ndarray]], ly: int, params: dict, tracking: bool):
        self.masks, self.window, self.ly, self.params, self.tracking = masks, window, ly, params, tracking
        self.changed: set[int] = set()
        self.touched: set[int] = set()
        self.sure = {i: real(m, params["thresh_mask"]) for i, m in masks.items() if m.confirmed} if tracking else {}

    def frame(self, t: int, regions: list[np.ndarray]) -> None:
        hit: dict[int, list[np.ndarray]] = {}
        for px in regions:
            belongs = None
            if self.tracking and len(px) > self.params["min_area"]:
                centre = int(np.rint(np.mean(px // self.ly)) * self.ly + np.rint(np.mean(px % self.ly)))
                belongs = best_old(px, {i: x for i, x in self.sure.items() if (x == centre).any()}, self.params)
            if belongs is None:
                self.window.append(((t << 31) + int(px.min()), t, px))
            else:
                hit.setdefault(belongs, []).append(px)
        for i, m in self.masks.items():
            if i in hit:
                self.masks[i] = m._replace(active=True, pending=(*m.pending, *np.concatenate(hit[i]).tolist()), pending_times=(*m.pending_times, t))
                self.touched.add(i)
            elif m.active:
                self.quiet(i)

    def quiet(self, i: int) -> None:
        """A mask that is no longer active takes up what it was given."""
        m = self.masks[i]
        p, w = added((m.p, m.w), (m.pending, np.ones(len(m.pending))))
        self.keep(i, m._replace(p=p, w=w, times=tuple(sorted({*m.times, *m.pending_times})), active=False, pending=(), pending_times=()))

    def close(self) -> None:
        """The end of a window: M8, then M9, or M10 with tracking."""
        ids, new = merge_window(self.window, self.ly, self.params)
        self.window.clear()
        old = {i: real(m, self.params["thresh_mask"]) for i, m in self.masks.items() if not (self.tracking and m.confirmed)}
        join: dict[int, list[tuple]] = {}
        for i, m in zip(ids, new, strict=True):
            to = best_old(real(m, self.params["thresh_mask"]), old, self.params)
            join.setdefault(i if to is None else to, []).append(m)
        for i, parts in join.items():
            m = self.masks.get(i, Mask(np.empty(0, np.int64), np.empty(0)))
            p, w = added((m.p, m.w), *((x[0], x[1]) for x in parts))
            self.keep(i, m._replace(p=p, w=w, times=tuple(sorted({*m.times, *(t for x in parts for t in x[2])}))))

    def keep(self, i: int, m: Mask) -> None:
        m = m._replace(confirmed=m.confirmed or has_run(m.times, self.params["cons"]))
        self.masks[i] = m
        self.changed.add(i)
        self.touched.add(i)
        if self.tracking and m.confirmed:
            self.sure[i] = real(m, self.params["thresh_mask"])


class MaskProcessor(StatefulProcessor):
    """Frames (video_id, t, p, seg) of a video, t from 0, in any order within the watermark. States: the masks, the open
    window's regions, frames that wait for earlier ones, and the next frame. A timer ends the window of a video that has
    gone quiet."""

    def __init__(self, ly: int, params: dict, first: int, every: int, tracking: bool):
        self.ly, self.params, self.first, self.every, self.tracking = ly, params, first, every, tracking

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.next = handle.getValueState("next", "t long")
        self.masks = handle.getMapState("masks", "id long", STATE)
        self.window = handle.getMapState("window", "id long", "t long, p array<long>")
        self.waiting = handle.getMapState("waiting", "t long", "p binary, seg binary")

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:  # noqa: N802, N803
        """Masks of a batch run (id, p, w, times) over the frames before `next_t`."""
        for r in initialState.itertuples():
            self.masks.updateValue((int(r.id),), ([int(x) for x in r.p], [float(x) for x in r.w], [int(x) for x in r.times], has_run(tuple(r.times), self.params["cons"]), False, [], []))
            self.next.update((int(r.next_t),))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        next_t = self._next()
        for frame in pd.concat(list(rows)).itertuples():
            if frame.t >= next_t:
                self.waiting.updateValue((int(frame.t),), (frame.p, frame.seg))
        yield from self._advance(key, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        yield from self._advance(key, timerValues.getCurrentWatermarkInMs())

    def _next(self) -> int:
        return self.next.get()[0] if self.next.exists() else 0

    def _end(self, t: int) -> int:
        """The first frame after t's window."""
        return self.first if t < self.first else t + self.every - (t - self.first) % self.every

    def _advance(self, key: tuple, watermark_ms: int) -> Iterator[pd.DataFrame]:
        t, final = self._next(), watermark_ms // FRAME_MS - 1
        due = sorted(k[0] for k in self.waiting.keys())
        if not due and not self.window.exists() and not self.masks.exists():
            return
        masks = {k[0]: Mask(np.array(v[0], np.int64), np.array(v[1], float), tuple(v[2]), v[3], v[4], tuple(v[5]), tuple(v[6])) for k, v in self.masks.iterator()}
        window = [(k[0], v[0], np.array(v[1], np.int64)) for k, v in self.window.iterator()]
        before = {w[0] for w in window}
        video = Video(masks, window, self.ly, self.params, self.tracking)
        while True:
            if due and due[0] == t:
                p, seg = (np.frombuffer(x, np.int64) for x in self.waiting.getValue((t,)))
                video.frame(t, [p[seg == k] for k in np.unique(seg)])
                self.waiting.removeKey((due.pop(0),))
                t += 1
            elif t <= final and (due or window or any(m.active for m in masks.values())):
                # Frames that never come: nothing is active in them, and only windows that end among them matter.
                video.frame(t, [])
                t = min(due[0] if due else final + 1, final + 1, self._end(t) if window else final + 1)
            else:
                break
            if t in (self.first, self._end(t - 1)):
                video.close()
        self.next.update((t,))
        for i in video.touched:
            m = masks[i]
            self.masks.updateValue((i,), (m.p.tolist(), m.w.tolist(), list(m.times), m.confirmed, m.active, list(m.pending), list(m.pending_times)))
        held = {w[0] for w in window}
        for i in before - held:
            self.window.removeKey((i,))
        for i, at, px in window:
            if i not in before:
                self.window.updateValue((i,), (at, px.tolist()))
        self._wake(due, window, masks, t, watermark_ms)
        if video.changed:
            ids = sorted(video.changed)
            yield pd.DataFrame({"video_id": [key[0]] * len(ids), "version": [t] * len(ids), "id": ids, "p": [masks[i].p.tolist() for i in ids], "w": [masks[i].w.tolist() for i in ids], "times": [list(masks[i].times) for i in ids], "confirmed": [masks[i].confirmed for i in ids]})

    def _wake(self, due: list[int], window: list, masks: dict[int, Mask], t: int, watermark_ms: int) -> None:
        """A timer for when the next gap, or the open window, has become final."""
        for x in list(self.handle.listTimers()):
            self.handle.deleteTimer(x if isinstance(x, int) else x[0])
        if due or window or any(m.active for m in masks.values()):
            at = (due[0] if due else self._end(t)) * FRAME_MS
            self.handle.registerTimer(max(at, watermark_ms + 1))


def regions_of(packed: DataFrame, ly: int, threshold: float) -> DataFrame:
    """(video_id, t, p, seg): the pixels above a threshold of packed frames (video_id, t, px), and for each the smallest one of
    its 4-connected region, as 8-byte integers; a row a frame, also of one without any."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, seg = [], []
            for px in batch.column("px").to_pylist():
                p = np.flatnonzero(np.array(px, float) > threshold)
                held.append(p.astype(np.int64).tobytes())
                seg.append((p[region_labels(p // ly, p % ly)] if len(p) else p).astype(np.int64).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("video_id"), batch.column("t"), pa.array(held, pa.binary()), pa.array(seg, pa.binary())], names=["video_id", "t", "p", "seg"])

    cast = packed.select(F.col("video_id").cast("long"), F.col("t").cast("long"), F.col("px").cast("array<double>"))
    return cast.mapInArrow(run, "video_id long, t long, p binary, seg binary")


def initial_masks(m: Masks, next_t: int) -> DataFrame:
    """Masks of a batch run over the frames before next_t, as a state to begin with."""
    px = m.pixels.groupBy("video_id", "id").agg(F.sort_array(F.collect_list(F.struct(F.col("p").cast("long").alias("p"), F.col("w").cast("double").alias("w")))).alias("px"))
    ts = m.times.groupBy("video_id", "id").agg(F.sort_array(F.collect_set(F.col("t").cast("long"))).alias("times"))
    return px.join(ts, ["video_id", "id"]).select("video_id", "id", "px.p", "px.w", "times", F.lit(next_t).cast("long").alias("next_t"))


def online_masks(regions: DataFrame, ly: int, params: dict, first: int, every: int, delay: int, tracking: bool = False, initial: DataFrame | None = None) -> DataFrame:
    """A stream of changed masks (CHANGED) from a stream of frames' regions (regions_of). Windows are the first
    `first` frames, then `every` at a time; frames may come `delay` frames late. The session must keep state in RocksDB
    while the stream runs (rocks_state)."""
    grouped = in_frame_time(regions, delay).groupBy("video_id")
    begin = None if initial is None else initial.groupBy("video_id")
    return grouped.transformWithStateInPandas(MaskProcessor(ly, params, first, every, tracking), CHANGED, "append", "eventTime", begin)


@contextmanager
def rocks_state(spark: SparkSession):
    """Streams that start inside keep their state in RocksDB, which map states need."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, ROCKS)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def latest(changed: DataFrame) -> Masks:
    """The masks' last states, from all that went out."""
    last = changed.groupBy("video_id", "id").agg(F.max_by(F.struct("p", "w", "times"), "version").alias("m"))
    px = last.select("video_id", "id", F.explode(F.arrays_zip("m.p", "m.w")).alias("x"))
    return Masks(px.select("video_id", "id", F.col("x.p").alias("p"), F.col("x.w").alias("w")), last.select("video_id", "id", F.explode("m.times").alias("t")))
