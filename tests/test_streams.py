"""Streams over several micro-batches, with frames out of order, twice, late and missing, against plain loops; masks in state
against the batch merges and a loop over frames."""

from __future__ import annotations

import numpy as np
import pytest
from framelake.functions.scalar import QUARTILE_SIGMA
from framelake.operators import merge, segment
from framelake.sources.scratch import new_path
from framelake.streaming import masks as live
from framelake.streaming import online
from pyspark.sql import functions as F

KERNEL, DELAY = [0.5, 0.3, 0.2], 12
PARAMS = {"min_area": 1, "avg_area": 30, "thresh_mask": 0.5, "thresh_com0": 0.6, "thresh_com": 1.0, "thresh_iou": 0.5, "cons": 2}


def write_files(spark, parts, schema):
    path = new_path(spark, "files")
    for rows in parts:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(spark.createDataFrame([], schema).schema).option("maxFilesPerTrigger", 1).parquet(path)


def run(spark, result):
    out = new_path(spark, "out")
    with live.rocks_state(spark):
        online.run_available(result, f"{out}/rows", f"{out}/state")
    return spark.read.schema(result.schema).parquet(f"{out}/rows")


def signal():
    """Two keys of 40 frames with gaps, one at the start and one longer than a block; frames dealt to files so that each is
    late by less than DELAY, some twice, and one far too late."""
    rng = np.random.default_rng(4)
    full = {k: np.where(rng.random(40) < 0.25, 0.0, rng.normal(size=40).round(3)) for k in (3, 8)}
    full[8][:2] = full[8][17:27] = 0.0
    full[3][39] = full[8][39] = 1.0
    parts = [[] for _ in range(9)]
    for k, v in full.items():
        for t in range(40):
            if v[t]:
                parts[min(7, (t + int(rng.integers(0, 5))) // 5)].append((k, t, float(v[t])))
    parts[4].append(parts[2][0])
    parts[8] = [(3, 1, 99.0), (-1, 500, 0.0)]
    return full, parts


def test_frames_come_out_in_order():
    x = lambda *t: np.array(t, np.int64)
    for given, want in [
        ((0, x(0, 1, 3), 0), ([1, 1], [3])),
        ((0, x(0, 1, 3), 3000), ([1, 1, 0, 1], [])),
        ((2, x(1, 2, 2, 7), 4000), ([1], [7])),
        ((2, x(4), 2000), ([], [4])),
        ((5, x(), 10**9), ([], [])),
    ]:
        ready, times, values = online.in_order(given[0], given[1], np.ones(len(given[1])), given[2])
        assert (ready.tolist(), times.tolist()) == want and len(values) == len(times)


def test_streaming_fir_over_batches(spark):
    full, parts = signal()
    got = run(spark, online.streaming_fir(write_files(spark, parts, "k long, t long, v double"), KERNEL, ["k"], DELAY)).filter("k > 0").collect()
    want = {(k, t): sum(v[t + i] * w for i, w in enumerate(KERNEL)) for k, v in full.items() for t in range(38)}
    assert {(r.k, r.t): pytest.approx(r.v) for r in got} == want and len(got) == len(want)


def test_streaming_baseline_over_batches(spark):
    full, parts = signal()
    got = run(spark, online.streaming_lagged_snr(write_files(spark, parts, "k long, t long, v double"), ["k"], 8, 7, DELAY)).filter("k > 0").collect()
    want, block = {}, lambda t: 0 if t < 8 else 1 + (t - 8) // 7
    for k, v in full.items():
        for t in range(40):
            base = v[[s for s in range(40) if block(s) == max(block(t) - 1, 0)]]
            high, low = np.percentile(base, [50, 25])
            noise = (high - low) / QUARTILE_SIGMA or np.std(base)
            want[k, t] = pytest.approx((v[t] - high) / noise if noise else 0.0)
    assert {(r.k, r.t): r.snr for r in got} == want and len(got) == len(want)


def test_keys_that_share_a_row_of_state(spark):
    """All keys in one group, by two columns, a key of nulls beginning in a later batch: the results of a group a key."""
    full, parts = signal()
    rows = [[(f"u{k}", k, t, v) for k, t, v in part] for part in parts]
    rows[6] = rows[6] + [(None, None, t, 2.0) for t in range(30, 35)]
    stream = lambda: write_files(spark, rows, "name string, k long, t long, v double")
    got = run(spark, online.streaming_fir(stream(), KERNEL, ["name", "k"], DELAY, 1)).filter("k > 0 or k is null").collect()
    full[None] = np.r_[np.zeros(30), np.full(5, 2.0)]
    want = {(k and f"u{k}", k, t): sum(v[t + i] * w for i, w in enumerate(KERNEL)) for k, v in full.items() for t in range(len(v) - 2)}
    assert {(r.name, r.k, r.t): pytest.approx(r.v) for r in got} == want and len(got) == len(want)
    by_key = {(r.name, r.k, r.t): r.snr for r in run(spark, online.streaming_lagged_snr(stream(), ["name", "k"], 8, 7, DELAY)).collect()}
    shared = run(spark, online.streaming_lagged_snr(stream(), ["name", "k"], 8, 7, DELAY, 1)).collect()
    assert {(r.name, r.k, r.t): r.snr for r in shared} == by_key and len(shared) == len(by_key)


def packed(spark, video=3):
    e = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").filter(F.col("label") == video).orderBy("vec_id").collect()
    return [(video, t, [float(x) for x in r.embedding]) for t, r in enumerate(e)]


def regions(frames):
    """{t: pixel arrays of the frame's regions}."""
    out = {}
    for _, t, px in frames:
        p = np.flatnonzero(np.array(px) > 0.15)
        label = segment.region_labels(p // 8, p % 8) if len(p) else p
        out[t] = [p[label == k] for k in np.unique(label)]
    return out


def table(m):
    px, ts = {}, {}
    for r in m.pixels.collect():
        px.setdefault(r.id, {})[r.p] = r.w
    for r in m.times.collect():
        ts.setdefault(r.id, set()).add(r.t)
    return {i: (px[i], ts[i]) for i in px}


def test_a_window_merges_as_the_batch_does(spark):
    frames = packed(spark)[:30]
    active = spark.createDataFrame([(3, t, p // 8, p % 8) for t, rs in regions(frames).items() for px in rs for p in px.tolist()], "video_id long, t long, x long, y long")
    ids, found = live.merge_window([((t << 31) + int(px.min()), t, px) for t, rs in regions(frames).items() for px in rs], 8, PARAMS)
    here = {i: (dict(zip(m[0].tolist(), m[1].tolist(), strict=True)), set(m[2])) for i, m in zip(ids, found, strict=True)}
    assert here == table(merge.merged(segment.frame_regions(active, 8), 8, PARAMS)) and len(here) > 5
    assert live.merge_window([], 8, PARAMS) == ([], [])


def tracked_by_loop(frames, first, every):
    """R5 frame by frame, masks as dicts."""
    masks, window = {}, []
    binary = lambda m: {p for p, w in m["px"].items() if w >= max(m["px"].values()) * PARAMS["thresh_mask"]}

    def fits(px, old):
        best = None
        for i in sorted(old):
            inter = len(px & old[i])
            iou = inter / len(px | old[i])
            if (iou >= PARAMS["thresh_iou"] or inter / min(len(px), len(old[i])) >= (1 + PARAMS["thresh_iou"]) / 2) and (best is None or iou > best[0]):
                best = (iou, i)
        return best and best[1]

    def add(m, pixels, times):
        for p, w in pixels:
            m["px"][p] = m["px"].get(p, 0) + w
        m["times"] |= set(times)
        m["sure"] |= any({t + k for k in range(PARAMS["cons"])} <= m["times"] for t in m["times"])

    def quiet(m):
        add(m, [(p, 1) for p in m["held"]], m["held_times"])
        m["held"], m["held_times"], m["active"] = [], [], False

    last, by_frame = max(frames), frames
    for t in range(first + every * (1 + (last - first) // every)):
        hit = set()
        for px in by_frame.get(t, []):
            centre = round(float(np.mean(px // 8))) * 8 + round(float(np.mean(px % 8)))
            old = {i: binary(m) for i, m in masks.items() if m["sure"]}
            to = fits(set(px.tolist()), {i: x for i, x in old.items() if centre in x}) if len(px) > PARAMS["min_area"] else None
            if to is None:
                window.append(((t << 31) + int(px.min()), t, px))
            else:
                masks[to]["held"] += px.tolist()
                masks[to]["held_times"].append(t)
                hit.add(to)
        for i, m in masks.items():
            if m["active"] and i not in hit:
                quiet(m)
            m["active"] = i in hit
        if t + 1 == first or (t + 1 > first and (t + 1 - first) % every == 0):
            ids, new = live.merge_window(window, 8, PARAMS)
            window, old = [], {i: binary(m) for i, m in masks.items() if not m["sure"]}
            to = [fits({p for p, w in zip(x[0].tolist(), x[1], strict=True) if w >= x[1].max() * PARAMS["thresh_mask"]}, old) for x in new]
            for i, k, x in zip(ids, to, new, strict=True):
                m = masks.setdefault(i if k is None else k, {"px": {}, "times": set(), "sure": False, "active": False, "held": [], "held_times": []})
                add(m, zip(x[0].tolist(), x[1].tolist(), strict=True), x[2])
    for m in masks.values():
        quiet(m)
    return {i: (m["px"], m["times"]) for i, m in masks.items()}


def streamed_masks(spark, frames, missing, tracking, initial=None, first=15, every=10):
    """Files of seven frames, every two swapped; frames in `missing` never come."""
    schema, last = "video_id long, t long, px array<double>", frames[-1][1]
    parts = [[f for f in frames if f[1] // 7 == k ^ 1 and f[1] not in missing] for k in range(last // 7 + 2)]
    closing = [(-1, last + 200, [0.0] * 64)]
    stream = write_files(spark, [p for p in parts if p] + [closing], schema)
    return run(spark, live.online_masks(live.regions_of(stream, 8, 0.15), 8, PARAMS, first, every, 14, tracking, initial))


@pytest.mark.parametrize("tracking", [True, False])
def test_masks_in_state_equal_a_loop_over_frames(spark, tracking):
    """Several micro-batches with borders inside windows, disorder, and frames that never come."""
    shown = packed(spark)[:12]
    frames = [(3, t, shown[t // 2 % 12][2]) for t in range(72)]  # each for two frames, three times over
    missing = {4, 21, 22, 50}
    changed = streamed_masks(spark, frames, missing, tracking).cache()
    here = regions([f for f in frames if f[1] not in missing])
    if tracking:
        want = tracked_by_loop(here, 15, 10)
    else:
        video = live.Video({}, [], 8, PARAMS, False)
        for t in range(75):
            video.frame(t, here.get(t, []))
            if t == 14 or (t > 14 and (t - 14) % 10 == 0):
                video.close()
        want = {i: (dict(zip(m.p.tolist(), m.w.tolist(), strict=True)), set(m.times)) for i, m in video.masks.items()}
    assert table(live.latest(changed)) == want
    assert any(len(m[1]) > 5 for m in want.values())
    # What goes out follows the change: no version holds all masks once there are several windows.
    sizes = [r["count"] for r in changed.groupBy("version").count().collect()]
    assert len(sizes) > 4 and max(sizes) < len(want)


def test_begins_from_a_batch_run(spark):
    """The first window as a batch, its masks as the initial state, and the rest as a stream, equal the stream of all."""
    frames = packed(spark)[:45]
    whole = table(live.latest(streamed_masks(spark, frames, set(), True)))
    active = spark.createDataFrame([(3, t, p // 8, p % 8) for t, rs in regions(frames[:15]).items() for px in rs for p in px.tolist()], "video_id long, t long, x long, y long")
    begin = live.initial_masks(merge.merged(segment.frame_regions(active, 8), 8, PARAMS), 15)
    rest = live.latest(streamed_masks(spark, frames[15:], set(), True, begin))
    assert {i: m for i, m in whole.items() if i in table(rest)} == table(rest)
    assert set(whole) - set(table(rest)) <= {r.id for r in begin.collect()}
