from __future__ import annotations

import itertools
import random

import numpy as np
import pytest

from framelake.functions import scalar
from framelake.operators import baseline, evaluate, joins, merge, score, segment, temporal, traces
from framelake.plans import tune
from framelake.sources import frames as src


def video(spark, values, video_id=0, x=0, y=0):
    return spark.createDataFrame([(video_id, t, x, y, float(v)) for t, v in enumerate(values)], "video_id int, t long, x int, y int, v double")


def test_fir_is_a_valid_correlation_also_for_long_kernels(spark):
    rng = np.random.default_rng(1)
    v, k = rng.random(40), rng.random(6)
    want = np.convolve(v, k[::-1], "valid")
    got = [r.v for r in temporal.fir_filter(video(spark, v), list(k)).orderBy("t").collect()]
    assert np.allclose(got, want) and len(got) == 35
    kernel = spark.createDataFrame([(i, float(w)) for i, w in enumerate(k)], "l int, w double")
    assert np.allclose([r.v for r in temporal.fir_filter_long(video(spark, v), kernel, 6).filter("t >= 0").orderBy("t").collect()], want)


def test_noise_falls_back_to_deviation_and_constant_pixels_score_zero(spark):
    (r,) = baseline.baseline(video(spark, [0, 0, 0, 0, 8])).collect()
    assert r.med == 0 and r.noise == pytest.approx(3.2)
    assert {r.snr for r in baseline.snr(video(spark, [5, 5, 5])).collect()} == {0.0}


def test_runs_at_their_limits(spark):
    active = spark.createDataFrame([(1, t) for t in (3, 4, 5, 5, 9)], "id long, t long")
    assert temporal.has_run(active, ["id"], 3).count() == 1 and temporal.has_run(active, ["id"], 4).count() == 0
    assert sorted((r.start, r.length) for r in temporal.runs(active, ["id"]).collect()) == [(3, 3), (9, 1)]


def test_diagonal_pixels_are_two_regions_and_random_frames_match_flood_fill(spark):
    rng = random.Random(2)
    cells = {(0, 0, 0), (0, 1, 1)} | {(t, x, y) for t in (1, 2) for x in range(12) for y in range(9) if rng.random() < 0.5}
    df = spark.createDataFrame([(7, t, x, y) for t, x, y in cells], "video_id int, t int, x int, y int")
    got = {(r.t, r.x, r.y): r.seg for r in segment.frame_regions(df, 9).collect()}
    want = {}
    for c in sorted(cells):
        if c not in want:
            todo = [c]
            while todo:
                t, x, y = todo.pop()
                if (t, x, y) in cells and (t, x, y) not in want:
                    want[t, x, y] = c[1] * 9 + c[2]
                    todo += [(t, x + 1, y), (t, x - 1, y), (t, x, y + 1), (t, x, y - 1)]
    assert got == want
    assert segment.frame_regions(df.limit(0), 9).count() == 0


def test_large_regions_split_into_pieces_of_a_quarter(spark):
    bar = [(0, 0, x, y) for x in range(5) for y in range(5)] + [(0, 0, x, y) for x in range(5) for y in range(7, 12)] + [(0, 0, 2, 5), (0, 0, 2, 6)]
    regions = segment.frame_regions(spark.createDataFrame(bar, "video_id int, t int, x int, y int"), 20)
    got = segment.split_large(regions, 3, 30, 20).collect()
    assert len({r.piece for r in got}) == 2 and {r.w for r in got} == {0.25} and not any(r.whole for r in got)
    assert {r.w for r in segment.split_large(regions, 3, 99, 20).collect()} == {1.0}


def leaders_by_hand(points, radius, nearest):
    used, out = set(), {}
    near = lambda a, b: np.hypot(points[a][0] - points[b][0], points[a][1] - points[b][1])
    lead = []
    for k in range(len(points)):
        if points[k][2] and k not in used:
            lead.append(k)
            used |= {j for j in range(len(points)) if near(j, k) <= radius}
    for k in range(len(points)):
        mine = [k] if k in lead else [g for g in lead if near(g, k) <= radius]
        if mine:
            out[k] = min(mine, key=lambda g: (near(g, k), g)) if nearest else min(mine)
    return out


def test_leader_clusters_equal_the_scan(spark):
    for seed, nearest in itertools.product(range(2), (False, True)):
        rng = random.Random(seed)
        points = [(rng.randrange(12), rng.randrange(12), rng.random() < 0.8) for _ in range(40)]
        df = spark.createDataFrame([(1, k, float(x), float(y), w) for k, (x, y, w) in enumerate(points)], "video_id long, id long, cx double, cy double, whole boolean")
        got = {r.id: r.leader for r in merge.cluster(df, 2.0, nearest).collect()}
        assert got == leaders_by_hand(points, 2.0, nearest)


def test_overlap_pairs_equal_all_pairs_and_merges_equal_loops(spark):
    rng = random.Random(5)
    sets = {k: set(rng.sample(range(14), rng.randint(1, 9))) for k in range(30)} | {90: {1, 2}, 91: {2, 3, 1, 4}}
    df = spark.createDataFrame([(3, k, p) for k, s in sets.items() for p in s], "video_id long, mask_id long, p long")
    masks = joins.as_masks(df)
    iou = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.5}
    assert {(r.a, r.b) for r in joins.overlap_pairs(masks, 0.5, "iou").collect()} == iou
    contain = {(a, b) for a in sets for b in sets if a != b and len(sets[a] & sets[b]) / len(sets[b]) >= 0.75}
    assert {(r.a, r.b) for r in joins.overlap_pairs(masks, 0.75, "contain").collect()} == contain
    dropped = {b if len(sets[b]) > len(sets[a]) else a for a, b in contain if max(len(sets[a]), len(sets[b])) > 6}
    root = {k: k for k in sets}
    for _ in sets:
        for a, b in contain:
            if max(len(sets[a]), len(sets[b])) <= 6:
                root[a] = root[b] = min(root[a], root[b])
    got = {r.id: r.leader for r in merge.containment_classes(masks, 6, 0.75).collect()}
    assert got == {k: root[k] for k in sets if k not in dropped}


def test_batch_merge_of_a_moving_region_and_of_nothing(spark):
    cells = [(0, t, x, y) for t in range(4) for x in range(3) for y in range(3)] + [(0, 1, x, y) for x in (8, 9) for y in (8, 9)]
    regions = segment.frame_regions(spark.createDataFrame(cells, "video_id int, t int, x int, y int"), 12)
    params = {"min_area": 2, "avg_area": 50, "thresh_mask": 0.5, "thresh_com0": 1.0, "thresh_com": 2.0, "thresh_iou": 0.5, "cons": 3}
    m = merge.complete(regions, 12, params)
    assert m.pixels.select("id").distinct().count() == 1 and m.pixels.count() == 9 and m.times.count() == 4
    assert merge.complete(regions.limit(0), 12, params).pixels.count() == 0


def test_new_masks_join_old_ones_or_are_appended(spark):
    px = lambda rows: spark.createDataFrame(rows, "video_id long, id long, p long, w double")
    ts = lambda rows: spark.createDataFrame(rows, "video_id long, id long, t long")
    old = merge.Masks(px([(0, 1, p, 1.0) for p in range(4)]), ts([(0, 1, 0)]))
    new = merge.Masks(px([(0, 8, p, 1.0) for p in range(1, 5)] + [(0, 9, p, 1.0) for p in range(20, 24)]), ts([(0, 8, 1), (0, 9, 1)]))
    out = merge.merge_into(old, new, {"thresh_mask": 0.5, "thresh_iou": 0.5})
    assert {(r.id, r.p): r.w for r in out.pixels.collect()} == {(1, 0): 1, (1, 1): 2, (1, 2): 2, (1, 3): 2, (1, 4): 1, **{(9, p): 1 for p in range(20, 24)}}
    assert sorted((r.id, r.t) for r in out.times.collect()) == [(1, 0), (1, 1), (9, 1)]


def test_assignment_is_best_and_scores_are_guarded(spark):
    rng = np.random.default_rng(3)
    for _ in range(60):
        r, c = rng.integers(1, 5, 2).tolist()
        gain = np.where(rng.random((r, c)) < 0.6, 1 + rng.random((r, c)).round(1), 0)
        best = max(sum(gain[i, j] for i, j in zip(range(r), p) if j < c) for p in itertools.permutations(range(max(r, c) + r), r)) if r <= 4 else 0
        at = np.nonzero(gain)
        chosen = evaluate.assign(*at, gain[at])
        pairs = list(zip(at[0][chosen], at[1][chosen], strict=True))
        assert sum(gain[i, j] for i, j in pairs) == pytest.approx(best) and len({i for i, _ in pairs}) == len({j for _, j in pairs}) == len(pairs)
    gt = spark.createDataFrame([(0, 1, p) for p in range(4)] + [(0, 2, p) for p in range(10, 14)] + [(1, 1, 0)], "video_id long, gt_id long, p long")
    found = spark.createDataFrame([(0, 5, p) for p in range(1, 5)] + [(0, 6, p) for p in range(3)] + [(2, 7, 0)], "video_id long, mask_id long, p long")
    got = {r.video_id: (r.n_match, r.recall, r.precision, r.f1) for r in evaluate.scores(gt, found).collect()}
    assert got == {0: (1, 0.5, 0.5, 0.5), 1: (0, 0, 0, 0), 2: (0, 0, 0, 0)}


def test_assignment_of_one_large_component():
    """5,000 masks on either side in one component: memory follows the candidates, and the total is that of a chain's best."""
    import tracemalloc

    n = 5000
    rows, columns = np.concatenate([np.arange(n), np.arange(n - 1)]), np.concatenate([np.arange(n), np.arange(1, n)])
    gain = 1 + np.random.default_rng(2).random(2 * n - 1)
    tracemalloc.start()
    chosen = evaluate.assign(rows, columns, gain)
    assert tracemalloc.get_traced_memory()[1] < 100e6
    tracemalloc.stop()
    # Best of a chain of candidates, of which no two neighbours may be taken.
    order = np.lexsort((columns, rows))
    without = with_ = 0.0
    for g in gain[order]:
        without, with_ = max(without, with_), without + g
    assert gain[chosen].sum() == pytest.approx(max(without, with_))
    assert len(set(rows[chosen])) == len(set(columns[chosen])) == len(chosen)


def test_matches_that_are_not_unique(spark):
    """A chain of masks that each overlap two labelled ones: the best assignment, not each one's best."""
    gt = [(0, g, p) for g in range(6) for p in range(10 * g, 10 * g + 10)]
    found = [(0, 100 + g, p) for g in range(5) for p in range(10 * g + 4, 10 * g + 14)] + [(0, 200, p) for p in range(3, 13)]
    match = evaluate.one_to_one(evaluate.iou_candidates(spark.createDataFrame(gt, "video_id long, gt_id long, p long"), spark.createDataFrame(found, "video_id long, mask_id long, p long"), 0.2, ["video_id"]), ["video_id"]).collect()
    px = {i: {p for _, k, p in gt + found if k == i} for i in {k for _, k, _ in gt + found}}
    iou = lambda a, b: len(px[a] & px[b]) / len(px[a] | px[b])
    masks = sorted({k for _, k, _ in found})
    best = max(sum(1 + iou(g, m) for g, m in zip(order, masks, strict=True) if iou(g, m) >= 0.2) for order in itertools.permutations(range(6)))
    assert sum(1 + iou(r.gt_id, r.mask_id) for r in match) == pytest.approx(best) and len(match) == 6


def test_pack_unpack_densify_and_kernels(spark):
    v = spark.createDataFrame([(0, t, x, y, float(t + x * 3 + y)) for t in range(2) for x in range(2) for y in range(3)], "video_id int, t long, x int, y int, v double")
    back = src.unpack(src.pack(v, 3), 3)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, v.collect()))
    assert src.densify(v).count() == 2 * 8 * 8 and src.crop(src.densify(v), 2, 3).count() == 12
    assert sum(scalar.exponential_kernel(10, 0.5)) == pytest.approx(1)
    assert scalar.resample_kernel([0, 2, 0], 10, 20) == [0, 1, 2, 1, 0]
    template = spark.createDataFrame([(0, 0.1), (1, 1.0), (2, 0.5)], "l int, w double")
    assert [(r.l, round(r.w, 4)) for r in scalar.kernel_from_template(template).orderBy("l").collect()] == [(0, 0.6667), (1, 0.3333)]


def test_high_pass_keeps_constant_frames_at_one_and_scorer_features(spark):
    v = spark.createDataFrame([(0, 0, [3.0] * 16), (0, 1, [float(k) for k in range(16)])], "video_id int, t long, px array<double>")
    got = {r.t: r.px for r in score.high_pass(v, 4, 4, 1.0).collect()}
    assert np.allclose(got[0], 1.0) and not np.allclose(got[1], 1.0)
    snr = spark.createDataFrame([(0, 0, x, y, float(x * 3 + y)) for x in range(3) for y in range(3)], "video_id int, t int, x int, y int, snr double")
    mid = score.neighbourhood(snr).filter("x = 1 and y = 1").first()
    assert [mid[f"f{i}{j}"] for i in range(3) for j in range(3)] == [float(k) for k in range(9)]


def test_pixel_scorer_learns_and_unmixing_finds_the_mask(spark):
    rng = np.random.default_rng(0)
    rows = [(0, t, x, y, float(rng.normal() + 6 * (y == 2)), float(y == 2)) for t in range(8) for x in range(4) for y in range(5)]
    model, features = score.train_scorer(spark.createDataFrame(rows, "video_id int, t int, x int, y int, snr double, y_true double"))
    assert model.summary.accuracy > 0.95
    t = np.arange(50)
    own, other = 5 + np.maximum(0, np.sin(t / 3)) * 4, 5 + np.maximum(0, np.cos(t / 5)) * 4
    data = [(0, 1, r, int(k), float(a * own[k] + (1 - a) * other[k])) for r, a in enumerate((0.9, 0.2, 0.1)) for k in t]
    out = traces.separate(spark.createDataFrame(data, "video_id int, mask_id int, region int, t int, v double")).orderBy("t").collect()
    assert np.corrcoef([r.unmixed for r in out], own)[0, 1] > 0.8


def test_spikes_waveform_and_decay(spark):
    # An island too near the start, a lone one, one of two peaks, and one above the range.
    z = [0, 5, 4, 0, 0, 0, 0, 5, 6, 5, 0, 0, 0, 0, 0, 5, 6, 4.5, 5.5, 0, 0, 0, 0, 0, 9, 0, 0]
    df = spark.createDataFrame([(0, t, float(v), float(v)) for t, v in enumerate(z)], "video_id int, t int, snr double, v double")
    peaks = temporal.spikes(df, ["video_id"], 4.0, 7.0, 1, 2)
    assert [(r.t, r.peak) for r in peaks.collect()] == [(8, 6.0)]
    shaken = df.withColumn("quiet", df.t != 9)
    assert temporal.spikes(shaken, ["video_id"], 4.0, 7.0, 1, 2).count() == 0
    wave = temporal.average_waveform(temporal.aligned_waveforms(df, peaks, ["video_id"], 1, 2))
    assert {r.rel: round(r.v, 4) for r in wave.collect()} == {-1: 0.8333, 0: 1.0, 1: 0.8333, 2: 0.0}
    from pyspark.sql import functions as F

    decay = temporal.decay_time(wave.withColumn("k", F.lit(0)), 0.5, ["k"]).first().decay
    assert decay == pytest.approx(1.3)


def test_folds_best_and_sampling(spark):
    v = spark.createDataFrame([(1,), (2,), (3,)], "video_id long")
    assert {(r.cv, r.video_id) for r in tune.folds(v, "train_1_test_rest").collect() if r.trains} == {(1, 1), (2, 2), (3, 3)}
    assert tune.folds(v, "leave-one-out").filter("trains").count() == 6 and tune.folds(v.unionByName(v), "use_all").count() == 3
    with pytest.raises(ValueError):
        tune.folds(v, "other")
    s = spark.createDataFrame([(1, 0.5, 0.5, 0.5, 3), (1, 0.5, 0.5, 0.5, 2), (1, 0.1, 0.1, 0.1, 1)], "cv int, recall double, precision double, f1 double, cons int")
    assert tune.best(s, ["cons"]).first().cons == 2
    assert sorted(r.t for r in score.sampled(video(spark, range(30)), 2, 4, 3).collect()) == [2, 6, 10]


def test_grid_search_scores_every_combination(spark):
    p = [(0, t, x, y, 0.9 if x < 2 and y < 2 else 0.0) for t in range(4) for x in range(8) for y in range(8)]
    pmap = spark.createDataFrame(p, "video_id long, t long, x int, y int, p double")
    gt = spark.createDataFrame([(0, 1, x * 8 + y) for x in range(2) for y in range(2)], "video_id long, gt_id long, p long")
    lists = {"min_area": [2, 9], "avg_area": [50], "thresh_pmap": [150, 254], "thresh_com": [2.0], "thresh_iou": [0.5], "cons": [1, 4, 5]}
    base = {"thresh_mask": 0.5, "thresh_com0": 1.0}
    want = {(a, c, n): float(a == 2 and c == 150 and n < 5) for a in (2, 9) for c in (150, 254) for n in (1, 4, 5)}
    for out in (tune.grid_search(pmap, gt, 8, lists, base), tune.online_grid_search(pmap, gt, 8, lists, base, 2, 2)):
        assert {(r.min_area, r.thresh_pmap, r.cons): r.f1 for r in out.collect()} == want


def test_template_of_lone_spikes(spark):
    from framelake.plans.pipeline import build_template

    rng = np.random.default_rng(2)
    shape = {0: 6.0, 1: 4.0, 2: 2.5, 3: 1.5, 4: 0.8}
    rows = []
    for m in range(3):
        v = rng.normal(10, 0.1, 200)
        for at in (40, 90, 150):
            for k, h in shape.items():
                v[at + k] += h * 0.1 * 1.5
        rows += [(0, m, t, float(x)) for t, x in enumerate(v)]
    df = spark.createDataFrame(rows, "video_id long, mask_id long, t long, v double")
    masks = spark.createDataFrame([(0, m, [m]) for m in range(3)], "video_id long, mask_id long, px array<long>")
    wave, decay = build_template(df, masks, 4.0, 14.0, 2, 4)
    got = {r.rel: r.v for r in wave.collect()}
    assert got[0] == pytest.approx(1.0) and got[0] > got[1] > got[2] and decay.count() == 1
    assert 1.8 < decay.first().tau < 2.8  # the shape falls below 1/e there, on a baseline of ten


def test_online_versions_end_as_one_mask(spark, tmp_path):
    from pyspark.sql import functions as F

    from framelake.streaming.online import OnlineMasks, initial_baseline, merge_windows, online_snr

    rows = [(0, t, x, y, 9.0 if 2 <= x < 5 and 2 <= y < 5 and t % 5 < 4 else float((x + y + t) % 2)) for t in range(15) for x in range(8) for y in range(8)]
    frames = spark.createDataFrame(rows, "video_id long, t long, x int, y int, v double")
    for k in range(3):
        frames.filter((F.col("t") >= 5 * k) & (F.col("t") < 5 * k + 5)).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    params = {"min_area": 2, "avg_area": 50, "thresh_mask": 0.5, "thresh_com0": 1.0, "thresh_com": 2.0, "thresh_iou": 0.5, "cons": 4}
    state = OnlineMasks(spark, f"{tmp_path}/state", 8, params, lambda f: f.filter("v > 5"))
    stream = spark.readStream.schema(frames.schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    merge_windows(stream, state.merge_batch, f"{tmp_path}/ck")
    state.merge_batch(frames.filter("t >= 10"), 2)  # a repeated batch replaces its own version
    last = state.finish(2)
    assert last.pixels.count() == 9 and last.times.count() == 12 and last.pixels.select("id").distinct().count() == 1
    z = online_snr(frames.filter("t >= 10"), initial_baseline(frames, 10))
    assert z.count() == 5 * 64 and z.filter("snr is null").count() == 0


def test_tracked_windows_add_regions_to_confirmed_masks(spark, tmp_path):
    """A cell active in all windows stays one mask by tracking; one that starts late becomes a second mask; times add up."""
    from framelake.streaming.online import OnlineTracker

    def cell(t, x0, y0):
        return [(0, t, x, y) for x in range(x0, x0 + 3) for y in range(y0, y0 + 3)]

    rows = [r for t in range(12) for r in cell(t, 1, 1)] + [r for t in range(6, 12) for r in cell(t, 4, 5)]
    frames = spark.createDataFrame(rows, "video_id long, t long, x int, y int")
    params = {"min_area": 2, "avg_area": 50, "thresh_mask": 0.5, "thresh_com0": 1.0, "thresh_com": 2.0, "thresh_iou": 0.5, "cons": 3}
    state = OnlineTracker(spark, f"{tmp_path}/state", 8, params, lambda f: f)
    for k in range(3):
        state.merge_batch(frames.filter(f"t >= {4 * k} and t < {4 * k + 4}"), k)
    last = state.version(2)
    times = {}
    for r in last.times.collect():
        times.setdefault(r.id, []).append(r.t)
    assert sorted(map(sorted, times.values())) == [list(range(12)), list(range(6, 12))]
    weights = {r.id: (r.n, r.w) for r in last.pixels.groupBy("id").agg({"p": "count", "w": "max"}).toDF("id", "n", "w").collect()}
    assert sorted(weights.values()) == [(9, 6.0), (9, 12.0)]
    assert state.finish(2).pixels.select("id").distinct().count() == 2


def test_copies_of_masks_make_no_pairs_before_the_result(spark):
    """Copies of masks: pairs, merges and drops equal brute force, and only different masks are compared."""
    rng = random.Random(6)
    kinds = [frozenset(rng.sample(range(12), rng.randint(2, 9))) for _ in range(12)]
    sets = {100 * c + k: s for k, s in enumerate(kinds) for c in (3, 1, 2) if k or c == 1}
    masks = joins.as_masks(spark.createDataFrame([(3, k, p) for k, s in sets.items() for p in s], "video_id long, mask_id long, p long"))
    for measure, threshold in (("iou", 0.5), ("contain", 0.75)):
        share = lambda a, b: len(a & b) / (len(a | b) if measure == "iou" else len(b))  # noqa: B023, E731
        wanted = {(a, b, len(sets[a]), len(sets[b]), len(sets[a] & sets[b])) for a in sets for b in sets if (a < b if measure == "iou" else a != b) and share(sets[a], sets[b]) >= threshold}
        got = [(r.a, r.b, r.area_a, r.area_b, r.inter) for r in joins.overlap_pairs(masks, threshold, measure).collect()]
        assert len(got) == len(set(got)) and set(got) == wanted
        pairs, member = joins.class_pairs(masks, threshold, measure)
        assert {x for r in pairs.collect() for x in (r.a, r.b)} <= {min(i for i in sets if sets[i] == s) for s in kinds}
        assert {r.id: (r.rep, r.copies) for r in member.collect()} == {i: (min(j for j in sets if sets[j] == s), sum(s == x for x in sets.values())) for i, s in sets.items()}
    contain = {(a, b) for a, b, *_ in wanted}
    dropped = {b if len(sets[b]) > len(sets[a]) else a for a, b in contain if max(len(sets[a]), len(sets[b])) > 4}
    root = {k: k for k in sets}
    for _ in sets:
        for a, b in contain:
            if max(len(sets[a]), len(sets[b])) <= 4:
                root[a] = root[b] = min(root[a], root[b])
    assert {r.id: r.leader for r in merge.containment_classes(masks, 4, 0.75).collect()} == {k: root[k] for k in sets if k not in dropped}


def test_silenced_frames_need_no_pairs_of_masks(spark):
    rng = random.Random(8)
    held = {k: {0} | set(rng.sample(range(1, 9), 2)) if k % 3 else {20 + k} for k in range(40)}
    on = {(k, t) for k in held for t in range(30) if rng.random() < 0.03}
    masks = joins.as_masks(spark.createDataFrame([(0, k, p) for k, s in held.items() for p in s], "video_id long, mask_id long, p long"))
    left = joins.silenced(spark.createDataFrame([(0, k, t) for k, t in on], "video_id long, mask_id long, t long"), masks)
    assert {(r.mask_id, r.t) for r in left.collect()} == {(k, t) for k, t in on if not any(o != k and s == t and held[o] & held[k] for o, s in on)}
    assert "other#" not in left._jdf.queryExecution().optimizedPlan().toString()
