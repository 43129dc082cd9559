"""Further registered queries: sources and sinks, kernels, templates, folds, traces, spatial filter, leader merges,
tracking, and streams over stored frames."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from framelake import registry_sql as sql
from framelake.functions import scalar
from framelake.operators import baseline, merge, score, segment, temporal, traces
from framelake.operators.joins import as_masks
from framelake.plans import pipeline, tune
from framelake.registry import EMB, FIR, KERNEL, REG, SCORES, SNR, TRACE, VD, WIDTH, base, clusters, emb_regions, grouped_pixels, packed_emb, query, r6, scored_grid, single_pixels, v_day, v_emb
from framelake.sources import frames as src
from framelake.sources.scratch import materialise, new_path
from framelake.streaming import masks as live
from framelake.streaming import online

# Sources and sinks.


@query(f"WITH {VD} SELECT x, y, t::BIGINT AS t, greatest(round(v - 40, 6), 0) AS v FROM vid WHERE t < 10")
def first_frames_clipped(spark, sf_dir):
    stored = materialise(v_day(spark, sf_dir).select("video_id", "t", "x", "y", F.round(F.col("v") - 40, 6).alias("v")), "frames")
    return src.read_frames(spark, stored._framelake_path, clip=True, frames=10).select("x", "y", "t", "v")


@query(f"WITH {EMB} SELECT video_id, t AS mask_id, p, round(v, 6) AS w FROM emb WHERE v > 0.15")
def sparse_pixels(spark, sf_dir):
    dense = v_emb(spark, sf_dir).select("video_id", F.col("t").alias("mask_id"), "x", "y", F.when(F.col("v") > 0.15, F.col("v")).otherwise(0.0).alias("w"))
    return src.sparse_masks(dense, 8).select("video_id", "mask_id", F.col("p").cast("long").alias("p"), r6("w"))


@query(f"WITH RECURSIVE {REG} SELECT video_id, t, seg, y AS x, x AS y FROM reg")
def transposed_masks(spark, sf_dir):
    return src.transpose(emb_regions(spark, sf_dir)).select("video_id", "t", "seg", "x", "y")


@query(f"WITH {TRACE} SELECT mask_id, t::BIGINT AS t, round(raw, 6) AS raw FROM tr WHERE mask_id = 3")
def stored_traces(spark, sf_dir):
    """Traces through the partitioned sink: a reader of one mask opens its folder alone."""
    v = v_day(spark, sf_dir)
    path = new_path(spark, "traces")
    src.save_by(traces.mask_traces(v, grouped_pixels(v), WIDTH), path, "mask_id")
    return spark.read.parquet(path).filter("mask_id = 3").select(F.col("mask_id").cast("long").alias("mask_id"), F.col("t").cast("long").alias("t"), r6("raw"))


@query(f"WITH {SCORES}, b AS (SELECT threshold, cons FROM sc ORDER BY f1 DESC, threshold, cons LIMIT 1), v AS (SELECT DISTINCT label::BIGINT AS video_id FROM embeddings) SELECT video_id, threshold, cons FROM v, b")
def stored_best_params(spark, sf_dir):
    """The best parameters through their sink, joined back to the videos of their fold."""
    path = new_path(spark, "best")
    src.save_by(tune.best(scored_grid(spark, sf_dir).withColumns({"cv": F.lit(0), "f1": F.round("f1", 9)}), ["threshold", "cons"]), path, "cv")
    fold = tune.folds(v_emb(spark, sf_dir), "use_all")
    return fold.join(spark.read.parquet(path), "cv").select("video_id", "threshold", "cons")


# Kernels and parameters.


@query(f"WITH {VD} SELECT x, y, t::BIGINT AS t, round((v + exp(-0.5) * b + exp(-1) * c) / (1 + exp(-0.5) + exp(-1)), 6) AS v FROM (SELECT x, y, t, v, lead(v, 1) OVER w AS b, lead(v, 2) OVER w AS c FROM vid WINDOW w AS (PARTITION BY pix ORDER BY t)) WHERE c IS NOT NULL")
def exponential_filter(spark, sf_dir):
    return temporal.fir_filter(v_day(spark, sf_dir), scalar.exponential_kernel(2, 1.0)).select("x", "y", "t", r6("v"))


@query(f"WITH {VD} SELECT x, y, t::BIGINT AS t, round(0.5 * v + 0.4 * lead(v, 1) OVER w + 0.3 * lead(v, 2) OVER w + 0.25 * lead(v, 3) OVER w + 0.2 * lead(v, 4) OVER w, 6) AS v FROM vid WINDOW w AS (PARTITION BY pix ORDER BY t) QUALIFY lead(v, 4) OVER w IS NOT NULL")
def resampled_filter(spark, sf_dir):
    """The kernel at twice its frame rate."""
    return temporal.fir_filter(v_day(spark, sf_dir), scalar.resample_kernel(KERNEL, 1, 2)).select("x", "y", "t", r6("v"))


@query("SELECT DISTINCT label::BIGINT AS video_id, round_even(30 * (1 + label * 0.25) ** 2, 0)::BIGINT AS min_area, round_even(177 * (1 + label * 0.25) ** 2, 0)::BIGINT AS avg_area, round((6.0 * (1 + label * 0.25))::DOUBLE, 6) AS thresh_com FROM embeddings")
def scaled_params(spark, sf_dir):
    videos = v_emb(spark, sf_dir).select("video_id").distinct()
    params = videos.select("video_id", (1 + F.col("video_id") * 0.25).alias("mag"), F.lit(30).alias("min_area"), F.lit(177).alias("avg_area"), F.lit(6.0).alias("thresh_com"))
    return scalar.scaled(params).select("video_id", "min_area", "avg_area", r6("thresh_com"))


# Runs, spikes and templates.

MAD = f"{VD}, f AS (SELECT pix, quantile_cont(v, 0.5) AS f0 FROM vid GROUP BY pix), m AS (SELECT vid.pix, quantile_cont(abs(v - f0), 0.5) AS mad FROM vid JOIN f USING (pix) GROUP BY vid.pix), z AS (SELECT vid.pix, t, (v - f0) / (mad / 0.6744897501960817) AS snr FROM vid JOIN f USING (pix) JOIN m USING (pix) WHERE mad > 0)"


def spikes_sql(low: float, high: float, far: int, quiet: str) -> str:
    """lone (pix, t, peak) from z; quiet: a condition on a frame q."""
    return f"""ends AS (SELECT pix, min(t) AS t0, max(t) AS t1 FROM z GROUP BY pix),
        q AS (SELECT z.*, snr > lag(snr) OVER w AND snr > lead(snr) OVER w AS top FROM z WINDOW w AS (PARTITION BY pix ORDER BY t)),
        isl AS (SELECT pix, min(t) AS a, max(t) AS b, bool_and({quiet}) AS calm, count(*) FILTER (top) AS tops, max(t) FILTER (top) AS t, max(snr) FILTER (top) AS peak FROM (SELECT *, t - row_number() OVER (PARTITION BY pix ORDER BY t) AS g FROM q WHERE snr > {low} AND snr < {high}) q GROUP BY pix, g),
        nb AS (SELECT isl.*, coalesce(lag(b) OVER w, t0) AS pb, coalesce(lead(a) OVER w, t1) AS na, lag(b) OVER w IS NULL AS is_first, lead(a) OVER w IS NULL AS is_last FROM isl JOIN ends USING (pix) WINDOW w AS (PARTITION BY pix ORDER BY a)),
        lone AS (SELECT pix, t, peak FROM nb WHERE calm AND tops = 1 AND a - pb >= {far} AND na - b >= {far} AND NOT EXISTS (SELECT 1 FROM z WHERE z.pix = nb.pix AND z.snr > {high} AND ((z.t < a AND (is_first OR z.t > pb)) OR (z.t > b AND (is_last OR z.t < na)))))"""


@query(f"WITH {MAD}, {spikes_sql(1.0, 3.0, 3, 'true')} SELECT pix, t::BIGINT AS t, round(peak, 6) AS peak FROM lone")
def lone_spikes(spark, sf_dir):
    """Lone peaks of users' daily sums by the smallest and largest score."""
    z = baseline.mad_snr(v_day(spark, sf_dir), ["pix"]).filter("snr is not null")
    return temporal.spikes(z.select("pix", "t", "snr"), ["pix"], 1.0, 3.0, 1, 2).select("pix", "t", r6("peak"))


WAVES = "wv AS (SELECT l.pix, l.t AS pk, z.t - l.t AS rel, z.snr / l.peak AS v FROM lone l JOIN z ON z.pix = l.pix AND z.t BETWEEN l.t - 1 AND l.t + 2)"


@query(f"WITH {MAD}, {spikes_sql(1.0, 3.0, 3, 'true')}, {WAVES} SELECT rel::INTEGER AS rel, round(avg(v), 6) AS v FROM (SELECT pix, rel, avg(v) AS v FROM wv GROUP BY ALL) GROUP BY rel")
def aligned_waveform(spark, sf_dir):
    z = materialise(baseline.mad_snr(v_day(spark, sf_dir), ["pix"]).filter("snr is not null"), "snr")
    waves = temporal.aligned_waveforms(z, temporal.spikes(z.select("pix", "t", "snr"), ["pix"], 1.0, 3.0, 1, 2), ["pix"], 1, 2)
    return temporal.average_waveform(waves, "pix").select("rel", r6("v"))


DISTURBED = "NOT EXISTS (SELECT 1 FROM z o WHERE o.t = q.t AND abs(o.pix - q.pix) = 1 AND o.snr > 1.0)"
FINE = "fine AS (SELECT video_id, rel + k / 10.0 AS pos, v + coalesce((nx - v) * k / 10.0, 0) AS v FROM (SELECT *, lead(v) OVER (PARTITION BY video_id ORDER BY rel) AS nx FROM bw), (SELECT unnest(range(10)) AS k) WHERE nx IS NOT NULL OR k = 0)"
TEMPLATE = f"{MAD}, {spikes_sql(1.0, 3.0, 3, DISTURBED)}, {WAVES}, bw AS (SELECT 0 AS video_id, rel, avg(v) AS v FROM wv GROUP BY ALL)"


def _neighbours(spark, sf_dir):
    v = v_day(spark, sf_dir)
    tr = v.select(F.lit(0).cast("long").alias("video_id"), F.col("pix").alias("mask_id"), "t", "v")
    masks = as_masks(v.select(F.lit(0).cast("long").alias("video_id"), F.col("pix").alias("mask_id"), F.explode(F.array(F.col("pix"), F.col("pix") + 1)).alias("p")))
    return pipeline.build_template(tr, masks, 1.0, 3.0, 1, 2)


@query(f"WITH {TEMPLATE} SELECT rel::INTEGER AS rel, round(v, 6) AS v FROM bw")
def template_waveform(spark, sf_dir):
    """The mean shape of lone spikes that no overlapping mask disturbs; every mask overlaps with the next user's."""
    return _neighbours(spark, sf_dir)[0].select("rel", r6("v"))


@query(f"WITH {TEMPLATE}, {FINE} SELECT video_id::BIGINT AS video_id, round(max(pos) FILTER (v > exp(-1)), 4) AS tau, round(max(pos) FILTER (v > 0.5) / ln(2), 4) AS half_life FROM fine GROUP BY video_id HAVING max(pos) FILTER (v > exp(-1)) IS NOT NULL")
def template_decay(spark, sf_dir):
    return _neighbours(spark, sf_dir)[1].select("video_id", F.round("tau", 4).alias("tau"), F.round("half_life", 4).alias("half_life"))


@query(f"WITH {TEMPLATE}, k AS (SELECT rel, v FROM bw WHERE v > exp(-1)) SELECT row_number() OVER (ORDER BY rel)::INTEGER - 1 AS l, round(v / sum(v) OVER (), 6) AS w FROM k")
def template_kernel(spark, sf_dir):
    wave = _neighbours(spark, sf_dir)[0]
    return scalar.kernel_from_template(wave.select(F.col("rel").alias("l"), F.col("v").alias("w"))).select(F.col("l").cast("int").alias("l"), r6("w"))


@query(
    f"WITH {VD}, {FIR}, {SNR}, hot AS (SELECT pix, t FROM snr WHERE snr > 2), run AS (SELECT pix, min(t) AS a, count(*) AS n FROM (SELECT pix, t, t - row_number() OVER (PARTITION BY pix ORDER BY t) AS g FROM hot) GROUP BY pix, g), old AS (SELECT pix FROM (SELECT pix, count(*) AS n FROM (SELECT pix, t, t - row_number() OVER (PARTITION BY pix ORDER BY t) AS g FROM hot WHERE t < 15) GROUP BY pix, g) WHERE n >= 2) SELECT DISTINCT pix FROM run WHERE n >= 2 AND pix NOT IN (SELECT pix FROM old)"
)
def newly_confirmed(spark, sf_dir):
    """Users that the first half doesn't confirm and the whole does."""
    hot = materialise(baseline.snr(temporal.fir_filter(v_day(spark, sf_dir), KERNEL)).filter("snr > 2").select("pix", "t"), "hot")
    return temporal.newly_confirmed(hot, temporal.has_run(hot.filter("t < 15"), ["pix"], 2), ["pix"], 2)


# Cross-validation over videos of embeddings: pixels above a threshold for some frames against those of a high mean.

CV = f"""{EMB}, gt AS (SELECT video_id, p FROM emb GROUP BY ALL HAVING avg(v) > 0.02), th AS (SELECT unnest([0.1, 0.15, 0.2])::DOUBLE AS threshold), cs AS (SELECT unnest([1, 2]) AS cons),
    isl AS (SELECT video_id, threshold, p, t - row_number() OVER (PARTITION BY video_id, threshold, p ORDER BY t) AS g FROM emb, th WHERE v > threshold),
    top AS (SELECT video_id, threshold, p, max(n) AS m FROM (SELECT video_id, threshold, p, g, count(*) AS n FROM isl GROUP BY ALL) GROUP BY ALL),
    cell AS (SELECT * FROM (SELECT video_id, count(*) AS n_gt FROM gt GROUP BY video_id), th, cs),
    cnt AS (SELECT c.video_id, c.threshold, c.cons, c.n_gt, count(o.p) AS n_found, count(gt.p) AS n_match FROM cell c LEFT JOIN top o ON o.video_id = c.video_id AND o.threshold = c.threshold AND o.m >= c.cons LEFT JOIN gt ON gt.video_id = o.video_id AND gt.p = o.p GROUP BY ALL),
    sc AS (SELECT *, CASE WHEN n_match > 0 THEN n_match / n_gt ELSE 0 END AS recall, CASE WHEN n_match > 0 THEN n_match / n_found ELSE 0 END AS precision, CASE WHEN n_match > 0 THEN 2.0 * n_match / (n_gt + n_found) ELSE 0 END AS f1 FROM cnt),
    mean AS (SELECT v.video_id AS cv, threshold, cons, avg(recall) AS recall, avg(precision) AS precision, avg(f1) AS f1 FROM (SELECT DISTINCT video_id FROM emb) v JOIN sc ON sc.video_id <> v.video_id GROUP BY ALL)"""


def fold_means(spark, sf_dir):
    v = materialise(v_emb(spark, sf_dir).select("video_id", (F.col("x") * 8 + F.col("y")).alias("id"), "t", F.col("v").alias("z")), "signal")
    gt = v.groupBy("video_id", "id").agg(F.avg("z").alias("m")).filter("m > 0.02")
    each = tune.threshold_scores(v, gt, [0.1, 0.15, 0.2], [1, 2], ["video_id"])
    return tune.mean_over_training(each, tune.folds(v, "leave-one-out"), ["threshold", "cons"])


@query(f"WITH {CV} SELECT cv, threshold, cons, round(recall, 6) AS recall, round(precision, 6) AS precision, round(f1, 6) AS f1 FROM mean")
def cross_validation_means(spark, sf_dir):
    return fold_means(spark, sf_dir).select("cv", "threshold", "cons", r6("recall"), r6("precision"), r6("f1"))


@query(f"WITH {CV} SELECT cv, threshold, cons FROM (SELECT *, row_number() OVER (PARTITION BY cv ORDER BY round(f1, 9) DESC, threshold, cons) AS r FROM mean) WHERE r = 1")
def cross_validation_best(spark, sf_dir):
    return tune.best(fold_means(spark, sf_dir).withColumn("f1", F.round("f1", 9)), ["threshold", "cons"]).select("cv", "threshold", "cons")


# Traces.


@query(
    f"WITH {VD}, mk AS (SELECT DISTINCT pix, x, y FROM vid), cell AS (SELECT m.pix AS mask_id, o.pix AS p, CASE WHEN o.pix = m.pix THEN 0 ELSE least(floor((atan2(o.y - m.y, o.x - m.x) + pi()) / (2 * pi()) * 4), 3) + 1 END::BIGINT AS region FROM mk m JOIN mk o ON sqrt((o.x - m.x) ** 2 + (o.y - m.y) ** 2) < 3) SELECT mask_id, region, t::BIGINT AS t, round(avg(v), 6) AS v FROM cell JOIN vid ON vid.pix = cell.p GROUP BY ALL"
)
def region_traces(spark, sf_dir):
    """A mask's own trace and those of the four sectors around it."""
    v = v_day(spark, sf_dir)
    return traces.region_traces(v, single_pixels(v), WIDTH, 4, 6.0).select("mask_id", "region", "t", r6("v"))


@query(f"WITH {TRACE}, d AS (SELECT mask_id, t, raw - 30 AS raw, t // 10 AS trial FROM tr), f AS (SELECT mask_id, trial, greatest(quantile_cont(raw, 0.05), 0) AS f0 FROM d GROUP BY ALL) SELECT mask_id, t::BIGINT AS t, round(CASE WHEN f0 <> 0 THEN (raw - f0) / f0 END, 6) AS df FROM d JOIN f USING (mask_id, trial)")
def delta_f_by_trial(spark, sf_dir):
    v = v_day(spark, sf_dir)
    tr = traces.mask_traces(v, grouped_pixels(v), WIDTH).withColumns({"raw": F.col("raw") - 30, "trial": F.floor(F.col("t") / 10)})
    return traces.delta_f(tr, key=["mask_id", "trial"]).select("mask_id", "t", r6("df"))


@query()
def unmixed_components(spark, sf_dir):
    """Each mask's own trace and its four sectors as ranked non-negative components."""
    v = v_day(spark, sf_dir)
    parts = traces.components(traces.region_traces(v, single_pixels(v), WIDTH, 4, 6.0))
    return parts.select("mask_id", "rank", r6("share"), "t", r6("part"), "converged")


@query(f"WITH {EMB} SELECT video_id, round(med, 6) AS med, round(noise, 6) AS noise FROM {base('emb', 'video_id')}")
def video_baseline(spark, sf_dir):
    """Median and noise of all pixel values of each video: a few very long groups."""
    return baseline.long_baseline(v_emb(spark, sf_dir), ["video_id"]).select("video_id", r6("med"), r6("noise"))


# Preprocessing and scoring.

RING = "(SELECT dx, dy, sum((1 - exp(-0.5 * (u / (8 / (2 * pi() * 2.0))) ** 2) * exp(-0.5 * (w / (8 / (2 * pi() * 2.0))) ** 2)) * cos(2 * pi() * (u * dx + w * dy) / 8)) / 64 AS k FROM (SELECT unnest(range(-4, 4)) AS u), (SELECT unnest(range(-4, 4)) AS w), (SELECT unnest(range(8)) AS dx), (SELECT unnest(range(8)) AS dy) GROUP BY dx, dy)"
HIGH = f"{EMB}, ker AS {RING}, hp AS (SELECT a.video_id, a.t, a.x, a.y, exp(sum(ln(1 + greatest(b.v, 0)) * k)) AS v FROM emb a JOIN emb b ON a.video_id = b.video_id AND a.t = b.t JOIN ker ON dx = (a.x - b.x + 8) % 8 AND dy = (a.y - b.y + 8) % 8 GROUP BY ALL)"


@query(f"WITH {HIGH} SELECT video_id, t, x, y, round(v, 5) AS v FROM hp")
def spatial_filter(spark, sf_dir):
    """The homomorphic high-pass of every frame."""
    packed = src.pack(src.clipped(v_emb(spark, sf_dir)), 8)
    out = src.unpack(score.high_pass(packed, 8, 8, 2.0), 8)
    return out.select("video_id", "t", F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y"), F.round("v", 5).alias("v"))


@query(
    f"WITH {VD}, c AS (SELECT * REPLACE (greatest(v, 0) AS v) FROM vid), vid2 AS (SELECT * FROM c), fir AS (SELECT * FROM (SELECT pix, x, y, t, v * 0.5 + lead(v, 1) OVER w * 0.3 + lead(v, 2) OVER w * 0.2 AS v, lead(t, 2) OVER w AS last FROM vid2 WINDOW w AS (PARTITION BY pix ORDER BY t)) WHERE last IS NOT NULL), r AS (SELECT t, x, quantile_cont(v, 0.5) AS m FROM fir WHERE x % 2 = 0 AND y % 2 = 0 GROUP BY t, x), l AS (SELECT t, quantile_cont(m, 0.5) AS level FROM r GROUP BY t), sub AS (SELECT pix, x, y, t, v - level AS v FROM fir JOIN l USING (t)) SELECT x, y, t::BIGINT AS t, round(CASE WHEN noise IS NULL THEN 0.0 ELSE (v - med) / noise END, 6) AS snr FROM sub JOIN {base('sub')} b USING (pix)"
)
def preprocessed_video(spark, sf_dir):
    """All of the preprocessing in a row: clip, temporal filter, frame median, SNR."""
    return pipeline.preprocess(v_day(spark, sf_dir), KERNEL, subtract=True).select("x", "y", "t", r6("snr"))


@query(f"WITH {EMB}, m AS (SELECT video_id, t, avg(v) AS mean FROM emb GROUP BY ALL) SELECT video_id, t, x, y, round(1 / (1 + exp(-(v - mean) / 0.05)), 6) AS v FROM emb JOIN m USING (video_id, t)")
def scored_frames(spark, sf_dir):
    """A user's scorer on whole frames: logistic in the distance to the frame's mean."""
    packed = src.pack(v_emb(spark, sf_dir), 8)
    out = src.unpack(score.score_frames(packed, lambda px: 1 / (1 + np.exp(-(px - px.mean(1, keepdims=True)) / 0.05))), 8)
    return out.select("video_id", "t", F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y"), r6("v"))


# Leaders: every segment in its order leads unless a leader stands within the radius.


def leaders_sql(points: str, radius: float, pick: str) -> str:
    """points (video_id, k, id, cx, cy), k from 1 in order."""
    near = f"sqrt((l.cx - p.cx) ** 2 + (l.cy - p.cy) ** 2) <= {radius}"
    return f"""pt AS ({points}), lead_(video_id, k, ls) AS (SELECT video_id, 0, CAST([] AS STRUCT(id BIGINT, cx DOUBLE, cy DOUBLE)[]) FROM (SELECT DISTINCT video_id FROM pt)
        UNION ALL SELECT p.video_id, p.k, CASE WHEN len(list_filter(s.ls, lambda l: {near})) = 0 THEN list_append(s.ls, {{'id': p.id, 'cx': p.cx, 'cy': p.cy}}) ELSE s.ls END FROM lead_ s JOIN pt p ON p.video_id = s.video_id AND p.k = s.k + 1),
        ld AS (SELECT video_id, l.id AS id, l.cx AS cx, l.cy AS cy FROM (SELECT video_id, unnest(arg_max(ls, k)) AS l FROM lead_ GROUP BY video_id)),
        cl AS (SELECT p.video_id, p.id, l.id AS leader, row_number() OVER (PARTITION BY p.video_id, p.id ORDER BY {pick}) AS r FROM pt p JOIN ld l ON l.video_id = p.video_id AND {near}),
        member AS (SELECT video_id, id, leader FROM cl WHERE r = 1)"""


NUMBERED = "SELECT video_id, row_number() OVER (PARTITION BY video_id ORDER BY t, seg) AS k, (t * 2147483648 + seg)::BIGINT AS id, cx, cy FROM stat WHERE area > 1"
DIST = "sqrt((l.cx - p.cx) ** 2 + (l.cy - p.cy) ** 2)"


@query(f"WITH RECURSIVE {REG}, {leaders_sql(NUMBERED, 1.2, 'l.id')} SELECT * FROM member")
def leader_merge_small(spark, sf_dir):
    return clusters(spark, sf_dir, False)


BINARY = """gat AS (SELECT m.video_id, m.leader AS id, r.p, count(*) AS w FROM member m JOIN reg r ON r.video_id = m.video_id AND m.id = r.t * 2147483648 + r.seg GROUP BY ALL),
    bin AS (SELECT video_id, id, p FROM (SELECT *, max(w) OVER (PARTITION BY video_id, id) AS top FROM gat) WHERE w >= top * 0.5),
    cen AS (SELECT video_id, id, avg(p // 8) AS cx, avg(p % 8) AS cy FROM bin GROUP BY ALL)"""


@query(
    f"WITH RECURSIVE {REG}, {leaders_sql(NUMBERED, 0.6, 'l.id')}, {BINARY}, "
    + leaders_sql("SELECT video_id, row_number() OVER (PARTITION BY video_id ORDER BY id) AS k, id, cx, cy FROM cen", 1.0, "round(" + DIST + ", 9), l.id").replace("pt AS", "pt2 AS").replace("lead_", "lead2_").replace("ld AS", "ld2 AS").replace("cl AS", "cl2 AS").replace("member AS", "member2 AS").replace("FROM pt ", "FROM pt2 ").replace("FROM pt)", "FROM pt2)").replace("JOIN pt ", "JOIN pt2 ").replace("JOIN ld ", "JOIN ld2 ").replace("FROM cl ", "FROM cl2 ")
    + " SELECT * FROM member2"
)
def leader_merge_nearest(spark, sf_dir):
    """Merged segments, binarised, whose centres are taken anew, go to the nearest leader."""
    segments, pixels, times = merge.numbered(materialise(emb_regions(spark, sf_dir), "regions"))
    first = merge.gather(pixels, times, merge.cluster(materialise(segments.filter("area > 1"), "segments"), 0.6, False))
    real = merge.binarised(materialise(first.pixels, "pixels"), 0.5)
    return merge.cluster(materialise(merge.centres(real, 8), "centres"), 1.0, True)


@query()
def split_regions(spark, sf_dir):
    """Large regions of the embedding videos, split until their pieces fit."""
    reg = segment.frame_regions(v_emb(spark, sf_dir).filter("v > 0.05"), 8)
    out = segment.split_large(reg, 1, 6, 8)
    return out.groupBy("video_id", "t", "seg", "piece", "whole").agg(F.count("*").alias("area"), F.min("p").alias("first"), F.max("p").alias("last"))


# Tracking: later regions against the masks of the first frame.


@query(
    f"WITH RECURSIVE {REG}, old AS (SELECT video_id, seg AS mask_id, p FROM reg WHERE t = 0), new AS (SELECT * FROM stat WHERE t > 0), hit AS (SELECT n.video_id, n.t, n.seg, n.area AS na, o.mask_id FROM new n JOIN old o ON o.video_id = n.video_id AND o.p = (round_even(n.cx, 0) * 8 + round_even(n.cy, 0))::BIGINT), i AS (SELECT h.video_id, h.t, h.seg, h.na, h.mask_id, s.area AS nb, (SELECT count(*) FROM reg r JOIN old o USING (video_id, p) WHERE r.video_id = h.video_id AND r.t = h.t AND r.seg = h.seg AND o.mask_id = h.mask_id) AS inter FROM hit h JOIN stat s ON s.video_id = h.video_id AND s.t = 0 AND s.seg = h.mask_id), rk AS (SELECT *, row_number() OVER (PARTITION BY video_id, t, seg ORDER BY inter / (na + nb - inter) DESC, mask_id) AS r FROM i WHERE inter / (na + nb - inter) >= 0.5 OR inter / least(na, nb) >= 0.75) SELECT n.video_id, n.t, n.seg, rk.mask_id FROM new n LEFT JOIN rk ON rk.video_id = n.video_id AND rk.t = n.t AND rk.seg = n.seg AND r = 1"
)
def tracked_regions(spark, sf_dir):
    reg = materialise(emb_regions(spark, sf_dir), "regions")
    px = F.sort_array(F.collect_set("p")).alias("px")
    new = segment.region_stats(reg).filter("t > 0").join(reg.groupBy("video_id", "t", "seg").agg(px), ["video_id", "t", "seg"]).withColumnRenamed("seg", "id")
    old = reg.filter("t = 0").groupBy("video_id", F.col("seg").alias("mask_id")).agg(px)
    return merge.track(new, old, 8, {"thresh_iou": 0.5}).select("video_id", "t", F.col("id").alias("seg"), "mask_id")


# Streams over stored frames.


#: Frames of a stored file, and how late a file of frames may come: files are written, and so read, two by two in turned order.
FILE_FRAMES, DELAY = 7, 14
#: Keys, about, that share a row of a stream's state, and keys a file.
BUCKET_KEYS, FILE_KEYS = 256, 65_536


def frame_stream(spark, frames, transform, key):
    """Store frames in parts of FILE_FRAMES frames, of which every two are swapped, in as many files a part as the keys ask
    for, stream them a part's files at a time through a transformation (stream, buckets of keys) into a sink, and read the
    sink. Frames without any value but the last are left out: they are gaps. A closing row, of a key and a time of its own,
    lets the last timers pass."""
    frames = materialise(frames, "frames")
    last, n_keys = frames.agg(F.max("t"), F.approx_count_distinct(F.struct(*key))).first()
    path, last, n_files = new_path(spark, "files"), last or 0, 1 + n_keys // FILE_KEYS
    parts = [k ^ 1 for k in range(last // FILE_FRAMES + 2)]
    closing = frames.limit(1).select(*[(F.lit(last + 10 * DELAY) if c == "t" else F.lit(-1) if c in key else F.col(c)).cast(k).alias(c) for c, k in frames.dtypes])
    for part in parts:
        mine = frames.filter((F.col("t") >= part * FILE_FRAMES) & (F.col("t") < (part + 1) * FILE_FRAMES) & ((F.col("v") != 0) | (F.col("t") == last)))
        (mine.repartition(n_files) if n_files > 1 else mine.coalesce(1)).write.mode("append").parquet(path)
    closing.coalesce(1).write.mode("append").parquet(path)
    result = transform(spark.readStream.schema(frames.schema).option("maxFilesPerTrigger", n_files).parquet(path), 1 + n_keys // BUCKET_KEYS)
    out = new_path(spark, "stream")
    online.run_available(result, f"{out}/rows", f"{out}/state")
    return spark.read.schema(result.schema).parquet(f"{out}/rows").filter(" and ".join(f"{c} >= 0" for c in key))


@query(f"WITH {VD} SELECT x, y, t::BIGINT AS t, round(CASE WHEN noise IS NULL THEN 0.0 ELSE (v - med) / noise END, 6) AS snr FROM vid JOIN {base('(SELECT * FROM vid WHERE t < 10)')} b USING (pix)")
def stream_fixed_baseline(spark, sf_dir):
    """Streamed frames against the baseline of the first ten."""
    v = materialise(v_day(spark, sf_dir).select("video_id", "t", "x", "y", "v"), "frames")
    known = materialise(online.initial_baseline(v, 10), "baseline")
    stream = spark.readStream.schema(v.schema).parquet(v._framelake_path)
    out = new_path(spark, "stream")
    online.run_available(online.online_snr(stream, known), f"{out}/rows", f"{out}/state")
    return spark.read.parquet(f"{out}/rows").select("x", "y", "t", r6("snr"))


@query(
    f"WITH {VD}, k AS (SELECT *, CASE WHEN t < 8 THEN 0 ELSE 1 + (t - 8) // 7 END AS block FROM vid), b AS {base('k', 'pix, block')} SELECT k.pix, t::BIGINT AS t, round(CASE WHEN noise IS NULL THEN 0.0 ELSE (v - med) / noise END, 6) AS snr FROM k JOIN b ON b.pix = k.pix AND b.block = greatest(k.block - 1, 0)"
)
def stream_rolling_baseline(spark, sf_dir):
    """Streamed frames, out of order and with gaps, each block of seven against the baseline of the block before; borders of
    batches lie inside the blocks."""
    v = v_day(spark, sf_dir).select("pix", "t", "v")
    return frame_stream(spark, v, lambda s, n: online.streaming_lagged_snr(s, ["pix"], 8, 7, DELAY, n), ["pix"]).select("pix", "t", r6("snr"))


@query(f"WITH {VD}, {FIR} SELECT pix, t::BIGINT AS t, round(v, 6) AS v FROM fir")
def stream_fir_equals_batch(spark, sf_dir):
    """Daily frames through the stateful filter, out of order and with gaps; borders of batches lie inside the kernel."""
    v = v_day(spark, sf_dir).select("pix", "t", "v")
    return frame_stream(spark, v, lambda s, n: online.streaming_fir(s, KERNEL, ["pix"], DELAY, n), ["pix"]).select("pix", "t", r6("v"))


#: Windows that the SQL unrolls; the streams have as many as there are.
WINDOWS = 8
ONLINE = {"min_area": 1, "avg_area": 30, "thresh_mask": 0.5, "thresh_com0": 0.6, "thresh_com": 1.0, "thresh_iou": 0.5, "cons": 1}


#: Files, and so batches, that a stored stream of frames has at most, but for the closing one.
FILES = 24


def file_parts(n):
    """Parts 0 to n - 1 of a stream, of which every two are swapped, dealt to at most FILES files. With several parts a file
    their number is odd, so that swapped parts still lie in different files."""
    parts = [k ^ 1 for k in range(n)]
    size = -(-n // FILES)
    size += size > 1 and size % 2 == 0
    return [parts[k : k + size] for k in range(0, n, size)]


def live_masks(spark, sf_dir, cons, tracking):
    """Frames in parts of ten, of which every two are swapped, in files of one part or of as many as file_parts() deals to them,
    streamed a file at a time into masks in keyed state, windows of 25 frames; a closing frame of a video of its own lets
    the last windows end. Masks are merged once more at the end."""
    frames = materialise(packed_emb(spark, sf_dir), "packed")
    last, path, out = frames.agg(F.max("t")).first()[0] or 0, new_path(spark, "files"), new_path(spark, "masks")
    for parts in file_parts(last // 10 + 2):
        frames.filter(F.expr("t div 10").isin(parts)).coalesce(1).write.mode("append").parquet(path)
    closing = frames.limit(1).select(F.lit(-1).cast("long").alias("video_id"), F.lit(last + 100).cast("long").alias("t"), F.transform("px", lambda _: F.lit(0.0).cast("float")).alias("px"))
    closing.write.mode("append").parquet(path)
    stream = spark.readStream.schema(frames.schema).option("maxFilesPerTrigger", 1).parquet(path)
    params = ONLINE | {"cons": cons}
    with live.rocks_state(spark):
        online.run_available(live.online_masks(live.regions_of(stream, 8, 0.15), 8, params, 25, 25, 20, tracking), f"{out}/rows", f"{out}/state")
    m = live.latest(spark.read.schema(live.CHANGED).parquet(f"{out}/rows"))
    return merge.final_merge(merge.Masks(materialise(m.pixels, "pixels"), materialise(m.times, "times")), params)


def _summary(m):
    px = m.pixels.groupBy("video_id", "id").agg(F.count("*").alias("pixels"), F.round(F.sum("w"), 6).alias("weight"))
    return px.join(m.times.groupBy("video_id", "id").agg(F.count("*").alias("frames")), ["video_id", "id"])


@query(f"WITH RECURSIVE {REG}, {sql.windowed('o', 'reg', '0.5', 25, WINDOWS)}, {sql.final('ox')} {sql.SUMMARY.format(px='fin', tm='tmoxe', weight='weight,')}")
def online_masks(spark, sf_dir):
    """Masks merged window by window in state, and once more at the end."""
    return _summary(live_masks(spark, sf_dir, 1, False))


@query()
def online_tracked_masks(spark, sf_dir):
    """As online_masks, with regions going to confirmed masks first, which take them up when they go quiet."""
    return _summary(live_masks(spark, sf_dir, 2, True))


# Sweeps of all six parameters over embedding videos. Labelled masks are regions of each video's mean image.


def swept(spark, sf_dir, search, *more):
    v = v_emb(spark, sf_dir)
    p = v.select("video_id", "t", "x", "y", F.col("v").alias("p"))
    image = baseline.mean_image(v).filter("v > 0.02").withColumn("t", F.lit(0))
    gt = segment.frame_regions(image, 8).select("video_id", F.col("seg").alias("gt_id"), "p")
    lists = {"min_area": [1], "avg_area": [30], "thresh_pmap": [45, 60], "thresh_com": [1.0], "thresh_iou": [0.5, 0.7], "cons": [1, 2]}
    return search(p, materialise(gt, "labelled"), 8, lists, {"thresh_mask": 0.5, "thresh_com0": 0.6}, *more)


SWEPT = sql.sweep(EMB, sql.merged("g", "SELECT * FROM each", sql.IOU), "g")
SWEPT_ONLINE = sql.sweep(EMB, sql.windowed("h", "each", sql.IOU, 25, WINDOWS), "hx")
SWEPT_ROWS = "SELECT video_id, min_area, avg_area, thresh_pmap, thresh_com, thresh_iou, cons, round(recall, 6) AS recall, round(precision, 6) AS precision, round(f1, 6) AS f1 FROM sc"


@query(f"WITH RECURSIVE {SWEPT} {SWEPT_ROWS}")
def grid_search(spark, sf_dir):
    out = swept(spark, sf_dir, tune.grid_search)
    return out.select("video_id", *tune.GRID, r6("recall"), r6("precision"), r6("f1"))


@query(
    f"WITH RECURSIVE {SWEPT}, mean AS (SELECT v.video_id AS cv, min_area, avg_area, thresh_pmap, thresh_com, thresh_iou, cons, avg(f1) AS f1 FROM (SELECT DISTINCT video_id FROM sc) v JOIN sc ON sc.video_id <> v.video_id GROUP BY ALL) SELECT cv, min_area, avg_area, thresh_pmap, thresh_com, thresh_iou, cons, round(f1, 6) AS f1 FROM (SELECT *, row_number() OVER (PARTITION BY cv ORDER BY round(f1, 9) DESC, min_area, avg_area, thresh_pmap, thresh_com, thresh_iou, cons) AS r FROM mean) WHERE r = 1"
)
def grid_search_best(spark, sf_dir):
    """The best combination of each leave-one-out fold."""
    return tune.cross_validated(materialise(swept(spark, sf_dir, tune.grid_search), "scores"), "leave_one_out", tune.GRID).select("cv", *tune.GRID, r6("f1"))


@query(f"WITH RECURSIVE {SWEPT_ONLINE} {SWEPT_ROWS}")
def online_grid_search(spark, sf_dir):
    out = swept(spark, sf_dir, tune.online_grid_search, 25, 25)
    return out.select("video_id", *tune.GRID, r6("recall"), r6("precision"), r6("f1"))
