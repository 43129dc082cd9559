"""Registered queries over the given tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from framelake import registry_sql as sql
from framelake.functions import scalar
from framelake.operators import baseline, evaluate, joins, merge, score, segment, temporal, traces
from framelake.plans import tune
from framelake.sources import frames as src
from framelake.sources.scratch import materialise, new_path
from framelake.streaming import online

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

KERNEL = [0.5, 0.3, 0.2]
WIDTH = 15
HOUR, DAY = 3600, 86400


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Fixtures: a video of users by days or hours, videos of embeddings, masks of users.


def v_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return src.events_as_frames(table(spark, sf_dir, "events"), DAY, WIDTH)


def v_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    return src.events_as_frames(table(spark, sf_dir, "events"), HOUR, WIDTH)


def packed_emb(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    t = F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1
    return e.select(F.col("label").cast("long").alias("video_id"), t.cast("long").alias("t"), F.col("embedding").alias("px"))


def v_emb(spark: SparkSession, sf_dir: str) -> DataFrame:
    return src.unpack(packed_emb(spark, sf_dir), 8)


def emb_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment.frame_regions(v_emb(spark, sf_dir).filter(F.col("v") > 0.15), 8)


def m_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").filter(F.col("event_type") == "error")
    day = F.unix_date(F.col("ts").cast("date")).cast("long")
    return joins.as_masks(e.select(F.lit(0).cast("long").alias("video_id"), F.col("user_id").alias("mask_id"), day.alias("p")))


def grouped_pixels(frames: DataFrame) -> DataFrame:
    """Ten masks of the users of the same last digit."""
    return frames.select(F.lit(0).alias("video_id"), (F.col("pix") % 10).alias("mask_id"), F.col("pix").alias("p")).distinct()


def binned(seconds: int) -> str:
    return f"""vid AS (SELECT u.pix, u.pix // 15 AS x, u.pix % 15 AS y, d.t, round(coalesce(s.v, 0), 6) AS v
        FROM (SELECT DISTINCT user_id AS pix FROM events) u CROSS JOIN (SELECT unnest(range((date_diff('day', min(ts)::DATE, max(ts)::DATE) + 1) * {DAY // seconds})) AS t FROM events) d
        LEFT JOIN (SELECT user_id AS pix, CAST(floor((epoch(ts) - (SELECT epoch(min(ts)::DATE::TIMESTAMP) FROM events)) / {seconds}) AS BIGINT) AS t, sum(value) AS v FROM events GROUP BY ALL) s ON s.pix = u.pix AND s.t = d.t)"""


VD, VH = binned(DAY), binned(HOUR)
EMB = """emb AS (SELECT label::BIGINT AS video_id, t::BIGINT AS t, (i // 8)::BIGINT AS x, (i % 8)::BIGINT AS y, i::BIGINT AS p, v FROM
        (SELECT label, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS t, unnest(range(64)) AS i, unnest(embedding)::DOUBLE AS v FROM embeddings))"""
FIR = "fir AS (SELECT * FROM (SELECT pix, x, y, t, v * 0.5 + lead(v, 1) OVER w * 0.3 + lead(v, 2) OVER w * 0.2 AS v, lead(t, 2) OVER w AS last FROM vid WINDOW w AS (PARTITION BY pix ORDER BY t)) WHERE last IS NOT NULL)"


def base(of: str, keys: str = "pix", where: str = "") -> str:
    q = f"quantile_cont(v, 0.5){where}"
    r = f"quantile_cont(v, 0.25){where}"
    return f"(SELECT {keys}, {q} AS med, CASE WHEN {q} - {r} <> 0 THEN ({q} - {r}) / 0.6744897501960817 WHEN stddev_pop(v) > 0 THEN stddev_pop(v) END AS noise FROM {of} GROUP BY {keys})"


SNR = f"snr AS (SELECT f.*, CASE WHEN noise IS NULL THEN 0.0 ELSE (v - med) / noise END AS snr FROM fir f JOIN {base('fir')} b USING (pix))"
REG = f"""{EMB}, act AS (SELECT video_id, t, x, y, p FROM emb WHERE v > 0.15),
    edge AS (SELECT a.video_id, a.t, a.p AS a, b.p AS b FROM act a JOIN act b ON a.video_id = b.video_id AND a.t = b.t AND abs(a.x - b.x) + abs(a.y - b.y) = 1),
    reach(video_id, t, p, q) AS (SELECT video_id, t, p, p FROM act UNION SELECT r.video_id, r.t, r.p, e.b FROM reach r JOIN edge e ON e.video_id = r.video_id AND e.t = r.t AND e.a = r.q),
    seg AS (SELECT video_id, t, p, min(q) AS seg FROM reach GROUP BY ALL),
    reg AS (SELECT video_id, t, seg, p, p // 8 AS x, p % 8 AS y FROM seg),
    stat AS (SELECT video_id, t, seg, count(*) AS area, avg(x) AS cx, avg(y) AS cy, min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1 FROM reg GROUP BY ALL)"""
MU = "mu AS (SELECT DISTINCT user_id AS id, date_diff('day', DATE '1970-01-01', ts::DATE)::BIGINT AS p FROM events WHERE event_type = 'error'), sz AS (SELECT id, count(*) AS n FROM mu GROUP BY id), pr AS (SELECT a.id AS a, b.id AS b, count(*) AS inter FROM mu a JOIN mu b ON a.p = b.p AND a.id <> b.id GROUP BY ALL), pn AS (SELECT pr.*, x.n AS na, y.n AS nb FROM pr JOIN sz x ON x.id = a JOIN sz y ON y.id = b)"


def r6(name: str):
    return F.round(name, 6).alias(name)


@query(f"WITH {VD} SELECT x, y, t::BIGINT AS t, v FROM vid")
def pixel_video_dense(spark, sf_dir):
    return v_day(spark, sf_dir).select("x", "y", "t", "v")


@query(f"WITH {VD}, {FIR} SELECT x, y, t::BIGINT AS t, round(v, 6) AS v FROM fir")
def fir_filter(spark, sf_dir):
    return temporal.fir_filter(v_day(spark, sf_dir), KERNEL).select("x", "y", "t", r6("v"))


@query(f"WITH {VD} SELECT x, y, round(med, 6) AS med, round(noise, 6) AS noise FROM {base('vid', 'x, y')}")
def robust_baseline(spark, sf_dir):
    return baseline.baseline(v_day(spark, sf_dir), ["x", "y"]).select("x", "y", r6("med"), r6("noise"))


@query(f"WITH {VD}, {FIR}, {SNR} SELECT x, y, t::BIGINT AS t, round(snr, 6) AS snr FROM snr")
def snr_video(spark, sf_dir):
    return baseline.snr(temporal.fir_filter(v_day(spark, sf_dir), KERNEL)).select("x", "y", "t", r6("snr"))


@query(f"WITH {VD} SELECT v.x, v.y, t::BIGINT AS t, round(CASE WHEN noise IS NULL THEN 0.0 ELSE (v - med) / noise END, 6) AS snr FROM vid v JOIN {base('vid', where=' FILTER (t % 3 = 0)')} b USING (pix)")
def snr_decimated(spark, sf_dir):
    return baseline.snr(v_day(spark, sf_dir), every=3).select("x", "y", "t", r6("snr"))


@query(f"WITH {VH} SELECT x, y, round(max((v - med) / noise), 6) AS top, count(*) FILTER (v <> med) AS off FROM vid v JOIN {base('vid')} b USING (pix) GROUP BY x, y")
def snr_zero_noise(spark, sf_dir):
    z = baseline.snr(v_hour(spark, sf_dir))
    return z.groupBy("x", "y").agg(F.round(F.max("snr"), 6).alias("top"), F.count(F.when(F.col("snr") != 0, 1)).alias("off"))


@query(f"WITH {VD} SELECT x, y, t::BIGINT AS t, round(v / greatest(1, (SELECT avg(m) FROM (SELECT quantile_cont(v, 0.5) AS m FROM vid GROUP BY pix))), 6) AS v FROM vid")
def median_normalized(spark, sf_dir):
    return baseline.median_normalise(v_day(spark, sf_dir)).select("x", "y", "t", r6("v"))


@query(f"WITH {VD}, r AS (SELECT t, x, quantile_cont(v, 0.5) AS m FROM vid WHERE x % 2 = 0 AND y % 2 = 0 GROUP BY t, x), l AS (SELECT t, quantile_cont(m, 0.5) AS level FROM r GROUP BY t) SELECT x, y, t::BIGINT AS t, round(v - level, 6) AS v FROM vid JOIN l USING (t)")
def frame_median_subtract(spark, sf_dir):
    return baseline.frame_median_subtract(v_day(spark, sf_dir)).select("x", "y", "t", r6("v"))


@query(
    f"WITH {VD}, k AS (SELECT *, t // 10 AS block FROM vid), b AS {base('k', 'pix, block')} SELECT x, y, t::BIGINT AS t, k.block::BIGINT AS block, round(CASE WHEN noise IS NULL THEN 0.0 ELSE (v - med) / noise END, 6) AS snr FROM k JOIN b ON b.pix = k.pix AND b.block = greatest(k.block - 1, 0)"
)
def lagged_block_baseline(spark, sf_dir):
    return temporal.lagged_block_normalise(v_day(spark, sf_dir), baseline.baseline, 10, 10).select("x", "y", "t", "block", r6("snr"))


@query(f"WITH {VD}, k AS (SELECT *, t // 10 AS block FROM vid), l AS (SELECT block, avg(m) AS level FROM (SELECT pix, block, quantile_cont(v, 0.5) AS m FROM k GROUP BY ALL) GROUP BY block) SELECT x, y, t::BIGINT AS t, round(v / greatest(1, level), 6) AS v FROM k JOIN l ON l.block = greatest(k.block - 1, 0)")
def lagged_block_level(spark, sf_dir):
    return temporal.lagged_level(v_day(spark, sf_dir), 10, 10).select("x", "y", "t", r6("v"))


@query(f"WITH {VD} SELECT x, y, t::BIGINT AS t, round(ln(1 + v), 6) AS logged, round(exp(ln(1 + v)), 6) AS back FROM vid WHERE v > -1")
def homomorphic_log_exp(spark, sf_dir):
    v = v_day(spark, sf_dir).filter(F.col("v") > -1)
    return v.select("x", "y", "t", F.round(scalar.log1p(F.col("v")), 6).alias("logged"), F.round(scalar.exp(scalar.log1p(F.col("v"))), 6).alias("back"))


@query(f"WITH {EMB}, q AS (SELECT *, 1 / (1 + exp(-(v - 0.15) / 0.05)) AS pr FROM emb) SELECT video_id, t, least(floor(pr * 256), 255)::INTEGER AS bucket, count(*) AS n FROM q GROUP BY ALL")
def pmap_bucket(spark, sf_dir):
    p = v_emb(spark, sf_dir).withColumn("bucket", scalar.bucket(scalar.logistic_score(F.col("v"), 0.15, 0.05)))
    return p.groupBy("video_id", "t", "bucket").agg(F.count("*").alias("n"))


@query(f"WITH {EMB} SELECT video_id, t, x, y FROM emb WHERE 1 / (1 + exp(-(v - 0.15) / 0.05)) > 151 / 256")
def threshold_active(spark, sf_dir):
    p = scalar.logistic_score(F.col("v"), 0.15, 0.05)
    return v_emb(spark, sf_dir).filter(p > scalar.bucket_threshold(150)).select("video_id", "t", F.col("x").cast("long"), F.col("y").cast("long"))


def hot_days(spark, sf_dir):
    z = baseline.snr(temporal.fir_filter(v_day(spark, sf_dir), KERNEL))
    return z.filter(F.col("snr") > 2)


RUNS = f"{VD}, {FIR}, {SNR}, isl AS (SELECT pix, t, t - row_number() OVER (PARTITION BY pix ORDER BY t) AS g FROM snr WHERE snr > 2), run AS (SELECT pix, min(t) AS start, count(*) AS length FROM isl GROUP BY pix, g)"


@query(f"WITH {RUNS} SELECT pix, start::BIGINT AS start, length FROM run")
def active_runs(spark, sf_dir):
    return temporal.runs(hot_days(spark, sf_dir), ["pix"])


@query(f"WITH {RUNS} SELECT pix, max(length) AS max_run, cons FROM run, (VALUES (1), (2), (3)) c(cons) GROUP BY pix, cons HAVING max(length) >= cons")
def max_run_by_cons(spark, sf_dir):
    return tune.sweep_cons(hot_days(spark, sf_dir), [1, 2, 3], ["pix"])


@query(f"WITH {RUNS}, top AS (SELECT pix, max(length) AS max_run FROM run GROUP BY pix HAVING max(length) >= 2) SELECT pix, max_run, round(max(snr), 6) AS peak FROM top JOIN snr USING (pix) WHERE snr > 2 GROUP BY ALL")
def confirmed_users(spark, sf_dir):
    hot = hot_days(spark, sf_dir)
    good = temporal.has_run(hot, ["pix"], 2)
    longest = temporal.runs(hot, ["pix"]).groupBy("pix").agg(F.max("length").alias("max_run"))
    return hot.join(good, "pix", "left_semi").groupBy("pix").agg(F.round(F.max("snr"), 6).alias("peak")).join(longest, "pix").select("pix", "max_run", "peak")


@query(f"WITH RECURSIVE {REG} SELECT video_id, t, seg, p FROM reg")
def frame_regions(spark, sf_dir):
    return emb_regions(spark, sf_dir).select("video_id", "t", "seg", "p")


@query(f"WITH RECURSIVE {REG} SELECT video_id, t, seg, area, round(cx, 6) AS cx, round(cy, 6) AS cy, x0, y0, x1, y1 FROM stat")
def region_stats(spark, sf_dir):
    return segment.region_stats(emb_regions(spark, sf_dir)).select("video_id", "t", "seg", "area", r6("cx"), r6("cy"), "x0", "y0", "x1", "y1")


@query(f"WITH RECURSIVE {REG} SELECT video_id, t, seg, area, min_area FROM stat, (VALUES (1), (2), (3)) g(min_area) WHERE area > min_area")
def region_area_filter(spark, sf_dir):
    return segment.larger(segment.region_stats(emb_regions(spark, sf_dir)), tune.grid(spark, min_area=[1, 2, 3])).select("video_id", "t", "seg", "area", "min_area")


@query(f"WITH RECURSIVE {REG} SELECT a.video_id, (a.t * 2147483648 + a.seg)::BIGINT AS a, (b.t * 2147483648 + b.seg)::BIGINT AS b, round(sqrt((a.cx - b.cx) ** 2 + (a.cy - b.cy) ** 2), 6) AS dist FROM stat a JOIN stat b ON a.video_id = b.video_id AND (a.t, a.seg) < (b.t, b.seg) WHERE a.area > 1 AND b.area > 1 AND sqrt((a.cx - b.cx) ** 2 + (a.cy - b.cy) ** 2) <= 1.2")
def com_radius_pairs(spark, sf_dir):
    segments, _, _ = merge.numbered(emb_regions(spark, sf_dir))
    return joins.radius_pairs(segments.filter("area > 1"), 1.2).select("video_id", "a", "b", r6("dist"))


def clusters(spark, sf_dir, nearest):
    segments, _, _ = merge.numbered(emb_regions(spark, sf_dir))
    return merge.cluster(materialise(segments.filter("area > 1"), "segments"), 1.2, nearest)


@query(f"WITH {MU} SELECT a, b, round(inter / (na + nb - inter), 6) AS iou FROM pn WHERE a < b AND inter / (na + nb - inter) >= 0.4")
def iou_pairs(spark, sf_dir):
    return joins.overlap_pairs(m_user(spark, sf_dir), 0.4, "iou").select("a", "b", F.round("score", 6).alias("iou"))


@query(f"WITH {MU} SELECT a, b, round(inter / nb, 6) AS share FROM pn WHERE inter / nb >= 0.75")
def containment_pairs(spark, sf_dir):
    return joins.overlap_pairs(m_user(spark, sf_dir), 0.75, "contain").select("a", "b", F.round("score", 6).alias("share"))


def chains(pairs: str) -> str:
    return f"e AS ({pairs}), sym AS (SELECT a, b FROM e UNION SELECT b, a FROM e), reach(id, q) AS (SELECT id, id FROM sz UNION SELECT r.id, sym.b FROM reach r JOIN sym ON sym.a = r.q), cls AS (SELECT id, min(q) AS leader FROM reach GROUP BY id)"


@query(f"WITH RECURSIVE {MU}, {chains('SELECT a, b FROM pn WHERE inter / (na + nb - inter) >= 0.6')} SELECT leader, count(DISTINCT cls.id) AS members, count(DISTINCT p) AS pixels FROM cls JOIN mu ON mu.id = cls.id GROUP BY leader")
def iou_merge(spark, sf_dir):
    masks = materialise(m_user(spark, sf_dir), "masks")
    pairs, each = joins.class_pairs(masks, 0.6, "iou", links=True)
    member = merge.classes(materialise(pairs, "pairs"), each)
    px = masks.select("video_id", F.col("mask_id").alias("id"), F.explode("px").alias("p"))
    return px.join(member, ["video_id", "id"]).groupBy("leader").agg(F.countDistinct("id").alias("members"), F.countDistinct("p").alias("pixels"))


@query(
    f"WITH RECURSIVE {MU}, con AS (SELECT * FROM pn WHERE inter / nb >= 0.8), gone AS (SELECT CASE WHEN nb > na THEN b ELSE a END AS id FROM con WHERE greatest(na, nb) > 12), {chains('SELECT a, b FROM con WHERE greatest(na, nb) <= 12')} SELECT id, leader FROM cls WHERE id NOT IN (SELECT id FROM gone)"
)
def containment_merge(spark, sf_dir):
    return merge.containment_classes(materialise(m_user(spark, sf_dir), "masks"), 12, 0.8).select("id", "leader")


@query(f"WITH RECURSIVE {REG} SELECT s.video_id, s.t, s.seg, r.seg AS mask_id FROM stat s JOIN reg r ON r.video_id = s.video_id AND r.t = 0 AND r.p = (round_even(s.cx, 0) * 8 + round_even(s.cy, 0))::BIGINT WHERE s.t > 0")
def point_in_mask(spark, sf_dir):
    reg = materialise(emb_regions(spark, sf_dir), "regions")
    points = segment.region_stats(reg).filter("t > 0").withColumn("id", F.struct("t", "seg"))
    hits = joins.point_in_mask(points, reg.filter("t = 0").withColumnRenamed("seg", "mask_id"), 8)
    return hits.select("video_id", "id.t", "id.seg", "mask_id")


@query(
    f"WITH RECURSIVE {REG}, old AS (SELECT video_id, seg, p FROM reg WHERE t = 0), new AS (SELECT video_id, t, seg, p FROM reg WHERE t > 0), i AS (SELECT n.video_id, n.t, n.seg, o.seg AS mask_id, count(*) AS inter FROM new n JOIN old o USING (video_id, p) GROUP BY n.video_id, n.t, n.seg, o.seg), sc AS (SELECT i.*, inter / (a.area + b.area - inter) AS s, inter / least(a.area, b.area) AS c FROM i JOIN stat a USING (video_id, t, seg) JOIN stat b ON b.video_id = i.video_id AND b.t = 0 AND b.seg = i.mask_id), rk AS (SELECT *, row_number() OVER (PARTITION BY video_id, t, seg ORDER BY s DESC, mask_id) AS r FROM sc WHERE s >= 0.5 OR c >= 0.75) SELECT video_id, t, seg, mask_id, round(s, 6) AS iou FROM rk WHERE r = 1"
)
def best_match(spark, sf_dir):
    reg = materialise(emb_regions(spark, sf_dir), "regions")
    px = reg.groupBy("video_id", "t", "seg").agg(F.sort_array(F.collect_set("p")).alias("px"))
    new = px.filter("t > 0").select("video_id", F.struct("t", "seg").alias("id"), "px")
    found = merge.matches(new, px.filter("t = 0").select("video_id", F.col("seg").alias("mask_id"), "px"), 0.5, 0.75)
    return found.select("video_id", "id.t", "id.seg", "mask_id", F.round("score", 6).alias("iou"))


@query(
    f"WITH RECURSIVE {REG}, key AS (SELECT (video_id * 1000 + t // 2) AS g, t % 2 AS side, seg, p FROM reg), a AS (SELECT g, seg, count(*) AS n FROM key WHERE side = 0 GROUP BY ALL), b AS (SELECT g, seg, count(*) AS n FROM key WHERE side = 1 GROUP BY ALL), i AS (SELECT x.g, x.seg AS gs, y.seg AS ms, count(*) AS inter FROM key x JOIN key y ON x.g = y.g AND x.p = y.p AND x.side = 0 AND y.side = 1 GROUP BY ALL), hit AS (SELECT i.g, count(*) AS n_match FROM i JOIN a ON a.g = i.g AND a.seg = gs JOIN b ON b.g = i.g AND b.seg = ms WHERE inter / (a.n + b.n - inter) > 0.5 GROUP BY i.g), ct AS (SELECT coalesce(a.g, b.g) AS g, coalesce(a.k, 0) AS n_gt, coalesce(b.k, 0) AS n_found FROM (SELECT g, count(*) AS k FROM a GROUP BY g) a FULL JOIN (SELECT g, count(*) AS k FROM b GROUP BY g) b ON a.g = b.g) SELECT ct.g AS video_id, n_gt, n_found, coalesce(n_match, 0) AS n_match, round(CASE WHEN n_match > 0 THEN n_match / n_gt ELSE 0 END, 6) AS recall, round(CASE WHEN n_match > 0 THEN n_match / n_found ELSE 0 END, 6) AS precision, round(CASE WHEN n_match > 0 THEN 2 * (n_match / n_gt) * (n_match / n_found) / (n_match / n_gt + n_match / n_found) ELSE 0 END, 6) AS f1 FROM ct LEFT JOIN hit ON hit.g = ct.g"
)
def match_scores(spark, sf_dir):
    """Regions of even frames against those of the next odd frame; disjoint masks with IoU > 1/2 pair uniquely."""
    # The number given out is that of another video's frames from frame 2000 on, so it can't be the key.
    reg = materialise(emb_regions(spark, sf_dir), "regions").withColumn("pair", F.expr("t div 2"))
    gt = reg.filter("t % 2 = 0").select("video_id", "pair", F.col("seg").alias("gt_id"), "p")
    found = reg.filter("t % 2 = 1").select("video_id", "pair", F.col("seg").alias("mask_id"), "p")
    return evaluate.scores(gt, found, 0.5000001, ["video_id", "pair"]).select((F.col("video_id") * 1000 + F.col("pair")).alias("video_id"), "n_gt", "n_found", "n_match", r6("recall"), r6("precision"), r6("f1"))


@query(f"WITH RECURSIVE {REG}, {sql.merged('m', 'SELECT video_id, t, seg, p FROM reg', '0.5')}, {sql.final('m')} {sql.SUMMARY.format(px='fin', tm='tmme', weight='')}")
def tracked_masks(spark, sf_dir):
    """The whole batch pipeline over the embedding videos: masks with their pixels and active frames."""
    params = {"min_area": 1, "avg_area": 30, "thresh_mask": 0.5, "thresh_com0": 0.6, "thresh_com": 1.0, "thresh_iou": 0.5, "cons": 1}
    m = merge.complete(materialise(emb_regions(spark, sf_dir), "regions"), 8, params)
    px = m.pixels.groupBy("video_id", "id").agg(F.count("*").alias("pixels"))
    return px.join(m.times.groupBy("video_id", "id").agg(F.count("*").alias("frames")), ["video_id", "id"])


TRACE = f"{VD}, tr AS (SELECT (pix % 10)::BIGINT AS mask_id, t, avg(v) AS raw FROM vid GROUP BY ALL)"


@query(f"WITH {TRACE} SELECT mask_id, t::BIGINT AS t, round(raw, 6) AS raw FROM tr")
def mask_traces(spark, sf_dir):
    v = v_day(spark, sf_dir)
    return traces.mask_traces(v, grouped_pixels(v), WIDTH).select("mask_id", "t", r6("raw"))


NEAR = "mk AS (SELECT pix AS mask_id, pix AS p FROM (SELECT DISTINCT pix FROM vid)), bg AS (SELECT m.mask_id, v.t, quantile_cont(v.v, 0.5) AS bg FROM mk m JOIN vid v ON sqrt((v.x - m.p // 15) ** 2 + (v.y - m.p % 15) ** 2) < 2 AND v.pix <> m.p GROUP BY ALL)"


def single_pixels(v: DataFrame) -> DataFrame:
    """Every pixel is a mask of its own."""
    return v.select("video_id", F.col("pix").alias("mask_id"), F.col("pix").alias("p")).distinct()


@query(f"WITH {VD}, {NEAR} SELECT mask_id, t::BIGINT AS t, round(bg, 6) AS bg FROM bg")
def background_traces(spark, sf_dir):
    v = v_day(spark, sf_dir)
    return traces.background_traces(v, single_pixels(v), WIDTH).select("mask_id", "t", r6("bg"))


@query(f"WITH {TRACE} SELECT mask_id, t::BIGINT AS t, round(CASE WHEN f0 <> 0 THEN (raw - f0) / f0 END, 6) AS df FROM tr JOIN (SELECT mask_id, quantile_cont(raw, 0.05) AS f0 FROM tr GROUP BY mask_id) USING (mask_id)")
def delta_f(spark, sf_dir):
    v = v_day(spark, sf_dir)
    return traces.delta_f(traces.mask_traces(v, grouped_pixels(v), WIDTH)).select("mask_id", "t", r6("df"))


LABEL = f"{VD}, {NEAR}, un AS (SELECT m.mask_id, v.t, v.v AS raw, v.v - coalesce(bg, 0) AS um FROM mk m JOIN vid v ON v.pix = m.p LEFT JOIN bg ON bg.mask_id = m.mask_id AND bg.t = v.t), act AS (SELECT u.mask_id, u.t, r.ratio FROM un u JOIN (SELECT mask_id, quantile_cont(um, 0.5) AS mu, (quantile_cont(raw, 0.5) - quantile_cont(raw, 0.25)) / 0.6744897501960817 AS s FROM un GROUP BY mask_id) q USING (mask_id), (VALUES (1.5), (3.0)) r(ratio) WHERE u.um > mu + r.ratio::DOUBLE * s)"


def labelled(spark, sf_dir):
    v = v_day(spark, sf_dir)
    px = single_pixels(v)
    return px, traces.activity(traces.unmixed(traces.mask_traces(v, px, WIDTH), traces.background_traces(v, px, WIDTH)), [1.5, 3.0])


@query(f"WITH {LABEL} SELECT mask_id, t::BIGINT AS t, ratio::DOUBLE AS ratio FROM act")
def activity_labels(spark, sf_dir):
    return labelled(spark, sf_dir)[1].select("mask_id", "t", "ratio")


@query(f"WITH {LABEL} SELECT DISTINCT act.t::BIGINT AS t, mk.p FROM act JOIN mk USING (mask_id) WHERE ratio = 3.0")
def temporal_masks(spark, sf_dir):
    px, active = labelled(spark, sf_dir)
    return joins.label_pixels(active.filter("ratio = 3.0"), px).select("t", "p")


@query(
    "WITH yp AS (SELECT lang, toxic::DOUBLE AS y, quality * 0.6 + 0.2 AS p FROM labels JOIN documents USING (doc_id)) SELECT lang, round((2 * sum(y * p) + 1) / (sum(y * y) + sum(p * p) + 1), 6) AS dice, round(-avg(y * ln(p) + (1 - y) * ln(1 - p)), 6) AS bce, round(-avg(0.25 * y * (1 - p) * ln(p) + 0.75 * (1 - y) * p * ln(1 - p)), 6) AS focal FROM yp GROUP BY lang"
)
def dice_focal_metrics(spark, sf_dir):
    yp = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id").select("lang", F.col("toxic").alias("y"), (F.col("quality") * 0.6 + 0.2).alias("p"))
    return score.losses(yp, key=["lang"]).select("lang", r6("dice"), r6("bce"), r6("focal"))


THRESHOLDS, CONS = [1.0, 1.5, 2.0, 2.5, 3.0], [1, 2, 3]
SCORES = f"""{VD}, {FIR}, {SNR}, gt AS (SELECT user_id AS pix FROM events WHERE event_type = 'error' GROUP BY user_id HAVING count(*) > 14),
    isl AS (SELECT th, pix, t - row_number() OVER (PARTITION BY th, pix ORDER BY t) AS g FROM snr, (SELECT unnest([1.0, 1.5, 2.0, 2.5, 3.0])::DOUBLE AS th) WHERE snr > th),
    longest AS (SELECT th, pix, max(n) AS m FROM (SELECT th, pix, g, count(*) AS n FROM isl GROUP BY ALL) GROUP BY th, pix),
    cell AS (SELECT th, cons FROM (SELECT unnest([1.0, 1.5, 2.0, 2.5, 3.0])::DOUBLE AS th), (SELECT unnest([1, 2, 3]) AS cons)),
    cnt AS (SELECT cell.th, cell.cons, count(l.pix) AS n_found, count(gt.pix) AS n_match, (SELECT count(*) FROM gt) AS n_gt FROM cell LEFT JOIN longest l ON l.th = cell.th AND l.m >= cell.cons LEFT JOIN gt ON gt.pix = l.pix GROUP BY ALL),
    sc AS (SELECT th AS threshold, cons, n_found, n_match, n_gt, CASE WHEN n_match > 0 THEN n_match / n_gt ELSE 0 END AS recall, CASE WHEN n_match > 0 THEN n_match / n_found ELSE 0 END AS precision, CASE WHEN n_match > 0 THEN 2 * (n_match / n_gt) * (n_match / n_found) / (n_match / n_gt + n_match / n_found) ELSE 0 END AS f1 FROM cnt)"""


def scored_grid(spark, sf_dir):
    z = baseline.snr(temporal.fir_filter(v_day(spark, sf_dir), KERNEL)).select(F.col("pix").alias("id"), "t", F.col("snr").alias("z"))
    gt = table(spark, sf_dir, "events").filter("event_type = 'error'").groupBy(F.col("user_id").alias("id")).count().filter("count > 14").select("id")
    return tune.threshold_scores(z, gt, THRESHOLDS, CONS)


@query(f"WITH {SCORES} SELECT threshold, cons, n_found, n_match, n_gt, round(f1, 6) AS f1 FROM sc")
def grid_scores(spark, sf_dir):
    return scored_grid(spark, sf_dir).select("threshold", "cons", "n_found", "n_match", "n_gt", r6("f1"))


@query(f"WITH {SCORES} SELECT threshold, cons, round(f1, 6) AS f1 FROM sc ORDER BY f1 DESC, threshold, cons LIMIT 1")
def best_params(spark, sf_dir):
    one = scored_grid(spark, sf_dir).withColumns({"cv": F.lit(0), "f1": F.round("f1", 9)})
    return tune.best(one, ["threshold", "cons"]).select("threshold", "cons", r6("f1"))


@query(f"WITH {SCORES} SELECT coalesce(threshold, -1) AS threshold, coalesce(cons, -1) AS cons, round(max(f1), 6) AS best_f1 FROM sc GROUP BY CUBE (threshold, cons)")
def grid_marginals(spark, sf_dir):
    best = tune.marginals(scored_grid(spark, sf_dir), ["threshold", "cons"])
    return best.select(F.coalesce("threshold", F.lit(-1.0)).alias("threshold"), F.coalesce("cons", F.lit(-1)).alias("cons"), r6("best_f1"))


@query("WITH v AS (SELECT DISTINCT label::BIGINT AS video_id FROM embeddings) SELECT a.video_id AS cv, b.video_id, a.video_id <> b.video_id AS trains FROM v a, v b")
def cv_folds(spark, sf_dir):
    return tune.folds(table(spark, sf_dir, "embeddings").select(F.col("label").alias("video_id")), "leave-one-out")


@query(f"WITH {EMB} SELECT video_id, t, p, round(v, 6) AS v FROM emb WHERE t >= 3 AND (t - 3) % 5 = 0 AND t - 3 < 50")
def systematic_sample(spark, sf_dir):
    return score.sampled(v_emb(spark, sf_dir), 3, 5, 10).select("video_id", "t", (F.col("x") * 8 + F.col("y")).cast("long").alias("p"), r6("v"))


@query(
    f"WITH {EMB}, c AS (SELECT *, (video_id + t) % 2 = 1 AS h, (t // 2) % 2 = 1 AS u, (t // 4) % 2 = 1 AS r FROM emb), f AS (SELECT *, CASE WHEN h THEN 7 - x ELSE x END AS fx, CASE WHEN u THEN 7 - y ELSE y END AS fy FROM c) SELECT video_id, t, CASE WHEN r THEN 7 - fy ELSE fx END AS x, CASE WHEN r THEN fx ELSE fy END AS y, round(v, 6) AS v FROM f"
)
def augment_flip_rot(spark, sf_dir):
    """Frames flipped and turned by coins that follow from video and frame."""
    coins = [(F.col("video_id") + F.col("t")) % 2 == 1, F.floor(F.col("t") / 2) % 2 == 1, F.floor(F.col("t") / 4) % 2 == 1]
    return scalar.moved(v_emb(spark, sf_dir), 8, 8, coins).select("video_id", "t", F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y"), r6("v"))


@query(f"WITH {VD}, f AS (SELECT pix, quantile_cont(v, 0.5) AS f0 FROM vid GROUP BY pix), m AS (SELECT vid.pix, quantile_cont(abs(v - f0), 0.5) AS mad FROM vid JOIN f USING (pix) GROUP BY vid.pix) SELECT vid.pix, t::BIGINT AS t, round(CASE WHEN mad > 0 THEN (v - f0) / (mad / 0.6744897501960817) END, 6) AS snr FROM vid JOIN f USING (pix) JOIN m USING (pix)")
def mad_snr(spark, sf_dir):
    return baseline.mad_snr(v_day(spark, sf_dir), ["pix"]).select("pix", "t", r6("snr"))


def streamed(spark, sf_dir, transform, mode="append"):
    """Run a streaming query over the whole events table into a Parquet sink, and read the sink. A second run of the same
    query brings the earliest hundred events again, which are late by then and must be dropped, and a row a year later,
    which moves the watermark past all events, so that the last windows come out too."""
    path = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(path).schema
    # A file stream reads a folder; a one-file table is streamed by its name.
    stream = online.event_stream(spark, path if _is_folder(spark, path) else f"{sf_dir}/events*.parquet", schema)
    out, more = new_path(spark, "stream"), new_path(spark, "late")
    events = spark.read.parquet(path)
    spark.createDataFrame([], schema).write.parquet(more)
    result = transform(stream.unionByName(online.event_stream(spark, more, schema)))
    online.run_available(result, f"{out}/rows", f"{out}/state", mode)
    closing = events.agg((F.max("ts") + F.expr("INTERVAL 1 YEAR")).alias("ts")).select(*[F.col("ts") if f.name == "ts" else F.lit(None).cast(f.dataType).alias(f.name) for f in schema])
    events.orderBy("ts", "event_id").limit(100).unionByName(closing).write.mode("append").parquet(more)
    online.run_available(result, f"{out}/rows", f"{out}/state", mode)
    return spark.read.schema(result.schema).parquet(f"{out}/rows")


def _is_folder(spark, path):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def tumbling_activity(spark, sf_dir):
    got = streamed(spark, sf_dir, lambda s: online.tumbling_activity(s, "1 hour", "1 hour"))
    return got.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query(
    "WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 hour THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k"
)
def session_activity(spark, sf_dir):
    got = streamed(spark, sf_dir, lambda s: online.session_activity(s, "6 hours", "1 hour"))
    return got.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n")


@query(f"WITH {EMB} SELECT video_id, max(t) + 1 AS nt, max(x) + 1 AS lx, max(y) + 1 AS ly FROM emb GROUP BY video_id")
def video_dims(spark, sf_dir):
    dims = src.video_dims(v_emb(spark, sf_dir))
    return dims.select("video_id", "nt", F.col("lx").cast("long").alias("lx"), F.col("ly").cast("long").alias("ly"))


@query(f"WITH {EMB} SELECT x, y, video_id, round(avg(v), 6) AS v FROM emb GROUP BY ALL")
def mean_image(spark, sf_dir):
    return baseline.mean_image(v_emb(spark, sf_dir)).select(F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y"), "video_id", r6("v"))


@query(f"WITH {EMB} SELECT video_id, threshold::DOUBLE AS threshold, round(avg((v > threshold)::INTEGER), 6) AS ratio FROM emb, (VALUES (0.05), (0.1), (0.15), (0.2)) g(threshold) GROUP BY ALL HAVING avg((v > threshold)::INTEGER) <= 0.12")
def active_ratio(spark, sf_dir):
    return tune.sparse_enough(v_emb(spark, sf_dir).withColumnRenamed("v", "p"), [0.05, 0.1, 0.15, 0.2], 0.12).select("video_id", "threshold", r6("ratio"))


@query(f"WITH {EMB} SELECT video_id, t, x, y, round(v, 6) AS v FROM emb WHERE x < 7 AND y < 6")
def pack_round_trip(spark, sf_dir):
    back = src.unpack(src.pack(v_emb(spark, sf_dir).repartition("x"), 8), 8)
    return src.crop(back, 7, 6).select("video_id", "t", F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y"), r6("v"))


@query(f"WITH {VD}, g AS (SELECT max(t) + 1 AS nt, (max(x) // 8 + 1) * 8 AS lx, (max(y) // 8 + 1) * 8 AS ly FROM vid) SELECT t::BIGINT AS t, (SELECT lx * ly FROM g)::BIGINT AS cells, round(sum(v), 4) AS total FROM vid GROUP BY t")
def densified_grid(spark, sf_dir):
    dense = src.densify(v_day(spark, sf_dir).drop("pix"))
    return dense.groupBy("t").agg(F.count("*").alias("cells"), F.round(F.sum("v"), 4).alias("total"))


@query(f"WITH {VD} SELECT x, y, t::BIGINT AS t, round(v * CASE WHEN (x + y) % 2 = 0 THEN 0.5 ELSE 0 END, 6) AS v FROM vid")
def masked_frames(spark, sf_dir):
    v = v_day(spark, sf_dir)
    mask = v.filter((F.col("x") + F.col("y")) % 2 == 0).select("x", "y", F.lit(0.5).alias("w")).distinct()
    return scalar.masked(v, mask).select("x", "y", "t", r6("v"))


HOURS = "CAST(floor(epoch(ts) / 3600) AS BIGINT)"


def by_hour(events: DataFrame, kind: str, name: str) -> DataFrame:
    hour = F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / HOUR)
    return events.filter(F.col("event_type") == kind).select(F.lit(0).cast("long").alias("video_id"), F.col("user_id").alias("mask_id"), hour.cast("long").alias(name)).distinct()


@query(
    f"WITH m AS (SELECT DISTINCT user_id AS id, {HOURS} AS p FROM events WHERE event_type = 'error'), act AS (SELECT DISTINCT user_id AS id, {HOURS} AS t FROM events WHERE event_type = 'purchase'), pr AS (SELECT DISTINCT a.id AS a, b.id AS b FROM m a JOIN m b ON a.p = b.p AND a.id <> b.id) SELECT id, t FROM act WHERE NOT EXISTS (SELECT 1 FROM pr JOIN act o ON o.id = pr.b WHERE pr.a = act.id AND o.t = act.t)"
)
def silenced_frames(spark, sf_dir):
    """Purchase hours of users in which no user buys who shares an error hour with them."""
    e = table(spark, sf_dir, "events")
    masks = joins.as_masks(by_hour(e, "error", "p"))
    return joins.silenced(by_hour(e, "purchase", "t"), masks).select(F.col("mask_id").alias("id"), "t")


@query("WITH u AS (SELECT DISTINCT user_id AS eid FROM events), done AS (SELECT user_id AS eid FROM events WHERE event_type = 'error' GROUP BY user_id HAVING count(*) > 14) SELECT eid FROM u WHERE eid NOT IN (SELECT eid FROM done)")
def unfinished_work(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    plan = e.select(F.col("user_id").alias("eid")).distinct()
    done = e.filter("event_type = 'error'").groupBy(F.col("user_id").alias("eid")).count().filter("count > 14").select("eid")
    return src.unfinished(plan, done, ["eid"])
