"""The sweep's tree of stages against one run of the merges for each combination, and the rows that its stages write."""

from __future__ import annotations

import itertools

from framelake.operators import merge, segment
from framelake.plans import stages, tune
from pyspark.sql import functions as F

LISTS = {"min_area": [0, 1], "thresh_com": [0.8, 1.5], "thresh_iou": [0.4, 0.7], "avg_area": [4, 30]}
BASE = {"thresh_mask": 0.5, "thresh_com0": 0.6}


def active(spark):
    e = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").filter("label in (1, 4)").orderBy("label", "vec_id").collect()
    seen, rows = {}, []
    for r in e:
        t = seen[r.label] = seen.get(r.label, -1) + 1
        rows += [(r.label, t, p // 8, p % 8) for p, v in enumerate(r.embedding) if v > 0.17] if t < 25 else []
    return spark.createDataFrame(rows, "video_id long, t long, x long, y long")


def table(m):
    px, ts = {}, {}
    for r in m.pixels.collect():
        px.setdefault((r.video_id, r.id), {})[r.p] = r.w
    for r in m.times.collect():
        ts.setdefault((r.video_id, r.id), set()).add(r.t)
    return {k: (px[k], ts[k]) for k in px}


def test_every_combination_equals_its_own_run(spark, monkeypatch):
    regions = segment.frame_regions(active(spark), 8).cache()
    keyed = regions.withColumn("video_id", F.struct("video_id", F.lit(42).alias("thresh_pmap")))
    written, gathered = [], stages._gathered

    def count(m, member):
        out = gathered(m, member)
        written.append((len(stages.fields(out.pixels)), m.pixels.count(), out.pixels.count()))
        return out

    monkeypatch.setattr(stages, "_gathered", count)
    got = table(stages.merged(keyed, 8, LISTS, BASE))
    for combo in itertools.islice(itertools.product(*LISTS.values()), 0, None, 5):
        one = dict(zip(LISTS, combo, strict=True))
        want = table(merge.merged(regions, 8, BASE | one))
        mine = {(k.video_id, i): m for (k, i), m in got.items() if all(k[n] == v for n, v in one.items())}
        assert mine == want and want
    # A stage reads its parents' pixels, whose number no later list multiplies.
    assert [w[0] for w in written] == [3, 4, 5, 6]
    assert written[0][1] == regions.count()
    assert all(a[2] == b[1] for a, b in itertools.pairwise(written))
    assert all(out <= n * read for (_, read, out), n in zip(written, map(len, LISTS.values()), strict=True))


def test_scores_from_a_scorer(spark):
    """T4: packed frames, a scorer, probabilities in 256 steps, and the sweep."""
    e = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").filter("label = 1 and vec_id < 200")
    packed = e.select(F.col("label").cast("long").alias("video_id"), F.col("vec_id").alias("t"), F.col("embedding").alias("px"))
    gt = segment.frame_regions(active(spark).filter("t < 3").withColumn("t", F.lit(0)), 8).select("video_id", F.col("seg").alias("gt_id"), "p")
    lists = {k: v[:1] for k, v in LISTS.items()} | {"thresh_pmap": [43, 70], "cons": [1]}
    got = tune.scored_grid_search(packed, lambda px: px, gt, 8, lists, BASE).collect()
    assert {(r.video_id, r.thresh_pmap) for r in got} == {(v, c) for v in (1, 4) for c in (43, 70)}
    assert all(0 <= r.f1 <= 1 for r in got)
