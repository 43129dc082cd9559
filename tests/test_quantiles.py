from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from framelake.operators import baseline, traces
from framelake.operators.quantiles import exact_quantiles

SHARES = [0.0, 0.05, 0.25, 0.5, 0.9, 1.0]


def rows(rng):
    """One group with two thirds of all rows, ties, outliers, a constant group, single values, null values and null keys."""
    out = [(1, rng.gauss(0, 1) ** 3) for _ in range(20000)] + [(2, float(rng.randrange(5))) for _ in range(5000)]
    out += [(3, 7.0)] * 3000 + [(4, -1.5)] + [(None, rng.random()) for _ in range(999)] + [(5, None)] + [(6, rng.choice([1e300, -1e300, 0.1, float("inf")])) for _ in range(200)]
    out += [(7, float(k)) for k in range(2)]
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("accuracy", [20, 100, 1000])
def test_equal_to_percentile(spark, accuracy):
    df = spark.createDataFrame(rows(random.Random(3)), "k int, v double").repartition(6)
    want = {r.k: (r.n, r.q) for r in df.groupBy("k").agg(F.count("v").alias("n"), F.percentile("v", SHARES).alias("q")).filter("n > 0").collect()}
    got = {r.k: (r.n, r.q) for r in exact_quantiles(df, ["k"], "v", SHARES, accuracy).collect()}
    assert str(got[6]) == str(want[6])  # infinities give NaN between them
    assert {k: x for k, x in got.items() if k != 6} == {k: x for k, x in want.items() if k != 6}


def test_empty_table(spark):
    assert exact_quantiles(spark.createDataFrame([], "k int, v double"), ["k"], "v", SHARES).count() == 0


def test_long_baseline_is_the_baseline(spark):
    rng = random.Random(8)
    df = spark.createDataFrame([(x, t, {0: rng.random(), 1: 4.0, 2: float(t % 50 == 0), 3: float(t)}[x]) for x in range(4) for t in range(4000)], "x int, t int, v double")
    low = {r.x: (r.med, r.noise) for r in baseline.baseline(df, ["x"]).collect()}
    assert low[1] == (4.0, None) and low[2][1] > 0
    for r in baseline.long_baseline(df, ["x"]).collect():
        assert r.med == low[r.x][0] and (r.noise or 0.0) == pytest.approx(low[r.x][1] or 0.0, rel=1e-12)


def plain_factors(s, rounds, seed):
    """Multiplicative updates, one number at a time."""
    rng = np.random.default_rng(seed)
    n, t = s.shape
    w, h = rng.random((n, n)) + 0.1, rng.random((n, t)) + 0.1
    for _ in range(rounds):
        wh = [[sum(w[i, k] * h[k, j] for k in range(n)) for j in range(t)] for i in range(n)]
        h = np.array([[h[k, j] * sum(w[i, k] * s[i, j] for i in range(n)) / max(sum(w[i, k] * wh[i][j] for i in range(n)), 1e-12) for j in range(t)] for k in range(n)])
        wh = [[sum(w[i, k] * h[k, j] for k in range(n)) for j in range(t)] for i in range(n)]
        w = np.array([[w[i, k] * sum(s[i, j] * h[k, j] for j in range(t)) / max(sum(wh[i][j] * h[k, j] for j in range(t)), 1e-12) for k in range(n)] for i in range(n)])
    return w, h


def test_updates_equal_plain_loops_and_stop():
    rng = np.random.default_rng(2)
    s = rng.random((3, 2)) @ rng.random((2, 12))
    w, h, rounds, converged = traces.factorised(s, 0.0, 20, 7)
    want_w, want_h = plain_factors(s, rounds, 7)
    assert np.allclose(w, want_w) and np.allclose(h, want_h) and (rounds, converged) == (20, False)
    loose, tight = (traces.factorised(s, tol, 20000, 7) for tol in (1e-2, 1e-7))
    assert loose[3] and tight[3] and loose[2] < tight[2]
    assert np.linalg.norm(s - tight[0] @ tight[1]) < np.linalg.norm(s - loose[0] @ loose[1]) < np.linalg.norm(s)


def test_components_are_ranked_and_add_up(spark):
    rng = np.random.default_rng(4)
    own, other = np.repeat(rng.random(20) > 0.7, 5) * 3.0, np.repeat(rng.random(20) > 0.6, 5) * 2.0
    mixed = {0: own + 0.4 * other, 1: 0.1 * own + other, 2: 0.2 * own + 0.9 * other}
    data = [(0, m, r, t, float(x) - 5 + m) for m in (1, 2) for r, xs in mixed.items() for t, x in enumerate(xs)]
    data += [(0, 3, 1, 0, 1.0), (0, 4, 0, 0, None), (0, 5, 0, 0, 2.0)]  # no own region, no value, a single frame
    df = spark.createDataFrame(data, "video_id int, mask_id int, region int, t int, v double")
    got = traces.components(df, tol=1e-7).toPandas()
    assert set(got.mask_id) == {1, 2, 5}
    for m in (1, 2):
        one = got[got.mask_id == m]
        assert one.converged.all() and len(one) == 300
        share = one.groupby("rank").share.first()
        assert list(share.index) == [0, 1, 2] and share.is_monotonic_decreasing
        whole = one.groupby("t").part.sum() + one.level.iloc[0]
        assert np.allclose(whole, mixed[0] - 5 + m, atol=0.05)
        assert np.corrcoef(one[one["rank"] == 0].sort_values("t").part, own)[0, 1] > 0.95
    unmixed = traces.separate(df, tol=1e-7).filter("mask_id = 1").orderBy("t").toPandas().unmixed
    best = got[(got.mask_id == 1) & (got["rank"] == 0)].sort_values("t")
    assert np.allclose(unmixed, best.part + best.level)


def test_masks_factorised_together_are_as_each_alone(spark, monkeypatch):
    """Masks of several shapes, over borders of record batches and of chunks: each as factorised by itself."""
    rng = np.random.default_rng(9)
    s = {m: rng.random((2 + m % 3, 12)) * m for m in range(1, 41)}
    w, h, rounds, converged = traces.factorised_all(np.stack([s[m] for m in range(3, 40, 3)]), 1e-4, 300, 0)
    for k, m in enumerate(range(3, 40, 3)):
        one = traces.factorised(s[m], 1e-4, 300, 0)
        assert np.array_equal(w[k], one[0]) and np.array_equal(h[k], one[1]) and (rounds[k], converged[k]) == one[2:]
    assert len(set(rounds.tolist())) > 1 and not converged.all()
    monkeypatch.setattr(traces, "CHUNK_ROWS", 100)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 17)
    try:
        rows = [(7, m, r, t, float(s[m][r, t])) for m in s for r in range(len(s[m])) for t in range(12)]
        got = traces.components(spark.createDataFrame(rows, "video_id int, mask_id int, region int, t int, v double").repartition(8), max_rounds=300).toPandas()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == len(rows) and set(got.video_id) == {7}
    for m, x in s.items():
        level, one = x.min(), got[got.mask_id == m].sort_values(["rank", "t"])
        scale = np.median(x - level)
        w, h, rounds, converged = traces.factorised((x - level) / scale, 1e-4, 300, 0)
        order = np.argsort(-w[0] / w.sum(0), kind="stable")
        assert np.allclose(one.part, (w[0, order, None] * h[order] * scale).ravel()) and np.allclose(one.share, np.repeat((w[0] / w.sum(0))[order], 12))
        assert (one.rounds == rounds).all() and (one.converged == converged).all() and np.allclose(one.level, level)
