"""Leaders of points by tiles against the plain scan in the order of ids."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from framelake.operators import leaders as L


def plain(points, radius):
    """{(video, id): (smallest leader, nearest leader)} of points (video, id, x, y), those without any left out."""
    lead, out = {}, {}
    dist = lambda a, b: math.sqrt((a[0] - b[0]) ** 2 + (a[1] - b[1]) ** 2)
    for v, i, x, y in sorted(points):
        if not any(dist((x, y), q) <= radius for q in lead.get(v, {}).values()):
            lead.setdefault(v, {})[i] = (x, y)
    for v, i, x, y in points:
        near = [(round(dist((x, y), q), 9), k) for k, q in lead.get(v, {}).items() if dist((x, y), q) <= radius]
        if near:
            out[v, i] = min(k for _, k in near), min(near)[1]
    return out


def by_tiles(spark, points, radius, tile=L.TILE, rows=L.SCAN_ROWS):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(points, "video_id long, id long, cx double, cy double").withColumn("r", F.lit(float(radius)))
    lead = L.leaders(df, tile, rows)
    small, near = ({(r.video_id, r.id): r.leader for r in L.members(df, lead, nearest).collect()} for nearest in (False, True))
    assert small.keys() == near.keys()
    return {k: (small[k], near[k]) for k in small}


def cloud(seed, n=600, size=40.0):
    """Points over two videos, ids in no spatial order, with crowds, equal places and halves of the radius."""
    rng = random.Random(seed)
    spots = [(rng.uniform(0, size), rng.uniform(-size, 0)) for _ in range(n // 6)]
    out = []
    for i in rng.sample(range(10 * n), n):
        x, y = rng.choice(spots) if rng.random() < 0.5 else (rng.uniform(0, size), rng.uniform(-size, 0))
        out.append((rng.randrange(2), i, round(x * 2) / 2 if rng.random() < 0.3 else x, y))
    return out


@pytest.mark.parametrize(("tile", "rows"), [(32, 8192), (2, 8192), (1, 20)])
def test_equals_plain_scan(spark, tile, rows):
    """One tile, many with borders that stay open, and tiles that scan twenty points at a time."""
    points = cloud(tile + rows)
    assert by_tiles(spark, points, 2.0, tile, rows) == plain(points, 2.0)


@pytest.mark.parametrize("step", [1, -1])
def test_drifting_chain_needs_few_rounds(spark, monkeypatch, step):
    """A chain of 3,000 points, each in reach of the last, whose first point decides all: rounds grow with the logarithm of
    the tiles that it crosses, and with ids that run against it too."""
    points = [(0, k, 0.9 * step * k, 0.3 * (k % 3)) for k in range(3000)]
    rounds, first_rows = [], L._first_rows
    monkeypatch.setattr(L, "_first_rows", lambda *a: rounds.append(1) or first_rows(*a))
    assert by_tiles(spark, points, 1.0, 32) == plain(points, 1.0)
    assert len(rounds) <= 2 + math.log2(3000 / 32)


def test_a_cell_seen_very_often(spark, monkeypatch):
    """40,000 sightings of three cells are never paired: rows that leave a join or a task stay in proportion to the points."""
    rng = np.random.default_rng(1)
    at = np.array([(0.0, 0.0), (5.0, 0.0), (2.4, 0.0)])[rng.integers(0, 3, 40_000)] + rng.normal(0, 0.2, (40_000, 2))
    points = [(0, k, float(x), float(y)) for k, (x, y) in enumerate(at)]
    counted, near = [], L._near

    def count(rows, lead):
        out = near(rows, lead)
        counted.append((rows.count(), out.count()))
        return out

    monkeypatch.setattr(L, "_near", count)
    got = by_tiles(spark, points, 2.5, rows=1000)
    assert all(a == b for a, b in counted) and len(counted) <= 8
    assert got == plain(points, 2.5)


def test_odd_points(spark):
    """No points, a radius of 0 (equal places alone), points on the edges of cells."""
    points = [(0, k, float(x), float(y)) for k, (x, y) in enumerate([(0, 0), (0, 0), (1, 0), (2, 0), (1, 1), (-1, 0), (0, 0)])]
    assert by_tiles(spark, points, 0) == plain(points, 0)
    assert by_tiles(spark, points, 1) == plain(points, 1)
    assert by_tiles(spark, [], 1) == {}
