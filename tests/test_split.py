"""Splitting of large regions, again and again, against plain loops over pixel sets."""

from __future__ import annotations

import numpy as np
from framelake.operators import segment

LY = 200


def near(p):
    return [(p[0] + 1, p[1]), (p[0] - 1, p[1]), (p[0], p[1] + 1), (p[0], p[1] - 1)]


def flood(px):
    """{pixel: smallest pixel number of its 4-connected set}."""
    out = {}
    for start in sorted(px):
        if start not in out:
            todo = [start]
            while todo:
                p = todo.pop()
                if p in px and p not in out:
                    out[p] = start[0] * LY + start[1]
                    todo += near(p)
    return out


def plain_cut(px):
    depth, left, k = {}, set(px), 0
    while left:
        k += 1
        depth |= dict.fromkeys(left, k)
        left = {p for p in left if all(q in left for q in near(p))}
    label = flood({p for p in px if depth[p] > 0.7 * k})
    while len(label) < len(px):
        reached = {p: max(label[q] for q in near(p) if q in label) for p in px if p not in label and any(q in label for q in near(p))}
        label |= reached
    return label


def plain_pieces(px, min_area, avg_area):
    if len(px) > avg_area:
        label = plain_cut(px)
        parts = [{p for p in px if label[p] == k} for k in sorted(set(label.values()))]
        good = [x for x in parts if len(x) > min_area]
        if len(parts) > 1 and good:
            return [y for x in good for y in plain_pieces(x, min_area, avg_area)]
    return [px]


def disc(cx, cy, r):
    return {(x, y) for x in range(cx - r, cx + r + 1) for y in range(cy - r, cy + r + 1) if (x - cx) ** 2 + (y - cy) ** 2 <= r * r}


#: A row of discs of unlike size: the small ones stand in one core's shadow until the large ones are cut off.
CHAIN = disc(12, 12, 10) | disc(12, 28, 9) | disc(12, 41, 6) | disc(12, 50, 5) | disc(22, 50, 4) | {(12, y) for y in range(50, 62)}


def found(px, min_area, avg_area):
    x, y = np.array(sorted(px)).T
    return [{(int(x[k]), int(y[k])) for k in own} for _, own in segment.pieces(x, y, LY, min_area, avg_area)]


def test_pieces_at_every_depth():
    key = lambda parts: sorted(sorted(p) for p in parts)
    rng = np.random.default_rng(3)
    shapes = [CHAIN, disc(20, 20, 9), {(0, k) for k in range(30)}]
    for _ in range(12):
        shapes.append(set().union(*(disc(int(a), int(b), int(r)) for a, b, r in zip(rng.integers(10, 40, 5), rng.integers(10, 40, 5), rng.integers(2, 9, 5), strict=True))))
    depths = set()
    for shape in shapes:
        for px in [{p for p, k in flood(shape).items() if k == v} for v in set(flood(shape).values())]:
            for least, most in ((5, 40), (5, 120), (60, 100), (10**6, 10)):
                want = plain_pieces(px, least, most)
                assert key(found(px, least, most)) == key(want)
                depths.add(len(want))
    assert len(depths) > 3
    once = [{p for p, k in plain_cut(CHAIN).items() if k == v} for v in set(plain_cut(CHAIN).values())]
    assert len(found(CHAIN, 5, 60)) > len(once) > 1


def test_weights_and_wholes(spark):
    rows = [(1, 0, 7, x, y, x * LY + y) for x, y in CHAIN] + [(1, 0, 9, 100, y, 100 * LY + y) for y in range(4)]
    df = spark.createDataFrame(rows, "video_id long, t long, seg long, x long, y long, p long")
    got = segment.split_large(df, 5, 60, LY).collect()
    assert {(r.whole, r.w) for r in got if r.seg == 7} == {(False, 0.25)} and {(r.whole, r.w) for r in got if r.seg == 9} == {(True, 1.0)}
    parts = {}
    for r in got:
        parts.setdefault((r.seg, r.piece), set()).add((r.x, r.y))
    assert sorted(sorted(v) for k, v in parts.items() if k[0] == 7) == sorted(sorted(v) for v in plain_pieces(CHAIN, 5, 60))


def test_a_group_is_a_frame_not_a_region(spark):
    cells = spark.createDataFrame([(0, 0, x, y) for x in range(9) for y in range(0, 9, 2)], "video_id long, t long, x long, y long")
    plan = segment.split_large(segment.frame_regions(cells, 9), 1, 6, 9)._jdf.queryExecution().optimizedPlan().toString()
    keys = [line.split("[")[1].split("]")[0] for line in plan.splitlines() if "FlatMapGroupsInArrow [" in line]
    assert len(keys) == 2 and all(len(k.split(",")) == 2 for k in keys)
