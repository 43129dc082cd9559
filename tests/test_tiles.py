"""Pairs by blocks of masks against all pairs by plain loops, where very many masks hold a pixel."""

from __future__ import annotations

import random

import numpy as np
import pytest

from framelake.operators import joins, merge, tiles


def overlapping(sets, measure, threshold):
    """(a, b, areas, shared pixels) by a loop over all pairs."""
    share = lambda a, b: len(a & b) / (len(a | b) if measure == "iou" else len(b))
    return {(a, b, len(sets[a]), len(sets[b]), len(sets[a] & sets[b])) for a in sets for b in sets if (a < b if measure == "iou" else a != b) and share(sets[a], sets[b]) >= threshold}


def connected(ids, pairs):
    root = {k: k for k in ids}
    for _ in ids:
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    return root


@pytest.mark.parametrize(("few", "block"), [(6, 20), (0, 1000)])
def test_pairs_by_blocks_equal_all_pairs(spark, monkeypatch, few, block):
    """Masks of few frequent and many rare pixels, some with copies, in two videos."""
    monkeypatch.setattr(joins, "FEW", few)
    monkeypatch.setattr(tiles, "BLOCK_MASKS", block)
    rng = random.Random(3)
    kinds = [frozenset(rng.sample(range(12), rng.randint(1, 8))) | frozenset(rng.sample(range(100, 130), rng.randint(0, 2))) for _ in range(70)]
    sets = {7 * k: s for k, s in enumerate([*kinds, *kinds[:9], *kinds[:3]])}
    rows = [(v, k, p) for v, drop in ((1, 0), (2, 3)) for k, s in sets.items() if k % 5 != drop for p in s]
    masks = joins.as_masks(spark.createDataFrame(rows, "video_id long, mask_id long, p long"))
    for measure, threshold in (("iou", 0.5), ("contain", 0.75)):
        wanted = {(v, *x) for v, drop in ((1, 0), (2, 3)) for x in overlapping({k: s for k, s in sets.items() if k % 5 != drop}, measure, threshold)}
        got = [(r.video_id, r.a, r.b, r.area_a, r.area_b, r.inter) for r in joins.overlap_pairs(masks, threshold, measure).collect()]
        assert len(got) == len(set(got)) and set(got) == wanted
    mine = {k: s for k, s in sets.items() if k % 5}
    contain = overlapping(mine, "contain", 0.75)
    dropped = {b if nb > na else a for a, b, na, nb, _ in contain if max(na, nb) > 6}
    root = connected(mine, [x[:2] for x in contain if max(x[2:4]) <= 6])
    merged = merge.containment_classes(masks.filter("video_id = 1"), 6, 0.75).collect()
    assert {r.id: r.leader for r in merged} == {k: root[k] for k in mine if k not in dropped}
    pairs, member = joins.class_pairs(masks.filter("video_id = 1"), 0.5, "iou", links=True)
    assert {r.id: r.leader for r in merge.classes(pairs, member).collect()} == connected(mine, [x[:2] for x in overlapping(mine, "iou", 0.5)])


def test_a_pixel_that_all_masks_hold_makes_no_rows_of_pairs(spark):
    """400 masks that differ and share one pixel, and any other with few: all 79,800 pairs of them are counted in blocks."""
    rows = [(0, k, p) for k in range(400) for p in (0, 1 + k % 20, 21 + k // 20)]
    found = joins.overlap_pairs(joins.as_masks(spark.createDataFrame(rows, "video_id long, mask_id long, p long")), 0.2, "iou")
    assert found.count() == 400 * 399 // 2
    assert "MapInArrow" in found._jdf.queryExecution().optimizedPlan().toString()


def test_blocks_of_masks_of_many_pixels(monkeypatch):
    """Pixels in several pieces, masks in several steps; only what shares no pixel before the block's own one."""
    monkeypatch.setattr(tiles, "STEP_MASKS", 6)
    monkeypatch.setattr(tiles, "STEP_PIXELS", 11)
    rng = random.Random(4)
    sets = [sorted(rng.sample(range(40), 15)) for _ in range(25)]
    before = [sum(p < 9 for p in s) for s in sets]
    block = tiles.Block(np.arange(25), np.zeros(25, bool), np.full(25, 15), np.array(before), np.array(sum(sets, [])))
    for iou in (True, False):
        for same in (True, False):
            got = {(int(i), int(j), int(n)) for x in tiles.block_pairs(block, block, 0.35, iou, same) for i, j, n in zip(*x, strict=True)}
            both = lambda i, j: len(set(sets[i]) & set(sets[j]))
            assert got == {(i, j, both(i, j)) for i in range(25) for j in range(25) if (i < j if same else i != j) and both(i, j) / (30 - both(i, j) if iou else 15) >= 0.35 and not set(sets[i][: before[i]]) & set(sets[j][: before[j]])}
