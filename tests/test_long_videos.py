"""Videos of more frames than the test tables have."""

from __future__ import annotations

from framelake import registry, registry_more
from framelake.operators import merge


def test_pairs_of_frames_of_two_videos_do_not_meet(spark, tmp_path):
    """From frame 2000 of a video on, the number that is given out belongs to another video's frames too."""
    region = [0.2 if p in (0, 1) else 0.0 for p in range(64)]
    rows = [(v * 10_000 + t, region if t // 2 in (0, 1000) else [0.0] * 64, v) for v, n in ((0, 2002), (1, 2)) for t in range(n)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = sorted((r.video_id, r.n_gt, r.n_found, r.n_match, r.f1) for r in registry.match_scores(spark, str(tmp_path)).collect())
    assert got == [(0, 1, 1, 1, 1.0), (1000, 1, 1, 1, 1.0), (1000, 1, 1, 1, 1.0)]


def test_batches_of_a_stored_stream_do_not_grow_with_its_frames():
    for n in (2, 24, 25, 121, 1200):
        files = registry_more.file_parts(n)
        assert len(files) <= registry_more.FILES and {p for f in files for p in f} >= set(range(n - 1))
        seen = -1
        for f in files:
            assert min(f) >= seen - 1  # a part of ten frames comes within the delay of 20
            seen = max(seen, *f)
        assert any(min(b) < max(a) for a, b in zip(files, files[1:], strict=False))


def test_windows_join_the_masks_before_in_order(spark):
    """Window 1's masks meet those of window 0 alone, not each other; the masks come out the same in one block or in two."""
    key = "video_id long, thresh_iou double"
    rows = [(0, 0.5, 0, 5, [1, 2], [1.0, 1.0], [0]), (0, 0.5, 1, 9, [1, 2, 3], [2.0, 2.0, 2.0], [1]), (0, 0.5, 1, 8, [3, 4], [1.0, 1.0], [2]), (0, 0.5, 1, 10, [3, 4], [1.0, 1.0], [3]), (0, 0.5, 2, 20, [3, 4, 5], [3.0, 3.0, 3.0], [4])]
    df = spark.createDataFrame(rows, f"{key}, window long, id long, p array<long>, w array<double>, times array<long>")
    table = lambda d: {(r.id, tuple(r.p), tuple(r.w), tuple(r.times)) for r in d.collect()}
    at_once = merge.merge_windows(df, ["video_id", "thresh_iou"], 0.5)
    assert table(at_once) == {(5, (1, 2, 3), (3.0, 3.0, 2.0), (0, 1)), (8, (3, 4, 5), (4.0, 4.0, 3.0), (2, 4)), (10, (3, 4), (1.0, 1.0), (3,))}
    state = merge.merge_windows(df.filter("window < 1"), ["video_id", "thresh_iou"], 0.5).selectExpr("*", "-1L AS window")
    assert table(merge.merge_windows(df.filter("window > 0").unionByName(state), ["video_id", "thresh_iou"], 0.5)) == table(at_once)
