"""SimHash by vantage-point trees against all pairs."""

from __future__ import annotations

import numpy as np
import pytest
import xxhash
from framelake.llm.queries import op12_simhash_vptree
from framelake.llm.simhash_vptree import distance, grow, majority_bits, masks, near_fingerprints, shard_links, shingle_hashes, simhash_dedup
from framelake.operators.graph import connected_components, forest

SF = "/root/testdata/sf0.001"


def fingerprint(text: str | None, width: int = 4) -> int:
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[k : k + width]) for k in range(max(1, len(words) - width + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in hashes) > len(hashes))


def classes(fps: np.ndarray, bits: int) -> dict[int, int]:
    a, b = np.nonzero(np.triu(np.bitwise_count(fps[:, None] ^ fps) <= bits, 1))
    ids, roots = forest(fps[a].view(np.int64), fps[b].view(np.int64))
    return dict(zip(ids.tolist(), roots.tolist(), strict=True))


def planted(seed: int, n: int = 1500, dense: int = 300) -> np.ndarray:
    """Random fingerprints, some with up to seven bits flipped, and a dense family around one of them."""
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 2**64, n, dtype=np.uint64)
    near = np.concatenate([base[rng.integers(0, n, n // 2)], np.repeat(base[:1], dense)])
    for _ in range(7):
        hit = rng.random(len(near)) < 0.6
        near[hit] ^= np.uint64(1) << rng.integers(0, 64, hit.sum(), dtype=np.uint64)
    return np.unique(np.concatenate([base, near, np.zeros(1, np.uint64)]))


def found(spark, fps: np.ndarray, bits: int, groups: int, rows: int) -> dict[int, int]:
    table = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long").repartition(3)
    edges = near_fingerprints(table, bits, groups, rows)
    return {r["id"]: r["component"] for r in connected_components(edges).collect() if r["id"] != r["component"]}


@pytest.mark.parametrize(("bits", "groups", "rows"), [(4, 3, 200), (4, 3, 40), (4, 3, 10_000), (5, 2, 100), (3, 4, 100)])
def test_equals_all_pairs(spark, bits, groups, rows):
    """Shards of every size, those dealt in tiles too, and other numbers of bits and groups."""
    fps = planted(bits + rows)
    assert found(spark, fps, bits, groups, rows) == classes(fps, bits)


def test_one_dense_family_is_dealt(spark):
    """Fingerprints that no vantage point parts: all within two bits of a centre."""
    centre = np.uint64(0x123456789ABCDEF0)
    pairs = [centre ^ (np.uint64(1) << np.uint64(i)) ^ (np.uint64(1) << np.uint64(j)) for i in range(20) for j in range(i)]
    far = [~x for x in pairs[:30]]
    fps = np.unique(np.array([*pairs, *far], np.uint64))
    assert found(spark, fps, 4, 3, 25) == classes(fps, 4)
    assert found(spark, fps, 0, 3, 25) == {}


def test_branches_hold_every_neighbour():
    """A neighbour's own leaf is always among those visited, and visits are far fewer than leaves."""
    fps, mask = planted(3, 4000, 0), masks(3)[1]
    tree = grow(fps, mask, 20)
    _, own = tree.leaves(fps, 0)
    at, visited = tree.leaves(fps, 1)
    seen = set(zip(at.tolist(), visited.tolist(), strict=True))
    for k in range(0, len(fps), 37):
        near = np.flatnonzero(distance(fps, fps[k], mask) == 1)
        assert all((k, int(own[p])) in seen for p in near)
        assert all(own[p] == own[k] for p in np.flatnonzero(distance(fps, fps[k], mask) == 0))
    assert tree.levels >= 2 and len(at) / len(fps) <= 2**tree.levels < len(np.unique(own))


def test_shard_of_nothing():
    empty = np.empty(0, np.uint64)
    assert not len(shard_links(empty, {1: np.ones(3, np.uint64)}, masks(3)[0], 4)[0])
    assert not len(shard_links(np.ones(1, np.uint64), {}, masks(3)[0], 4)[0])


def test_fingerprints_by_plain_loops():
    texts = ["", "One", "a b c", "a b c d", "A b c d e\n\n a b c d", "é ü  \x0b x y z é ü x y", "w " * 70_000 + "v " * 70_000]
    for t in texts[:-1]:
        hashes = np.array(shingle_hashes(t.encode(), 4), np.uint64)
        assert int(majority_bits(hashes, np.array([len(hashes)]))[0]) == fingerprint(t)
    found = [np.array(shingle_hashes(t.encode(), 4), np.uint64) for t in texts]
    together = majority_bits(np.concatenate(found), np.array([len(x) for x in found]))
    assert [int(x) for x in together[:-1]] == [fingerprint(t) for t in texts[:-1]]
    assert int(together[-1]) == fingerprint(texts[-1])


def test_odd_rows(spark):
    """Nulls, empty texts (linked at zero), repeated ids, a long text, clashing extra columns; a null id never names a group that has another."""
    long = " ".join(f"w{k * k % 9973} " for k in range(60_000))
    rows = [(4, None), (9, ""), (None, " \n"), (7, "alpha beta gamma"), (7, "ALPHA beta\tgamma"), (None, "only without an id"), (2, long), (1, long + " dolor")]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, fp int, n int")
    got = sorted(((r.doc_id, r.fp % 2**64, r.component_id) for r in simhash_dedup(docs).collect()), key=str)
    groups = {0: 4, fingerprint("alpha beta gamma"): 7, fingerprint("only without an id"): None, fingerprint(long): 1, fingerprint(long + " dolor"): 1}
    assert got == sorted(((i, fingerprint(t), groups[fingerprint(t)]) for i, t in rows), key=str)
    assert simhash_dedup(docs.limit(0)).count() == 0


def test_query_equals_all_pairs(spark):
    rows = op12_simhash_vptree(spark, SF).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert len(rows) == len(texts)
    assert {r.doc_id: int(r.fingerprint, 16) for r in rows} == {k: fingerprint(t) for k, t in texts.items()}
    fps = np.array([int(r.fingerprint, 16) for r in rows], np.uint64)
    label = classes(np.unique(fps), 4)
    group = [label.get(x, x) for x in fps.view(np.int64).tolist()]
    least = {}
    for r, g in zip(rows, group, strict=True):
        least[g] = min(least.get(g, r.doc_id), r.doc_id)
    assert [r.component_id for r in rows] == [least[g] for g in group]
    assert len(set(group)) < len(rows)
