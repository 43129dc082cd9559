from __future__ import annotations

import random

import numpy as np
import pytest

from framelake.llm.ngram_join import Similarity, chains, keep_one, keys, ngram_jaccard_join, shingles


def brute(texts, sim):
    def grams(t):
        w = (t or "").encode().lower().split()
        n = min(sim.width, len(w))
        return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set()

    sets = {d: grams(t) for d, t in texts}
    root = {d: d for d in sets}
    changed = True
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and sim.den * len(sets[a] & sets[b]) >= sim.num * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in links:
            m = min(root[a], root[b])
            changed |= root[a] != m or root[b] != m
            root[a] = root[b] = m
    return {d: (len(sets[d]), root[d]) for d in sets}


def corpus(seed=0, n=220):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 4)))
    texts = [None, "", " \n ", "one", "ONE", "two words", "Two  Words"]
    while len(texts) < n:
        if rng.random() < 0.45 or len(texts) < 12:
            texts.append(" ".join(word() for _ in range(rng.choice([1, 2, 3, 4, 5, 8, 20, 60, 150, 400]))))
        else:
            w = (rng.choice(texts) or "x").split()
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 5])):
                k = rng.randrange(len(w) + 1)
                w[k : k + rng.randint(0, 1)] = [word()] * rng.randint(0, 1)
            texts.append(" ".join(w))
    ids = rng.sample(range(-50, 5000), len(texts))
    return list(zip(ids, texts, strict=True))


@pytest.mark.parametrize("sim,bound", [(Similarity(3, 9, 10), 1_000_000), (Similarity(5, 4, 5), 1_000_000), (Similarity(3, 4, 5), 300)])
def test_equals_brute_force_with_small_and_split_families(spark, sim, bound):
    texts = corpus(sim.num)
    base = " ".join(f"w{k}" for k in range(60))
    texts += [(9000 + k, base.replace(f"w{3 * k % 60} ", f"v{k} ")) for k in range(40)]  # one large group of near copies
    df = spark.createDataFrame([(d, t, "x") for d, t in texts], "doc_id long, text string, digest string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_jaccard_join(df, sim, bound).collect()}
    assert got == brute(texts, sim)


@pytest.mark.parametrize("sim", [Similarity(3, 9, 10), Similarity(5, 4, 5)])
def test_linked_sets_always_share_a_key(sim):
    """For any division of hashes into those that other documents hold and those that none does."""
    rng = random.Random(2)
    linked = 0
    for _ in range(600):
        n = rng.choice([1, 2, 5, 9, 10, 19, 40, 41, 300, 900])
        pool = np.array([rng.getrandbits(56) for _ in range(2 * n)], np.uint64)
        a = np.unique(pool[:n])
        most = max(0, int(n * (sim.den - sim.num) / sim.num))
        b = np.unique(np.concatenate([a[rng.randint(0, most) :] if rng.random() < 0.5 else a, pool[n : n + rng.randint(0, most)]]))
        if sim.linked(len(np.intersect1d(a, b)), len(a), len(b)):
            linked += 1
            heads = [s[: sim.head(len(s))] for s in (a, b)]
            common = np.intersect1d(*heads)
            assert len(common) >= max(sim.both(len(a)), sim.both(len(b)))
            others = np.union1d(common, pool[np.array([rng.random() < 0.5 for _ in pool])])
            found = [keys(len(s), np.intersect1d(h, others), sim) for s, h in zip((a, b), heads, strict=True)]
            assert set(found[0].tolist()) & set(found[1].tolist())
    assert linked > 200


def test_chains_of_sizes_connect_like_pairs():
    rng = np.random.default_rng(3)
    for _ in range(50):
        n, steps = 30, 5
        h, o, low = rng.integers(0, 4, n).astype(np.uint64), rng.permutation(n), rng.integers(0, 60, n)
        high = low + rng.integers(0, 4, n)
        (keys_, least, lo, hi), edges = chains(h, o, low, high, steps)
        root = np.arange(n)
        for _ in range(n):
            for i in range(n):
                for j in range(n):
                    if h[i] == h[j] and low[i] <= high[j] + steps and low[j] <= high[i] + steps:
                        m = min(root[o[i]], root[o[j]])
                        root[o[i]] = root[o[j]] = m
        got = np.arange(n)
        got[edges[:, 0]] = edges[:, 1]
        assert (got == root).all()
        assert sorted(zip(keys_.tolist(), least.tolist(), strict=True)) == sorted({(int(h[k]), int(root[o[k]])) for k in range(n)})


def test_shingles_of_short_texts():
    assert len(shingles(b"", 3)) == 0 and len(shingles(b"a b", 3)) == 1
    assert shingles(b"A b", 3).tolist() == shingles(b"a B", 3).tolist()


def test_keep_one_keeps_columns(spark):
    df = spark.createDataFrame([(2, "a b c d e f", "s"), (1, "A b c d e f", None), (3, None, None)], "doc_id long, text string, source string")
    assert sorted(keep_one(df).collect()) == [(1, "A b c d e f", None), (3, None, None)]
    assert keep_one(df.limit(0)).count() == 0


def test_an_id_of_several_rows_is_one_document(spark):
    a, b = "a b c d e f g h", "p q r s t u v w"
    df = spark.createDataFrame([(1, a), (2, b), (3, a), (3, b), (4, b), (4, b)], "doc_id long, text string")
    assert sorted(ngram_jaccard_join(df, Similarity(3, 9, 10)).collect()) == [(1, 6, 1), (2, 6, 1), (3, 6, 1), (3, 6, 1), (4, 6, 1), (4, 6, 1)]
