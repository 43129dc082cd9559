"""K2-treap search against plain loops over all documents."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from framelake.llm.k2_treap import BITS, Treap, build_index, count_terms, ranked_search, terms

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def plain_terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k=50):
    held = [(d, plain_terms(t)) for d, t in docs]
    total, words = sum(bool(w) for _, w in held), sum(len(w) for _, w in held)
    counts = [Counter(w) for _, w in held]
    df = Counter(t for c in counts for t in c)
    out = []
    for item, text in items:
        weight = {t: math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1))) for t in set(plain_terms(text)) if df[t]}
        scores = []
        for (d, w), c in zip(held, counts, strict=True):
            if w:
                m = 50 + (50 * len(w) * total) // words
                scores.append((sum(x * ((1000000000 * c[t]) // (1000 * c[t] + 20 * m)) for t, x in weight.items() if c[t]), d))
        best = sorted(((s, d) for s, d in scores if s > 0), key=lambda x: (-x[0], x[1] is None, x[1] or 0))[:k]
        out += [(item, r + 1, d, s) for r, (s, d) in enumerate(best)]
    return sorted(out, key=str)


def corpus(seed=0, n=400):
    rng = random.Random(seed)
    vocabulary = [f"{rng.choice('abcdéü')}{k}" for k in range(300)]
    word = lambda: vocabulary[min(299, int(rng.expovariate(0.03)))]
    text = lambda n: "".join(word() + rng.choice([" ", ", ", "\n", "-", "."]) for _ in range(n))
    docs = [(k, text(rng.choice([1, 2, 5, 20, 80, 300]))) for k in rng.sample(range(-100, 5000), n)]
    docs += [(6000 + k, docs[0][1]) for k in range(60)]  # ties beyond the last place
    items = [(k, text(rng.choice([1, 3, 12, 40]))) for k in range(25)]
    return docs, items


@pytest.mark.parametrize(("postings", "block_bytes"), [(1 << 20, 1 << 20), (300, 200), (1, 1 << 20)])
def test_equals_plain_loops(spark, postings, block_bytes):
    """One shard a task, many, one a document; one block of items and several."""
    docs, items = corpus(postings)
    items.append((99, docs[0][1]))
    found = ranked_search(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string"), postings=postings, block_bytes=block_bytes)
    rows = [tuple(r) for r in found.select("item_id", "rank", "doc_id", "score").collect()]
    assert sorted(rows, key=str) == brute(docs, items)
    assert len([r for r in rows if r[0] == 99 and r[2] >= 6000]) > 30


def test_odd_rows(spark):
    """Nulls, texts without terms, repeated rows and ids, a long text, capitals beyond ASCII, clashing columns, empty tables."""
    docs = [(None, "alpha beta"), (None, None), (3, ""), (4, "... -- \x00"), (5, "Alpha BETA"), (5, "alpha beta"), (6, "beta " * 50_000), (7, "ÀB àb"), (8, "alpha"), (8, "alpha")]
    items = [(1, "alpha, alpha!"), (1, "beta"), (None, "àb"), (2, None), (3, "unknown"), (4, "ALPHA beta")]
    df = spark.createDataFrame([(*r, 7, 1) for r in docs], "doc_id long, text string, score int, key int")
    it = spark.createDataFrame([(*r, 7) for r in items], "item_id long, text string, rank int")
    found = sorted((tuple(r) for r in ranked_search(df, it).collect()), key=str)
    assert found == brute(docs, items)
    assert sum(r[0] is None for r in found) == 1
    assert ranked_search(df, it.limit(0)).count() == 0 == ranked_search(df.limit(0), it).count()
    assert ranked_search(df, it, k=2).filter("item_id = 4").count() == 2


def test_terms():
    for t in ["", "a", "A-b_c9", "éÉ x\x7fy", "naïve Über 東京1", "tail ", " \x00 "]:
        assert [w.decode() for w in terms(t.encode())] == plain_terms(t)
        assert count_terms(t.encode()) == len(plain_terms(t))


def test_cells_hold_maxima_and_open_few_ranges():
    """Every cell's maximum is that of its postings, the packed form is read back alike, and a clear winner is found without opening all."""
    rng = np.random.default_rng(5)
    n = 4000
    at = rng.choice(1 << 20, n, replace=False)
    rows, columns, impacts = at >> 10, at & 1023, rng.integers(1, 1000, n)
    impacts[7] = 10**6
    cells, maxima = Treap.levels(rows, columns, impacts, 10)
    treap = Treap.unpack(*Treap.pack(cells, maxima))
    assert treap.height == 10 and (treap.maxima[:-1] == maxima).all() and BITS[cells].sum() == len(maxima) - 1
    grid = np.zeros((1024, 1024), np.int64)
    grid[rows, columns] = impacts
    level, nodes = 0, {(0, 0): 0}
    while level < 10:
        side, below = 1 << (10 - level), {}
        for (r, c), node in nodes.items():
            assert treap.maxima[node] == grid[r * side : (r + 1) * side, c * side : (c + 1) * side].max()
            children = [q for q in range(4) if treap.cells[node] >> q & 1]
            below |= {(2 * r + (q >> 1), 2 * c + (q & 1)): treap.below[node] + k for k, q in enumerate(children)}
        level, nodes = level + 1, below
    assert len(nodes) == n
    chosen, weights = np.unique(rows)[:40], np.arange(1, 41)
    exact = weights @ grid[chosen]
    for k in (1, 5, 50, 5000):
        found = [np.concatenate(x) for x in zip(*treap.best(chosen, weights, k, 1), strict=True)]
        best = sorted(zip(-found[1], found[0], strict=True))[:k]
        assert best == sorted((-s, c) for c, s in enumerate(exact) if s > 0)[:k]


def test_index_keeps_every_posting(spark):
    docs, _ = corpus(9)
    index, total = build_index(spark.createDataFrame(docs, "doc_id long, text string").repartition(2), postings=500)
    rows = index.collect()
    assert total == len(docs) == sum(len(r["doc_ids"]) for r in rows) and len(rows) > 4
    assert sum(int(np.frombuffer(r["df"], "<u4").sum()) for r in rows) == sum(len(set(plain_terms(t))) for _, t in docs)
