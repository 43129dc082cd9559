from __future__ import annotations

import hashlib
import random

import numpy as np
from pyspark.sql import functions as F

from framelake.llm import packed
from framelake.llm.queries import op1_substring_dedup
from framelake.llm.substring_dedup import substring_dedup
from framelake.llm.text import rolling
from tests.conftest import SF


def brute(docs, window=13):
    """docs {doc_id: text} -> {doc_id: (n_words, kept words)}."""
    words = {d: (t or "").encode().split() for d, t in docs.items()}
    least = {}
    for d in sorted(words, reverse=True):
        for i in range(len(words[d]) - window + 1):
            least[tuple(words[d][i : i + window])] = d
    out = {}
    for d, w in words.items():
        gone = {i + k for i in range(len(w) - window + 1) if least[tuple(w[i : i + window])] < d for k in range(window)}
        out[d] = (len(w), [x for k, x in enumerate(w) if k not in gone])
    return out


def test_query_on_the_whole_table(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    want = {d: (n, n - len(k), hashlib.sha256(b" ".join(k)).hexdigest()) for d, (n, k) in brute(docs).items()}
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in op1_substring_dedup(spark, SF).collect()} == want


def test_overlaps_within_and_between_documents_and_odd_rows(spark):
    rng = random.Random(8)
    pool = [" ".join(rng.choice("abcdef") for _ in range(rng.randint(5, 40))) for _ in range(12)]
    docs = {d: " \t".join(rng.choice(pool) for _ in range(rng.randint(0, 6))) for d in rng.sample(range(-99, 999), 80)}
    docs |= {2000: None, 2001: "", 2002: "a " * 30000, 2003: "a " * 14, 2004: "x" * 100000}
    rows = [(d, t, 1) for d, t in docs.items()] + [(None, pool[0] * 3, 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, starts int").repartition(5)
    for window in (3, 13):
        got = {r.doc_id: (r.n_words, r.kept_text.encode().split(), sum(s["last"] - s["first"] for s in r.removed_spans)) for r in substring_dedup(df, window).filter("doc_id is not null").collect()}
        assert got == {d: (n, k, n - len(k)) for d, (n, k) in brute(docs, window).items()}
    twice = df.filter("doc_id is not null").unionByName(df.filter("doc_id is not null"))
    assert substring_dedup(twice).count() == 2 * len(docs)
    assert substring_dedup(df.limit(0)).count() == 0
    assert substring_dedup(df).filter(F.col("doc_id").isNull()).first().n_removed == 0


def test_rows_of_one_id_are_judged_each_by_their_own_windows(spark):
    a, b, c = (" ".join(f"{x}{k}" for k in range(20)) for x in "abc")
    rows = [(1, a), (2, b), (2, a), (2, b), (3, c + " " + b), (None, c), (2**62, c), (-(2**62), "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((r.doc_id or 0, r.n_words, r.n_removed, r.kept_text) for r in substring_dedup(df).collect())
    assert got == sorted([(1, 20, 0, a), (2, 20, 0, b), (2, 20, 20, ""), (2, 20, 0, b), (3, 40, 20, c), (0, 20, 0, c), (2**62, 20, 20, ""), (-(2**62), 1, 0, "x")])


def test_packed_blocks_round_trip():
    rng = np.random.default_rng(1)
    owners = np.sort(rng.integers(-(2**62), 2**62, 50)).repeat(rng.integers(1, 90, 50))
    positions = np.concatenate([np.sort(rng.integers(0, 2**31, int((owners == o).sum()))) for o in np.unique(owners)])
    hashes = rng.integers(0, 2**63, len(owners)).astype(np.uint64)
    h, o, p = packed.unpack(packed.pack(hashes, owners, positions))
    assert (h == hashes & np.uint64(2**56 - 1)).all() and (o == owners).all() and (p == positions).all()


def test_rolling_hash_depends_on_the_window_alone():
    x = np.array([1, 2, 3, 1, 2, 3, 2, 1], np.uint64)
    h = rolling(x, 3)
    assert len(h) == 6 and h[0] == h[3] and len(set(h.tolist())) == 5
