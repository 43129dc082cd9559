from __future__ import annotations

import random

import numpy as np

from framelake.llm.decontaminate import Block, Matching, align, contaminated, keep_uncontaminated, most_score, words_of
from framelake.llm.queries import op2_decontaminate
from framelake.llm.text import word_hashes
from tests.conftest import SF

M = Matching()


def plain(a, b):
    """Smith-Waterman score by the plain recurrence."""
    h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (M.match if x == y else M.mismatch), h[i - 1][j] + M.gap, h[i][j - 1] + M.gap)
    return max(map(max, h))


def test_alignment_scores_and_spans():
    rng = random.Random(4)
    for _ in range(200):
        a, b = ([rng.randrange(6) for _ in range(rng.randint(1, 25))] for _ in range(2))
        score, first, last = align(np.array(a, np.uint64), np.array(b, np.uint64), M)
        assert score == plain(a, b)
        assert plain(a, b[first:last]) == score


def test_query_against_alignment_of_every_pair(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    items = spark.read.parquet(f"{SF}/benchmark.parquet").collect()
    got = {(r.doc_id, r.item_id): r.score for r in op2_decontaminate(spark, SF).collect()}
    want = {}
    hashed = [(i.item_id, word_hashes(words_of(i.text.encode()))) for i in items]
    for d in docs:
        text = word_hashes(words_of(d.text.encode()))
        for item_id, w in hashed:
            if len(np.intersect1d(text, w)) >= M.least_score * len(np.unique(w)) * 0.6:
                score = align(w, text, M)[0] / (M.match * len(w))
                if score >= M.least_score:
                    want[d.doc_id, item_id] = score
    assert want and got == want


def test_edited_copies_blocks_and_odd_rows(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    items = [(k, " ".join(word() for _ in range(40))) for k in range(6)]
    noise = lambda n: " ".join(word() for _ in range(n))

    def edited(t, share):
        return " ".join(word() if rng.random() < share else w for w in t.split())

    docs = [(1, noise(300)), (2, f"{noise(50)} {items[0][1].upper()} {noise(50)}"), (3, edited(items[1][1], 0.15)), (4, None), (5, ""), (6, " ".join(items[2][1].split()[:10])), (7, noise(20000) + " " + items[3][1].replace(" ", ", ", 9)), (7, items[4][1])]
    docs += [(100 + k, items[5][1] + " " + noise(5)) for k in range(60)]
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, item_id long")
    bench = spark.createDataFrame([*items, (50, "too short"), (None, noise(20)), (51, None)], "item_id long, text string")
    want = sorted([(2, 0), (3, 1), (7, 3), (7, 4), *((100 + k, 5) for k in range(60))])
    for m in (M, Matching(block_words=50)):
        assert sorted((r.doc_id, r.item_id) for r in contaminated(df, bench, m).collect()) == want
    assert sorted(r.doc_id for r in keep_uncontaminated(df, bench).collect()) == [1, 4, 5, 6]
    assert contaminated(df.limit(0), bench).count() == 0
    assert contaminated(df, bench.limit(0)).count() == 0


def test_items_shorter_than_a_seed_are_searched_whole(spark):
    docs = [(1, "one zeta two"), (2, "a Zeta, eta b"), (3, "zeta x eta"), (4, "the whole item of five words here"), (5, "the whole thing of five words"), (None, "zeta eta")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame([(1, "zeta eta"), (2, "the whole item of five words"), (3, "..."), (4, "two")], "item_id long, text string")
    got = sorted((r.doc_id or 0, r.item_id, round(r.score, 4)) for r in contaminated(df, bench, Matching(least_score=0.9)).collect())
    assert got == [(0, 1, 1.0), (1, 4, 1.0), (2, 1, 1.0), (4, 2, 1.0)]
    assert sorted(r.doc_id or 0 for r in keep_uncontaminated(df, bench, Matching(least_score=0.9)).collect()) == [0, 1, 2, 3, 5]


def test_frequent_seeds_of_edited_copies_are_aligned(spark):
    # As in a large corpus: the item's other seeds occur once (in a whole copy), those of the edited copies far more often.
    words = [f"w{k}x" for k in range(22)]
    edited = [f"other{k}" if k in (3, 7, 11, 18) else w for k, w in enumerate(words)]
    docs = [(0, " ".join(words)), *((k, " ".join(["start", str(k), *edited])) for k in range(1, 61)), *((k, f"text number {k} of nothing") for k in range(61, 200))]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame([(7, " ".join(words))], "item_id long, text string")
    assert sorted(r.doc_id for r in contaminated(df, bench).collect()) == list(range(61))


def test_the_bound_of_the_score_holds():
    rng = random.Random(6)
    for _ in range(300):
        a, b = ([rng.randrange(30) for _ in range(rng.randint(1, 25))] for _ in range(2))
        assert most_score(np.isin(np.array(a), np.array(b)), M) >= plain(a, b)


def _edits(words, fresh):
    """Copies with an edit in every second or third word."""
    yield [x for k, w in enumerate(words) for x in ([w, fresh()] if k % 2 else [w])]
    yield [x for w in words for x in (w, fresh())]
    yield [fresh() if k % 3 == 2 else w for k, w in enumerate(words)]
    yield [w for k, w in enumerate(words) if k % 3 != 2]
    yield [w for k, w in enumerate(words) if k % 4 != 2 or k > len(words) // 2]


def test_no_copy_above_the_score_is_lost(spark):
    rng = random.Random(21)
    common = [f"c{k}" for k in range(40)]
    fresh = lambda: rng.choice(common) if rng.random() < 0.6 else "".join(rng.choice("abcdefghij") for _ in range(6))
    items = [(k, [fresh() for _ in range(n)]) for k, n in enumerate([3, 5, 8, 12, 20, 33, 50, 80])]
    docs = [[fresh() for _ in range(rng.randint(0, 60))] + copy + [fresh() for _ in range(rng.randint(0, 60))] for _, w in items for copy in _edits(w, fresh)]
    for _, w in items:  # any edits, up to losing the copy
        for share in (0.1, 0.2, 0.3, 0.4, 0.5):
            docs.append([x for v in w for x in ([], [v], [v, fresh()], [fresh()])[rng.choice((0, 2, 3)) if rng.random() < share else 1]])
    docs += [[fresh() for _ in range(200)] for _ in range(30)]
    df = spark.createDataFrame([(k, " ".join(d)) for k, d in enumerate(docs)], "doc_id long, text string")
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in items], "item_id long, text string")
    want = {}
    for d, text in enumerate(docs):
        for i, w in items:
            score = align(word_hashes([x.encode() for x in w]), word_hashes([x.encode() for x in text]), M)[0] / (2 * len(w))
            if score >= M.least_score:
                want[d, i] = score
    assert len(want) > 60
    for m in (M, Matching(block_words=60)):
        assert {(r.doc_id, r.item_id): r.score for r in contaminated(df, bench, m).collect()} == want


def test_rare_seeds_stay_and_their_number_is_sure():
    rng = random.Random(5)
    words = [[f"w{rng.randrange(30)}".encode() for _ in range(n)] for n in (4, 9, 30)]
    block = Block(list(enumerate(words)), M)
    counts = {k: rng.randrange(1000) for k in block.keys.tolist()}
    weight = {(i, p): 0 for i, p in zip(block.item.tolist(), block.place.tolist(), strict=True)}
    for k, i, p in zip(block.keys.tolist(), block.item.tolist(), block.place.tolist(), strict=True):
        weight[i, p] += counts[k]
    block.keep_rare(counts, M)
    left = set(zip(block.item.tolist(), block.place.tolist(), strict=True))
    for i, w in enumerate(words):
        kept = [x for x in left if x[0] == i]
        gone = [x for x in weight if x[0] == i and x not in left]
        assert len(gone) == M.sure_seeds(len(w)) - block.need[i]
        assert not gone or max(weight[x] for x in kept) <= min(weight[x] for x in gone)
