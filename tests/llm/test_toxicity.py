from __future__ import annotations

import random
import zlib

from framelake.llm.queries import op10_toxicity
from framelake.llm.toxicity import Training, score_toxicity


def test_held_out_accuracy_on_the_table(spark):
    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in op10_toxicity(spark, sf).collect()}
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for d, r in got.items())
    test = [(r.toxic, got[r.doc_id].predicted) for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if got[r.doc_id].held_out]
    right = sum(a == b for a, b in test) / len(test)
    found = sum(b for a, b in test if a) / sum(a for a, _ in test)
    false = sum(b for a, b in test if not a) / sum(1 - a for a, _ in test)
    assert right > 0.93 and found > 0.7 and false < 0.02


def test_offending_sentences_and_odd_rows(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(3))
    rows, labels = [], []
    for d in range(300):
        s = [" ".join(word() for _ in range(8)) for _ in range(6)]
        if d % 4 == 0:
            s[rng.randrange(6)] += " you blockhead"
        rows.append((d, ". ".join(s), 0.5))
        labels.append((d, int(d % 4 == 0), "x"))
    rows += [(1000, None, 0.0), (1001, "", 0.0), (None, "blockhead", 0.0), (1002, "fine words. " * 20000, 0.0), (5, "blockhead again", 0.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double")
    known = spark.createDataFrame(labels + [(None, 1, "x"), (7, None, "x")], "doc_id long, toxic int, text string")
    got = score_toxicity(docs, known).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got if r.doc_id is not None and r.doc_id < 300 and r.doc_id != 5}
    assert all(r.predicted == (d % 4 == 0) for d, r in by.items())
    assert all("blockhead" in s["text"] for r in by.values() for s in r.offending)
    assert not [r for r in got if r.doc_id in (1000, 1001, 1002) and r.predicted]
    assert score_toxicity(docs.limit(0), known).count() == 0
    assert len({r.score for r in score_toxicity(docs, known.limit(0), Training()).collect()}) == 1


def test_toxic_sentences_late_in_long_texts_are_trained_on(spark):
    filler = "fine plain words stand here. " * 2500  # over 60,000 characters
    rows = [(d, filler + ("you blockhead." if d % 3 == 0 else "good day.")) for d in range(90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    known = spark.createDataFrame([(d, int(d % 3 == 0)) for d in range(90)], "doc_id long, toxic int")
    assert {r.doc_id: r.predicted for r in score_toxicity(docs, known).collect()} == {d: int(d % 3 == 0) for d in range(90)}


def likelihood(theta, bags, labels, n, setting):
    """Weighted log likelihood of noisy-or with a leak, less the penalty, by its definition."""
    import math

    n_pos = max(1.0, sum(labels))
    n_neg = max(1.0, len(labels) - sum(labels))
    total = 0.0
    for bag, y in zip(bags, labels, strict=True):
        clean = 1 - 1 / (1 + math.exp(-theta[n + 1]))
        for sentence in bag:
            clean *= 1 - 1 / (1 + math.exp(-theta[n] - sum(theta[f] for f in sentence)))
        weight = 0.25 / (n_pos if y else n_neg) + 0.5 / len(labels)
        total += weight * math.log(1 - clean if y else clean)
    return total - setting.penalty / 2 * sum(x * x for x in theta)


def test_fit_climbs_the_noisy_or_likelihood_by_plain_loops():
    import numpy as np

    from framelake.llm.toxicity import fit

    rng = random.Random(7)
    n = 4
    bags = [[[f for f in range(n) if rng.random() < 0.4] for _ in range(rng.randint(0, 4))] for _ in range(25)]
    bags = [[s for s in bag if s] for bag in bags]
    labels = [int(any(0 in s for s in bag)) if rng.random() < 0.9 else 1 for bag in bags]
    bag_of = np.array([d for d, bag in enumerate(bags) for _ in bag])
    row = np.array([k for k, s in enumerate([s for bag in bags for s in bag]) for _ in s])
    col = np.array([f for bag in bags for s in bag for f in s])
    setting = Training(rounds=12, penalty=0.01)
    got = fit({f"w{k}": k for k in range(n)}, labels, bag_of, row, col, setting)
    theta, m, v = [0.0] * n + [-3.0, -3.0], [0.0] * (n + 2), [0.0] * (n + 2)
    for t in range(1, setting.rounds + 1):
        slope = []
        for k in range(n + 2):
            up, down = list(theta), list(theta)
            up[k] += 1e-5
            down[k] -= 1e-5
            slope.append((likelihood(up, bags, labels, n, setting) - likelihood(down, bags, labels, n, setting)) / 2e-5)
        for k, g in enumerate(slope):
            m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.999 * v[k] + 0.001 * g * g
            theta[k] += setting.rate * (m[k] / (1 - 0.9**t)) / ((v[k] / (1 - 0.999**t)) ** 0.5 + 1e-8)
    assert np.allclose([got["weights"][f"w{k}"] for k in range(n)] + [got["bias"]], theta[: n + 1], atol=1e-3)
    assert abs(got["leak"] - 1 / (1 + np.exp(-theta[n + 1]))) < 1e-4


def test_scores_by_plain_loops(spark):
    """The model that the operator trains, applied word by word; a score at the threshold counts."""
    import math

    from framelake.llm.toxicity import features, sentences, train

    rows = [(d, ("fine words. you blockhead!! " if d % 3 == 0 else "fine words. good day. ") * (1 + d % 4)) for d in range(60)] + [(100, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    known = spark.createDataFrame([(d, int(d % 3 == 0)) for d in range(60)], "doc_id long, toxic int")
    model = train(docs, known)
    want = {}
    for d, text in rows:
        clean = 1 - model["leak"]
        for _, words in sentences(text or ""):
            found = [sum(model["weights"][f] for f in features(w) if f in model["weights"]) for w in words if any(f in model["weights"] for f in features(w))]
            if found:
                clean *= 1 - 1 / (1 + math.exp(-max(-30.0, min(30.0, model["bias"] + sum(found)))))
        want[d] = 1 - clean
    got = {r.doc_id: r for r in score_toxicity(docs, known).collect()}
    assert all(abs(got[d].score - p) < 1e-9 for d, p in want.items())
    edge = Training(threshold=got[0].score)
    assert {r.doc_id: r.predicted for r in score_toxicity(docs, known, edge).collect()}[0] == 1
