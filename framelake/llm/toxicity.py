"""Operator 10: toxicity by multiple-instance learning. A document is a bag of sentences; a document is toxic if any
sentence is (noisy-or), so sentence scores are trained from document labels alone and then point at the sentences."""

from __future__ import annotations

import re
from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelake.llm.text import small_batches, text_bytes
from framelake.sources.scratch import materialise

#: Sentences end at . ! ? or a line's end, also in other scripts.
SENTENCE = re.compile(r"([.!?…。！？।؟\n]+)")
TOKEN = re.compile(r"\w+")


@dataclass(frozen=True)
class Training:
    #: Labelled documents that the fit reads at most: those of the smallest hash of their id.
    most_documents: int = 6000
    #: Training documents that a word must be in to be a feature.
    least_documents: int = 5
    #: Words become features if their presence and the label depend on each other at this log-likelihood ratio: at 20
    #: about one in 100,000 unrelated words passes.
    least_evidence: float = 20.0
    rounds: int = 400
    rate: float = 0.05
    #: Weight of the squared penalty.
    penalty: float = 1e-4
    threshold: float = 0.7


def sentences(text: str) -> Iterator[tuple[str, set[str]]]:
    """(sentence, its words): distinct words in lower case, and marks for shouting (capitals, !!)."""
    parts = SENTENCE.split(text)
    for sentence, end in zip(parts[::2], [*parts[1::2], ""], strict=True):
        if words := set(TOKEN.findall(sentence.lower())):
            if sentence.isupper():
                words.add("<capitals>")
            if "!!" in end:
                words.add("<!!>")
            yield sentence, words


def features(word: str) -> Iterator[str]:
    """The word and its proper prefixes of 3 to 7 letters, so that unseen forms of a stem count too."""
    yield word
    for n in range(3, min(8, len(word))):
        yield word[:n] + "-"


class Lexicon:
    """Weight of each word by its features' weights; None if it has none. Remembers words up to a bound."""

    def __init__(self, weights: dict[str, float], bound: int = 300_000):
        self.weights, self.bound, self.known = weights, bound, {}

    def of(self, words: set[str]) -> list[float]:
        if len(self.known) > self.bound:
            self.known = {}
        known, out = self.known, []
        for w in words:
            if w not in known:
                found = [self.weights[f] for f in features(w) if f in self.weights]
                known[w] = sum(found) if found else None
            if known[w] is not None:
                out.append(known[w])
        return out


def held_out(doc_id: str = "doc_id"):
    """Column: is the row kept from training."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _presence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(feature, documents that have it, toxic ones) of each batch of whole texts."""
    for batch in batches:
        n, p = Counter(), Counter()
        for raw, y in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
            found = {f for w in set().union(*(words for _, words in sentences(raw.decode("utf-8", "replace")))) for f in features(w)}
            n.update(found)
            if y:
                p.update(found)
        yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64()), pa.array([p[f] for f in n], pa.int64())], names=["feature", "n", "p"])


def _telling(n_pos: float, total: float, least_evidence: float):
    """Features whose presence in documents and the label depend on each other."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n_neg = max(1.0, total - n_pos)
        for batch in batches:
            n, p = (np.asarray(batch.column(k), np.float64) for k in ("n", "p"))
            cells = np.stack([p, n - p, np.maximum(n_pos - p, 0), np.maximum(n_neg - n + p, 0)])
            expected = np.stack([n * n_pos, n * n_neg, (total - n) * n_pos, (total - n) * n_neg]) / total
            ratio = 2 * (cells * np.log(np.maximum(cells, 1e-9) / np.maximum(expected, 1e-9))).sum(0)
            yield pa.RecordBatch.from_arrays([batch.column("feature").filter(pa.array(ratio >= least_evidence))], names=["feature"])

    return run


def _bags(index: dict[str, int]):
    """(doc_id, label, for each sentence that has any the numbers of its words' features) of whole texts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bags = []
            for raw in batch.column("text").to_pylist():
                found = ([index[f] for w in sorted(words) for f in features(w) if f in index] for _, words in sentences(raw.decode("utf-8", "replace")))
                bags.append([x for x in found if x])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), pa.array(bags, pa.list_(pa.list_(pa.int32())))], names=["doc_id", "toxic", "sentences"])

    return run


def fit(index: dict[str, int], labels: list[int], bag_of: np.ndarray, row: np.ndarray, col: np.ndarray, setting: Training) -> dict:
    """{leak, bias, weights by feature}. A sentence with features has p = sigmoid(bias + sum of their weights), any
    other 0; a document has P = 1 - (1 - leak) * product of (1 - p). The leak takes up labels that no sentence explains,
    so that a document's length alone says nothing. index numbers the features, bag_of has each sentence's document, row
    and col each sentence's features."""
    y = np.asarray(labels, np.float64)
    n_pos, n_neg = max(1.0, y.sum()), max(1.0, len(y) - y.sum())
    theta = np.append(np.zeros(len(index)), [-3.0, -3.0])  # weights, bias, logit of the leak
    m, v = np.zeros(len(theta)), np.zeros(len(theta))
    weight = 0.25 / np.where(y == 1, n_pos, n_neg) + 0.5 / max(1, len(y))
    for t in range(1, setting.rounds + 1):
        z = theta[-2] + np.bincount(row, theta[col], len(bag_of))
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        leak = 1 / (1 + np.exp(-theta[-1]))
        clean = np.bincount(bag_of, np.log1p(-np.minimum(p, 1 - 1e-12)), len(y)) + np.log1p(-leak)
        # Slope of the log likelihood along any log(1 - p): -(1 - P) / P for label 1, 1 for label 0.
        by_doc = np.where(y == 1, np.exp(clean) / np.maximum(-np.expm1(clean), 1e-9), -1.0) * weight
        by_sentence = by_doc[bag_of] * p
        g = np.append(np.bincount(col, by_sentence[row], len(index)), [by_sentence.sum(), by_doc.sum() * leak]) - setting.penalty * theta
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta = theta + setting.rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return {"leak": float(1 / (1 + np.exp(-theta[-1]))), "bias": float(theta[-2]), "weights": {w: float(theta[i]) for w, i in index.items()}}


def train(docs: DataFrame, labels: DataFrame, setting: Training = Training()) -> dict:
    """Fit on whole texts of a bounded sample of labelled rows outside the held-out third: those with the smallest hash of the
    id. Texts stay in tasks; the driver gets the features and, by sentence, which of them it has."""
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(setting.most_documents)
    texts = text_bytes(docs).join(F.broadcast(sample), "doc_id")  # at most most_documents rows of two numbers
    texts = materialise(texts.select("doc_id", "text", F.col("toxic").cast("int").alias("toxic")), "training")
    total, n_pos = texts.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    counts = texts.mapInArrow(_presence, "feature string, n long, p long").groupBy("feature").agg(F.sum("n").alias("n"), F.sum("p").alias("p")).filter(F.col("n") >= setting.least_documents)
    told = counts.mapInArrow(_telling(max(1.0, float(n_pos)), max(2.0, float(total)), setting.least_evidence), "feature string").collect()
    index = {f: i for i, f in enumerate(sorted(r.feature for r in told))}
    labels, bag_of, sizes, col = [], array("q"), array("q"), array("q")
    for r in texts.mapInArrow(_bags(index), "doc_id long, toxic int, sentences array<array<int>>").orderBy("doc_id").toLocalIterator():
        for x in r.sentences:
            bag_of.append(len(labels))
            sizes.append(len(x))
            col.extend(x)
        labels.append(int(r.toxic))
    bag_of, sizes, col = (np.array(x, np.int64) for x in (bag_of, sizes, col))
    return fit(index, labels, bag_of, np.repeat(np.arange(len(sizes)), sizes), col, setting)


SCHEMA = "doc_id long, held_out boolean, score double, predicted int, offending array<struct<sentence:int,score:double,text:string>>"


def _scored(model, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bias, weights = model["bias"], model["weights"]
        lexicon = Lexicon(weights)
        leak = float(np.log1p(-model["leak"]))
        for batch in batches:
            scores, found = [], []
            for raw in batch.column("text").to_pylist():
                clean, spots = leak, []
                for k, (s, words) in enumerate(sentences((raw or b"").decode("utf-8", "replace"))):
                    if not (found_here := lexicon.of(words)):
                        continue
                    z = sum(found_here)
                    p = 1 / (1 + np.exp(-min(30.0, max(-30.0, bias + z))))
                    clean += float(np.log1p(-p))
                    if p >= 0.5:
                        spots.append({"sentence": k, "score": float(p), "text": s})
                scores.append(float(min(1.0, max(0.0, -np.expm1(clean)))))
                found.append(spots)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(scores, pa.float64()), pa.array([int(x >= threshold) for x in scores], pa.int32()), pa.array(found, pa.list_(pa.struct([("sentence", pa.int32()), ("score", pa.float64()), ("text", pa.string())])))],
                names=["doc_id", "held_out", "score", "predicted", "offending"],
            )

    return run


def score_toxicity(docs: DataFrame, labels: DataFrame, setting: Training = Training()) -> DataFrame:
    """Score every whole text and locate its offending sentences.

    Reads doc_id and text of docs, doc_id and toxic of labels; other columns are ignored. Labels of rows with
    crc32(doc_id as text) mod 3 = 1 are never read. Null ids in docs are scored and not held out; repeated labels of a
    document count as toxic if any is; without labels every score is
    the leak's prior. An empty text has no sentence and scores the leak. Only the fit is on a sample (Training.most_documents); scoring covers all rows in one pass, no shuffle.
    """
    small_batches(docs.sparkSession)
    model = train(docs, labels, setting)
    sent = docs.select("doc_id", held_out().alias("held_out"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    return sent.mapInArrow(_scored(model, setting.threshold), SCHEMA)
