"""Operator 2: benchmark decontamination. Rare word pairs of test items, next to each other or one word apart, are seeds that
join documents to items; Smith-Waterman alignment over words scores how much of an item each passage holds, so edited copies
count too."""

from __future__ import annotations

import string
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property, reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelake.llm.text import BASE, binary_column, ramp, small_batches, text_bytes
from framelake.sources.scratch import materialise

#: ASCII punctuation separates words as white space does.
SEPARATORS = bytes.maketrans(string.punctuation.encode(), b" " * len(string.punctuation))
#: Bits of the hash that sorts out most pairs before the search among seeds.
SIEVE = 22


@dataclass(frozen=True)
class Matching:
    match: int = 2
    mismatch: int = -1
    gap: int = -1
    #: Share of the score of a whole copy from which a passage is a copy.
    least_score: float = 0.5
    #: An item of fewer words is found only where its words stand together, and is no reason to drop a document.
    least_words: int = 3
    #: Words of test items that one pass over the documents takes: bounds what is broadcast and the counts on the driver.
    block_words: int = 1_000_000

    def least(self, length: int) -> float:
        return self.least_score * self.match * length

    def reach(self, words: int, length: int) -> int:
        """Passage words that an alignment reaching the score can spend on this many words of an item of `length` words, at
        one of its ends or in all. What it inserts is paid for by the matches of the same part, and by all that a copy has
        above the least score."""
        spare = min(self.match * words, self.match * length - self.least(length))
        return words + int(spare // -self.gap)

    def sure_seeds(self, length: int) -> int:
        """At so many places of the item at least, a copy reaching the score holds a seed. Of m matched words, m - 1 are followed
        by another with some edits between. All edits cost at most what the matches earn above the least score, and only two
        edits or more spoil a seed: a pair with one edit between (a word inserted, left out or replaced) stands within two
        words in the item and in the passage."""
        least, cost = self.least(length), 2 * min(-self.mismatch, -self.gap)
        fewest = int(-(-least // self.match))
        return min(m - 1 - int((self.match * m - least) // cost) for m in range(max(fewest, 1), length + 1))


def words_of(raw: bytes) -> list[bytes]:
    """Lower-case words between ASCII white space and punctuation."""
    low = raw.lower() if raw.isascii() else raw.decode("utf-8", "replace").lower().encode()
    return low.translate(SEPARATORS).split()


class Block:
    """Some test items as numbers of their words, and their seeds. Words that no item holds have the number 0."""

    def __init__(self, items: list[tuple[int, list[bytes]]], m: Matching):
        self.ids = [i for i, _ in items]
        self.numbers: dict[bytes, int] = {}
        self.words = [np.array([self.numbers.setdefault(w, len(self.numbers) + 1) for w in ws], np.int64) for _, ws in items]
        self.length = np.array([len(w) for w in self.words], np.int64)
        self.span = np.array([m.reach(n, n) for n in self.length.tolist()], np.int64)
        keys, item, place = [], [], []
        for k, w in enumerate(self.words):
            for step in self.steps(len(w), m):
                keys.append(self.pairs(w, step))
                item.append(np.full(len(keys[-1]), k))
                place.append(np.arange(len(keys[-1])))
        self.set_seeds(*(np.concatenate([*x, np.empty(0, np.int64)]).astype(np.int64) for x in (keys, item, place)))
        self.need = np.ones(len(items), np.int64)

    @staticmethod
    def steps(length: int, m: Matching) -> tuple[int, ...]:
        """Distances between the two words of an item's seeds; 0 for an item of a lone word."""
        return (length - 1,) if length < min(m.least_words, 3) else (1, 2)

    def pairs(self, words: np.ndarray, step: int) -> np.ndarray:
        """A number for each pair of words at that distance, 0 where no item holds one of them."""
        a, b = words[: len(words) - step], words[step:]
        return np.where((a > 0) & (b > 0), a * (len(self.numbers) + 1) + b if step else -a, 0)

    def set_seeds(self, keys: np.ndarray, item: np.ndarray, place: np.ndarray) -> None:
        order = np.argsort(keys, kind="stable")
        self.keys, self.item, self.place = keys[order], item[order], place[order]
        self.__dict__.pop("sieve", None)

    @cached_property
    def sieve(self) -> np.ndarray:
        out = np.zeros(1 << SIEVE, bool)
        out[self.sieved(self.keys)] = True
        return out

    @staticmethod
    def sieved(keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(BASE)) >> np.uint64(64 - SIEVE)).astype(np.int64)

    def read(self, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        """(word counts, numbers of the words of all texts in a row)."""
        split = [words_of(x) for x in binary_column(batch, "text")]
        lengths = np.array([len(w) for w in split], np.int64)
        of = self.numbers.get
        return lengths, np.concatenate([np.empty(0, np.int64), *(np.fromiter(map(of, w, repeat(0)), np.int64, len(w)) for w in split)])

    def found(self, lengths: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document in the batch, word place in it, first entry of its key) of every pair that is a seed and doesn't cross a
        document's end."""
        ends, out = np.cumsum(lengths), []
        for step in (1, 2, 0) if len(self.keys) and self.keys[0] < 0 else (1, 2):
            keys = self.pairs(words, step)
            at = np.flatnonzero(self.sieve[self.sieved(keys)] & (keys != 0))
            entry = np.searchsorted(self.keys, keys[at])
            hit = self.keys[np.minimum(entry, len(self.keys) - 1)] == keys[at] if len(self.keys) else np.zeros(len(at), bool)
            at, entry = at[hit], entry[hit]
            doc = np.searchsorted(ends, at, "right")
            inside = at + step < ends[doc]
            out.append((doc[inside], (at - (ends - lengths)[doc])[inside], entry[inside]))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))

    def hits(self, lengths: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, ...]:
        """(document in the batch, word place in it, item, place in the item), sorted, of the seeds that stand in a passage with
        as many others of the item as a copy must hold."""
        doc, at, low = self.found(lengths, words)
        times = np.searchsorted(self.keys, self.keys[low], "right") - low
        entry = np.repeat(low, times) + ramp(times)
        doc, at, item, place = np.repeat(doc, times), np.repeat(at, times), self.item[entry], self.place[entry]
        order = np.lexsort((at, item, doc))
        doc, at, item, place = doc[order], at[order], item[order], place[order]
        first = np.arange(len(doc))
        last = first + self.need[item] - 1
        end = np.minimum(last, len(doc) - 1)
        dense = (last < len(doc)) & (doc[end] == doc) & (item[end] == item) & (at[end] - at <= self.span[item])
        change = np.zeros(len(doc) + 1, np.int64)
        np.add.at(change, first[dense], 1)
        np.add.at(change, last[dense] + 1, -1)
        kept = np.cumsum(change[:-1]) > 0
        return doc[kept], at[kept], item[kept], place[kept]

    def keep_rare(self, counts: dict[int, int], m: Matching) -> None:
        """Leave to each item its rarest places, so many that a copy holds a third of its sure seeds (one at least) among
        them, and demand these."""
        weight = np.array([counts.get(k, 0) for k in self.keys.tolist()], np.int64)
        order = np.lexsort((self.place, self.item))
        item, place, weight, keys = self.item[order], self.place[order], weight[order], self.keys[order]
        begins = np.flatnonzero(np.concatenate([[True], (item[1:] != item[:-1]) | (place[1:] != place[:-1])])[: len(item)])
        at_item, at_place = item[begins], place[begins]
        total = np.add.reduceat(weight, begins) if len(begins) else weight
        by = np.lexsort((at_place, total, at_item))
        rank = ramp(np.bincount(at_item, minlength=len(self.ids)))
        sure = np.array([max(m.sure_seeds(n), 1) if n >= min(m.least_words, 3) else 1 for n in self.length.tolist()], np.int64)
        self.need = np.maximum(sure // 3, 1)
        places = np.bincount(at_item, minlength=len(self.ids))
        rare = np.zeros(len(begins), bool)
        rare[by] = rank < (places - sure + self.need)[at_item[by]]
        kept = np.repeat(rare, np.diff(np.append(begins, len(item))))
        self.set_seeds(keys[kept], item[kept], place[kept])


def most_score(present: np.ndarray, m: Matching) -> int:
    """No alignment of an item scores more than this, given which of its words the passage holds at all: it covers a run of
    the item's words, where a held word gives a match at most and any other costs a mismatch or a gap."""
    total = np.concatenate([[0], np.cumsum(np.where(present, m.match, max(m.mismatch, m.gap)))])
    return int((total - np.minimum.accumulate(total)).max())


def align(a: np.ndarray, b: np.ndarray, m: Matching) -> tuple[int, int, int]:
    """Smith-Waterman with linear gaps: best local score of item a in passage b, and the passage words it spans."""
    across = np.arange(len(b) + 1) * -m.gap
    row, start = np.zeros(len(b) + 1, np.int64), np.arange(len(b) + 1)
    best = (0, 0, 0)
    for x in a:
        step = row[:-1] + np.where(b == x, m.match, m.mismatch)
        up = row[1:] + m.gap
        new, origin = np.zeros(len(b) + 1, np.int64), np.arange(len(b) + 1)
        diagonal = step >= up
        value = np.where(diagonal, step, up)
        live = value > 0
        new[1:] = np.where(live, value, 0)
        origin[1:] = np.where(live, np.where(diagonal, start[:-1], start[1:]), origin[1:])
        lifted = np.maximum.accumulate(new + across)  # gaps along the passage
        by = np.maximum.accumulate(np.where(new + across == lifted, np.arange(len(lifted)), 0))
        row, start = lifted - across, origin[by]
        k = int(row.argmax())
        if row[k] > best[0]:
            best = (int(row[k]), int(start[k]), k)
    return best


FOUND = "doc_id long, item_id long, score double, first_word long, last_word long, n_seeds long"
COUNTS = "key long, n long"


def passages(places: np.ndarray, offsets: np.ndarray, length: int, n_words: int, m: Matching) -> list[tuple[int, int]]:
    """Word ranges of a document to align with an item of `length` words: around each run of hits, as wide as a copy can
    reach before and after each."""
    before, after = (np.array([m.reach(k, length) for k in range(length + 1)])[at] for at in (offsets, length - offsets))
    low, high = np.maximum(places - before, 0), np.minimum(places + after, n_words)
    out: list[tuple[int, int]] = []
    for a, b in sorted(zip(low.tolist(), high.tolist(), strict=True)):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _counted(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value
        n = np.zeros(len(block.keys), np.int64)
        for batch in batches:
            n += np.bincount(block.found(*block.read(batch))[2], minlength=len(n))
        yield pa.RecordBatch.from_arrays([pa.array(block.keys[n > 0]), pa.array(n[n > 0])], names=["key", "n"])

    return run


def _aligned(shared, m: Matching):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value
        for batch in batches:
            ids, (lengths, words) = batch.column("doc_id"), block.read(batch)
            begins = np.cumsum(lengths) - lengths
            doc, place, item, offset = block.hits(lengths, words)
            cut = np.append(np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (item[1:] != item[:-1])])[: len(doc)]), len(doc))
            rows = []
            for a, b in zip(cut[:-1], cut[1:], strict=True):
                d, i = int(doc[a]), int(item[a])
                text, own = words[begins[d] : begins[d] + lengths[d]], block.words[i]
                least, best = m.least(len(own)), None
                for x, y in passages(place[a:b], offset[a:b], len(own), len(text), m):
                    if most_score(np.isin(own, text[x:y]), m) >= least:
                        s, f, e = align(own, text[x:y], m)
                        if best is None or s > best[0]:
                            best = s, x + f, x + e
                if best and best[0] >= least:
                    score, first, last = best
                    rows.append((ids[d].as_py(), block.ids[i], score / (m.match * len(own)), first, last, int(b - a)))
            columns = list(zip(*rows, strict=True)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=[x.split()[0] for x in FOUND.split(", ")])

    return run


def _blocks(benchmark: DataFrame, m: Matching) -> Iterator[Block]:
    items, size = [], 0
    for r in benchmark.select("item_id", "text").orderBy("item_id", "text").toLocalIterator():
        words = words_of((r.text or "").encode())
        if r.item_id is None or not words:
            continue
        if items and size + len(words) > m.block_words:
            yield Block(items, m)
            items, size = [], 0
        items.append((r.item_id, words))
        size += len(words)
    if items:
        yield Block(items, m)


def contaminated(docs: DataFrame, benchmark: DataFrame, matching: Matching = Matching()) -> DataFrame:
    """(doc_id, item_id, score, first_word, last_word, n_seeds): documents that hold a copy, whole or edited, of a test item.

    score is the alignment's score over that of a whole copy; the words first_word up to last_word of the document
    align best, and the document holds n_seeds seeds of the item. The test items are the query set: they are taken in blocks of
    bounded size, each broadcast to all documents, without shuffling texts. A first pass counts every seed of the block in all
    documents; of each item the most frequent seeds go, as many as leave every copy that reaches the score with seeds enough
    (Matching.sure_seeds). A second pass meets documents and items at the rare seeds and aligns the passages around them, so
    no copy that reaches the score is lost, however it is edited. Items of under least_words words are found only where their
    words stand together; with costs under which a copy needn't hold a seed (sure_seeds below 1), one is asked for.
    Reads doc_id and text of docs, item_id and text of benchmark; other columns are ignored. Null texts hold nothing;
    items with a null id or without words can't be looked for; repeated items and rows are each reported. With either table
    empty there are no rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    texts, found = text_bytes(docs), []
    for block in _blocks(benchmark, matching):
        every = spark.sparkContext.broadcast(block)
        counts = texts.mapInArrow(_counted(every), COUNTS).groupBy("key").agg(F.sum("n").alias("n"))
        block.keep_rare({r.key: r.n for r in counts.toLocalIterator()}, matching)
        shared = spark.sparkContext.broadcast(block)
        found.append(materialise(texts.mapInArrow(_aligned(shared, matching), FOUND), "contaminated"))
        every.unpersist()
    return reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], FOUND)


def keep_uncontaminated(docs: DataFrame, benchmark: DataFrame, matching: Matching = Matching()) -> DataFrame:
    """The rows of docs that hold no copy of a test item. Items of under least_words words are no reason to drop a document:
    such a word or two stand in clean texts too. Rows with a null doc_id can't be told apart, and stay."""
    long = F.size(F.split(F.trim(F.regexp_replace("text", r"[\s\p{Punct}]+", " ")), " ")) >= matching.least_words
    found = contaminated(docs.filter("doc_id is not null"), benchmark.filter(long), matching)
    return docs.join(found.select("doc_id").distinct(), "doc_id", "left_anti").select(*docs.columns)
