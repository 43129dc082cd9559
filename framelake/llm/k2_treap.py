"""Operator 13: ranked lexical search by K2-treaps.

A shard of the index is a grid of its terms (rows) and documents (columns). Each cell that holds something is split in
four, down to single postings; a cell stores which of its quarters hold something (four bits; the place of a child is a
count of bits before it) and the largest impact in it. An item walks down the paths of all of its rows together, over one
range of documents: the weighted maxima of its rows' cells bound what a document of the range can score. Ranges are
opened best first, until no bound reaches the last of the best found.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framelake.llm.text import binary_column, free_name, small_batches, text_bytes
from framelake.sources.scratch import drop, materialise

#: Postings of a shard, about: one text is never divided.
POSTINGS = 1 << 20
#: Ranges that are opened at a time.
OPENED = 128
#: Bytes of items that are ranked in one pass over the index.
BLOCK_BYTES = 16 << 20
INDEX = "doc_ids array<long>, terms binary, df binary, cells binary, maxima binary"
#: Bytes of terms; A-Z become a-z, all that is no part of a term becomes a space.
TERM_BYTES = np.array([c >= 0x80 or bytes([c]).isalnum() for c in range(256)])
FOLD = bytes(ord(chr(c).lower()) if c < 0x80 and TERM_BYTES[c] else c if TERM_BYTES[c] else 0x20 for c in range(256))
BITS = np.array([k.bit_count() for k in range(16)], np.uint8)


def terms(text: bytes) -> list[bytes]:
    """All terms of a UTF-8 text, in order: runs of letters and digits of ASCII, in lower case, and of anything beyond ASCII."""
    return text.translate(FOLD).split()


def count_terms(text: bytes) -> int:
    inside = TERM_BYTES[np.frombuffer(text, np.uint8)]
    return int(np.count_nonzero(inside[1:] & ~inside[:-1])) + int(inside[:1].sum())


def impact(tf: np.ndarray, n: np.ndarray, total_docs: int, total_terms: int) -> np.ndarray:
    """What a document's occurrences of a term count for, before the term's weight."""
    m = 50 + (50 * n * total_docs) // max(total_terms, 1)
    return (1_000_000_000 * tf) // (1000 * tf + 20 * m)


def _spaced(x: np.ndarray) -> np.ndarray:
    """The bits of 32-bit values with a free bit above each."""
    x = x.astype(np.uint64)
    for shift, keep in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        x = (x | x << np.uint64(shift)) & np.uint64(keep)
    return x


@dataclass
class Treap:
    """cells: the quarters of every inner cell, a level after the other; below: its first child; maxima: of all cells, and 0
    at the end for what isn't there."""

    height: int
    cells: np.ndarray
    below: np.ndarray
    maxima: np.ndarray

    @staticmethod
    def levels(rows: np.ndarray, columns: np.ndarray, impacts: np.ndarray, height: int) -> tuple[np.ndarray, np.ndarray]:
        """(cells, maxima), from the root down."""
        codes = _spaced(rows) << np.uint64(1) | _spaced(columns)
        order = np.argsort(codes)
        codes, top, cells = codes[order], impacts[order], []
        maxima = [top]
        for _ in range(height):
            above = codes >> np.uint64(2)
            first = np.flatnonzero(np.concatenate([[True], above[1:] != above[:-1]]))
            cells.append(np.bitwise_or.reduceat(np.uint8(1) << (codes & np.uint64(3)).astype(np.uint8), first))
            top = np.maximum.reduceat(top, first)
            maxima.append(top)
            codes = above[first]
        return np.concatenate([*cells[::-1], np.empty(0, np.uint8)]), np.concatenate(maxima[::-1])

    @staticmethod
    def pack(cells: np.ndarray, maxima: np.ndarray) -> tuple[bytes, bytes]:
        """Compressed; maxima as what they lack to their parent's."""
        lack = maxima[:1].astype(np.uint32)
        if len(cells):
            lack = np.concatenate([lack, (np.repeat(maxima[: len(cells)], BITS[cells]) - maxima[1:]).astype(np.uint32)])
        press = zstandard.ZstdCompressor(level=1).compress
        return press(cells.tobytes()), press(lack.view(np.uint8).reshape(-1, 4).T.tobytes())

    @classmethod
    def unpack(cls, cells: bytes, maxima: bytes) -> Treap:
        read = zstandard.ZstdDecompressor().decompress
        cells = np.frombuffer(read(cells), np.uint8)
        lack = np.frombuffer(read(maxima), np.uint8).reshape(4, -1).T.copy().view(np.uint32).ravel().astype(np.int64)
        below = 1 + np.cumsum(BITS[cells], dtype=np.int64) - BITS[cells]
        out, height, first, last = -lack, 0, 0, 1
        out[:1] = lack[:1]
        while first < len(cells):
            # A level's children are the next level.
            counts = BITS[cells[first:last]]
            out[last : last + int(counts.sum())] += np.repeat(out[first:last], counts)
            first, last, height = last, last + int(counts.sum()), height + 1
        return cls(height, np.append(cells, np.zeros(len(out) - len(cells) + 1, np.uint8)), np.append(below, np.zeros(len(out) - len(cells) + 1, np.int64)), np.append(out, 0))

    def best(self, rows: np.ndarray, weights: np.ndarray, k: int, least: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(columns, scores) of documents, best ranges first, until nothing more can score `least` or be among the k best of
        what came; all that ties with the last of them comes."""
        nothing, seen = len(self.maxima) - 1, np.empty(0, np.int64)
        nodes, level, column = np.zeros((1, len(rows)), np.int64), np.zeros(1, np.int64), np.zeros(1, np.int64)
        bound = (self.maxima[nodes] * weights).sum(axis=1)
        while True:
            if len(seen) >= k:
                least = max(least, int(seen[-k]))
            done = level == self.height
            if done.any():
                ready = done & (bound >= least)
                yield column[ready], bound[ready]
                seen = np.sort(np.concatenate([seen, bound[ready]]))[-k:]
                if len(seen) >= k:
                    least = max(least, int(seen[-k]))
            keep = ~done & (bound >= least)
            nodes, level, column, bound = nodes[keep], level[keep], column[keep], bound[keep]
            if not len(bound):
                return
            order = np.argpartition(-bound, OPENED) if len(bound) > OPENED else np.arange(len(bound))
            take, rest = order[:OPENED], order[OPENED:]
            mine, deep = nodes[take], level[take]
            cells, below = self.cells[mine], self.below[mine]
            quarter = ((rows >> (self.height - 1 - deep)[:, None]) & 1).astype(np.uint8) << np.uint8(1)
            parts = [(nodes[rest], level[rest], column[rest], bound[rest])]
            for side in (0, 1):
                bit = np.uint8(1) << (quarter + np.uint8(side))
                child = np.where(cells & bit, below + BITS[cells & (bit - np.uint8(1))], nothing)
                parts.append((child, deep + 1, 2 * column[take] + side, (self.maxima[child] * weights).sum(axis=1)))
            nodes, level, column, bound = (np.concatenate(x) for x in zip(*parts, strict=True))


def _shard(ids: list, lengths: list[int], held: list[Counter], total_docs: int, total_terms: int) -> tuple:
    """A row of the index. Columns by length, so that neighbours have impacts alike; rows by how many documents hold the term."""
    order = sorted(range(len(ids)), key=lambda k: lengths[k])
    sizes = np.array([len(held[k]) for k in order], np.int64)
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(t) for k in order for t in held[k]), np.uint64, int(sizes.sum()))
    tf = np.fromiter((c for k in order for c in held[k].values()), np.int64, len(hashes))
    columns = np.repeat(np.arange(len(order)), sizes)
    known, row, df = np.unique(hashes, return_inverse=True, return_counts=True)
    by_df = np.argsort(-df, kind="stable")
    place = np.empty(len(known), np.int64)
    place[by_df] = np.arange(len(known))
    n = np.repeat(np.array([lengths[k] for k in order], np.int64), sizes)
    height = max(1, (max(len(known), len(order)) - 1).bit_length())
    packed = Treap.pack(*Treap.levels(place[row], columns, impact(tf, n, total_docs, total_terms), height))
    return [ids[k] for k in order], known[by_df].tobytes(), df[by_df].astype("<u4").tobytes(), *packed


def totals(docs: DataFrame) -> tuple[int, int]:
    """Documents with a term, and terms of all of them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [count_terms(t) for t in binary_column(batch, "text")]
            yield pa.RecordBatch.from_arrays([pa.array([sum(x > 0 for x in found)], pa.int64()), pa.array([sum(found)], pa.int64())], names=["docs", "terms"])

    small_batches(docs.sparkSession)
    docs, words = text_bytes(docs).select("text").mapInArrow(run, "docs long, terms long").agg(F.sum("docs"), F.sum("terms")).first()
    return docs or 0, words or 0


def build_index(docs: DataFrame, postings: int = POSTINGS) -> tuple[DataFrame, int]:
    """The index over all terms of all documents (INDEX, a row a shard), and the number of documents with a term. Each task
    cuts its part of the scan into shards of about as many postings, so nothing is shuffled and no shard grows with the
    corpus. Terms are compared by 64-bit hashes: among v different ones about v * v / 2**65 pairs are taken for one."""
    total_docs, total_terms = totals(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, lengths, held, size = [], [], [], 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x], kind) for x, kind in zip(_shard(ids, lengths, held, total_docs, total_terms), (pa.list_(pa.int64()), *[pa.binary()] * 4), strict=True)], names=["doc_ids", "terms", "df", "cells", "maxima"])

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), binary_column(batch, "text"), strict=True):
                words = terms(text)
                if words:
                    ids.append(doc_id)
                    lengths.append(len(words))
                    held.append(Counter(words))
                    size += len(held[-1])
                if size >= postings:
                    yield out()
                    ids, lengths, held, size = [], [], [], 0
        if ids:
            yield out()

    return materialise(text_bytes(docs.withColumn("doc_id", F.col("doc_id").cast("long"))).mapInArrow(run, INDEX), "k2_treaps"), total_docs


def _document_counts(index: DataFrame, hashes: np.ndarray) -> np.ndarray:
    """How many documents hold each of these terms (ascending hashes); a row a task and term that it met."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(hashes), np.int64)
        for batch in batches:
            for known, df in zip(batch.column("terms").to_pylist(), batch.column("df").to_pylist(), strict=True):
                known, df = np.frombuffer(known, np.uint64), np.frombuffer(df, "<u4")
                at = np.searchsorted(hashes, known)
                hit = at < len(hashes)
                hit[hit] = hashes[at[hit]] == known[hit]
                total[at[hit]] += df[hit]
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(total[met])], names=["term", "df"])

    out = np.zeros(len(hashes), np.int64)
    for r in index.select("terms", "df").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():
        out[r["term"]] = r["df"]
    return out


def _search(index: DataFrame, queries: list[tuple[int, int | None, np.ndarray]], weights: dict[int, int], k: int) -> DataFrame:
    """The k best documents of every task for each query (key, item_id, term hashes)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = {key: (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)) for key, *_ in queries}
        for batch in batches:
            for r in range(batch.num_rows):
                ids = batch.column("doc_ids")[r].values
                missing, ids = np.asarray(ids.is_null()), np.asarray(ids.fill_null(0))
                known = np.frombuffer(batch.column("terms")[r].as_py(), np.uint64)
                order = np.argsort(known)
                treap = Treap.unpack(batch.column("cells")[r].as_py(), batch.column("maxima")[r].as_py())
                for key, _, hashes in queries:
                    at = np.minimum(np.searchsorted(known, hashes, sorter=order), len(known) - 1)
                    rows = order[at]
                    hit = known[rows] == hashes
                    if not hit.any():
                        continue
                    score, doc, none = best[key]
                    worth = np.array([weights[h] for h in hashes[hit].tolist()], np.int64)
                    found = list(treap.best(rows[hit], worth, k, int(score[k - 1]) if len(score) == k else 1))
                    if found:
                        columns, scores = (np.concatenate(x) for x in zip(*found, strict=True))
                        score, doc, none = np.concatenate([score, scores]), np.concatenate([doc, ids[columns]]), np.concatenate([none, missing[columns]])
                        first = np.lexsort((doc, none, -score))[:k]
                        best[key] = score[first], doc[first], none[first]
        for key, item_id, _ in queries:
            score, doc, none = best[key]
            if len(score):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(score), key)), pa.array([item_id] * len(score), pa.int64()), pa.array(doc, mask=none), pa.array(score)], names=["key", "item_id", "doc_id", "score"])

    return index.mapInArrow(run, "key long, item_id long, doc_id long, score long")


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 50, postings: int = POSTINGS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The k best documents for each item: item_id, rank (from 1), doc_id, score.

    Reads doc_id and text of docs and item_id and text of items; other columns are ignored. Terms are the maximal runs of
    ASCII letters and digits and of characters beyond ASCII; A-Z are lower-cased; a null text has none. Each row of items
    is ranked by itself, also where ids repeat or are null. Only scores above 0 are returned; equal ones ascend by
    doc_id, null last; rows of equal doc_id and score are each ranked. Empty tables give no rows. Items are collected in
    blocks of bounded bytes, each searched in one pass over the index, which holds all terms of all documents.
    """
    spark = docs.sparkSession
    small_batches(spark)
    index, total_docs = build_index(docs.select("doc_id", "text"), postings)
    items = materialise(items.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("key", F.monotonically_increasing_id()), "items")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks, out = max(1, -(-size // block_bytes)), None
    for b in range(blocks):
        mine = items.filter(F.pmod(F.xxhash64("key"), F.lit(blocks)) == b).collect()
        queries = [(r["key"], r["item_id"], np.unique(np.fromiter(map(xxhash.xxh3_64_intdigest, set(terms(r["text"].encode()))), np.uint64))) for r in mine]
        hashes = np.unique(np.concatenate([*(q[2] for q in queries), np.empty(0, np.uint64)]))
        df = _document_counts(index, hashes)
        weights = {h: math.floor(1000 * math.log((2 * total_docs + 2) / (2 * d + 1))) for h, d in zip(hashes.tolist(), df.tolist(), strict=True)}
        found = _search(index, queries, weights, k)
        out = found if out is None else out.unionByName(found)
    found = materialise(out, "found")
    drop(index)
    salt = free_name(found, "salt")
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    # Each task sent up to k rows an item: first the best of each of 64 parts, then of all.
    parted = found.withColumn(salt, F.pmod(F.xxhash64("doc_id"), F.lit(64)))
    parted = parted.withColumn("rank", F.row_number().over(Window.partitionBy("key", salt).orderBy(*order))).filter(F.col("rank") <= k)
    ranked = parted.withColumn("rank", F.row_number().over(Window.partitionBy("key").orderBy(*order))).filter(F.col("rank") <= k)
    return ranked.select("item_id", "rank", "doc_id", "score")
