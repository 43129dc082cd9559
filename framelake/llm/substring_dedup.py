"""Operator 1: substring dedup by Rabin-Karp hashes of every fixed-length token window."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelake.llm import packed
from framelake.llm.text import BASE2, binary_column, mix, ramp, rolling, small_batches, text_bytes, word_hashes
from framelake.operators.rank import global_rank
from framelake.operators.skew import join_group_value
from framelake.sources.scratch import materialise

WINDOW = 13


def _window_blocks(window: int, n_buckets: int, shift: int):
    """Batches of (doc_id, text) -> blocks of window hashes, and what a batch can settle alone."""
    def rows(batch: pa.RecordBatch) -> Iterator[tuple[int, bool, bytes]]:
        ids = np.asarray(batch.column("owner").to_pylist(), np.int64)
        order = np.argsort(ids, kind="stable")
        texts = binary_column(batch, "text")
        split = [texts[i].split() for i in order]
        lengths = np.array([len(x) for x in split], np.int64)
        words = word_hashes([w for x in split for w in x])
        whole = np.maximum(lengths - window + 1, 0)
        if not whole.any():
            return
        positions, owners = ramp(whole), np.repeat(ids[order], whole)
        at = np.repeat(np.cumsum(lengths) - lengths, whole) + positions
        first, second = mix(rolling(words, window))[at], mix(rolling(words, window, BASE2))[at]
        late, _ = packed.shared(first, owners >> shift)
        yield from packed.settled_rows(((d, p.astype("<u4").tobytes()) for d, p in packed.owner_runs(owners[late], positions[late])), n_buckets)
        keep = ~late
        yield from packed.blocks(first[keep], second[keep], owners[keep], positions[keep], n_buckets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return packed.record_batches(row for batch in batches for row in rows(batch))

    return run


def _later_holders(shift: int):
    def settle(hashes: np.ndarray, owners: np.ndarray, positions: np.ndarray) -> list[tuple[int, bytes]]:
        late, _ = packed.shared(hashes, owners >> shift)
        owners, positions = owners[late], positions[late]
        order = np.lexsort((positions, owners))
        return [(d, p.astype("<u4").tobytes()) for d, p in packed.owner_runs(owners[order], positions[order])]

    return settle


def intervals(starts: np.ndarray, window: int) -> list[tuple[int, int]]:
    """Maximal [first, last) word ranges that windows at the given starts cover."""
    s = np.unique(starts)
    if not len(s):
        return []
    cut = np.concatenate([[0], np.flatnonzero(np.diff(s) > window) + 1, [len(s)]])
    return [(int(s[a]), int(s[b - 1]) + window) for a, b in zip(cut[:-1], cut[1:], strict=True)]


def repeated_windows(docs: DataFrame, size: int, window: int = WINDOW, shift: int = 0) -> DataFrame:
    """(owner, starts): 4-byte word positions at which a window begins that also begins in a smaller document; a row may
    have several rows here. docs (owner, text) of `size` bytes; owner >> shift orders the documents.

    Every window of every document is hashed; hashes are compared on 56 bits and the independent bits of the bucket
    (62 at least), so among n windows about n*n / 2**63 are wrongly taken for repeats, 0.002 at 1.4e8 windows.
    """
    n_buckets = packed.buckets_for(size // 6)
    return packed.grouped(text_bytes(docs, "owner").mapInArrow(_window_blocks(window, n_buckets, shift), packed.BLOCK_SCHEMA), _later_holders(shift)).toDF("owner", "starts")


def _owners(docs: DataFrame) -> tuple[DataFrame, int, int]:
    """docs (doc_id, text) with `owner`, its shift, and the bytes of all texts. Where ids are unique the owner is the id.
    Else rows are numbered: the owner is the place of the id's first row, shifted, and the row's place among those of its id."""
    size, rows, most = docs.groupBy("doc_id").agg(F.sum(F.octet_length("text")).alias("size"), F.count("*").alias("n"), F.count("doc_id").alias("rows")).agg(F.sum("size"), F.sum("n"), F.max("rows")).first()
    if (most or 0) <= 1:
        return docs.withColumn("owner", F.col("doc_id").cast("long")), 0, size or 0
    shift = int(most).bit_length()
    if shift + int(rows).bit_length() > 63:
        raise ValueError("too many rows of one doc_id")
    placed, _ = global_rank(docs.filter("doc_id is not null"), ["doc_id", "text"], "place")
    placed = materialise(placed, "placed")
    first = placed.groupBy("doc_id").agg(F.min("place").alias("first"), F.count("*").alias("rows"))
    placed = join_group_value(placed, first, ["doc_id"], "rows").withColumn("owner", F.shiftleft("first", shift) + F.col("place") - F.col("first"))
    unnamed = docs.filter("doc_id is null").withColumn("owner", F.lit(None).cast("long"))
    return materialise(placed.select("doc_id", "text", "owner").unionByName(unnamed), "owners"), shift, size or 0


def _cut(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, n_words, n_removed, kept_text, spans = [], [], [], [], []
            for doc_id, text, starts in zip(batch.column("doc_id").to_pylist(), binary_column(batch, "text"), batch.column("starts").to_pylist(), strict=True):
                words = text.split()
                found = intervals(np.frombuffer(b"".join(starts or []), "<u4").astype(np.int64), window)
                kept = [w for a, b in zip([0, *(x[1] for x in found)], [*(x[0] for x in found), len(words)], strict=True) for w in words[a:b]]
                ids.append(doc_id)
                n_words.append(len(words))
                n_removed.append(len(words) - len(kept))
                kept_text.append(b" ".join(kept).decode())
                spans.append([{"first": a, "last": b} for a, b in found])
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept_text, pa.string()), pa.array(spans, pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())])))],
                names=["doc_id", "n_words", "n_removed", "kept_text", "removed_spans"],
            )

    return run


def substring_dedup(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Remove every word that a window of `window` words covers which also begins in a document with a smaller doc_id.

    Reads doc_id and text; other columns are ignored. Rows with a null doc_id lose nothing and take nothing; rows of one
    doc_id are each judged by their own windows, and take nothing from each other. Words are runs of anything but ASCII
    white space; a null or empty text has none. Windows are judged on the input. Returns doc_id, n_words, n_removed,
    kept_text (kept words joined by one space) and removed_spans (maximal [first, last) word ranges). Within one
    document repeats are kept. An empty table gives no rows; texts under `window` words lose nothing.
    """
    small_batches(docs.sparkSession)
    docs, shift, size = _owners(docs.select("doc_id", "text"))
    starts = repeated_windows(docs.filter("owner is not null"), size, window, shift).groupBy("owner").agg(F.collect_list("starts").alias("starts"))
    texts = docs.select("doc_id", "owner", F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    return texts.join(starts, "owner", "left").select("doc_id", "text", "starts").mapInArrow(
        _cut(window), "doc_id long, n_words long, n_removed long, kept_text string, removed_spans array<struct<first:long,last:long>>"
    )
