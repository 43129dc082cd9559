"""An exchange of very many (hash, owner, position) facts as packed blocks.

A row for each window of a corpus costs more disk in a shuffle than the corpus itself. Here each task splits the
facts of one batch by hash into buckets and sends one compressed block per bucket; Spark shuffles and groups the
blocks, and a grouped task finds the hashes that several owners hold. Facts that share their hash inside one batch
are settled before the shuffle: only the smallest owner's facts go out, so a hash that a third of all documents hold
costs one entry a batch, and no task ever gathers all of its holders.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice
from zlib import crc32

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

#: Facts that one grouped task holds at a time, about (70 bytes each while they are sorted).
FACTS_A_BUCKET = 1 << 21
LEAST_BUCKETS = 64
#: settled: the block is an owner (8 bytes) and what was found for it inside its own batch, and only passes through.
BLOCK_SCHEMA = "bucket int, settled boolean, block binary"
FOUND_SCHEMA = "owner long, found binary"
#: Bytes of a hash that travel; the bucket adds its own independent bits.
HASH_BYTES = 7
MASK = (1 << 8 * HASH_BYTES) - 1


def buckets_for(facts: int) -> int:
    """So many that a bucket holds about FACTS_A_BUCKET facts at any size of input."""
    return max(LEAST_BUCKETS, int(facts // FACTS_A_BUCKET))


def _planes(x: np.ndarray) -> bytes:
    return x.view(np.uint8).reshape(len(x), x.itemsize).T.tobytes()


def _from_planes(data: bytes, n: int, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, n).T).view(kind).reshape(n)


def pack(hashes: np.ndarray, owners: np.ndarray, positions: np.ndarray) -> bytes:
    """One block; owners and positions are stored as differences, which compress to a byte or two."""
    n = len(hashes)
    same = np.concatenate([[False], owners[1:] == owners[:-1]])
    owner_step = np.diff(owners, prepend=np.int64(0))
    position_step = np.where(same, np.diff(positions, prepend=0), positions).astype(np.int64).astype(np.uint32)
    side = zstandard.ZstdCompressor(level=1).compress(_planes(owner_step) + _planes(position_step))
    low = np.ascontiguousarray(hashes.astype("<u8")).view(np.uint8).reshape(n, 8)[:, :HASH_BYTES].tobytes()
    return n.to_bytes(4, "little") + low + side


def unpack(block: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = int.from_bytes(block[:4], "little")
    wide = np.zeros((n, 8), np.uint8)
    wide[:, :HASH_BYTES] = np.frombuffer(block, np.uint8, n * HASH_BYTES, 4).reshape(n, HASH_BYTES)
    side = zstandard.ZstdDecompressor().decompress(block[4 + n * HASH_BYTES :])
    owners = np.cumsum(_from_planes(side[: 8 * n], n, "<i8"))
    step = _from_planes(side[8 * n :], n, "<u4").astype(np.int64)
    new = np.concatenate([[True], owners[1:] != owners[:-1]])
    total = np.cumsum(step)
    first = np.flatnonzero(new)
    positions = total - np.repeat(total[first] - step[first], np.diff(np.append(first, n)))
    return wide.view("<u8").reshape(n), owners, positions & 0xFFFFFFFF


def shared(hashes: np.ndarray, owners: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every fact: is there a smaller owner of the same hash, and the smallest owner."""
    order = np.argsort(hashes, kind="stable")
    h = hashes[order]
    starts = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.empty(0, np.int64)
    least = np.empty(len(h), np.int64)
    if len(h):
        least[order] = np.repeat(np.minimum.reduceat(owners[order], starts), np.diff(np.append(starts, len(h))))
    return least < owners, least


def holders(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every fact: how many facts here have its hash, and is it the first of them."""
    order = np.argsort(hashes, kind="stable")
    h = hashes[order]
    starts = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])[: len(h)])
    counts = np.diff(np.append(starts, len(h)))
    number, first = np.empty(len(h), np.int64), np.zeros(len(h), bool)
    number[order] = np.repeat(counts, counts)
    first[order[starts]] = True
    return number, first


def blocks(hashes: np.ndarray, second: np.ndarray, owners: np.ndarray, positions: np.ndarray, n_buckets: int) -> Iterator[tuple[int, bool, bytes]]:
    """(bucket, False, block) of facts in (owner, position) order; `second` is an independent hash that picks the bucket."""
    if not len(hashes):
        return
    bucket = (second % np.uint64(n_buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    ends = np.cumsum(np.bincount(bucket, minlength=n_buckets))
    begin = 0
    for k, end in enumerate(ends):
        if end > begin:
            take = order[begin:end]
            yield k, False, pack(hashes[take], owners[take], positions[take])
        begin = int(end)


def owner_runs(owners: np.ndarray, *more: np.ndarray) -> Iterator[tuple]:
    """(owner, parts of the other arrays), for arrays sorted by owner."""
    if len(owners):
        cut = np.append(np.flatnonzero(np.concatenate([[True], owners[1:] != owners[:-1]])), len(owners))
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            yield int(owners[a]), *(x[a:b] for x in more)


def settled_rows(found: Iterator[tuple[int, bytes]], n_buckets: int) -> Iterator[tuple[int, bool, bytes]]:
    """Rows that only pass through, dealt by what they hold: an owner with very many of them has no task of its own."""
    for owner, data in found:
        block = owner.to_bytes(8, "little", signed=True) + data
        yield crc32(block[:64]) % n_buckets, True, block


def record_batches(rows: Iterator[tuple[int, bool, bytes]], size: int = 1024) -> Iterator[pa.RecordBatch]:
    """Rows of BLOCK_SCHEMA as Arrow batches."""
    rows = iter(rows)
    while part := list(islice(rows, size)):
        yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*part, strict=True), (pa.int32(), pa.bool_(), pa.binary()), strict=True)], names=["bucket", "settled", "block"])


def grouped(sent: DataFrame, settle) -> DataFrame:
    """Shuffle rows of BLOCK_SCHEMA by bucket; settle(hashes, owners, positions) gives (owner, found) of one bucket."""
    def run(table: pa.Table) -> pa.Table:
        out, parts = [], []
        for settled, block in zip(table.column("settled").to_pylist(), table.column("block").to_pylist(), strict=True):
            if settled:
                out.append((int.from_bytes(block[:8], "little", signed=True), block[8:]))
            else:
                parts.append(unpack(block))
        if parts:
            out += settle(*(np.concatenate(x) for x in zip(*parts, strict=True)))
        return pa.table({"owner": pa.array([x[0] for x in out], pa.int64()), "found": pa.array([x[1] for x in out], pa.binary())})

    return sent.groupBy("bucket").applyInArrow(run, FOUND_SCHEMA)


def grouped_edges(sent: DataFrame, settle) -> DataFrame:
    """As grouped(), for found lists of 8-byte smaller ids: rows (a, b), a > b."""
    def run(table: pa.Table) -> pa.Table:
        a, b, parts = [], [], []
        for settled, block in zip(table.column("settled").to_pylist(), table.column("block").to_pylist(), strict=True):
            if settled:
                b.append(np.frombuffer(block, "<i8", offset=8))
                a.append(np.full(len(b[-1]), int.from_bytes(block[:8], "little", signed=True)))
            else:
                parts.append(unpack(block))
        if parts:
            for owner, found in settle(*(np.concatenate(x) for x in zip(*parts, strict=True))):
                b.append(np.frombuffer(found, "<i8"))
                a.append(np.full(len(b[-1]), owner))
        pairs = np.unique(np.stack([np.concatenate([*x, np.empty(0, np.int64)]).astype(np.int64) for x in (a, b)], 1), axis=0)
        return pa.table({"a": pa.array(pairs[:, 0]), "b": pa.array(pairs[:, 1])})

    return sent.groupBy("bucket").applyInArrow(run, "a long, b long")
