"""Operator 12: SimHash near-dedup with vantage-point trees.

Two fingerprints that differ in at most K bits differ in at most K // T bits of one of T groups of bits. So every group
gets a vantage-point tree of its own, over the Hamming distance of that group's bits. A node has a vantage point, its
children are the rings of equal distance to it, and its leaves are the shards. A fingerprint lies in one leaf of each
tree. By the triangle inequality, one that is `apart` bits away is at most `apart` rings away on every level, and an even
or odd number of rings as `apart` is even or odd; all other branches are pruned. What is left of the leaves beyond its
own is what a fingerprint is sent to as a query. Inside a shard the tree goes on, and what meets is compared on all bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelake.llm.text import binary_column, ramp, small_batches, text_bytes
from framelake.operators.graph import connected_components, forest
from framelake.operators.skew import join_group_value
from framelake.sources.scratch import drop, materialise

SEED = 42
#: Bits of a node's code that hold one ring, and levels that fit in a code.
RING_BITS, MOST_LEVELS = 7, 8
#: Fingerprints from which the upper trees are grown. They only choose vantage points; every fingerprint is indexed.
SAMPLE = 4096
#: A node with fewer rows of the sample isn't grown: its level's spare vantage point serves.
LEAST_ROWS = 8
#: Fingerprints that a shard owns, about; a shard with more is dealt out in tiles of as many.
SHARD_ROWS = 2048
#: Of a leaf inside a shard, about, and pairs that are compared at a time.
CELL_ROWS, PAIRS = 32, 1 << 21
#: Hashes whose bits are counted at a time.
HASHES = 1 << 15


def shingle_hashes(text: bytes, width: int) -> list[int]:
    """XXH64 of all runs of `width` words, A-Z in lower case, joined by a space; of all words together if there are fewer."""
    words = text.lower().split()
    if len(words) <= width:
        return [xxhash.xxh64_intdigest(b" ".join(words), SEED)] if words else []
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    begins = np.concatenate([[0], ends[: len(words) - width] + 1])
    return [xxhash.xxh64_intdigest(line[a:b], SEED) for a, b in zip(begins.tolist(), ends[width - 1 :].tolist(), strict=True)]


def majority_bits(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Of each run of `counts` hashes, the bits that over half of them have; 0 for an empty run."""
    owners = np.repeat(np.arange(len(counts)), counts)
    ones = np.zeros((len(counts), 64), np.int64)
    for at in range(0, len(hashes), HASHES):
        bits = np.unpackbits(hashes[at : at + HASHES].astype(">u8").view(np.uint8)).reshape(-1, 64)
        mine = owners[at : at + HASHES]
        first = np.flatnonzero(np.concatenate([[True], mine[1:] != mine[:-1]]))
        for a, b in pairwise(np.append(first, len(mine)).tolist()):
            ones[mine[a]] += bits[a:b].sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > counts[:, None], axis=1).view(">u8").reshape(len(counts)).astype(np.uint64)


def fingerprints(docs: DataFrame, width: int = 4) -> DataFrame:
    """(doc_id, fp): the SimHash of every whole text as a signed long."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingle_hashes(t, width) for t in binary_column(batch, "text")]
            counts = np.fromiter(map(len, found), np.int64, len(found))
            hashes = np.fromiter((h for x in found for h in x), np.uint64, int(counts.sum()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(majority_bits(hashes, counts).view(np.int64))], names=["doc_id", "fp"])

    small_batches(docs.sparkSession)
    return text_bytes(docs.withColumn("doc_id", F.col("doc_id").cast("long"))).mapInArrow(run, "doc_id long, fp long")


def masks(groups: int) -> list[int]:
    """The 64 bits in as many groups of neighbours, equal in size but for one bit."""
    cut = [64 * k // groups for k in range(groups + 1)]
    return [(1 << b) - (1 << a) for a, b in pairwise(cut)]


def distance(a: np.ndarray, b: np.ndarray | np.uint64, mask: int) -> np.ndarray:
    return np.bitwise_count((a ^ b) & np.uint64(mask)).astype(np.int64)


@dataclass
class VantageTree:
    """codes: the grown nodes, ascending, a path of rings below a leading 1; points: their vantage points; spare: a vantage
    point a level, for nodes that the sample didn't reach."""

    mask: int
    levels: int
    codes: np.ndarray
    points: np.ndarray
    spare: np.ndarray

    def vantage(self, nodes: np.ndarray, level: int) -> np.ndarray:
        if not len(self.codes):
            return np.full(len(nodes), self.spare[level])
        at = np.minimum(np.searchsorted(self.codes, nodes), len(self.codes) - 1)
        return np.where(self.codes[at] == nodes, self.points[at], self.spare[level])

    def leaves(self, rows: np.ndarray, apart: int, upward: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """(row numbers, leaf codes) of the leaves that can hold what is `apart` bits of the mask away from each row.
        upward: at the root only rings that are not nearer, which is enough where both ends of a pair are sent."""
        at, codes, rings = np.arange(len(rows)), np.ones(len(rows), np.int64), int(self.mask).bit_count()
        for level in range(self.levels):
            moves = np.arange(-apart, apart + 1, 2)
            moves = moves[moves >= 0] if upward and level == 0 else moves
            ring = distance(rows[at], self.vantage(codes, level), self.mask)[:, None] + moves
            fits = (ring >= 0) & (ring <= rings)
            at = np.repeat(at, fits.sum(axis=1))
            codes = ((codes << RING_BITS)[:, None] | ring)[fits]
        return at, codes


def _spread(rows: np.ndarray, mask: int) -> np.uint64:
    """Of up to eight of the rows, the one whose distances to up to 128 of them vary most."""
    tried = rows[np.linspace(0, len(rows) - 1, min(len(rows), 8)).astype(np.int64)]
    seen = rows[np.linspace(0, len(rows) - 1, min(len(rows), 128)).astype(np.int64)]
    return tried[np.argmax(distance(tried[:, None], seen, mask).var(axis=1))]


def grow(sample: np.ndarray, mask: int, most_rows: float, most_levels: int = MOST_LEVELS) -> VantageTree:
    """A tree over the sample that gets another level until no leaf has more than `most_rows` rows of it, or until a level
    parts nothing."""
    sample = np.sort(sample)
    codes, points, levels, members = [], [], 0, {1: sample}
    while levels < most_levels and len(sample):
        largest, below = max(map(len, members.values())), {}
        if largest <= most_rows:
            break
        for code, rows in members.items():
            if len(rows) < LEAST_ROWS:
                below[code << RING_BITS] = rows
                continue
            codes.append(code)
            points.append(_spread(rows, mask))
            ring = distance(rows, points[-1], mask)
            below |= {code << RING_BITS | int(k): rows[ring == k] for k in np.unique(ring)}
        if levels and max(map(len, below.values())) == largest:
            break
        levels, members = levels + 1, below
    codes, points = np.array(codes, np.int64), np.array(points, np.uint64)
    order = np.argsort(codes)
    spare = sample[np.linspace(0, len(sample) - 1, most_levels + 2).astype(np.int64)[1:-1]] if len(sample) else np.zeros(most_levels, np.uint64)
    return VantageTree(mask, levels, codes[order], points[order], spare)


def _met(first: np.ndarray, last: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(k, p) for every p in [first[k], last[k]), a bounded number of pairs at a time."""
    counts = np.maximum(last - first, 0)
    ends = np.cumsum(counts)
    at = 0
    while at < len(counts):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS, side="right")))
        k = np.repeat(np.arange(at, to), counts[at:to])
        yield k, first[k] + ramp(counts[at:to])
        at = to


def shard_links(own: np.ndarray, sent: dict[int, np.ndarray], mask: int, bits: int, inner: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Links (fingerprint, fingerprint) enough to connect what differs in at most `bits` bits among the owned ones (if
    `inner`) and between them and those sent here, by their distance in the mask. The shard's own tree prunes again."""
    tree = grow(own[:: max(1, len(own) // SAMPLE)], mask, CELL_ROWS * min(1.0, SAMPLE / max(1, len(own))), 4)
    _, codes = tree.leaves(own, 0)
    order = np.argsort(codes, kind="stable")
    own, codes = own[order], codes[order]
    a, b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]

    def keep(rows: np.ndarray, first: np.ndarray, last: np.ndarray) -> None:
        for k, p in _met(first, last):
            near = np.bitwise_count(rows[k] ^ own[p]) <= bits
            roots = forest(rows[k][near].view(np.int64), own[p][near].view(np.int64))
            a.append(roots[0])
            b.append(roots[1])

    if inner:
        keep(own, np.arange(len(own)) + 1, np.searchsorted(codes, codes, side="right"))
    for apart, rows in sent.items():
        at, visited = tree.leaves(rows, apart)
        keep(rows[at], np.searchsorted(codes, visited, side="left"), np.searchsorted(codes, visited, side="right"))
    return forest(np.concatenate(a), np.concatenate(b))


def _dealt(placed: DataFrame, shard_rows: int) -> DataFrame:
    """Rows (tree, leaf, fp, apart) as (tree, leaf, i, j, fp, own, apart), own: the shard owns it, else it is sent there.

    A shard that owns or is sent too much is dealt out: every two of its blocks of rows meet in one tile. Block i of the
    owned rows meets block j of those sent in tile (i, j), and block k of the owned ones, where i <= k, in (i, -1 - k).
    All other shards are one tile, i = -1.
    """
    one = F.struct((F.col("apart") == 0).alias("own"), "apart", F.lit(-1).alias("i"), F.lit(0).alias("j"))
    size = placed.groupBy("tree", "leaf").agg(F.count(F.when(F.col("apart") == 0, 1)).alias("owned"), F.count("*").alias("rows"))
    size = size.withColumns({"bi": F.ceil(F.col("owned") / shard_rows).cast("int"), "bj": F.greatest(F.lit(1), F.ceil((F.col("rows") - F.col("owned")) / (8 * shard_rows))).cast("int")}).filter("bi > 0")
    size = materialise(size.select("tree", "leaf", "rows", "bi", "bj"), "shards")
    rows = join_group_value(placed, size, ["tree", "leaf"], "rows") if not size.filter("bi > 1 or bj > 1").isEmpty() else placed.withColumns({"bi": F.lit(1), "bj": F.lit(1)})
    mine, block = (F.pmod(F.xxhash64("fp", F.lit(3)), F.col(b).cast("long")).cast("int") for b in ("bi", "bj"))
    tile = lambda own, apart, i, j: F.struct(own.alias("own"), apart.alias("apart"), i.alias("i"), j.alias("j"))
    yes, no, zero = F.lit(True), F.lit(False), F.lit(0)
    owned_blocks, sent_blocks = F.sequence(zero, F.col("bi") - 1), F.sequence(zero, F.col("bj") - 1)
    among = F.transform(owned_blocks, lambda k: F.when(k >= mine, tile(yes, zero, mine, -1 - k)).otherwise(tile(no, zero, k, -1 - mine)))
    owned = F.concat(among, F.transform(sent_blocks, lambda j: tile(yes, zero, mine, j)))
    sent = F.transform(owned_blocks, lambda i: tile(no, F.col("apart"), i, block))
    tiles = F.when((F.col("bi") == 1) & (F.col("bj") == 1), F.array(one)).when(F.col("apart") == 0, owned).otherwise(sent)
    return rows.select("tree", "leaf", "fp", F.explode(tiles).alias("t")).select("tree", "leaf", "fp", "t.*")


def near_fingerprints(distinct: DataFrame, bits: int = 4, groups: int = 3, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """distinct (fp) -> edges (a, b), a > b, of fingerprints that differ in at most `bits` bits, enough to connect all that
    are linked. Exact at any size; three groups of bits prune well up to some 1e8 fingerprints."""
    spark, radius = distinct.sparkSession, bits // groups
    total = distinct.count()
    sample = np.array([r["fp"] for r in distinct.orderBy(F.xxhash64("fp"), "fp").limit(SAMPLE).collect()], np.int64).view(np.uint64)
    trees = [grow(sample, m, shard_rows * len(sample) / max(1, total)) for m in masks(groups)]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.asarray(batch.column("fp")).view(np.uint64)
            for k, tree in enumerate(trees):
                for apart in range(radius + 1):
                    at, leaf = tree.leaves(rows, apart, upward=True)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k, np.int32)), pa.array(leaf), pa.array(rows[at].view(np.int64)), pa.array(np.full(len(at), apart, np.int32))], names=["tree", "leaf", "fp", "apart"])

    def link(key: tuple, table: pa.Table) -> pa.Table:
        tree, _, i, j = (x.as_py() for x in key)
        rows, apart = np.asarray(table.column("fp")).view(np.uint64), np.asarray(table.column("apart"))
        own = table.column("own").to_numpy(zero_copy_only=False).astype(bool)
        sent = {int(k): rows[~own & (apart == k)] for k in np.unique(apart[~own])}
        a, b = shard_links(rows[own], sent, trees[tree].mask, bits, inner=i < 0 or j == -1 - i)
        return pa.table({"a": pa.array(np.maximum(a, b)), "b": pa.array(np.minimum(a, b))})

    small_batches(spark)
    placed = materialise(distinct.mapInArrow(place, "tree int, leaf long, fp long, apart int"), "placed")
    edges = materialise(_dealt(placed, shard_rows).groupBy("tree", "leaf", "i", "j").applyInArrow(link, "a long, b long"), "links")
    drop(placed)
    return edges


def simhash_dedup(docs: DataFrame, width: int = 4, bits: int = 4, groups: int = 3) -> DataFrame:
    """Documents in groups that are linked by fingerprints of at most `bits` differing bits.

    Reads doc_id and text; other columns are ignored. Words are runs of anything but ASCII white space, with A-Z in lower
    case; a text of fewer than `width` words is one shingle, a null text or one without words has fingerprint zero and is
    linked like any other. Returns a row a document: doc_id, fp (signed long), component_id (the smallest doc_id of the
    group; null ids are no candidates unless the group has no other, and then it is null). Repeated rows and ids are
    harmless; an empty table gives no rows. Copies meet as one fingerprint before anything is compared.
    """
    marked = materialise(fingerprints(docs, width), "marked")
    distinct = materialise(marked.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")), "fingerprints")
    edges = near_fingerprints(distinct.select("fp"), bits, groups)
    component = connected_components(edges).select(F.col("id").alias("fp"), "component")
    placed = materialise(distinct.join(component, "fp", "left").withColumn("component", F.coalesce("component", "fp")), "placed")
    roots = materialise(placed.groupBy("component").agg(F.min("first").alias("component_id"), F.count("*").alias("k")), "roots")
    named = materialise(join_group_value(placed.select("fp", "component", "n"), roots, ["component"], "k").select("fp", "n", "component_id"), "named")
    for t in (edges, distinct, placed, roots):
        drop(t)
    return join_group_value(marked, named, ["fp"], "n").select("doc_id", "fp", "component_id")
