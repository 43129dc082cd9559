"""Operator 9: n-gram Jaccard join. Two prefix filters over shingle hashes pick candidates without loss; inside a candidate
family size-banded tiles with hashed bitmaps bound the overlap by bit counts before exact intersection."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelake.llm import packed
from framelake.llm.families import link_families
from framelake.llm.text import binary_column, mix, rolling, small_batches, text_bytes, word_hashes
from framelake.operators.graph import connected_components
from framelake.operators.skew import join_group_value
from framelake.sources.scratch import drop, materialise

#: Shingles that one task holds in memory while it compares a family (8 bytes each, and as much again for bitmaps).
TASK_SHINGLES = 1_000_000


@dataclass(frozen=True)
class Similarity:
    """Documents link when den * |A and B| >= num * |A or B| over their distinct shingles of `width` words."""

    width: int = 5
    num: int = 4
    den: int = 5
    #: Share of a set by which its first prefix is longer than it must be. The more, the more shingles two documents must
    #: have in common to become candidates, and the more are exchanged.
    longer: Fraction = Fraction(1, 5)

    def linked(self, inter: int, n_a: int, n_b: int) -> bool:
        return self.den * inter >= self.num * (n_a + n_b - inter)

    def head(self, n: int) -> int:
        """Length of the first prefix of a set of n: what a linked set can't do without, and a share more."""
        return min(n, n - -(-n * self.num // self.den) + max(1, int(self.longer * n)))

    def both(self, n: int) -> int:
        """The least number of shingles that the heads of a set of n and of any set linked with it have in common."""
        return max(1, int(self.longer * n * self.num / self.den))

    def steps(self) -> int:
        """Classes of SIZE_STEPS that the sizes of linked sets are apart at most, with one for rounding."""
        return int(np.ceil(SIZE_STEPS * np.log2(self.den / self.num))) + 1


#: Classes of sizes in an octave.
SIZE_STEPS = 256


def size_class(n: np.ndarray) -> np.ndarray:
    return np.floor(SIZE_STEPS * np.log2(np.maximum(n, 1))).astype(np.int64)


def shingles(raw: bytes, width: int) -> np.ndarray:
    """Sorted distinct shingle hashes of a text, A-Z in lower case; a shorter text's whole sequence is its one shingle."""
    words = raw.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    n = min(width, len(words))
    return np.unique(mix(rolling(word_hashes(words), n) + np.uint64(n)))


def keys(n: int, shared: np.ndarray, sim: Similarity) -> np.ndarray:
    """Keys of a set of n shingles. shared: hashes of its head that other documents' heads have too, rarest first.

    Let a set's head be the first shingles in the order of hashes. The k-th common shingle of two linked sets stands in
    either before place n - ceil(n * num / den) + k, so their heads have both(n) shingles in common at least, for the
    smaller of their two k's. Sort each head anew, by rarity, shingles of one document first: of so many common ones the
    first stands before place head(n) - both(n) + 1 in either. Shingles of one document can't be the common one, so what
    is left of these places for shared ones are the keys: none, if a document has enough shingles of its own. All this
    holds for any measure of rarity, as long as a shingle's is the same for all documents.
    """
    own = sim.head(n) - len(shared)
    return shared[: max(0, sim.head(n) - sim.both(n) + 1 - own)]


#: First byte of a block: shingles of heads, or shingles that many documents of a batch have, with their number.
FEW, MANY = b"f", b"m"
#: First byte of what comes back: sizes of the sets of a batch (owner 0), shared hashes of an owner, or MANY hashes with
#: their number in all documents (owner 0).
SIZES, SHARED, COUNTS = b"s", b"h", b"c"
#: A shingle of more documents of one batch is MANY: each of them then sends nothing for it, the batch one number.
BATCH_HOLDERS = 8
#: Of a MANY shingle the rarity is its number of documents if that is one in COMMON at least, and else BATCH_HOLDERS + 1.
#: So at most COMMON times the mean head's size of them are broadcast.
COMMON = 1000
#: Bytes of a shared hash and its rarity (capped; 0 for MANY).
REPLY = np.dtype([("h", "<u8"), ("n", "<u2")])


def _head_blocks(sim: Similarity, n_buckets: int):
    """Texts -> blocks of the shingles of heads; what a batch can settle alone: which of them are MANY; and sizes and
    digests of all sets."""
    def rows(batch: pa.RecordBatch) -> Iterator[tuple[int, bool, bytes]]:
        ids = np.asarray(batch.column("doc_id").to_pylist(), np.int64)
        order = np.argsort(ids, kind="stable")
        texts = binary_column(batch, "text")
        sets = [shingles(texts[i], sim.width) for i in order]
        sizes = np.array([len(s) for s in sets], np.int64)
        digests = np.array([[mix(s).sum(dtype=np.uint64), mix(s * np.uint64(3)).sum(dtype=np.uint64)] for s in sets], np.uint64).reshape(-1, 2)
        yield from packed.settled_rows([(0, SIZES + np.column_stack([ids[order].view(np.uint64), sizes.view(np.uint64), digests]).tobytes())], n_buckets)
        heads = [s[: sim.head(len(s))] for s in sets]
        found = np.concatenate([*heads, np.empty(0, np.uint64)])
        counts = np.array([len(h) for h in heads], np.int64)
        owners, of_size = np.repeat(ids[order], counts), np.repeat(sizes, counts)
        holders, first = packed.holders(found)
        many = holders > BATCH_HOLDERS
        yield from packed.settled_rows(((d, _reply(int(n[0]), h, np.zeros(len(h), np.int64))) for d, h, n in packed.owner_runs(owners[many], found[many], of_size[many])), n_buckets)
        once = many & first
        for kind, own, of, position in ((FEW, owners, ~many, of_size), (MANY, np.zeros(len(owners), np.int64), once, holders)):
            for bucket, settled, block in packed.blocks(found[of], mix(found[of]) >> np.uint64(8), own[of], position[of], n_buckets):
                yield bucket, settled, kind + block

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return packed.record_batches(row for batch in batches for row in rows(batch))

    return run


def _reply(n: int, hashes: np.ndarray, counts: np.ndarray) -> bytes:
    out = np.empty(len(hashes), REPLY)
    out["h"], out["n"] = hashes & np.uint64(packed.MASK), np.minimum(counts, 65535)
    return SHARED + n.to_bytes(8, "little") + out.tobytes()


def _shared_in_heads(table: pa.Table) -> pa.Table:
    """Blocks of one bucket -> replies to the documents whose shingles others have, and numbers of MANY shingles."""
    out, few, many = [], [], []
    for settled, block in zip(table.column("settled").to_pylist(), table.column("block").to_pylist(), strict=True):
        if settled:
            out.append((int.from_bytes(block[:8], "little", signed=True), block[8:]))
        else:
            (few if block[:1] == FEW else many).append(packed.unpack(block[1:]))
    none = np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    hashes, owners, sizes = (np.concatenate(x) for x in zip(none, *few, strict=True))
    many_hashes, _, held = (np.concatenate(x) for x in zip(none, *many, strict=True))
    holders, _ = packed.holders(hashes)
    common, which = np.unique(many_hashes, return_inverse=True)
    if len(common):
        at = np.minimum(np.searchsorted(common, hashes), len(common) - 1)
        is_many = common[at] == hashes if len(hashes) else np.zeros(0, bool)
        total = np.bincount(which, held, len(common)) + np.bincount(at[is_many], minlength=len(common))
        out.append((0, COUNTS + np.column_stack([common, total.astype(np.uint64)]).tobytes()))
    else:
        is_many = np.zeros(len(hashes), bool)
    several = (holders > 1) | is_many
    order = np.flatnonzero(several)[np.argsort(owners[several], kind="stable")]
    out += [(d, _reply(int(n[0]), h, c)) for d, h, n, c in packed.owner_runs(owners[order], hashes[order], sizes[order], np.where(is_many, 0, holders)[order])]
    return pa.table({"owner": pa.array([x[0] for x in out], pa.int64()), "found": pa.array([x[1] for x in out], pa.binary())})


def rarest_first(replies: np.ndarray, common: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Distinct hashes of REPLY rows by rarity, then by hash; common (sorted) and counts: the MANY shingles of one in COMMON
    documents or more."""
    h, first = np.unique(replies["h"], return_index=True)
    rarity = replies["n"][first].astype(np.int64)
    rarity[rarity == 0] = BATCH_HOLDERS + 1
    if len(common):
        at = np.minimum(np.searchsorted(common, h), len(common) - 1)
        found = (common[at] == h) & (replies["n"][first] == 0)
        rarity[found] = 65536 + counts[at[found]]
    return h[np.lexsort((h, rarity))]


def _key_blocks(sim: Similarity, n_buckets: int, shared):
    """Rows (owner, found: all that came back for it) -> blocks of keys. Owners of one key in a batch whose sizes are near,
    or are connected by such, are linked here, and only the ends of their range of sizes go on."""
    def rows(batch: pa.RecordBatch) -> Iterator[tuple[int, bool, bytes]]:
        common, counts = shared.value
        found, owners, sizes = [], [], []
        for owner, replies in zip(batch.column("owner").to_pylist(), batch.column("found").to_pylist(), strict=True):
            by_size: dict[int, list[np.ndarray]] = {}  # several rows of one id are sets of their own
            for r in replies:
                by_size.setdefault(int.from_bytes(r[1:9], "little"), []).append(np.frombuffer(r, REPLY, offset=9))
            for n, parts in by_size.items():
                k = keys(n, rarest_first(np.concatenate(parts), common, counts), sim)
                found.append(k)
                owners.append(np.full(len(k), owner, np.int64))
                sizes.append(np.full(len(k), n, np.int64))
        if not found:
            return
        found, owners, sizes = (np.concatenate(x) for x in (found, owners, sizes))
        size = size_class(sizes)
        runs, edges = chains(found, owners, size, size, sim.steps())
        order = np.lexsort((edges[:, 1], edges[:, 0]))
        yield from packed.settled_rows(((a, np.unique(b).astype("<i8").tobytes()) for a, b in packed.owner_runs(edges[order, 0], edges[order, 1])), n_buckets)
        order = np.lexsort((runs[0], runs[1]))
        h, own, low, high = (x[order] for x in runs)
        yield from packed.blocks(h, mix(h) >> np.uint64(8), own, low << 16 | high, n_buckets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return packed.record_batches(row for batch in batches for row in rows(batch))

    return run


def chains(hashes: np.ndarray, owners: np.ndarray, low: np.ndarray, high: np.ndarray, steps: int) -> tuple[tuple[np.ndarray, ...], np.ndarray]:
    """Ranges of size classes under each hash that are at most `steps` apart become one. Returns the ranges (hash, smallest
    owner, low, high) and edges (a, b), a > b, from every owner to the smallest one of its range."""
    if not len(hashes):
        return (hashes, owners, low, high), np.empty((0, 2), np.int64)
    order = np.lexsort((low, hashes))
    h, o, low, high = hashes[order], owners[order], low[order], high[order]
    # The highest end so far under the hash: ends of other hashes are lifted out of reach.
    group = np.cumsum(np.concatenate([[0], (h[1:] != h[:-1]).astype(np.int64)])) << 20
    so_far = np.maximum.accumulate(high + group)
    starts = np.flatnonzero(np.concatenate([[True], (low + group)[1:] > so_far[:-1] + steps]))
    least = np.minimum.reduceat(o, starts)
    edges = np.stack([o, np.repeat(least, np.diff(np.append(starts, len(h))))], 1)
    ends = np.append(starts[1:], len(h)) - 1
    return (h[starts], least, low[starts], (so_far - group)[ends]), np.unique(edges[edges[:, 0] != edges[:, 1]], axis=0)


def _star(sim: Similarity):
    def run(hashes: np.ndarray, owners: np.ndarray, sizes: np.ndarray) -> list[tuple[int, bytes]]:
        _, edges = chains(hashes, owners, sizes >> 16, sizes & 0xFFFF, sim.steps())
        return [(a, b.astype("<i8").tobytes()) for a, b in packed.owner_runs(edges[:, 0], edges[:, 1])]

    return run


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for data in batch.column("found").to_pylist():
            x = np.frombuffer(data, "<u8", offset=1).reshape(-1, 4)
            yield pa.RecordBatch.from_arrays([pa.array(x[:, 0].view(np.int64)), pa.array(x[:, 1].view(np.int64)), pa.array([r.tobytes() for r in x[:, 2:]], pa.binary())], names=["doc_id", "n", "digest"])


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for data in batch.column("found").to_pylist():
            x = np.frombuffer(data, "<u8", offset=1).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(x[:, 0].view(np.int64)), pa.array(x[:, 1].view(np.int64))], names=["h", "n"])


def common_shingles(replies: DataFrame, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of the MANY shingles that one in COMMON documents has, and their numbers."""
    rows = replies.filter(F.substring("found", 1, 1) == F.lit(COUNTS)).select("found").mapInArrow(_counts, "h long, n long").filter(F.col("n") * COMMON >= n_docs).collect()
    h, n = np.array([r.h for r in rows], np.int64).view(np.uint64), np.array([r.n for r in rows], np.int64)
    order = np.argsort(h)
    return h[order], n[order]


def bitmaps(sets: list[np.ndarray]) -> np.ndarray:
    """One row of bits a set: bit (hash mod size) for each shingle; twice as many bits as the largest set has."""
    bits = 1 << max(9, int(2 * max(map(len, sets)) - 1).bit_length())
    out = np.zeros((len(sets), bits // 8), np.uint8)
    for row, s in zip(out, sets, strict=True):
        at = (s & np.uint64(bits - 1)).astype(np.int64)
        np.bitwise_or.at(row, at >> 3, (1 << (at & 7)).astype(np.uint8))
    return out.view(np.uint64)


def tile_linker(sim: Similarity):
    """Compare the sets of one tile in order of size. Bits that only one of two bitmaps has stand for shingles that only
    one set has, and so bound the overlap from above; pairs within the bound that aren't connected yet are
    intersected. Jaccard distance obeys the triangle inequality: with distances to a
    pivot given (reach), pairs whose distances differ too much are skipped."""
    slack = 1 - sim.num / sim.den + 1e-9

    def run(ids: np.ndarray, payloads: list[bytes], sides: np.ndarray | None, joined: np.ndarray | None, reach: np.ndarray | None) -> list[tuple[int, int]]:
        sets = [np.frombuffer(p, "<u8") for p in payloads]
        sizes = np.array([len(s) for s in sets], np.int64)
        order = np.lexsort((ids, sizes))
        ids, sizes, sets = ids[order], sizes[order], [sets[k] for k in order]
        sides = np.arange(len(ids)) if sides is None else sides[order]
        maps = bitmaps(sets)
        root = np.arange(len(ids))
        if joined is not None and joined.any():
            root[joined[order]] = np.flatnonzero(joined[order])[0]
        reach = None if reach is None else reach[order]
        edges = []
        for i in range(len(ids) - 1):
            end = int(np.searchsorted(sizes, sizes[i] * sim.den // sim.num, "right"))
            other = np.arange(i + 1, end)
            other = other[(root[other] != root[i]) & (sides[other] != sides[i])]
            if reach is not None:
                other = other[np.abs(reach[other] - reach[i]) <= slack]
            if not len(other):
                continue
            only_i = np.bitwise_count(maps[i] & ~maps[other]).sum(1, dtype=np.int64)
            only_j = np.bitwise_count(~maps[i] & maps[other]).sum(1, dtype=np.int64)
            most = np.minimum(sizes[i] - only_i, sizes[other] - only_j)
            for j in other[sim.den * most >= sim.num * (sizes[i] + sizes[other] - most)]:
                if root[j] != root[i] and sim.linked(len(np.intersect1d(sets[i], sets[j], assume_unique=True)), sizes[i], sizes[j]):
                    edges.append((int(ids[i]), int(ids[j])))
                    root[root == root[j]] = root[i]
        return edges

    return run


def pivot_distance(sim: Similarity):
    def run(pivot: bytes, row: bytes) -> tuple[bool, float]:
        a, b = np.frombuffer(pivot, "<u8"), np.frombuffer(row, "<u8")
        inter = len(np.intersect1d(a, b, assume_unique=True))
        return sim.linked(inter, len(a), len(b)), 1 - inter / (len(a) + len(b) - inter)

    return run


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(x, width) for x in binary_column(batch, "text")]
            yield pa.RecordBatch.from_arrays([batch.column("family"), batch.column("doc_id"), pa.array([s.astype("<u8").tobytes() for s in sets], pa.binary()), pa.array([len(s) for s in sets], pa.int64())], names=["family", "id", "payload", "weight"])

    return run


def ngram_jaccard_join(docs: DataFrame, sim: Similarity = Similarity(), task_shingles: int = TASK_SHINGLES) -> DataFrame:
    """(doc_id, n_shingles, component_id): component_id is the smallest doc_id reachable over links.

    Reads doc_id and text; other columns are ignored. Rows with a null doc_id are left out; rows of one doc_id are each
    returned, as one document. A text without words, or null, has an empty set and links with nothing. Documents of equal
    sets are one class and go on as its smallest doc_id; between classes no link is lost. Ids of shingles are 64-bit
    hashes. An empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    docs = docs.filter("doc_id is not null").select("doc_id", "text")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_buckets = packed.buckets_for(int(size / 6 * sim.head(1 << 20) / (1 << 20)))
    sent = text_bytes(docs).mapInArrow(_head_blocks(sim, n_buckets), packed.BLOCK_SCHEMA)
    replies = materialise(sent.groupBy("bucket").applyInArrow(_shared_in_heads, packed.FOUND_SCHEMA), "heads")
    of_kind = lambda k: replies.filter(F.substring("found", 1, 1) == F.lit(k))
    sizes = materialise(of_kind(SIZES).select("found").mapInArrow(_sizes, "doc_id long, n long, digest binary"), "sizes")
    classes = materialise(sizes.filter("n > 0").groupBy("digest", "n").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")), "classes")
    several = classes.filter("copies > 1")
    copies = materialise(join_group_value(sizes.select("doc_id", "digest", "n"), several, ["digest", "n"], "copies").select("doc_id", "rep"), "copies")
    # A copy's keys are its representative's, so the representative has the same candidates: links go between those.
    repeated = materialise(sizes.groupBy("doc_id").count().filter("count > 1").select("doc_id"), "repeated")
    others = copies.filter("doc_id <> rep").join(repeated, "doc_id", "left_anti")
    shared = docs.sparkSession.sparkContext.broadcast(common_shingles(replies, sizes.count()))
    asked = of_kind(SHARED).join(others.select(F.col("doc_id").alias("owner")), "owner", "left_anti")
    by_doc = asked.groupBy("owner").agg(F.collect_list("found").alias("found"))
    star = packed.grouped_edges(by_doc.mapInArrow(_key_blocks(sim, n_buckets, shared), packed.BLOCK_SCHEMA), _star(sim))
    candidates = materialise(star.distinct(), "candidates")
    drop(replies)
    families = materialise(connected_components(candidates), "families").toDF("doc_id", "family")
    drop(candidates)
    # Families grow with the documents: a sort-merge join at any size.
    members = text_bytes(docs).join(families.hint("merge"), "doc_id").select("family", "doc_id", "text").mapInArrow(_sets(sim.width), "family long, id long, payload binary, weight long")
    links = link_families(members, tile_linker(sim), pivot_distance(sim), task_shingles, sim.num / sim.den)
    # An id of several rows is one document, and so connects the classes of all its sets.
    links = links.unionByName(copies.filter("doc_id <> rep").join(repeated, "doc_id").select(F.col("doc_id").alias("a"), F.col("rep").alias("b")))
    linked = materialise(connected_components(links), "components").toDF("rep", "component")
    labelled = copies.join(linked, "rep", "left").select("doc_id", F.coalesce("component", "rep").alias("component"))
    alone = linked.join(copies.select(F.col("doc_id").alias("rep")), "rep", "left_anti").select(F.col("rep").alias("doc_id"), "component")
    component = labelled.unionByName(alone).groupBy("doc_id").agg(F.min("component").alias("component"))
    return sizes.select("doc_id", F.col("n").alias("n_shingles")).join(component, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, sim: Similarity = Similarity()) -> DataFrame:
    """The rows of docs that are the smallest doc_id of their group of linked documents. Rows with a null doc_id can't be
    told apart or compared, and stay."""
    found = ngram_jaccard_join(docs, sim)
    return docs.join(found.filter("doc_id <> component_id").select("doc_id").hint("merge"), "doc_id", "left_anti").select(*docs.columns)
