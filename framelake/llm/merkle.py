"""Operator 11: Merkle dataset manifest as a persistent tree.

Leaves are dealt into aligned blocks of whole subtrees. A block's task builds its subtree and sends up the root alone;
the roots are the leaves of the next stage, until one node is left. Then the stages are walked down: every block hands
the path from its root to the top of the tree to its nodes. A changed leaf is a version of the tree: only its ancestors
are copied, first inside its block, where all versions share the untouched nodes, then along the block's path to the top.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelake.operators.rank import global_rank
from framelake.operators.skew import join_group_value
from framelake.sources.scratch import drop, materialise

#: Children of a node, and levels of the subtree that one task builds: blocks of ARITY ** LEVELS nodes.
ARITY, LEVELS = 2, 12
#: The columns that a leaf covers, in order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
BYTES = 32


def leaf_hash(columns: list[Column]) -> Column:
    """sha256 (hex) of the values after each other, each as its UTF-8 byte count, a colon and itself, or - if null."""
    parts = [F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-")) for c in columns]
    return F.sha2(F.concat(*parts), 256)


def parent(children: list[bytes]) -> bytes:
    """The digest of the children's digests as hex text."""
    return sha256("".join(c.hex() for c in children).encode()).digest()


class Block:
    """The subtree over up to arity ** height nodes, leaves first; its last level is one node."""

    def __init__(self, nodes: list[bytes], height: int, arity: int = ARITY):
        self.arity, self.levels = arity, [nodes]
        for _ in range(height):
            below = self.levels[-1]
            self.levels.append([parent(below[k : k + arity]) for k in range(0, len(below), arity)])

    @property
    def root(self) -> bytes:
        return self.levels[-1][0]

    def path(self, k: int) -> bytes:
        """For every level above leaf k: its place in its run and the run's size (a byte each), then its siblings."""
        out = []
        for nodes in self.levels[:-1]:
            first = k - k % self.arity
            run = nodes[first : first + self.arity]
            out.append(bytes([k - first, len(run)]) + b"".join(run[: k - first] + run[k - first + 1 :]))
            k //= self.arity
        return b"".join(out)


def steps(path: bytes) -> Iterator[tuple[int, list[bytes]]]:
    """(place in the run, siblings) for every level of a path, from below."""
    at = 0
    while at < len(path):
        place, size = path[at], path[at + 1]
        end = at + 2 + BYTES * (size - 1)
        yield place, [path[k : k + BYTES] for k in range(at + 2, end, BYTES)]
        at = end


def ancestors(leaf: bytes, path: bytes) -> list[bytes]:
    """The nodes that a leaf with these siblings has above it, up to the root: what a version copies."""
    out = []
    for place, siblings in steps(path):
        leaf = parent([*siblings[:place], leaf, *siblings[place:]])
        out.append(leaf)
    return out


def proof(path: bytes) -> bytes:
    return parent([s for _, siblings in steps(path) for s in siblings])


def _height(n: int, levels: int, arity: int) -> int:
    """Levels that a block of a tree with n nodes in this row gets: all of them, or as many as leave one node."""
    height = 0
    while n > 1 and height < levels:
        n, height = -(-n // arity), height + 1
    return height


def _block(levels: int, arity: int) -> Column:
    return F.expr(f"i div {arity**levels}").alias("block")


def _in_order(table: pa.Table) -> pa.Table:
    return table.sort_by([("i", "ascending")])


def _stages(nodes: DataFrame, levels: int, arity: int) -> list[DataFrame]:
    """nodes (tree, i, n, hash), n the nodes of the tree -> these and the block roots above them, up to one node a tree."""
    def up(key: tuple, table: pa.Table) -> pa.Table:
        table, n = _in_order(table), table.column("n")[0].as_py()
        root = Block(table.column("hash").to_pylist(), _height(n, levels, arity), arity).root
        return pa.table({"tree": pa.array([key[0].as_py()], pa.int64()), "i": pa.array([key[1].as_py()], pa.int64()), "n": pa.array([-(-n // arity**levels)], pa.int64()), "hash": pa.array([root], pa.binary())})

    out = [nodes]
    while True:
        out.append(materialise(out[-1].select("tree", "i", "n", "hash", _block(levels, arity)).groupBy("tree", "block").applyInArrow(up, "tree long, i long, n long, hash binary"), "roots"))
        if (out[-1].agg(F.max("n")).first()[0] or 0) <= 1:
            return out


def _downwards(nodes: DataFrame, paths: DataFrame, levels: int, arity: int) -> DataFrame:
    """nodes (tree, i, n, hash) and the paths (tree, i, path) above their blocks -> (tree, i, path) of the nodes."""
    def down(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left):
            return pa.table({"tree": pa.array([], pa.int64()), "i": pa.array([], pa.int64()), "path": pa.array([], pa.binary())})
        left, above = _in_order(left), right.column("path")[0].as_py()
        block = Block(left.column("hash").to_pylist(), _height(left.column("n")[0].as_py(), levels, arity), arity)
        return pa.table({"tree": left.column("tree"), "i": left.column("i"), "path": pa.array([block.path(k) + above for k in range(len(left))], pa.binary())})

    left = nodes.select("tree", "i", "n", "hash", _block(levels, arity)).groupBy("tree", "block")
    return left.cogroup(paths.select("tree", F.col("i").alias("block"), "path").groupBy("tree", "block")).applyInArrow(down, "tree long, i long, path binary")


def _paths(stages: list[DataFrame], top: DataFrame, levels: int, arity: int) -> DataFrame:
    """Paths of the second stage's nodes (the first blocks' roots), given those of the last one's."""
    for k in range(len(stages) - 2, 0, -1):
        top = materialise(_downwards(stages[k], top, levels, arity), "paths")
    return top


def _leaves(nodes: DataFrame, paths: DataFrame, top_height: int, levels: int, arity: int) -> DataFrame:
    """Leaf rows with subroot, root, proof and what their version copies; top_height: the last levels, above the subroots."""
    def close(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left):
            return pa.table({n: pa.array([], t) for n, t in OUT})
        left, above = _in_order(left), right.column("path")[0].as_py()
        hashes, changed = left.column("hash").to_pylist(), left.column("changed").to_pylist()
        block = Block(hashes, _height(left.column("n")[0].as_py(), levels, arity), arity)
        over = [block.root, *ancestors(block.root, above)]
        proofs, folded, copied = [], [], []
        for k, (leaf, other) in enumerate(zip(hashes, changed, strict=True)):
            path = block.path(k) + above
            nodes = ancestors(other or leaf, path)
            proofs.append(proof(path))
            folded.append(nodes[-1] if nodes else other or leaf)
            copied.append(nodes if other else None)
        many = [[x] * len(left) for x in (over[-1 - top_height], over[-1])]
        return pa.table([left.column("doc_id"), left.column("tree"), left.column("i"), *(pa.array(x, pa.binary()) for x in (hashes, *many, proofs, folded)), pa.array(copied, pa.list_(pa.binary()))], names=[n for n, _ in OUT])

    OUT = [("doc_id", pa.int64()), ("tree", pa.int64()), ("i", pa.int64()), *((n, pa.binary()) for n in ("leaf", "subroot", "root", "proof", "folded")), ("copied", pa.list_(pa.binary()))]
    left = nodes.select("doc_id", "tree", "i", "n", "hash", "changed", _block(levels, arity)).groupBy("tree", "block")
    right = paths.select("tree", F.col("i").alias("block"), "path").groupBy("tree", "block")
    return left.cogroup(right).applyInArrow(close, "doc_id long, tree long, i long, leaf binary, subroot binary, root binary, proof binary, folded binary, copied array<binary>")


def merkle_manifest(docs: DataFrame, changed: dict[str, Column] | None = None, tampered: Column | None = None, group: str = "lang", levels: int = LEVELS, arity: int = ARITY) -> DataFrame:
    """The Merkle tree over all rows, a subtree for every value of `group`, and a version of it for each tampered row.

    A leaf covers FIELDS. In each subtree leaves ascend by doc_id (nulls first; equal ids by their digests); subroots are
    ordered by group, null first. changed: the values that tampering gives to columns, where `tampered` holds. Returns
    doc_id, tree and i (the subtree and the leaf's place in it), leaf, subroot, root, proof (the digest of all siblings
    up to the root), folded (the root that the row's leaf, or its tampered one, and the siblings give) and copied: the
    nodes that the version of a tampered row owns, from the leaf's parent to the root; all else it shares. copied is null
    where no field changes. Digests are binary. Nulls in any column count as such; repeated rows are leaves of their own;
    an empty table gives no rows; columns beside FIELDS are ignored.
    """
    names = [F.col(n) for n in FIELDS]
    leaf, other = leaf_hash(names), leaf_hash([(changed or {}).get(n, F.col(n)) for n in FIELDS])
    changes = F.when((F.lit(False) if tampered is None else tampered) & (other != leaf), F.unhex(other))
    # The group's text with a sign before it, so that null has a place of its own before all others and meets itself in joins.
    key = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit(""))
    rows = materialise(docs.select(F.col("doc_id").cast("long").alias("doc_id"), key.alias("group"), F.unhex(leaf).alias("hash"), changes.alias("changed")), "leaves")
    placed, _ = global_rank(rows, ["group", "doc_id", "hash"], "place")
    placed = materialise(placed, "placed")
    groups = materialise(placed.groupBy("group").agg(F.min("place").alias("tree"), F.count("*").alias("n")), "groups")
    nodes = materialise(join_group_value(placed, groups, ["group"], "n").withColumn("i", F.col("place") - F.col("tree")).select("doc_id", "tree", "i", "n", "hash", "changed"), "nodes")
    drop(rows)
    drop(placed)
    stages = _stages(nodes, levels, arity)
    # Subroots are the leaves of the top tree, by the order of their groups.
    subroots, total = global_rank(stages[-1].select("tree", "hash"), ["tree"], "i")
    subroots = materialise(subroots, "subroots")
    tops = _stages(subroots.select(F.lit(0).cast("long").alias("tree"), "i", F.lit(total).cast("long").alias("n"), "hash"), levels, arity)
    top = _paths(tops, tops[-1].select("tree", "i", F.lit(b"").alias("path")), levels, arity)
    over = _downwards(tops[0], top, levels, arity).select("i", "path").join(subroots.select("i", "tree"), "i").select("tree", F.lit(0).cast("long").alias("i"), "path")
    over = materialise(over, "over")
    paths = _paths(stages, over, levels, arity)
    return _leaves(nodes, paths, _height(total, 64, arity), levels, arity)


def version_nodes(manifest: DataFrame, arity: int = ARITY) -> DataFrame:
    """The nodes that versions own: (tree, version, level, i, hash), version the place of the changed leaf, level from 1 above
    the leaves. Any other node of a version is that of the untampered tree. Levels of the top tree follow those of the
    subtree, without i."""
    at = manifest.filter("copied is not null").select("tree", F.col("i").alias("version"), F.posexplode("copied").alias("level", "hash"))
    return at.select("tree", "version", (F.col("level") + 1).alias("level"), F.floor(F.col("version") / F.pow(F.lit(arity), F.col("level") + 1)).cast("long").alias("i"), "hash")
