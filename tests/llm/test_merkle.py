"""Merkle manifest against whole trees built in one list, and versions against rebuilt trees."""

from __future__ import annotations

from hashlib import sha256
from zlib import crc32

import pytest
from pyspark.sql import functions as F

from framelake.llm.merkle import Block, ancestors, merkle_manifest, parent, steps, version_nodes

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def h(text: str) -> str:
    return sha256(text.encode()).hexdigest()


def leaf(doc_id, text, lang, source, n_chars) -> str:
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def tree(nodes: list[str], arity: int = 2) -> list[list[str]]:
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h("".join(out[-1][k : k + arity])) for k in range(0, len(out[-1]), arity)])
    return out


def brute(rows: list[tuple], arity: int = 2) -> list[tuple]:
    """(doc_id, leaf, subroot, root, proof, folded, verified) of every row."""
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    order = {g: sorted((r for r in rows if r[2] == g), key=lambda r: (r[0] is not None, r[0] or 0, leaf(*r))) for g in langs}
    subs = {g: tree([leaf(*r) for r in order[g]], arity) for g in langs}
    top = tree([subs[g][-1][0] for g in langs], arity)
    out = []
    for g in langs:
        for k, r in enumerate(order[g]):
            hit = r[0] is not None and crc32(str(r[0]).encode()) % 7 == 0 and r[4] is not None
            folded, siblings = leaf(*r[:4], r[4] + 1) if hit else leaf(*r), []
            for levels, place in ((subs[g], k), (top, langs.index(g))):
                for nodes in levels[:-1]:
                    run = nodes[place // arity * arity :][:arity]
                    siblings += run[: place % arity] + run[place % arity + 1 :]
                    run[place % arity] = folded
                    folded, place = h("".join(run)), place // arity
            out.append((r[0], leaf(*r), subs[g][-1][0], top[-1][0], h("".join(siblings)), folded, folded == top[-1][0]))
    return sorted(out, key=str)


def run(spark, rows, levels=12, arity=2):
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("leaf", F.lit(1))
    return merkle_manifest(docs, {"n_chars": F.col("n_chars") + 1}, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, levels=levels, arity=arity)


def table(found) -> list[tuple]:
    rows = found.collect()
    return sorted(((r.doc_id, r.leaf.hex(), r.subroot.hex(), r.root.hex(), r.proof.hex(), r.folded.hex(), r.folded == r.root) for r in rows), key=str)


ODD = [
    *((k, f"text {k}", "en", "web", 7 + k) for k in range(37)),
    *((k, "same", "dé", None, None) for k in range(100, 105)),
    (200, "alone", "zh", "x", 1), (None, None, None, None, None), (None, "", None, "", 0), (3, "ü" * 50_000, None, "web", 3),
    (5, "text 5", "en", "web", 12), (5, "other", "en", "web", 12), (14, "again", "", "web", 12), (14, "again", "", "web", 12),
]


@pytest.mark.parametrize(("levels", "arity"), [(12, 2), (2, 2), (1, 3)])
def test_equals_whole_trees(spark, levels, arity):
    """Nulls in every column, empty and long texts, repeated ids and rows, lone leaves; blocks of one stage and of several."""
    assert table(run(spark, ODD, levels, arity)) == brute(ODD, arity)


def test_one_row_and_none(spark):
    assert table(run(spark, ODD[:1])) == brute(ODD[:1])
    assert run(spark, []).count() == 0


def test_versions_share_all_but_their_own_path(spark):
    """A version's nodes over the first tree's are the tree that the tampered rows alone would give."""
    rows = [r for r in ODD if r[2] == "en"]
    found = run(spark, rows, levels=2).cache()
    before = sorted(found.collect(), key=lambda r: r.i)
    owned = {}
    for v in version_nodes(found).collect():
        owned.setdefault(v.version, {})[v.level, v.i] = v["hash"].hex()
    tampered = [k for k, r in enumerate(before) if r.copied is not None]
    assert sorted(owned) == tampered and tampered
    first = tree([r.leaf.hex() for r in before])
    for k in tampered:
        doc = next(r for r in rows if leaf(*r) == before[k].leaf.hex())
        leaves = [r.leaf.hex() for r in before]
        leaves[k] = leaf(*doc[:4], doc[4] + 1)
        after = tree(leaves)
        mine = {(lv, i): x for lv, nodes in enumerate(after) for i, x in enumerate(nodes) if lv and x != first[lv][i]}
        assert owned[k] == mine
        assert [i for _, i in sorted(owned[k])] == [k >> lv for lv in range(1, len(first))]


def test_block_paths():
    leaves = [sha256(bytes([k])).digest() for k in range(11)]
    block = Block(leaves, 4)
    for k, x in enumerate(leaves):
        assert ancestors(x, block.path(k))[-1] == block.root
        assert len(list(steps(block.path(k)))) == 4
    assert parent([]) == sha256(b"").digest()
