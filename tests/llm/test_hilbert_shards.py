from __future__ import annotations

import itertools
import zlib
from collections import Counter

import numpy as np

from framelake.llm.hilbert_shards import hilbert_index, hilbert_shards
from framelake.llm.queries import op5_hilbert_shards
from tests.conftest import SF


def test_curve_visits_every_cell_by_unit_steps():
    for dims, bits in ((2, 4), (3, 3), (4, 2)):
        cells = np.array(list(itertools.product(range(1 << bits), repeat=dims)))
        index = hilbert_index(list(cells.T), bits)
        assert sorted(index) == list(range(len(cells)))
        path = cells[np.argsort(index)]
        assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


def test_query_obeys_its_law_over_the_whole_table(spark):
    got = op5_hilbert_shards(spark, SF).toPandas()
    docs = spark.read.parquet(f"{SF}/documents.parquet").toPandas().set_index("doc_id").text
    assert sorted(got.doc_id) == sorted(docs.index)
    counts = got.groupby("shard").size()
    assert set(counts.index) == set(range(16)) and counts.max() - counts.min() <= 1
    for _, g in got.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))
    assert (got["size"] == [len(docs[i].encode()) + 1 for i in got.doc_id]).all()
    assert (got.text_crc32 == [zlib.crc32(docs[i].encode()) for i in got.doc_id]).all()
    ends = got.groupby("shard").curve.agg(["min", "max"])
    assert (ends["max"].to_numpy()[:-1] <= ends["min"].to_numpy()[1:]).all()


def test_nulls_repeats_clashing_names_and_few_rows(spark):
    rows = [(1, None, None, None, 5), (1, None, None, None, 6), (2, "x", "en", "s", None), (None, "", None, "t", 1), (4, "é" * 90000, "fr", None, 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, shard int")
    got = hilbert_shards(df, 4).collect()
    assert sorted(Counter(r.shard for r in got).values()) == [1, 1, 1, 2]
    assert sorted(r["size"] for r in got) == [1, 1, 1, 2, 180001]
    assert hilbert_shards(df.limit(0)).count() == 0
    assert hilbert_shards(df.limit(1)).first().slot == 0


def test_cells_order_and_pruning_by_brute_force(spark):
    rng = np.random.default_rng(5)
    long = "https://a-name-longer-than-any-prefix.example/"
    rows = [(int(d), "x" * int(n), str(lang) if lang else None, f"{long}{s}") for d, n, lang, s in zip(rng.permutation(900), rng.integers(0, 400, 900), rng.choice(["", "de", "en", "fr"], 900), rng.zipf(1.6, 900).clip(1, 30), strict=True)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(7)
    got = hilbert_shards(df, 16).toPandas()

    def cell(values):
        order = sorted(values, key=lambda v: (v is not None, v))
        return [order.index(v) * 32 // len(values) for v in values]

    cells = [cell([r[2] for r in rows]), cell([r[3] for r in rows]), cell([len(r[1]) for r in rows])]
    curve = hilbert_index([np.array(c) for c in cells], 5)
    want = sorted((int(c), r[0]) for c, r in zip(curve, rows, strict=True))
    assert [tuple(x) for x in got.sort_values(["shard", "slot"])[["curve", "doc_id"]].to_numpy().tolist()] == want
    # Pruning: a reader of one source and a range of sizes opens few of the shards that hold all of them in doc_id order.
    meta = {r[0]: (r[3], len(r[1]) // 100) for r in rows}
    groups = {}
    for d, s in zip(got.doc_id, got.shard, strict=True):
        groups.setdefault(meta[d], []).append((s, d * 16 // 900))
    by_curve, by_id = (sum(len({x[k] for x in g}) for g in groups.values()) for k in (0, 1))
    assert by_curve < 0.6 * by_id
