"""Links inside candidate families.

A family is a connected set of rows that share candidate keys; links can only exist inside one. Small families are
compared whole, many to a task. A family with too many rows or too much weight is first compared with one pivot, which
settles all of its rows that the pivot links. What is left is dealt into blocks by bands of weight, and only blocks of
the same or of neighbouring bands meet, so that no task holds the family, rows that are far apart in weight are never
brought together, and rows that are already in the pivot's class are never compared with each other.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelake.operators.skew import join_group_value
from framelake.sources.scratch import drop, materialise

EDGES = "a long, b long"
#: Rows of a family that is compared whole, and of a block.
WHOLE_ROWS, BLOCK_ROWS = 1024, 512
#: Pairs of rows that one group of small families holds, about.
PAIRS = 1 << 22
#: linker(ids, payloads, sides, joined, reach) -> edges: links enough to connect every class among the rows. Each of these
#: may be None: pairs of the same side are skipped; joined rows are known to be one class; reach is the rows' distance to
#: one and the same other row.
Linker = Callable[[np.ndarray, list[bytes], np.ndarray | None, np.ndarray | None, np.ndarray | None], list[tuple[int, int]]]


def _edges(pairs: list[tuple[int, int]]) -> pa.Table:
    return pa.table({"a": pa.array([max(p) for p in pairs], pa.int64()), "b": pa.array([min(p) for p in pairs], pa.int64())})


def spread(rows: DataFrame, key: str) -> DataFrame:
    """rows by key in a given number of tasks, several a core: pairs take long for their bytes, and by these adaptive execution
    would put nearly all groups into a few tasks."""
    spark = rows.sparkSession
    return rows.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism), key)


def link_families(members: DataFrame, linker: Linker, distance: Callable[[bytes, bytes], tuple[bool, float]], bound: int, ratio: float, many: Callable[[list[tuple[np.ndarray, list[bytes]]]], list[tuple[int, int]]] | None = None) -> DataFrame:
    """members (family, id, payload, weight) -> edges (a, b) with a > b that connect what links.

    bound: weight that a task holds. ratio: the smaller of two linked rows has at least this share of the larger one's
    weight. distance(pivot, row) -> (linked, distance), a distance that obeys the triangle inequality. many: the linker of a
    list of families (ids, payloads), if it is faster over several at once.
    """
    members = materialise(members, "members")
    stats = members.groupBy("family").agg(F.sum("weight").alias("w"), F.count("*").alias("n"), F.max("weight").alias("top"))
    stats = materialise(stats.withColumn("big", (F.col("n") > 1) & ((F.col("w") > bound) | (F.col("n") > WHOLE_ROWS))), "families")
    weight, pairs, n_big = stats.agg(F.sum(F.when(~F.col("big"), F.col("w"))), F.sum(F.when(~F.col("big"), F.col("n") * F.col("n"))), F.count(F.when(F.col("big"), 1))).first()
    n_groups = max(64, 2 * int((weight or 0) // bound), int((pairs or 0) // PAIRS))

    def small(table: pa.Table) -> pa.Table:
        table = table.sort_by([("family", "ascending"), ("id", "ascending")])
        family, ids, payloads = np.asarray(table.column("family")), np.asarray(table.column("id")), table.column("payload")
        cut = np.append(np.flatnonzero(np.concatenate([[True], family[1:] != family[:-1]])), len(family))
        found = ((ids[x:y], payloads.slice(x, y - x).to_pylist()) for x, y in zip(cut[:-1], cut[1:], strict=True) if y - x > 1)
        return _edges(many(list(found)) if many else [p for x in found for p in linker(*x, None, None, None)])

    big = stats.filter("big")
    quiet = members.join(big.select("family"), "family", "left_anti") if n_big else members
    edges = spread(quiet.withColumn("g", F.pmod(F.xxhash64("family"), F.lit(n_groups))), "g").groupBy("g").applyInArrow(small, EDGES)
    tables = [members]
    out = materialise(edges.unionByName(_big_links(members, big, linker, distance, bound, ratio, tables)) if n_big else edges, "links")
    for t in tables:
        drop(t)
    return out


def _big_links(members: DataFrame, big: DataFrame, linker: Linker, distance, bound: int, ratio: float, tables: list[DataFrame]) -> DataFrame:
    """Links of big families; tables gets what is written for them and may go afterwards."""
    rows = materialise(members.join(big, "family"), "big")
    tables.append(rows)
    # The pivot's row goes to as many parts of its family as the family's size asks for.
    parts = F.greatest(F.ceil(F.col("w") / bound), F.ceil(F.col("n") / BLOCK_ROWS)).cast("int")
    pivots = rows.filter(F.col("id") == F.col("family")).select("family", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"), F.col("payload").alias("pivot"))
    dealt = rows.withColumn("part", F.pmod(F.xxhash64("id"), parts.cast("long")).cast("int"))

    def compare(batches):
        for batch in batches:
            found = [distance(p, x) for p, x in zip(batch.column("pivot").to_pylist(), batch.column("payload").to_pylist(), strict=True)]
            keep = [batch.column(k) for k in ("family", "id", "payload", "weight")]
            yield pa.RecordBatch.from_arrays([*keep, pa.array([not x[0] for x in found]), pa.array([x[1] for x in found], pa.float64())], names=["family", "id", "payload", "weight", "open", "distance"])

    held = materialise(dealt.join(pivots, ["family", "part"]).mapInArrow(compare, "family long, id long, payload binary, weight long, open boolean, distance double"), "pivoted")
    tables.append(held)
    star = held.filter(~F.col("open") & (F.col("id") != F.col("family"))).select(F.col("id").alias("a"), F.col("family").alias("b"))
    # Linked weights are one band apart at most (a band is a little wider than the ratio, for rounding).
    banded = held.withColumn("band", F.floor(F.log(F.greatest(F.col("weight"), F.lit(1))) / (math.log(1 / ratio) * 1.001)).cast("int"))
    banded = banded.select("family", "id", "payload", "weight", "open", "band", "distance")
    sizes = banded.groupBy("family", "band", "open").agg(F.count("*").alias("n"), F.sum("weight").alias("w"))
    blocks = F.greatest(F.ceil(F.col("n") / BLOCK_ROWS), F.ceil(2 * F.col("w") / bound)).cast("int")
    layout = sizes.groupBy("family").agg(F.collect_list(F.struct("band", "open", blocks.alias("n"))).alias("blocks"), F.sum("n").alias("n_rows")).filter(F.exists("blocks", lambda b: b.open))
    placed = join_group_value(banded, layout, ["family"], "n_rows")
    mine = F.filter("blocks", lambda b: (b.band == F.col("band")) & (b.open == F.col("open")))[0].n
    placed = placed.withColumn("me", F.struct("band", "open", F.pmod(F.xxhash64("id", F.lit(7)), mine.cast("long")).cast("int").alias("salt")))
    near = F.filter("blocks", lambda b: (F.abs(b.band - F.col("band")) <= 1) & (b.open | F.col("open")))
    partners = F.flatten(F.transform(near, lambda b: F.transform(F.sequence(F.lit(0), b.n - 1), lambda k: F.struct(b.band.alias("band"), b.open.alias("open"), k.alias("salt")))))
    tiles = F.transform(partners, lambda p: F.struct(F.least(p, F.col("me")).alias("i"), F.greatest(p, F.col("me")).alias("j"), (p == F.col("me")).alias("one"), (p < F.col("me")).alias("side")))
    placed = placed.select("family", "id", "payload", "open", "distance", F.explode(tiles).alias("tile"))
    placed = placed.select("id", "payload", "open", "distance", F.concat_ws("/", "family", F.to_json("tile.i"), F.to_json("tile.j")).alias("tile"), F.col("tile.one").alias("one"), F.col("tile.side").cast("int").alias("side"))

    def tile(table: pa.Table) -> pa.Table:
        table = table.sort_by([("id", "ascending")])
        sides = None if table.column("one")[0].as_py() else np.asarray(table.column("side"))
        shut = ~table.column("open").to_numpy(zero_copy_only=False).astype(bool)
        return _edges(linker(np.asarray(table.column("id")), table.column("payload").to_pylist(), sides, shut, np.asarray(table.column("distance"))))

    return star.unionByName(spread(placed, "tile").groupBy("tile").applyInArrow(tile, EDGES))
