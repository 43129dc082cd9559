"""First-come leaders of points in the plane: in the order of their ids, a point leads unless a leader stands within the
radius of it.

That order is a chain, but a short-sighted one: a tile that also sees the points around it can decide all of its points
but those that hang on something out of sight. So tiles are scanned at the same time, each in the order of ids; what stays
open goes to a next round of tiles twice as wide. No pairs are made: a point meets leaders alone, of which a cell as wide
as the radius holds a handful however many points it has. A tile with too many points scans its first ones; the rest
are held against the leaders found, which leaves few.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framelake.operators.skew import join_group_value
from framelake.sources.scratch import drop, materialise

#: Width of the first round's tiles, and of what they see around them, in radii.
TILE, HALO = 32, 3
#: Points that a tile scans at a time, about.
SCAN_ROWS = 8192
OPEN, LEADER, COVERED = 0, 1, 2


def scan(x: np.ndarray, y: np.ndarray, sees_all: np.ndarray, radius: float) -> np.ndarray:
    """Statuses of points in the order of their ids. A point that doesn't see everything within the radius, or that an open
    one may cover, stays open unless a leader covers it."""
    side = radius if radius > 0 else 1e-6
    leads: dict[tuple[int, int], list[tuple[float, float]]] = {}
    boxes: dict[tuple[int, int], list[float]] = {}
    out = np.zeros(len(x), np.int32)
    for k, (a, b, whole) in enumerate(zip(x.tolist(), y.tolist(), sees_all.tolist(), strict=True)):
        i, j = math.floor(a / side), math.floor(b / side)
        around = [(i + u, j + v) for u in (0, -1, 1) for v in (0, -1, 1)]
        if any(math.sqrt((a - p) * (a - p) + (b - q) * (b - q)) <= radius for c in around for p, q in leads.get(c, ())):
            out[k] = COVERED
        elif whole and not any(max(box[0] - a, a - box[1], 0.0) ** 2 + max(box[2] - b, b - box[3], 0.0) ** 2 <= radius * radius * (1 + 1e-9) for c in around if (box := boxes.get(c))):
            out[k] = LEADER
        if out[k] == LEADER:
            leads.setdefault((i, j), []).append((a, b))
        elif out[k] == OPEN:
            box = boxes.setdefault((i, j), [a, a, b, b])
            boxes[i, j] = [min(box[0], a), max(box[1], a), min(box[2], b), max(box[3], b)]
    return out


def _side() -> Column:
    return F.when(F.col("r") > 0, F.col("r")).otherwise(F.lit(1e-6))


def _in_tiles(points: DataFrame, tile: int) -> DataFrame:
    """Points in every tile that sees them: own, whether it is the tile's own, and sees_all, whether the tile sees all within
    the radius of it."""
    side, halo = _side() * tile, _side() * HALO
    at = lambda c, shift: F.floor((F.col(c) + shift) / side).cast("long")
    over = points.withColumn("gx", F.explode(F.sequence(at("cx", -halo), at("cx", halo)))).withColumn("gy", F.explode(F.sequence(at("cy", -halo), at("cy", halo))))
    inside = lambda c, g: (F.col(c) - F.col("r") > F.col(g) * side - halo) & (F.col(c) + F.col("r") < (F.col(g) + 1) * side + halo)
    own = (F.col("gx") == at("cx", F.lit(0.0))) & (F.col("gy") == at("cy", F.lit(0.0)))
    return over.withColumns({"own": own, "sees_all": inside("cx", "gx") & inside("cy", "gy")})


def _first_rows(tiled: DataFrame, scan_rows: int) -> tuple[DataFrame, bool]:
    """Rows with `due`: they are among their tile's first `scan_rows`, about; and whether any isn't."""
    key = ["video_id", "gx", "gy"]
    halves = [2.0**-k for k in range(30)]
    size = tiled.groupBy(*key).agg(F.count("*").alias("n"), F.percentile_approx("id", halves, 10_000).alias("cuts"))
    size = materialise(size.withColumn("last", F.when(F.col("n") > scan_rows, F.col("cuts")[F.least(F.lit(29), F.ceil(F.log2(F.col("n") / scan_rows)).cast("int"))])).drop("cuts"), "tiles")
    if size.filter("last is not null").isEmpty():
        return tiled.withColumn("due", F.lit(True)), False
    return join_group_value(tiled, size, key, "n").withColumn("due", F.col("last").isNull() | (F.col("id") <= F.col("last"))).drop("n", "last"), True


def leaders(points: DataFrame, tile: int = TILE, scan_rows: int = SCAN_ROWS) -> DataFrame:
    """points (video_id, id, cx, cy, r) -> (video_id, id, cx, cy, r) of the leaders, r the radius of the point's video. Each
    round decides at least each video's first open point, and all that sees far enough; tiles double until they see all."""
    fields = [points.schema[c] for c in ("video_id", "id", "cx", "cy", "r")]
    out = T.StructType([*fields, T.StructField("status", T.IntegerType())])
    names = [f.name for f in fields]

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("id", "ascending")])
        col = lambda c: table.column(c).to_numpy(zero_copy_only=False)
        status = scan(col("cx"), col("cy"), col("sees_all").astype(bool), float(col("r")[0]))
        return table.append_column("status", pa.array(status)).filter(pa.array(col("own").astype(bool))).select([*names, "status"])

    left, found = materialise(points.select(*names), "points"), []
    while True:
        tiled, late = _first_rows(_in_tiles(left, tile), scan_rows)
        due = tiled.filter("due").groupBy("video_id", "gx", "gy").applyInArrow(run, out)
        seen = materialise(due.filter(F.col("status") != COVERED), "scanned")
        found.append(seen.filter(F.col("status") == LEADER).select(*names))
        open_ = seen.filter(F.col("status") == OPEN).select(*names)
        if late:
            open_ = open_.unionByName(tiled.filter("own and not due").select(*names))
        # A leader's smaller neighbours are all covered, so a leader near an open point is the smaller of the two.
        rest = materialise(_near(open_, found[-1]).filter(~F.exists("near", lambda p: p.dist <= F.col("r"))).select(*names), "points") if late or not open_.isEmpty() else open_
        drop(left)
        left, tile = rest, 2 * tile
        if rest.isEmpty():
            return reduce(DataFrame.unionByName, found)


def _near(points: DataFrame, lead: DataFrame) -> DataFrame:
    """Points with the leaders of the nine cells around them as `near` (id, dist); a cell holds few leaders, so no pairs are
    made. AQE splits a cell with very many points."""
    cell = lambda c: F.floor(F.col(c) / _side()).cast("long")
    step = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    spread = lead.withColumns({"kx": cell("cx"), "ky": cell("cy")}).withColumn("s", F.explode(step))
    cells = spread.groupBy("video_id", (F.col("kx") + F.col("s.i")).alias("kx"), (F.col("ky") + F.col("s.j")).alias("ky")).agg(F.collect_list(F.struct("id", "cx", "cy")).alias("held"))
    met = points.withColumns({"kx": cell("cx"), "ky": cell("cy")}).join(cells, ["video_id", "kx", "ky"], "left")
    dist = lambda p: F.sqrt(F.pow(F.col("cx") - p.cx, 2) + F.pow(F.col("cy") - p.cy, 2))
    near = F.transform(F.coalesce("held", F.array().cast(dict(cells.dtypes)["held"])), lambda p: F.struct(dist(p).alias("dist"), p.id.alias("id")))
    return met.withColumn("near", near).drop("held", "kx", "ky")


def members(points: DataFrame, lead: DataFrame, nearest: bool) -> DataFrame:
    """(video_id, id, leader): each point's nearest leader within the radius (ties to the smaller id; distances are equal if
    they are so to 9 decimals), or the smallest one; points without any are left out."""
    within = F.filter("near", lambda p: p.dist <= F.col("r"))
    pick = F.array_min(F.transform(within, lambda p: F.struct(F.round(p.dist, 9).alias("dist"), p.id.alias("id"))))["id"] if nearest else F.array_min(F.transform(within, lambda p: p.id))
    return _near(points, lead).select("video_id", "id", pick.alias("leader")).filter("leader is not null")
