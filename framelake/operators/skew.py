"""Joins that a few very frequent keys don't slow down."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key with more than this share of the rows is hot; so there are at most SHARE hot keys, a proven broadcast bound.
SHARE = 200


def join_group_value(rows: DataFrame, stats: DataFrame, keys: list[str], count: str, total: int | None = None) -> DataFrame:
    """Inner join of rows with per-key values (one row a key, `count` rows of each key). Hot keys' values are broadcast,
    so that a key that holds a third of all rows never lands in one task; all other keys are joined by shuffle."""
    if total is None:
        total = stats.agg(F.sum(count)).first()[0] or 0
    hot = F.col(count) * SHARE >= F.lit(max(total, 1))
    frequent = stats.filter(hot)
    values = [c for c in stats.columns if c not in rows.columns or c in keys]
    common = rows.join(F.broadcast(frequent.select(*values)), keys)
    rare = rows.join(F.broadcast(frequent.select(*keys)), keys, "left_anti").join(stats.filter(~hot).select(*values), keys)
    return common.unionByName(rare)
