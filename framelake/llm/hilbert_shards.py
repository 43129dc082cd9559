"""Operator 5: shards as runs of a Hilbert curve over quantised metadata, for pruning files in several dimensions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framelake.operators.rank import global_rank, rows_before
from framelake.operators.skew import join_group_value
from framelake.sources.scratch import materialise

SHARDS = 16
#: Bits of each dimension on the curve.
BITS = 5


def hilbert_index(cells: list[np.ndarray], bits: int) -> np.ndarray:
    """Position on the Hilbert curve of points with `bits`-bit coordinates (Skilling's transpose method)."""
    x = [np.array(c, np.int64) for c in cells]
    n, q = len(x), 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            high = (x[i] & q) != 0
            t = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(high, x[0] ^ p, x[0] ^ t)
            x[i] = x[i] ^ t if i else x[0]
        q >>= 1
    for i in range(1, n):
        x[i] = x[i] ^ x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[n - 1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    x = [c ^ t for c in x]
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for c in x:
            out = (out << 1) | ((c >> b) & 1)
    return out


def _key(name: str, kind: T.DataType) -> Column:
    """An order-keeping value without nulls for a dimension: nulls come first."""
    if isinstance(kind, T.StringType):
        return F.concat(F.when(F.col(name).isNull(), "0").otherwise("1"), F.coalesce(F.col(name), F.lit("")))
    return F.coalesce(F.col(name).cast("double"), F.lit(float("-inf")))


def hilbert_keys(docs: DataFrame, dimensions: list[str], bits: int = BITS) -> DataFrame:
    """docs with `curve`, the Hilbert index of its cell. Each dimension is cut at exact quantiles: a value's cell is the
    share of all rows with smaller values. Values are counted, sorted by range and joined back; frequent ones by broadcast."""
    keyed = materialise(docs.withColumns({f"_d{k}": _key(c, docs.schema[c].dataType) for k, c in enumerate(dimensions)}), "dimensions")
    for k in range(len(dimensions)):
        values, total = rows_before(keyed.groupBy(f"_d{k}").agg(F.count("*").alias("_n")), f"_d{k}", "_n", "_before")
        cells = values.select(f"_d{k}", "_n", F.expr(f"cast(_before * {1 << bits}L div {max(total, 1)}L as int)").alias(f"_c{k}"))
        keyed = join_group_value(keyed, cells, [f"_d{k}"], "_n", total).drop(f"_d{k}", "_n")

    @F.pandas_udf("long")
    def curve(*cells: pd.Series) -> pd.Series:
        return pd.Series(hilbert_index([c.to_numpy(np.int64) for c in cells], bits))

    cells = [f"_c{k}" for k in range(len(dimensions))]
    return materialise(keyed.withColumn("curve", curve(*cells) if cells else F.lit(0)).drop(*cells), "curve")


def hilbert_shards(docs: DataFrame, shards: int = SHARDS, dimensions: tuple[str, ...] = ("lang", "source", "n_bytes"), bits: int = BITS) -> DataFrame:
    """Cut all rows, sorted along the curve, into `shards` runs of row counts at most one apart.

    Reads doc_id, text and the metadata columns among `dimensions` (n_bytes is the text's length in UTF-8); others are
    ignored, and dimensions that docs doesn't have are left out. Nulls in metadata sort first; a null text has no
    bytes; ties on the curve are ordered by doc_id, then by checksum and size, so equal texts of equal metadata stay
    close. Returns doc_id, size (bytes + 1), text_crc32, curve, shard and slot (gapless from 0 in each shard). Only these
    small rows are sorted, not the texts. An empty table gives no rows.
    """
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    slim = docs.select("doc_id", *[c for c in docs.columns if c in dimensions and c != "n_bytes"], F.octet_length(text).cast("long").alias("n_bytes"), F.crc32(text).alias("text_crc32"))
    keyed = hilbert_keys(slim, [c for c in dimensions if c in slim.columns], bits)
    ordered = keyed.select("doc_id", (F.col("n_bytes") + 1).alias("size"), "text_crc32", "curve")
    ranked, total = global_rank(ordered, ["curve", "doc_id", "text_crc32", "size"])
    shard = F.expr(f"(rank * {shards}L) div {max(total, 1)}L")
    first = F.expr(f"(shard * {total}L + {shards - 1}L) div {shards}L")
    return ranked.withColumn("shard", shard.cast("int")).withColumn("slot", F.col("rank") - first).select("doc_id", "size", "text_crc32", "curve", "shard", "slot")
