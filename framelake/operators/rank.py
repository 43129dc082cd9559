"""Global row numbers without a single task for all rows."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framelake.sources.scratch import materialise


def global_rank(df: DataFrame, order: list[str], name: str = "rank") -> tuple[DataFrame, int]:
    """df with gapless row numbers from 0 in the given order, and the number of rows.

    A range sort deals the rows out; each row's number is its place in its partition plus the sizes of the partitions
    before, which are counted on the written result (one number a partition reaches the driver).
    """
    placed = materialise(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), name)
    placed = placed.withColumns({"_part": F.shiftright("_at", 33), "_place": F.col("_at").bitwiseAND((1 << 33) - 1)})
    counts = sorted(placed.groupBy("_part").count().collect())
    starts = list(accumulate((r["count"] for r in counts), initial=0))
    offsets = df.sparkSession.createDataFrame(list(zip([r["_part"] for r in counts], starts, strict=False)), "_part long, _offset long")
    return placed.join(F.broadcast(offsets), "_part").withColumn(name, F.col("_place") + F.col("_offset")).drop("_at", "_part", "_place", "_offset"), starts[-1]


def rows_before(values: DataFrame, value: str, count: str, name: str) -> tuple[DataFrame, int]:
    """Distinct values with the sum of `count` over all smaller ones, and the sum of all. Values are dealt by range; the sums
    of the ranges (one number a partition) reach the driver."""
    placed = materialise(values.repartitionByRange(value).withColumn("_part", F.spark_partition_id()), name)
    sums = sorted(placed.groupBy("_part").agg(F.sum(count).alias("n")).collect())
    starts = list(accumulate((r["n"] for r in sums), initial=0))
    offsets = values.sparkSession.createDataFrame(list(zip([r["_part"] for r in sums], starts, strict=False)), "_part int, _offset long")
    inside = F.sum(count).over(Window.partitionBy("_part").orderBy(value).rowsBetween(Window.unboundedPreceding, -1))
    return placed.withColumn(name, F.coalesce(inside, F.lit(0))).join(F.broadcast(offsets), "_part").withColumn(name, F.col(name) + F.col("_offset")).drop("_part", "_offset"), starts[-1]
