from __future__ import annotations

from pyspark.sql import functions as F

from framelake.llm.families import spread


def test_groups_of_few_bytes_still_go_to_several_tasks(spark):
    """Adaptive execution would read all of these in one task."""
    rows = spark.range(4000).withColumn("g", F.col("id") % 64)
    grouped = spread(rows, "g").groupBy("g").applyInArrow(lambda t: t.select(["g"]).slice(0, 1), "g long")
    tasks = grouped.select(F.spark_partition_id().alias("task"), "g").collect()
    assert sorted(r.g for r in tasks) == list(range(64)) and len({r.task for r in tasks}) > 4
