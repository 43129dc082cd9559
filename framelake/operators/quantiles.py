"""Exact quantiles of groups of any length: a sketch finds a narrow range of values around each, and only what lies in that range
is counted and ordered."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framelake.sources.scratch import materialise


def _same(a: DataFrame, b: DataFrame, n: int):
    return reduce(lambda x, y: x & y, [a[f"_k{i}"].eqNullSafe(b[f"_g{i}"]) for i in range(n)])


def exact_quantiles(rows: DataFrame, key: list[str], value: str, shares: list[float], accuracy: int = 1000) -> DataFrame:
    """(key, n, q): for each key the count of its values and their quantiles, an array in the order of shares; the same doubles
    as percentile(), which keeps a map of all distinct values of a group.

    A mergeable sketch of about `accuracy` samples a group gives values three times its rank error below and above each
    quantile. Rows of one value within these bounds are counted together before any shuffle; what is below counts as one. So
    of a group of n rows about 6 n / accuracy distinct values are ordered, and no task holds a group. A group whose rank
    the bounds miss is ordered whole. Null values don't count; a key with no others isn't returned; a null in the key is a
    group of its own.
    """
    n, off = len(key), 3 / accuracy
    v = rows.filter(F.col(value).isNotNull()).select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(key)], F.col(value).cast("double").alias("_v"))
    keys = [f"_k{i}" for i in range(n)]
    low, high = [max(p - off, 0.0) for p in shares], [min(p + off, 1.0) for p in shares]
    about = v.groupBy(*keys).agg(F.count("*").alias("_n"), F.min("_v").alias("_min"), F.max("_v").alias("_max"), F.percentile_approx("_v", low + high, accuracy).alias("_at"))

    def span(j: int):
        at = F.col("_n").cast("double") - 1
        return F.struct(
            F.lit(j).alias("j"),
            (F.col("_min") if low[j] == 0 else F.col("_at")[j]).alias("low"),
            (F.col("_max") if high[j] == 1 else F.col("_at")[len(shares) + j]).alias("high"),
            (at * F.lit(float(shares[j]))).alias("at"),
        )

    spans = materialise(about.select(*[F.col(k).alias(k.replace("_k", "_g")) for k in keys], "_n", F.array(*[span(j) for j in range(len(shares))]).alias("_spans")), "spans")
    near = v.join(spans, _same(v, spans, n)).select(*keys, "_n", "_v", F.explode("_spans").alias("s")).filter(F.col("_v") <= F.col("s.high"))
    cell = F.when(F.col("_v") >= F.col("s.low"), F.col("_v"))
    counts = near.groupBy(*keys, "_n", "s.j", "s.at", cell.alias("_cell")).agg(F.count("*").alias("_c"))
    upto = counts.withColumn("_upto", F.sum("_c").over(Window.partitionBy(*keys, "j").orderBy(F.col("_cell").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)))
    first = lambda rank: F.min(F.when(F.col("_upto") > rank, F.struct("_upto", "_cell")))["_cell"]
    found = materialise(upto.groupBy(*keys, "_n", "j", "at").agg(first(F.floor("at")).alias("a"), first(F.ceil("at")).alias("b")), "quantiles")
    between = (F.ceil("at") - F.col("at")) * F.col("a") + (F.col("at") - F.floor("at")) * F.col("b")
    value_at = F.when(F.col("a") == F.col("b"), F.col("a")).otherwise(between)
    each = found.groupBy(*keys, "_n").agg(F.sort_array(F.collect_list(F.struct("j", value_at.alias("q")))).alias("_q"))
    sure = each.filter((F.size("_q") == len(shares)) & ~F.exists("_q", lambda x: x["q"].isNull()))
    missed = spans.drop("_spans", "_n").join(sure.select(*keys), _same(sure, spans, n), "left_anti")
    whole = v.join(missed, _same(v, missed, n), "left_semi").groupBy(*keys).agg(F.count("*").alias("n"), F.percentile("_v", list(shares)).alias("q"))
    both = sure.select(*keys, F.col("_n").alias("n"), F.transform("_q", lambda x: x["q"]).alias("q")).unionByName(whole)
    return both.select(*[F.col(k).alias(name) for k, name in zip(keys, key, strict=True)], "n", "q")
