from __future__ import annotations

import random

from framelake.operators.graph import connected_components
from framelake.operators.skew import join_group_value


def brute(edges):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        ra, rb = find(a), find(b)
        root[max(ra, rb)] = min(ra, rb)
    return {x: find(x) for x in root}


def test_components_of_random_graphs_chain_and_hub(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(120), rng.randrange(120)) for _ in range(90)]
    edges += [(1000 + k, 1001 + k) for k in range(60)]
    edges += [(2000, 2001 + k) for k in range(300)]
    edges += [(5000, 5000), (-5, -9)]
    df = spark.createDataFrame(edges + edges[:10], "a long, b long")
    assert {r.id: r.component for r in connected_components(df).collect()} == brute(edges)


def test_components_of_nothing_and_nulls(spark):
    assert connected_components(spark.createDataFrame([(None, 1)], "a long, b long")).count() == 0


def test_group_values_reach_hot_and_cold_keys(spark):
    rows = spark.createDataFrame([(k % 7 if k % 3 else 99, k) for k in range(900)], "k long, v long")
    stats = rows.groupBy("k").count()
    got = join_group_value(rows, stats, ["k"], "count")
    assert got.count() == 900 and got.filter("k = 99 and count = 300").count() == 300


def test_components_in_several_parts_and_of_struct_ids(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(330)] + [(1000 + k, 1001 + k) for k in range(40)] + [(2000, 2001 + k) for k in range(200)]
    df = spark.createDataFrame(edges, "a long, b long")
    assert {r.id: r.component for r in connected_components(df, task_edges=50).collect()} == brute(edges)
    named = df.selectExpr("struct('v' as v, a as id) as a", "struct('v' as v, b as id) as b").limit(60)
    few = [(r.a.id, r.b.id) for r in named.collect()]
    assert {r.id.id: r.component.id for r in connected_components(spark.createDataFrame([((("v", a)), ("v", b)) for a, b in few], "a struct<v:string,id:long>, b struct<v:string,id:long>")).collect()} == brute(few)
