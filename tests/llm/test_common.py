import random

import pytest
from pyspark.sql import functions as F

from pathloom.llm import common


def plain_components(edges):
    label = {}

    def find(x):
        while label.setdefault(x, x) != x:
            x = label[x]
        return x

    for u, v in edges:
        a, b = sorted((find(u), find(v)))
        label[b] = a
    return {x: find(x) for e in edges if e[0] != e[1] for x in e}


def graphs():
    rng = random.Random(5)
    yield [(0, k) for k in range(1, 200)] + [(900, 900 + k) for k in range(1, 50)] + [(-5, 40)]  # hubs
    yield [(1000 + k, 1001 + k) for k in range(100)] + [(2099, 2000 + k) for k in range(99)]  # a chain, and a hub at its end
    yield [(rng.randrange(150), rng.randrange(150)) for _ in range(100)] + [(7, 7), (1, 1)]


@pytest.mark.parametrize("chunk,heavy", [(1 << 20, 256), (40, 16)])
def test_components(spark, chunk, heavy):
    for edges in graphs():
        df = spark.createDataFrame(edges, "u long, v long")
        got = {r.node: r.component for r in common.components(df, chunk, heavy).collect()}
        assert got == plain_components(edges)
    assert common.components(spark.createDataFrame([], "u long, v long")).collect() == []


@pytest.mark.parametrize("how", ["inner", "left", "left_semi"])
def test_spread_join(spark, how):
    rows = spark.createDataFrame([(k % 5 if k < 400 else k, k) for k in range(450)] + [(None, -1)], "key long, y long")
    table = spark.createDataFrame([(k, str(k)) for k in range(0, 500, 2)], "key long, t string")
    got = common.spread_join(rows, table, "key", "y", how, heavy=30)
    assert sorted(map(str, got.collect())) == sorted(map(str, rows.join(table, "key", how).select(*got.columns).collect()))
    many = common.heavy_keys(rows, "key", 30).collect()
    assert {r.key for r in many} == set(range(5)) and all(r._copies == 3 for r in many)


def test_scratch_removes_tables(spark):
    with common.scratch(spark):
        held = common.saved(spark.range(5), "x")
        place = held.inputFiles()[0].removeprefix("file://")
        assert held.count() == 5 and open(place, "rb")
    with pytest.raises(FileNotFoundError):
        open(place, "rb")


def test_saved_after_shuffles_can_be_read_again(spark):
    rows = spark.range(1000).select((F.col("id") % 7).alias("k"))
    held = common.saved(rows.groupBy("k").count(), "x")
    assert held.count() == 7 and sorted(r["count"] for r in held.collect()) == sorted(r["count"] for r in rows.groupBy("k").count().collect())
