import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import joins


def plain(left, right):
    out = []
    for i, k, t in left:
        seen = [(u, v) for j, u, v in right if j == k and u is not None and t is not None and u <= t]
        out.append((i, k, t, max(seen)[1] if seen else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("bucket", [None, lambda t: F.floor(t / 10), lambda t: F.lit(1)])
def test_as_of_is_the_plain_search(spark, bucket):
    rng = random.Random(4)
    time = lambda: None if rng.random() < 0.05 else rng.randint(-50, 50)
    left = [(i, rng.choice([1, 1, 1, 2, 3]), time()) for i in range(300)]
    right = [(rng.choice([1, 1, 2, 4]), time(), rng.randint(0, 9)) for _ in range(60)]
    a = spark.createDataFrame(left, "i int, k int, t int")
    b = spark.createDataFrame(right, "k int, t int, v int")
    got = joins.as_of(a, b, ["k"], "t", ["v"], bucket).collect()
    assert sorted(map(tuple, got), key=str) == plain(left, right)
    assert [r.v for r in joins.as_of(a, b.limit(0), ["k"], "t", ["v"], bucket).collect()] == [None] * 300
    assert joins.as_of(a.limit(0), b, ["k"], "t", ["v"], bucket).count() == 0


def held(points, ranges):
    return sorted((i, p, j, a, b) for i, p in points for j, a, b in ranges if None not in (p, a, b) and a <= p <= b)


@pytest.mark.parametrize("cells", [{}, {"CELL_PAIRS": 9, "TASK_PAIRS": 90}, {"CELL_ROWS": 2}])
def test_in_range_is_the_plain_search(spark, monkeypatch, cells):
    for name, n in cells.items():
        monkeypatch.setattr(joins, name, n)
    rng = random.Random(5)
    at = lambda: None if rng.random() < 0.05 else rng.choice([0.0, 5.0, 10.0, rng.uniform(-20, 20)])
    points = [(i, at()) for i in range(150)] + [(7, 5.0)] * 12
    ranges = [(j, at(), at()) for j in range(60)] + [(3, 0.0, 10.0)] * 5
    a, b = spark.createDataFrame(points, "i int, p double"), spark.createDataFrame(ranges, "j int, a double, b double")
    assert sorted(map(tuple, joins.in_range(a, b, "p", "a", "b", 5.0).collect())) == held(points, ranges)
    assert joins.in_range(a, b.limit(0), "p", "a", "b", 5.0).count() == 0
    assert joins.in_range(a.limit(0), b, "p", "a", "b", 5.0).count() == 0


def test_in_range_deals_the_pairs_of_one_bucket_to_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(joins, "CELL_PAIRS", 1 << 8, raising=False)
    monkeypatch.setattr(joins, "TASK_PAIRS", 1 << 12, raising=False)
    points = spark.range(1000).select("id", (F.col("id") % 7).cast("double").alias("p"), F.create_map("id", "id").alias("more"))
    ranges = spark.range(100).select(F.col("id").alias("r"), F.lit(0.0).alias("a"), F.lit(9.0).alias("b"))
    got = joins.in_range(points, ranges, "p", "a", "b", 50.0).groupBy(F.spark_partition_id()).agg(F.count("*").alias("n"), F.countDistinct("id", "r").alias("d")).collect()
    assert sum(x.n for x in got) == sum(x.d for x in got) == 100_000
    assert max(x.n for x in got) <= 3 << 12
