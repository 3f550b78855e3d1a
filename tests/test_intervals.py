"""Joins by time against loops over both tables."""

import random

from pyspark.sql import functions as F

from wordloom.operators import intervals


def test_covering_intervals(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice(["a", "b", "c", None]), rng.choice([None, *range(-50, 300)])) for i in range(400)]
    spans = [(n, rng.choice(["a", "b", None]), s, s + rng.choice([-3, 0, 1, 7, 40, 250])) for n in range(120) for s in [rng.randrange(-60, 300)]] + [(999, "a", None, 5)]
    want = sorted((i, n) for i, k, t in rows for n, k2, s, e in spans if None not in (k, t, s) and k == k2 and s <= t < e)
    left, right = spark.createDataFrame(rows, "i int, k string, t long"), spark.createDataFrame(spans, "n int, k string, s long, e long")
    for width in (1, 10, 1_000):
        found = intervals.covering(left, "t", right, "s", "e", ["k"], width)
        assert sorted((r["i"], r["n"]) for r in found.collect()) == want and set(found.columns) == {"i", "k", "t", "n", "s", "e"}
    plan = intervals.covering(left, "t", right, "s", "e", ["k"], 10)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert intervals.covering(left.limit(0), "t", right, "s", "e", ["k"], 10).count() == 0


def test_versions_valid_at_a_time(spark):
    """One key has most rows and lies in several ranges; versions at the same time, before all, after all, and of no row."""
    rng = random.Random(2)
    rows = [(i, "hot" if i % 3 else rng.choice(["a", "b", "no", None]), rng.choice([None, *range(500)])) for i in range(3_000)]
    versions = [(rng.choice(["hot", "a", "b", "alone"]), rng.randrange(100, 600), n) for n in range(60)] + [("hot", 250, -1), ("hot", 250, 1_000), ("a", None, 5)]

    def latest(k, t):
        own = [(s, n) for k2, s, n in versions if None not in (t, s) and k == k2 and s <= t]
        return max(own, default=(None, None))

    left, right = spark.createDataFrame(rows, "i int, k string, t long"), spark.createDataFrame(versions, "k string, s long, n int")
    found = intervals.valid_at(left, "t", right, "s", ["k"])
    assert {r["i"]: (r["s"], r["n"]) for r in found.collect()} == {i: latest(k, t) for i, k, t in rows} and found.columns == ["i", "k", "t", "s", "n"]
    assert found.count() == len(rows)
    assert intervals.valid_at(left.limit(0), "t", right, "s", ["k"]).count() == 0
    assert intervals.valid_at(left, "t", right.limit(0), "s", ["k"]).where(F.col("s").isNull()).count() == len(rows)
