import random

import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import components as brute_components
from wordloom.llm.common import components, gapless_rank, pair_blocks


@pytest.mark.parametrize("seed", [1, 2])
def test_components_match_union_find(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)]
    edges += [(1000 + i, 1001 + i) for i in range(60)] + [(2000, 2001 + i) for i in range(200)]  # a chain and a hub
    found = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    linked = {n for a, b in edges if a != b for n in (a, b)}
    assert found == {n: c for n, c in brute_components({n for e in edges for n in e}, edges).items() if n in linked}


def test_components_of_nothing(spark):
    assert components(spark.createDataFrame([(1, 1), (None, 2)], "a long, b long"), "a", "b").count() == 0


def test_ranks_are_gapless(spark):
    rows = spark.range(1000).select(F.col("id"), (F.col("id") % 7 == 0).alias("g"), (F.col("id") % 3).alias("tie"))
    for _, ranks in rows_by(gapless_rank(rows, ["g"], ["tie", "id"], "r", 16), "g", "r").items():
        assert sorted(ranks) == list(range(len(ranks)))


def rows_by(df, key, value):
    out = {}
    for r in df.collect():
        out.setdefault(r[key], []).append(r[value])
    return out


def test_pairs_meet_in_one_block(spark):
    rows = spark.range(300).select(F.col("id").alias("u"), F.when(F.col("id") < 200, 1).otherwise(F.col("id")).alias("k"))
    blocks = {}
    for r in pair_blocks(rows, ["k"], "u", 20).collect():
        blocks.setdefault((r["k"], r["lo"], r["hi"]), []).append((r["u"], r["part"]))
    met = {}
    for (_, lo, hi), members in blocks.items():
        for u, p in members:
            for v, q in members:
                if u < v and (lo == hi or p != q):
                    met[u, v] = met.get((u, v), 0) + 1
    assert met == {(u, v): 1 for u in range(200) for v in range(u + 1, 200)}
    assert max(map(len, blocks.values())) < 80
