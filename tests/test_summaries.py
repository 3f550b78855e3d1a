"""Most frequent terms, totals over sets of keys, and sketches, against plain Python."""

import random
from collections import Counter, defaultdict
from itertools import product

import pytest
from pyspark.sql import functions as F

from wordloom.operators import summaries


@pytest.mark.parametrize("k", [1, 3, 40, 10_000])
def test_top_terms(spark, k, monkeypatch):
    """Ties at the last place, a group of one value, of fewer than k terms, a null group, null values; small and large numbers of groups."""
    rng = random.Random(k)
    rows = {(g, f"t{i}"): rng.choice([1, 1, 1, 2, 3, 9, 50]) for g in ("a", None) for i in range(200)}
    rows |= {("one", f"t{i}"): 7 for i in range(60)} | {("few", "x"): 2, ("few", "y"): None}
    want = set()
    for group in {g for g, _ in rows}:
        own = sorted(((t, c) for (g, t), c in rows.items() if g == group), key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))
        want |= {(group, t, c, i) for i, (t, c) in enumerate(own[:k], 1)}
    counted = spark.createDataFrame([(g, t, c) for (g, t), c in rows.items()], "g string, term string, cnt long")
    for most in (summaries.MOST_GROUPS, 0):
        monkeypatch.setattr(summaries, "MOST_GROUPS", most)
        found = summaries.top_terms(counted, ["g"], k)
        assert {tuple(r) for r in found.collect()} == want and found.count() == len(want)
    assert summaries.top_terms(counted.limit(0), ["g"], k).count() == 0


def test_top_terms_are_cut_before_they_are_exchanged(spark):
    counted = spark.createDataFrame([("a", f"t{i}", i) for i in range(1_000)], "g string, term string, cnt long")
    plan = summaries.top_terms(counted, ["g"], 5)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "BroadcastHashJoin" in plan


def test_totals_over_all_sets_of_keys(spark):
    """Null keys, null and empty texts; a null key and the sum over all keys are two rows."""
    rng = random.Random(5)
    docs = [(rng.choice(["a", "b", None]), rng.choice(["s", "t", None]), rng.choice([None, "", "one", "one two", "one two three four five"])) for _ in range(80)]
    want = defaultdict(lambda: [0, 0])
    for g, s, t in docs:
        size = len((t or "").split())
        for n, sets in product((1, 2), product((0, 1), repeat=3)):
            cell = want[None if sets[0] else g, None if sets[1] else s, None if sets[2] else n, sets[0] * 4 + sets[1] * 2 + sets[2]]
            cell[0] += 1
            cell[1] += max(0, size - n + 1)
    found = summaries.totals(spark.createDataFrame(docs, "g string, s string, text string"), ["g", "s"], n_max=2)
    assert {tuple(r)[:4]: list(r)[4:] for r in found.collect()} == want
    plan = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("Scan ExistingRDD") == 1


def test_sketches_of_terms(spark):
    """40,000 different terms with a few frequent ones, in 8 parts that are united: estimates within the stated bounds; empty input gives no rows."""
    rng = random.Random(6)
    terms = [(p, f"w{int(40_000 * rng.random() ** 4)}") for p in range(8) for _ in range(20_000)]
    true = Counter(t for _, t in terms)
    df = spark.createDataFrame(terms, "p int, term string").withColumn("g", F.lit("all"))
    parts = summaries.term_sketches(df, ["g", "p"])
    assert parts.count() == 8 and dict(parts.dtypes)["distinct"] == "binary"
    row = summaries.term_estimates(summaries.unite_terms(parts, ["g"]), ["g"], 10).collect()[0]
    assert abs(row["vocabulary"] - len(true)) <= len(true) * 4 * 0.83 / 2 ** (summaries.DISTINCT_BITS / 2)
    assert len(row["frequent"]) == 10 and all(true[f["item"]] <= f["count"] <= true[f["item"]] + len(terms) * 3.5 / 16_384 for f in row["frequent"])
    assert {f["item"] for f in row["frequent"][:3]} <= {t for t, _ in true.most_common(5)}
    assert summaries.unite_terms(summaries.term_sketches(df.limit(0), ["g", "p"]), ["g"]).count() == 0


def test_sketches_of_lengths(spark):
    rng = random.Random(7)
    sizes = [rng.choice([0, 3, rng.randrange(400)]) for _ in range(3_000)]
    docs = spark.createDataFrame([("g", i % 4, "ab " * n if n else rng.choice([None, ""])) for i, n in enumerate(sizes)], "g string, p int, text string")
    found = summaries.length_quantiles(summaries.unite_lengths(summaries.length_sketches(docs, ["g", "p"]), ["g"]), ["g"], [0.1, 0.5, 0.9]).collect()
    assert [r["share"] for r in found] == [0.1, 0.5, 0.9]
    for r in found:
        assert sum(n < r["words"] for n in sizes) / 3_000 <= r["share"] + 0.02 and sum(n <= r["words"] for n in sizes) / 3_000 >= r["share"] - 0.02
