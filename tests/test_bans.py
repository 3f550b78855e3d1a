"""Rate limiting with state in the state store, against rules in plain Python."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from tests.test_models import plain_outcomes
from wordloom.streaming import bans
from wordloom.streaming.ratelimit import Limits


@pytest.fixture
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", bans.PROVIDER)
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")  # else a query with the clock's timers never runs out of batches
    yield spark
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")


def add(spark, folder, times):
    spark.createDataFrame([(k, round(t * 1e6)) for k, t in times], "k string, us long").select("k", F.timestamp_micros("us").alias("t")).coalesce(1).write.mode("append").parquet(folder)


def run(spark, folder, **more):
    stream = spark.readStream.schema("k string, t timestamp").parquet(f"{folder}/in")
    (bans.limit_with_state(stream, "k", "t", **more).writeStream.format("parquet").option("checkpointLocation", f"{folder}/state")
     .trigger(availableNow=True).start(f"{folder}/out").awaitTermination())
    return spark.read.parquet(f"{folder}/out").select("key", F.unix_micros("at").alias("us"), "outcome", "wait").collect()


def test_a_restart_loses_no_ban(rocks, tmp_path):
    """Three runs from one checkpoint, with late requests in the last: outcomes go on where the run before has ended."""
    own: dict[str, list[float]] = {"a": [], "b": []}
    judged: dict[str, list[float]] = {"a": [], "b": []}
    parts = [[("a", t) for t in (100.0, 100.5, 101.0, 101.5)] + [("b", 100.0)], [("a", 150.0), ("b", 103.0), ("b", 104.0), ("b", 105.0)], [("a", 90.0), ("a", 700.0), ("b", 225.5), (None, 1.0)]]
    for part in parts:
        add(rocks, f"{tmp_path}/in", part)
        got = run(rocks, tmp_path)
        for key in own:
            for t in sorted(t for k, t in part if k == key):
                own[key].append(t)
                judged[key].append(max([t, *judged[key][-1:]]))
        want = Counter((k, round(t * 1e6), *o) for k in own for t, o in zip(own[k], plain_outcomes(judged[k], Limits()), strict=True))
        assert Counter(map(tuple, got)) == want
    assert {"banned", "admitted", "waited"} == {k[2] for k in want}
    held = {r["key"]: r for r in bans.entries(rocks, f"{tmp_path}/state").collect()}
    assert set(held) == {"a", "b"} and held["a"]["last"] == 700.0 and not held["a"]["banned"]


def test_first_state_and_end_of_a_ban(rocks, tmp_path):
    """A ban from a table holds, and its end is told once by the clock."""
    first = rocks.createDataFrame([("a", 3, True, 1_000.0, 1_121.0, 1_000.0), ("c", 1, False, 1_000.0, 1_010.0, 1_000.0)], bans.FIRST)
    add(rocks, f"{tmp_path}/in", [("a", 1_001.0), ("c", 1_002.0), ("d", 1_003.0)])
    got = run(rocks, tmp_path, first=first)
    assert {r["key"]: r["outcome"] for r in got} == {"a": "banned", "c": "admitted", "d": "admitted"}
    assert {r["key"]: r["count"] for r in bans.entries(rocks, f"{tmp_path}/state").collect()} == {"a": 3, "c": 2, "d": 1}
    with pytest.raises(ValueError, match="idle"):
        bans.limit_with_state(first.select("key", F.col("start").alias("t")), "key", "t", idle=60.0)
