"""Rate limiting of a stream with state in the state store: value state that ends by itself, timers, and a first state from a table.

The rules are those of wordloom.streaming.ratelimit; this form needs the RocksDB state store. A key's entry lives in a value
state with a time to live, a restart from the checkpoint finds it again, and `entries` reads it from outside.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from wordloom.streaming.ratelimit import Limits, Outcomes, counted

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
ENTRY = "count long, banned boolean, start double, until double, last double"
#: A first state: one row for each key.
FIRST = f"key string, {ENTRY}"
OUTPUT = "key string, at timestamp, outcome string, wait double"


class Limiter(StatefulProcessor):
    """Judges the requests of a key, and tells when a ban has ended without another request."""

    def __init__(self, limits: Limits, idle: float, tell_end: bool):
        self.limits, self.idle, self.tell_end = limits, idle, tell_end

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.entry = handle.getValueState("entry", ENTRY, ttlDurationMs=int(self.idle * 1000))

    def handleInitialState(self, key, initialState, timerValues) -> None:
        row = initialState.iloc[0]
        self.entry.update((int(row["count"]), bool(row["banned"]), float(row["start"]), float(row["until"]), float(row["last"])))
        self.watch(row["banned"], timerValues)

    def watch(self, banned: bool, timerValues) -> None:
        """One timer at most: the clock's time at which the present ban is over, counted from now, as requests may be older than the clock."""
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if banned and self.tell_end:
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + int((self.limits.ban + 1) * 1000))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        *held, last = self.entry.get() if self.entry.exists() else (-math.inf,)
        us = np.sort(np.concatenate([f["us"].to_numpy() for f in rows]))
        # A late request is judged as if it came with the last one of its key.
        judged = np.maximum(us, us[0] if math.isinf(last) else round(last * 1e6))
        outcomes, waits, entry = Outcomes(self.limits).fold(judged, tuple(held) or None)
        self.entry.update((int(entry[0]), bool(entry[1]), float(entry[2]), float(entry[3]), float(judged[-1] / 1e6)))
        self.watch(entry[1], timerValues)
        yield pd.DataFrame({"key": key[0], "at": pd.to_datetime(us, unit="us"), "outcome": outcomes, "wait": waits})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.entry.exists() and (entry := self.entry.get())[1]:
            yield pd.DataFrame({"key": [key[0]], "at": pd.to_datetime([round(entry[3] * 1e6)], unit="us"), "outcome": ["ended"], "wait": [0.0]})
            self.entry.clear()

    def close(self) -> None:
        pass


def limit_with_state(requests: DataFrame, key: str, at: str, text: str | None = None, limits: Limits = Limits(), idle: float = 3600.0,
                     first: DataFrame | None = None, tell_end: bool = False) -> DataFrame:
    """(key, at, outcome, wait) of each request of a stream, as rate_limit gives them.

    No request is lost: there is no watermark, and a late one is judged with the last of its key. An entry ends `idle` seconds of the clock after
    its key's last request, which has to exceed the interval and the ban. `first` (FIRST) holds entries from before, of each
    key one. With `tell_end`, a row (outcome "ended", at: the ban's end) tells that a ban is over, once the clock has passed it
    without a request. A task holds the times of one key in a micro-batch. Set spark.sql.streaming.stateStore.providerClass to PROVIDER;
    a query that is to end when its input does needs spark.sql.streaming.noDataMicroBatches.enabled to be false as well.
    """
    if idle <= max(limits.interval, limits.ban):
        raise ValueError(f"idle has to exceed the interval and the ban: {idle} s, {limits}")
    kept = counted(requests, key, at, text).select(F.col(key).cast("string").alias("key"), F.unix_micros(F.col(at).cast("timestamp")).alias("us"))
    return kept.groupBy("key").transformWithStateInPandas(
        Limiter(limits, idle, tell_end), OUTPUT, outputMode="Append", timeMode="ProcessingTime", initialState=None if first is None else first.groupBy("key"))


def entries(spark: SparkSession, checkpoint: str) -> DataFrame:
    """(key, count, banned, start, until, last) as a query's checkpoint holds them now; a table for `first`."""
    state = spark.read.format("statestore").option("stateVarName", "entry").load(checkpoint)
    value = F.col("value.value") if "value" in state.select("value.*").columns else F.col("value")
    return state.select(F.col("key.key").alias("key"), *[value[c.split()[0]].alias(c.split()[0]) for c in ENTRY.split(", ")])
