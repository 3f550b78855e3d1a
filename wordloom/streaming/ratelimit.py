"""Requests by key: a counting window from the first request on, and a ban that further requests renew."""

from __future__ import annotations

import math
import pickle
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import BinaryType, IntegerType, StructField, StructType
from pyspark.sql.window import Window

from wordloom.sources.scratch import in_parts

#: Fixed value: a remaining wait up to so many seconds is waited for instead of a ban.
GRACE = 3.0
#: Requests with this text are not counted.
EXEMPT = "_dummy_"
#: Rows that a step hands on at once.
ROWS = 100_000


@dataclass(frozen=True)
class Limits:
    interval: float = 10.0
    requests: int = 3
    ban: float = 120.0


#: (requests counted, banned, start of the window or ban, end of the entry); no entry: None.
Entry = tuple[int, bool, float, float]


def step(entry: Entry | None, now: float, limits: Limits) -> tuple[str, float, Entry | None]:
    """What becomes of a request at `now`: (admitted, waited or banned; seconds to wait; the key's next entry)."""
    if entry is not None and now >= entry[3]:
        entry = None
    if entry is None:
        return "admitted", 0.0, (1, False, now, now + limits.interval)
    count, banned, start, end = entry
    if not banned and count < limits.requests:
        return "admitted", 0.0, (count + 1, False, start, end)
    remaining = max(0.0, (limits.ban if banned else limits.interval) - (now - start) + (0.0 if banned else 1.0))
    if remaining > GRACE:
        return "banned", limits.ban, (count, True, now, now + limits.ban + 1)
    return "waited", max(1.0, remaining), (1, False, now + max(1.0, remaining), now + max(1.0, remaining) + limits.interval)


def counted(requests: DataFrame, key: str, at: str, text: str | None) -> DataFrame:
    """The requests that have a key and a time and are not exempt."""
    kept = requests.where(F.col(key).isNotNull() & F.col(at).isNotNull())
    return kept.where(F.coalesce(F.col(text), F.lit("")) != EXEMPT) if text else kept


def rate_limit(requests: DataFrame, key: str, at: str, text: str | None = None, limits: Limits = Limits(), idle: float = 3600.0) -> DataFrame:
    """(key, at, outcome, wait) of each request of a stream, in order of time within a micro-batch. Null keys and times are left out, nothing else is.

    A request that comes late, after later ones of its key in an earlier micro-batch, is judged as if it came with the
    last of these. The watermark is on the time of arrival, since one on `at` would drop it. A key's entry is forgotten
    after `idle` seconds of the clock without a request of it, which should exceed limits.interval and limits.ban by far where a stream runs behind its times.

    A ValueError is raised if `idle` does not exceed both, as bans would be forgotten.

    A task holds the times of one key in a micro-batch, eight bytes each: the source's options bound them. A table goes through request_outcomes.
    """
    if idle <= max(limits.interval, limits.ban):
        raise ValueError(f"idle has to exceed the interval and the ban: {idle} s, {limits}")
    kept = counted(requests, key, at, text).select(F.col(key).cast("string").alias("key"), F.col(at).cast("timestamp").alias("at"))
    kept = kept.withColumn("arrived", F.current_timestamp()).withWatermark("arrived", "1 second")  # of a micro-batch, so that no row is late

    def run(group: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        frames = list(frames)
        arrived = max(f["arrived"].max().timestamp() for f in frames)
        *held, last = state.get if state.exists else (-math.inf,)
        entry: Entry | None = tuple(held) or None
        times = np.sort(np.concatenate([f["at"].to_numpy() for f in frames]))
        for i in range(0, len(times), ROWS):
            rows = []
            for t in map(pd.Timestamp, times[i:i + ROWS]):
                last = max(last, t.timestamp())
                outcome, wait, entry = step(entry, last, limits)
                rows.append((group[0], t, outcome, wait))
            yield pd.DataFrame(rows, columns=["key", "at", "outcome", "wait"])
        if entry is not None:
            state.update((*entry, last))
            state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs(), int(arrived * 1000)) + 1 + int(idle * 1000))

    return kept.groupBy("key").applyInPandasWithState(
        run, "key string, at timestamp, outcome string, wait double", "count long, banned boolean, start double, until double, last double",
        "append", GroupStateTimeout.EventTimeTimeout)


def in_blocks(requests: DataFrame, key: Column, at: str) -> DataFrame:
    """(_block, _key, _us): requests in order, cut into ranges of key and time of about equal size, so that a key with many requests lies in many of them."""
    rows = requests.select(key.alias("_key"), F.unix_micros(F.col(at).cast("timestamp")).alias("_us"))
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.repartitionByRange(parts, "_key", "_us").sortWithinPartitions("_key", "_us")
    return in_parts(ranged.select(F.spark_partition_id().alias("_block"), "_key", "_us"))


def keys_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Array, np.ndarray]]:
    """(block, the key as an array of one, its times) of each key of a partition that is in order."""
    held: list[np.ndarray] = []
    last: pa.Array | None = None
    block = 0
    for b in batches:
        if not b.num_rows:
            continue
        keys, us, block = b.column(1), b.column(2).to_numpy(), b.column(0)[0].as_py()
        change = pc.not_equal(keys.slice(1), keys.slice(0, len(keys) - 1)).to_numpy(zero_copy_only=False)
        for s, e in pairwise([0, *(np.flatnonzero(change) + 1).tolist(), len(keys)]):
            if last is not None and keys[s] != last[0]:
                yield block, last, np.concatenate(held)
                held = []
            last = keys.slice(s, 1)
            held.append(us[s:e])
    if last is not None:
        yield block, last, np.concatenate(held)


class Windows:
    """Counting windows: one opens with the first request at or after the end of the one before. What a block begins with is the start of the window that may go on, or None."""

    def __init__(self, limits: Limits):
        self.span = round(limits.interval * 1_000_000)

    def summary(self, us: np.ndarray) -> bytes:
        """The times at which a window may open first in this block, all within one interval of its beginning, and for each the last window then opened.

        Each time points to the one that opens the next window; doubling the pointers leads all of them to the block's last window at once.
        """
        follow = np.searchsorted(us, us + self.span)
        points = np.where(follow < len(us), follow, np.arange(len(us)))
        while (further := points[points]).tobytes() != points.tobytes():
            points = further
        first = us[:np.searchsorted(us, us[0] + self.span) + 1]
        return np.concatenate([first, us[points[:len(first)]]]).tobytes()

    def after(self, opened: int | None, summary: bytes) -> int | None:
        """The last window that is open at the block's end."""
        first, last = np.frombuffer(summary, np.int64).reshape(2, -1)
        at = 0 if opened is None else int(np.searchsorted(first, opened + self.span))
        return opened if at == len(first) else int(last[at])

    def rows(self, us: np.ndarray, opened: int | None) -> tuple[np.ndarray, ...]:
        """(windows' starts, requests of this block in them)."""
        starts, counts = [], []
        at = 0
        if opened is not None and (at := int(np.searchsorted(us, opened + self.span))):
            starts, counts = [opened], [at]
        while at < len(us):
            follow = bisect_left(us, us[at] + self.span, at)
            starts.append(int(us[at]))
            counts.append(follow - at)
            at = follow
        return np.array(starts, np.int64), np.array(counts, np.int64)


class Outcomes:
    """What the limiter does with each request. What a block begins with is the key's entry, or None."""

    def __init__(self, limits: Limits):
        self.limits = limits
        #: After a rest of so many seconds every entry has ended.
        self.rest = max(limits.interval + GRACE, limits.ban + 1)

    def fold(self, us: np.ndarray, entry: Entry | None) -> tuple[np.ndarray, np.ndarray, Entry | None]:
        """(outcomes, waits, last entry). While a key is banned and its requests follow closely, each renews the ban: these are passed over at once."""
        t = us / 1e6
        outcomes, waits = np.full(len(t), "banned", object), np.full(len(t), self.limits.ban)
        ends = np.flatnonzero(~(self.limits.ban - np.diff(t) > GRACE)) + 1  # requests that may end a ban
        i = 0
        while i < len(t):
            outcomes[i], waits[i], entry = step(entry, float(t[i]), self.limits)
            i += 1
            if entry[1]:
                k = int(np.searchsorted(ends, i))
                far = int(ends[k]) if k < len(ends) else len(t)
                if far > i:
                    i, entry = far, (entry[0], True, float(t[far - 1]), float(t[far - 1]) + self.limits.ban + 1)
        return outcomes, waits, entry

    def summary(self, us: np.ndarray) -> bytes:
        """The times from the last rest in the block on, with a leading 1; without a rest all times, with a leading 0."""
        rests = np.flatnonzero(np.diff(us) > self.rest * 1e6 + 1000)
        return np.concatenate([[min(len(rests), 1)], us[rests[-1] + 1 if len(rests) else 0:]]).astype(np.int64).tobytes()

    def after(self, entry: Entry | None, summary: bytes) -> Entry | None:
        rested, *_ = us = np.frombuffer(summary, np.int64)
        return self.fold(us[1:], None if rested else entry)[2]

    def rows(self, us: np.ndarray, entry: Entry | None) -> tuple[np.ndarray, ...]:
        outcomes, waits, _ = self.fold(us, entry)
        return us, outcomes, waits


def folded(blocks: DataFrame, rule: Windows | Outcomes, columns: str) -> DataFrame:
    """(_key, columns): rule.rows of each key, in all blocks at once.

    Only a key that goes on from one block to the next needs what came before: its blocks' summaries are read one after
    the other, a block at a time, and tell what each block begins with. There are two such keys a block at most, so that the
    driver may hand these beginnings to all tasks.
    """
    key = blocks.schema["_key"]

    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, last = True, None
        for found in keys_of(batches):
            if first:
                first = False
                yield edge(found)
            else:
                last = found
        if last is not None:
            yield edge(last)

    def edge(found: tuple[int, pa.Array, np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([found[0]], pa.int32()), found[1], pa.array([rule.summary(found[2])], pa.binary())], ["_block", "_key", "_s"])

    def begins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = None, None
        for b in batches:
            states = []
            for k, s in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                state = state if k == last else None
                states.append(pickle.dumps(state))
                last, state = k, rule.after(state, s)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(states, pa.binary())], ["_block", "_key", "_state"])

    edge_type = StructType([StructField("_block", IntegerType()), key, StructField("_s", BinaryType())])
    begin_type = StructType([StructField("_block", IntegerType()), key, StructField("_state", BinaryType())])
    spans = Window.partitionBy("_key")
    summaries = blocks.mapInArrow(edges, edge_type).withColumn("_n", F.count(F.lit(1)).over(spans)).where("_n > 1").drop("_n")
    found = summaries.repartition("_key").sortWithinPartitions("_key", "_block").mapInArrow(begins, begin_type).collect()
    known = blocks.sparkSession.sparkContext.broadcast({(r["_block"], r["_key"]): pickle.loads(r["_state"]) for r in found})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, parts, n = [], [], 0
        for block, k, us in keys_of(batches):
            parts.append(rule.rows(us, known.value.get((block, k[0].as_py()))))
            keys.append(pa.concat_arrays([k]).take(pa.array(np.zeros(len(parts[-1][0]), np.int64))))
            n += len(keys[-1])
            if n >= ROWS:
                yield out(keys, parts)
                keys, parts, n = [], [], 0
        if parts:
            yield out(keys, parts)

    def out(keys: list[pa.Array], parts: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.concat_arrays(keys), *[pa.array(np.concatenate(c)) for c in zip(*parts, strict=True)]], ["_key", *names])

    names = [c.split()[0] for c in columns.split(", ")]
    schema = StructType([key, *blocks.sparkSession.createDataFrame([], columns).schema.fields])
    return blocks.mapInArrow(run, schema)


def request_outcomes(requests: DataFrame, key: str, at: str, text: str | None = None, limits: Limits = Limits()) -> DataFrame:
    """(key, at, outcome, wait) of each request of a table: what rate_limit gives if all come in one micro-batch.

    A key of any number of requests is dealt to all tasks by ranges of time; a task holds the times of one range.
    """
    rows = folded(in_blocks(counted(requests, key, at, text), F.col(key).cast("string"), at), Outcomes(limits), "_us long, outcome string, wait double")
    return rows.select(F.col("_key").alias("key"), F.timestamp_micros("_us").cast(requests.schema[at].dataType).alias("at"), "outcome", "wait")


def request_windows(requests: DataFrame, key: str, at: str, limits: Limits = Limits()) -> DataFrame:
    """(key, opened, requests): counting windows of a table of requests, without bans.

    A window opens with the first request after the one before has ended. A key of any number of requests is dealt to
    all tasks by ranges of time; what several ranges count of one window is added up.
    """
    parts = folded(in_blocks(counted(requests, key, at, None), F.col(key), at), Windows(limits), "_opened long, _n long")
    windows = parts.groupBy("_key", "_opened").agg(F.sum("_n").alias("_n"))
    return windows.select(F.col("_key").alias(key), F.timestamp_micros("_opened").cast(requests.schema[at].dataType).alias("opened"), F.col("_n").alias("requests"))
