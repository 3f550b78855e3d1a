"""Counts of the n-grams that a cut by running mass can reach, without an exchange of all the others.

Most n-grams are rare, and no cut keeps them. A first reading counts n-grams by a number of 32 bits, in numpy within each task; what tasks
exchange is sorted numbers with their counts, packed to some two bytes each. N-grams with one number are counted together, so that a number's
count is never too low, and an n-gram whose number is too rare is too rare itself. A second reading counts the others exactly.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType
from pyspark.sql.window import Window

from wordloom.functions.tokens import words_in
from wordloom.operators.counts import CUT_PERCENTS, following, mass_threshold, places
from wordloom.operators.scoring import most_weights
from wordloom.sources.scratch import keep

#: N-grams that one task gathers before it packs them, and at most so many of all in one range of numbers, by which they are summed: 32 MB each.
AT_ONCE = 1 << 22
#: By so much more than the mass that the cut keeps is counted exactly, since n-grams of one number make it look larger than it is.
MARGIN = 1.01


def packed(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted keys as differences, with their counts, byte by byte of all, as high ones are mostly zero."""
    both = np.stack([np.diff(keys, prepend=np.int64(0)), counts]).astype("<i8")
    return zlib.compress(both.view(np.uint8).reshape(-1, 8).T.tobytes(), 1)


def unpacked(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    flat = np.frombuffer(zlib.decompress(blob), np.uint8)
    flat = flat.reshape(8, len(flat) // 8).T.copy().view("<i8").reshape(2, len(flat) // 16)
    return np.cumsum(flat[0]), flat[1]


def numbered(docs: DataFrame, key: str, text: str, classes: list) -> DataFrame:
    """(class, _class, _words) of joined texts; _class is the place of the class among all."""
    schema = StructType([docs.schema[key], StructField("_class", IntegerType(), False)])
    table = docs.sparkSession.createDataFrame([(c, i) for i, c in enumerate(classes)], schema)
    return docs.select(key, F.col(text).alias("_text")).join(F.broadcast(table), key).select(key, "_class", words_in(F.col("_text")).alias("_words"))


def number(n: int, n_max: int, groups: int) -> Column:
    """The number of the n-gram at a place, which tells class and n, from 0 to groups - 1, by its rest; null beyond the end."""
    words = [F.col("word"), *following(n)]
    return F.when(words[-1].isNotNull(), F.hash(*words).cast("long") * groups + F.col("_class") * n_max + (n - 1))


def numbers_counted(docs: DataFrame, n_max: int, groups: int, grams: int) -> DataFrame:
    """(_group, cnt, _k, _packed), stored: how many numbers of a group have a count, and the packed numbers that occur twice or more. `grams` are all n-grams."""
    ranges = math.ceil(grams / AT_ONCE)
    bounds = np.array([(-(1 << 31) + (i << 32) // ranges) * groups for i in range(1, ranges)], np.int64)
    most = AT_ONCE

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, size = [], 0

        def out() -> pa.RecordBatch:
            keys, counts = np.unique(np.concatenate(found), return_counts=True)
            cuts = [0, *np.searchsorted(keys, bounds), len(keys)]
            rows = [(i, packed(keys[a:b], counts[a:b])) for i, (a, b) in enumerate(zip(cuts, cuts[1:])) if b > a]
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=["_range", "_packed"])

        for batch in batches:
            for column in batch.columns:
                found.append(column.drop_null().to_numpy())
                size += len(found[-1])
            if size >= most:
                yield out()
                found, size = [], 0
        if size:
            yield out()

    def add_up(rows: pd.DataFrame) -> pd.DataFrame:
        parts = [unpacked(b) for b in rows["_packed"]]
        keys, counts = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
        firsts = np.flatnonzero(np.diff(keys, prepend=keys[0] - 1))
        keys, counts = keys[firsts], np.add.reduceat(counts, firsts)
        told, k = np.unique(counts * groups + np.mod(keys, groups), return_counts=True)
        told = pd.DataFrame({"_group": told % groups, "cnt": told // groups, "_k": k, "_packed": None})
        often = counts > 1
        return pd.concat([told, pd.DataFrame({"_group": [-1], "cnt": [0], "_k": [0], "_packed": [packed(keys[often], counts[often])]})])

    columns = [number(n, n_max, groups).alias(f"_{n}") for n in range(1, n_max + 1)]
    gathered = places(docs).select(*columns).mapInArrow(gather, "_range int, _packed binary")
    return keep(gathered.groupBy("_range").applyInPandas(add_up, "_group long, cnt long, _k long, _packed binary"))


def levels_of(counted: DataFrame, limits: Column) -> dict[int, int]:
    """By group, the count down to which n-grams are to be counted exactly; 1 if all are."""
    downwards = Window.partitionBy("_group").orderBy(F.desc("cnt")).rowsBetween(Window.unboundedPreceding, 0)
    histogram = counted.where(F.col("_packed").isNull()).groupBy("_group", "cnt").agg(F.sum(F.col("_k") * F.col("cnt")).alias("_mass"))
    total = F.sum("_mass").over(Window.partitionBy("_group"))
    enough = histogram.select("_group", "cnt", (F.sum("_mass").over(downwards) >= F.least(mass_threshold(total, limits) * MARGIN, total.cast("double"))).alias("_enough"))
    found = enough.where("_enough").groupBy("_group").agg(F.max("cnt").alias("_level")).collect()  # one row for each class and n
    return {r["_group"]: r["_level"] for r in found}


def numbers_from(counted: DataFrame, levels: dict[int, int], groups: int) -> DataFrame:
    """(_number): the numbers that occur as often as their group's level says; none of groups with a level of 1, which are counted whole."""
    least = np.full(groups, np.iinfo(np.int64).max)
    for group, level in levels.items():
        least[group] = level if level > 1 else least[group]

    def often(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob in batch.column(0).to_pylist():
                keys, counts = unpacked(blob)
                yield pa.RecordBatch.from_arrays([pa.array(keys[counts >= least[np.mod(keys, groups)]])], names=["_number"])

    return counted.where(F.col("_packed").isNotNull()).select("_packed").mapInArrow(often, "_number long")


def exact_counts(docs: DataFrame, key: str, n_max: int, groups: int, numbers: DataFrame, levels: dict[int, int]) -> DataFrame:
    """(class, n, term, cnt) of the n-grams with these numbers, and of all in groups with a level of 1, as far as they reach the level of their group."""
    numbers_at = F.array(*[number(n, n_max, groups) for n in range(1, n_max + 1)])
    words = ["word", *[w.alias(f"_w{i}") for i, w in enumerate(following(n_max), 2)]]
    rows = places(docs).select(key, *words, numbers_at.alias("_numbers"))
    rows = rows.select(key, *words[:1], *[f"_w{i}" for i in range(2, n_max + 1)], F.posexplode_outer("_numbers").alias("_more", "_at")).where(F.col("_at").isNotNull())
    term = F.col("word")
    for i in range(2, n_max + 1):  # made of what is counted only
        term = F.when(F.col("_more") < i - 1, term).otherwise(F.concat("word", *[x for j in range(2, i + 1) for x in (F.lit(" "), F.col(f"_w{j}"))]))
    whole = F.pmod("_at", F.lit(groups)).isin([g for g, level in levels.items() if level == 1])
    met = rows.join(F.broadcast(numbers), F.col("_at") == F.col("_number"), "left").where(F.col("_number").isNotNull() | whole)
    counts = met.groupBy(key, term.alias("term"), F.pmod("_at", F.lit(groups)).alias("_group")).agg(F.count(F.lit(1)).alias("cnt"))
    schema = StructType([StructField("_group", LongType()), StructField("_level", LongType())])
    table = docs.sparkSession.createDataFrame(list(levels.items()), schema)
    return (counts.join(F.broadcast(table), "_group").where(F.col("cnt") >= F.col("_level"))
            .select(key, (F.col("_group") % n_max + 1).cast("int").alias("n"), "term", "cnt"))


def frequent_counts(docs: DataFrame, key: str, classes: list, totals: dict[tuple, int], text: str, n_max: int, cut: str) -> Iterator[tuple[DataFrame, DataFrame]]:
    """Counts of the n-grams of joined texts that a cut reaches, stored, and (key, n, cnt, _k), the mass of what is left out, as that many n-grams that occur once.

    If the cut turns out to reach what is left out (counts.cut_by_mass tells), the next ones have more; the last have all. There are none if more numbers than can be broadcast are frequent.
    """
    docs, groups = numbered(docs, key, text, classes), len(classes) * n_max
    counted = numbers_counted(docs, n_max, groups, sum(totals.values()))
    percents = F.element_at(F.array(*[F.lit(float(p)) for p in CUT_PERCENTS[cut]]), (F.col("_group") % n_max + 1).cast("int"))
    levels = levels_of(counted, percents)
    schema = StructType([docs.schema[key], StructField("n", IntegerType()), StructField("cnt", LongType()), StructField("_k", LongType())])
    while True:
        numbers = keep(numbers_from(counted, levels, groups))
        if numbers.count() > most_weights(docs.sparkSession):
            return
        rest = keep(exact_counts(docs, key, n_max, groups, numbers, levels))
        sums = {(r[0], r[1]): r[2] for r in rest.groupBy(key, "n").agg(F.sum("cnt")).collect()}
        left = [(*group, 1, total - sums.get(group, 0)) for group, total in totals.items() if total > sums.get(group, 0)]
        yield rest, docs.sparkSession.createDataFrame(left, schema)
        levels = {g: level // 2 or 1 for g, level in levels.items()}
