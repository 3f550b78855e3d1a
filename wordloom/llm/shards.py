"""Sharding by histogram sort: probe key boundaries, count exact bytes below them, exchange once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordloom.llm.common import cut, fresh, gapless_rank

#: Keys have 63 bits: 39 of the text's hash, then 24 of the id's hash, so that equal texts are
#: neighbours and a large group of equal texts can still be cut inside.
KEY_BITS, GROUP_BITS = 63, 24
FANOUT = 1024


def sort_key(text: Column, ident: Column) -> Column:
    group = F.shiftleft(F.shiftrightunsigned(F.xxhash64(text), 64 - KEY_BITS + GROUP_BITS), GROUP_BITS)
    return group.bitwiseOR(F.xxhash64(ident).bitwiseAND(F.lit(2**GROUP_BITS - 1)))


def find_splitters(keyed: DataFrame, shards: int, tolerance: float) -> list[int]:
    """Key boundaries between shards, each within tolerance of its share of bytes where rows allow it.

    keyed has key and size. A round counts the bytes of FANOUT equal parts of each open interval (at
    most shards - 1 intervals, so what reaches the driver is bounded); the part that holds the target
    is opened next. Boundaries fall between groups of equal texts unless no such one is near enough.
    """
    total = keyed.agg(F.sum("size")).first()[0] or 0
    targets = [total * i / shards for i in range(1, shards)]
    allowed = tolerance * total / shards
    found: dict[int, int] = {}
    open_at = {i: (0, 2**KEY_BITS, 0) for i in range(len(targets))}  # splitter: low key, high key, bytes below low
    while open_at:
        intervals = sorted({(lo, hi) for lo, hi, _ in open_at.values()})
        steps = {}
        which, part = F.lit(None).cast("int"), F.lit(None).cast("long")
        for k, (lo, hi) in enumerate(intervals):
            step = -(-(hi - lo) // FANOUT)
            if hi - lo > 2**GROUP_BITS:
                step = -(-step // 2**GROUP_BITS) * 2**GROUP_BITS
            steps[lo, hi] = step
            inside = F.col("key").between(F.lit(lo), F.lit(hi - 1))
            which = F.when(inside, F.lit(k)).otherwise(which)
            part = F.when(inside, F.expr(f"(key - {lo}L) div {step}L")).otherwise(part)
        counted = (keyed.select(which.alias("k"), part.alias("p"), "size").where("k is not null")
                   .groupBy("k", "p").agg(F.sum("size").alias("bytes")).collect())
        bytes_of: dict[int, dict[int, int]] = {}
        for k, p, b in counted:
            bytes_of.setdefault(k, {})[p] = b
        for i, (lo, hi, below) in list(open_at.items()):
            step, parts = steps[lo, hi], bytes_of.get(intervals.index((lo, hi)), {})
            edge, left, right = lo, below, below
            for p in range(-(-(hi - lo) // step)):
                left, right, edge = right, right + parts.get(p, 0), lo + p * step
                if right >= targets[i]:
                    break
            end = min(edge + step, hi)
            gap, at = min((abs(left - targets[i]), edge), (abs(right - targets[i]), end))
            if gap <= allowed or step == 1:
                found[i] = at
                del open_at[i]
            else:
                open_at[i] = (edge, end, left)
    return [found[i] for i in sorted(found)]


def shard_of(key: Column, splitters: list[int]) -> Column:
    out = F.lit(len(splitters))
    for i in range(len(splitters) - 1, -1, -1):
        out = F.when(key < F.lit(splitters[i]), F.lit(i)).otherwise(out)
    return out.cast("int")


def measured(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(_id, size, text_crc32, key) of each row, kept."""
    text = F.coalesce(docs[text_col], F.lit(""))
    return cut(docs.select(docs[id_col].alias("_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"),
                           sort_key(text, docs[id_col]).alias("key")))


def shard_by_bytes(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text", tolerance: float = 0.005) -> DataFrame:
    """Deal all rows to shards of nearly equal bytes; equal texts are neighbours and stay together where that is near enough.

    Returns id, size (UTF-8 bytes plus 1), text_crc32, shard, and slot, gapless from 0 in each shard. A null
    text has size 1 and the checksum of no bytes, 0; a very long one is one row like any other, and its shard
    may exceed its share by it. A null id is an id like any other. Rows that repeat id and text have one key
    and go to one shard, however many they are. Columns other than the two named are not read. An empty table
    gives an empty result.
    """
    narrow = measured(docs, id_col, text_col)
    splitters = find_splitters(narrow, shards, tolerance)
    buckets = 16 + narrow.count() // (shards * 50_000)
    ranked = gapless_rank(narrow.withColumn("shard", shard_of(F.col("key"), splitters)), ["shard"], ["key", "_id", "text_crc32"], "slot", buckets)
    return ranked.select(F.col("_id").alias(id_col), "size", "text_crc32", "shard", "slot")


def write_shards(docs: DataFrame, path: str, shards: int = 16, id_col: str = "doc_id", text_col: str = "text", tolerance: float = 0.005) -> str:
    """Write docs as Parquet, one folder for each shard, after one exchange by shard and a part of it.

    Rows go to the shards that shard_by_bytes gives them, with the same rules for nulls, long texts and repeated
    rows. All columns are kept; the column of the folders' names is `shard`, with underscores in front where
    docs has that name, and is returned. An empty table gives no folder.
    """
    splitters = find_splitters(measured(docs, id_col, text_col), shards, tolerance)
    shard, part = fresh("shard", docs), fresh("_wl_part", docs)
    text, parts = F.coalesce(docs[text_col], F.lit("")), 1 + docs.count() // (shards * 200_000)
    dealt = docs.withColumns({shard: shard_of(sort_key(text, docs[id_col]), splitters), part: F.pmod(F.xxhash64(text, docs[id_col]), F.lit(parts))})
    dealt.repartition(shard, part).drop(part).write.partitionBy(shard).parquet(path)
    return shard
