"""Near-duplicate embeddings by Euclidean p-stable hashing, then exact cosines in double precision."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordloom.llm.common import components, cut, pair_blocks
from wordloom.llm.simhash import Forest, tiles, whole_groups

#: Rows compared as one tile, and rows of a bucket that one task may compare.
TILE, CAP = 1024, 2048
#: Width of a quantisation cell, for vectors of length 1.
WIDTH = 2.0


def same_cell(distance: float, width: float = WIDTH) -> float:
    """Probability that a random projection puts two vectors at this distance into one cell."""
    r = width / distance
    return math.erf(r / math.sqrt(2)) - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


def table_plan(rows: int, threshold: float, recall: float = 0.97, bucket: int = 256) -> tuple[int, int]:
    """(projections per table, tables): unrelated vectors share buckets of about `bucket` rows; pairs just at the threshold are found with probability `recall`."""
    near, far = same_cell(math.sqrt(2 - 2 * threshold)), same_cell(math.sqrt(2))
    k = max(1, math.ceil(math.log(max(rows, bucket + 1) / bucket) / -math.log(far)))
    return k, math.ceil(math.log(1 - recall) / math.log(1 - near**k))


def unit_rows(vectors: np.ndarray) -> np.ndarray:
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


@lru_cache(maxsize=8)
def projections(dim: int, k: int, tables: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Directions, shifts of the cells, and the factors that mix a table's cells to a key; made once in a worker."""
    rng = np.random.default_rng([seed, dim])
    return rng.standard_normal((dim, tables * k)), rng.uniform(0, WIDTH, tables * k), rng.integers(1, 2**62, size=(tables, k)) | 1


def bucket_keys(unit: np.ndarray, k: int, tables: int, seed: int) -> np.ndarray:
    """(rows, tables) of 32-bit keys, mixed from the k cells of each table."""
    directions, shifts, odd = projections(unit.shape[1], k, tables, seed)
    cells = np.floor((unit @ directions + shifts) / WIDTH).astype(np.int64).reshape(len(unit), tables, k)
    mixed = (cells * odd).sum(axis=2)  # wraps around
    return ((mixed ^ (mixed >> 29)) * np.int64(0x5851F42D4C957F2D) >> 32).astype(np.int32)


def coded(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of length 1 as whole numbers of eight bits, and for each row its step and the length of what rounding lost, rounded up."""
    step = np.maximum(np.abs(unit).max(axis=1), 1e-300) / 127
    code = np.rint(unit / step[:, None]).astype(np.int8)
    lost = np.linalg.norm(unit - code * step[:, None], axis=1) * (1 + 1e-9) + 1e-12
    return code, np.stack([step, lost], axis=1)


def keyed(classes: DataFrame, k: int, tables: int, seed: int) -> DataFrame:
    """(_rep, dim, _code, _step, _lost, sig): vectors in eight bits a number, and their bucket keys in all tables."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for rows, flat, dim in by_dimension(b.column(1)):
                unit = unit_rows(flat)
                keys, (code, scale) = bucket_keys(unit, k, tables, seed), coded(unit)
                sig = pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1, dtype=np.int32) * tables), pa.array(keys.ravel()))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array(rows)), pa.array(np.full(len(rows), dim, np.int32)), pa.array([x.tobytes() for x in code], pa.binary()),
                     pa.array(scale[:, 0].astype(np.float32)), pa.array(np.nextafter(scale[:, 1].astype(np.float32), np.float32(9))), sig],
                    ["_rep", "dim", "_code", "_step", "_lost", "sig"])

    return classes.select("_rep", "_v").mapInArrow(run, "_rep long, dim int, _code binary, _step float, _lost float, sig array<int>")


def by_dimension(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(row numbers, their vectors as doubles, dimension) for each dimension in the column."""
    sizes = np.diff(column.offsets.to_numpy()) if len(column) else np.empty(0, np.int64)
    for dim in np.unique(sizes):
        rows = np.flatnonzero(sizes == dim)
        picked = column.take(pa.array(rows))
        yield rows, picked.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(rows), dim), int(dim)


def exact_links(va: np.ndarray, vb: np.ndarray, threshold: float) -> np.ndarray:
    """Which pairs have cosine >= threshold; pairs within rounding of it are computed one by one."""
    cosine = va @ vb.T
    links = cosine >= threshold
    for i, j in zip(*np.nonzero(np.abs(cosine - threshold) < 1e-12), strict=True):
        links[i, j] = math.fsum(va[i] * vb[j]) / math.sqrt(math.fsum(va[i] ** 2) * math.fsum(vb[j] ** 2)) >= threshold
    return links


def rows_of(table: pa.Table, column: str, kind: type, s: int, e: int) -> np.ndarray:
    """Rows s to e of a column of equally long byte strings, as a matrix."""
    return np.frombuffer(b"".join(table.column(column).slice(s, e - s).to_pylist()), kind).reshape(e - s, -1)


def tiles_of(table: pa.Table, bounds: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, bool]]:
    """(first row, end, two tiles, whether they are one) of each block of two or more rows, such that each pair of a bucket meets once."""
    lo, hi, part = (table.column(c).to_numpy() for c in ("lo", "hi", "part"))
    for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if e - s > 1:
            at = np.arange(s, e)
            left, right = (at[part[at] == lo[s]], at[part[at] == hi[s]]) if lo[s] != hi[s] else (at, at[:0])
            for a, b, same in tiles(left, right, TILE):
                yield s, e, a, b, same


def near_rows(blocks: DataFrame, threshold: float) -> DataFrame:
    """(t, key, _rep) of vectors that have another one in their bucket which they may link with, by the eight-bit numbers and a bound on what these lost."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, bounds in whole_groups(batches, 5):
            table = table.combine_chunks()
            step, lost = (table.column(c).to_numpy().astype(np.float64) for c in ("_step", "_lost"))
            found, at, unit = np.zeros(len(table), bool), -1, None
            for s, e, a, b, same in tiles_of(table, bounds):
                if s != at:
                    at, unit = s, rows_of(table, "_code", np.int8, s, e).astype(np.float32) * step[s:e, None].astype(np.float32)
                    slack = 1e-5 + 2e-7 * unit.shape[1]
                # |u.v - u'v'| <= |u - u'| + |v - v'| (1 + |u - u'|), besides rounding in single precision, the slack.
                near = unit[a - s] @ unit[b - s].T >= threshold - slack - lost[a][:, None] - (lost[b] * (1 + lost[a].max()))[None, :]
                if same:
                    np.fill_diagonal(near, False)
                found[a] |= near.any(axis=1)
                found[b] |= near.any(axis=0)
            rows = pa.array(np.flatnonzero(found))
            yield pa.RecordBatch.from_arrays([table.column(c).combine_chunks().take(rows) for c in ("t", "key", "_rep")], ["t", "key", "_rep"])

    order = ["dim", "t", "key", "lo", "hi"]
    return (blocks.select(*order, "part", "_rep", "_code", "_step", "_lost").repartition(*order).sortWithinPartitions(*order)
            .mapInArrow(run, "t int, key int, _rep long"))


def block_results(blocks: DataFrame, threshold: float, k: int, tables: int, seed: int) -> DataFrame:
    """kind 0: a forest's edge (a, b). kind 1: class a has b more linked vectors.

    A pair that shares several tables is counted in the first of them only; keys in the others are made again here, for vectors with links.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, bounds in whole_groups(batches, 5):
            table = table.combine_chunks()
            t, reps, n = (table.column(c).to_numpy() for c in ("t", "_rep", "_n"))
            vectors, forest, found = table.column("_v").combine_chunks(), Forest(len(table)), np.zeros(len(table), np.int64)
            at, unit = -1, None
            for s, e, a, b, same in tiles_of(table, bounds):
                if s != at:
                    at, unit = s, unit_rows(vectors.slice(s, e - s).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(e - s, -1))
                    sig = None
                links = exact_links(unit[a - s], unit[b - s], threshold)
                if same:
                    links &= ~np.tri(len(a), dtype=bool)
                i, j = np.nonzero(links)
                if len(i):
                    forest.join(a[i], b[j])
                    x, y = a[i], b[j]
                    sig = bucket_keys(unit, k, tables, seed)[:, :t[s]] if sig is None else sig
                    first = np.ones(len(i), dtype=bool)
                    for before in range(sig.shape[1]):
                        first &= sig[x - s, before] != sig[y - s, before]
                    np.add.at(found, x[first], n[y[first]])
                    np.add.at(found, y[first], n[x[first]])
            roots, own = forest.roots(), np.arange(len(table))
            child, some = np.flatnonzero(roots != own), np.flatnonzero(found)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat([0, 1], [len(child), len(some)]).astype(np.int32)), pa.array(np.concatenate([reps[child], reps[some]])),
                 pa.array(np.concatenate([reps[roots[child]], found[some]]))], ["kind", "a", "b"])

    order = ["dim", "t", "key", "lo", "hi"]
    return (blocks.select(*order, "part", "_rep", "_n", "_v").repartition(*order).sortWithinPartitions(*order)
            .mapInArrow(run, "kind int, a long, b long"))


def cosine_groups(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.9,
                  recall: float = 0.97, seed: int = 7) -> DataFrame:
    """One row per input row: id, n_links (other vectors linked directly), component_id, kept.

    Equal vectors form a class that is hashed and compared once; its copies link with each other.
    Vectors that are null, empty, zero or hold null or non-finite components link with nothing, nor do
    vectors of different dimensions with each other. Ids are integers; rows that repeat an id are one node:
    their component is one, each row's n_links are those of its own vector, with rows of the same id counted.
    A row with a null id links with nothing and has a null component. Columns other than the two named are not
    read. An empty table gives an empty result. Links of cosine just at the threshold are found with
    probability `recall`, closer ones with a higher one; every link found is checked exactly.

    Vectors are exchanged for all tables in eight bits a number; only those that may link with another one in
    a bucket are exchanged as they are, for that bucket.
    """
    ident, v = F.col("_id"), F.col("_v")
    rows = vectors.select(F.col(id_col).cast("long").alias("_id"), F.col(vector_col).alias("_v"))
    fit = (ident.isNotNull() & v.isNotNull() & F.exists(v, lambda x: x != 0)
           & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    # What links with nothing is spread by its id in the join below.
    rows = rows.withColumn("_h", F.when(fit, F.xxhash64(v)).otherwise(F.xxhash64("_id"))).withColumn("_v", F.when(fit, v))
    classes = cut(rows.where("_v is not null").groupBy("_v", "_h").agg(F.count(F.lit(1)).alias("_n"), F.min("_id").alias("_least"))
                  .withColumn("_rep", F.monotonically_increasing_id()))  # numbers of classes, fixed as they are kept
    k, tables = table_plan(classes.count(), threshold, recall)
    codes = keyed(classes, k, tables, seed).select("*", F.posexplode("sig").alias("t", "key")).drop("sig")
    near = cut(near_rows(pair_blocks(codes, ["dim", "t", "key"], "_rep", CAP), threshold).distinct())
    exact = near.join(classes.select("_rep", "_n", "_v"), "_rep").withColumn("dim", F.size("_v"))
    results = cut(block_results(pair_blocks(exact, ["dim", "t", "key"], "_rep", CAP), threshold, k, tables, seed))
    edges = results.where("kind = 0").select("a", "b")
    # An id with several vectors is one node, so it links their classes.
    several = cut(rows.where("_v is not null").groupBy("_id").agg(F.min("_h").alias("_a"), F.max("_h").alias("_b")).where("_a <> _b").select("_id"))
    if not several.isEmpty():
        of_class = rows.join(several, "_id").join(classes.select("_h", "_v", "_rep"), ["_h", "_v"]).select("_id", "_rep")
        edges = edges.unionByName(of_class.join(of_class.groupBy("_id").agg(F.min("_rep").alias("a")), "_id").select("a", F.col("_rep").alias("b")))
    joined = components(edges, "a", "b")
    least = joined.join(classes, F.col("node") == F.col("_rep")).groupBy("component").agg(F.min("_least").alias("_component"))
    reached = joined.join(least, "component").select(F.col("node").alias("_rep"), "_component")
    degree = results.where("kind = 1").groupBy(F.col("a").alias("_rep")).agg(F.sum("b").alias("_links"))
    label = (classes.join(reached, "_rep", "left").join(degree, "_rep", "left")
             .select("_h", "_v", F.coalesce("_component", "_least").alias("_component"), (F.coalesce("_links", F.lit(0)) + F.col("_n") - 1).alias("_links")))
    return (rows.join(label, ["_h", "_v"], "left")
            .select(F.col("_id").alias(id_col), F.coalesce("_links", F.lit(0)).cast("long").alias("n_links"),
                    F.coalesce("_component", "_id").alias("component_id"))
            .withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(False))))
