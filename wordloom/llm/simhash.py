"""SimHash near-deduplication with bit-sliced Hamming comparison.

Fingerprints meet in buckets of masked bits: of radius + k bands at least k agree when at most
`radius` bits differ, so no link is missed. A bucket that is too large is dealt once more, by bands of
the bits that its mask leaves. Inside a block the bit planes are stored vertically and 64 distances are
updated at once by carry-save counters.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, pairwise

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordloom.llm.common import components, cut, rows_that_stay

#: Rows of one block of the comparison, and rows of a bucket beyond which it is dealt once more.
BLOCK, CAP = 512, 8192


def shingle_hashes(text: bytes, shingle: int) -> np.ndarray:
    """XXH64 (seed 42) of each run of `shingle` words; of all words if there are fewer."""
    words = text.lower().split()  # on bytes: A-Z only, and white space is \x20 \x09-\x0D
    if len(words) <= shingle:
        grams = [b" ".join(words)] if words else []
    else:
        grams = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))
    h = xxhash.xxh64_intdigest
    return np.array([h(g, 42) for g in grams], dtype=np.uint64)


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """64 bits; a bit is 1 if set in over half of the shingle hashes. Zero without words."""
    hashes = shingle_hashes(text, shingle)
    counts = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), 65_536):
        counts += np.unpackbits(hashes[i:i + 65_536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def text_hash(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(_id, _h, _fp): a hash of each whole text, and its fingerprint as a signed long; a null text counts as empty."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = [fingerprint(t or b"", shingle) for t in b.column(2).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.array(fps, dtype=np.uint64).view(np.int64))], ["_id", "_h", "_fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("_id"), text_hash(F.col(text_col)).alias("_h"), F.col(text_col).alias("_text"))
    return rows.mapInArrow(run, "_id long, _h long, _fp long")


def band_masks(radius: int, rows: int) -> list[int]:
    """Masks such that fingerprints within the radius agree under one at least; longer for more rows."""
    for k in range(1, 5):
        edges = [round(64 * i / (radius + k)) for i in range(radius + k + 1)]
        bands = [sum(1 << b for b in range(lo, hi)) for lo, hi in pairwise(edges)]
        masks = [sum(c) for c in combinations(bands, k)]
        if rows >> min(m.bit_count() for m in masks) <= 64:
            break
    return masks


def finer_masks(mask: int, radius: int) -> list[int]:
    """The mask with one band more of the bits that it leaves; fingerprints within the radius that agree under it agree under one of these."""
    free = [b for b in range(64) if not mask >> b & 1]
    edges = [round(len(free) * i / (radius + 1)) for i in range(radius + 2)]
    return [mask | sum(1 << b for b in free[lo:hi]) for lo, hi in pairwise(edges)]


def bit_planes(fps: np.ndarray) -> np.ndarray:
    """Row b holds bit b of all fingerprints, 64 to a word."""
    bits = np.unpackbits(fps.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").T
    bits = np.pad(bits, ((0, 0), (0, -len(fps) % 64)))
    return np.ascontiguousarray(np.packbits(bits, axis=1, bitorder="little")).view(np.uint64)


def within_radius(a: np.ndarray, b: np.ndarray, radius: int, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (i, j) with at most `radius` differing bits; with same, b is a and i < j."""
    planes, width = bit_planes(b), -(-len(b) // 64)
    asked = (np.uint64(0) - ((a[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1))).astype(np.uint64)
    skip = np.ones((len(a), width * 64), dtype=bool)
    skip[:, :len(b)] = np.tri(len(a), len(b), dtype=bool) if same else False
    over = np.ascontiguousarray(np.packbits(skip, axis=1, bitorder="little")).view(np.uint64)
    # Counters start so far below their end that one overflows just when its distance exceeds the radius.
    n = radius.bit_length()
    start = 2**n - 1 - radius
    counters = [np.full_like(over, 0xFFFFFFFFFFFFFFFF if start >> i & 1 else 0) for i in range(n)]
    for plane in range(64):
        carry = planes[plane][None, :] ^ asked[:, plane][:, None]
        for c in counters:
            overflow = c & carry
            c ^= carry
            carry = overflow
        over |= carry
        if plane >= 15 and plane % 4 == 3 and (over == 0xFFFFFFFFFFFFFFFF).all():
            return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.nonzero(np.unpackbits((~over).view(np.uint8), axis=1, bitorder="little"))


class Forest:
    """Union-find over the rows of one chunk."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def roots(self) -> np.ndarray:
        while True:
            up = self.up[self.up]
            if (up == self.up).all():
                return up
            self.up = up

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = int(self.up[i])
        return i

    def join(self, i: np.ndarray, j: np.ndarray) -> None:
        """Joins the pairs (i, j); pairs between the same two roots are joined once."""
        roots = self.roots()
        a, b = roots[i], roots[j]
        apart = a != b
        for x, y in np.unique(np.stack([a[apart], b[apart]], axis=1), axis=0):
            x, y = self.find(int(x)), self.find(int(y))
            if x != y:
                self.up[max(x, y)] = min(x, y)


def whole_groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables that hold whole groups of rows sorted by the first `keys` columns, and the groups' bounds."""
    rest = None
    for b in batches:
        table = pa.Table.from_batches([b]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([b])])
        bounds = group_bounds(table, keys)
        done = int(bounds[-2]) if len(bounds) > 1 else 0
        if done:
            yield table.slice(0, done), bounds[:-1]
        rest = table.slice(done)
    if rest is not None and len(rest):
        yield rest, group_bounds(rest, keys)


def group_bounds(table: pa.Table, keys: int) -> np.ndarray:
    change = np.zeros(max(0, len(table) - 1), dtype=bool)
    for k in range(keys):
        col = table.column(k).to_numpy()
        change |= col[1:] != col[:-1]
    return np.concatenate([[0], np.flatnonzero(change) + 1, [len(table)]]) if len(table) else np.array([0])


def tiles(lo: np.ndarray, hi: np.ndarray, block: int) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """Index pairs of tiles that cover lo x hi once; with hi empty, each pair within lo once."""
    own = [lo[i:i + block] for i in range(0, len(lo), block)]
    if not len(hi):
        for x, a in enumerate(own):
            yield a, a, True
            for b in own[x + 1:]:
                yield a, b, False
        return
    for a in own:
        for i in range(0, len(hi), block):
            yield a, hi[i:i + block], False


def signed(mask: int) -> int:
    return mask - 2**64 if mask >> 63 else mask


def buckets(classes: DataFrame, rows: int, radius: int) -> DataFrame:
    """(t, key, _fp): buckets of at most CAP different fingerprints such that any two within the radius share one.

    A larger bucket gives way to finer ones, again and again: a mask that leaves b bits has no bucket of over 2**b.
    """
    masks = band_masks(radius, rows)
    keyed = classes.select("_fp", F.posexplode(F.array(*[F.col("_fp").bitwiseAND(signed(m)) for m in masks])).alias("t", "key"))
    out, first = None, 0
    while True:
        heavy = cut(keyed.groupBy("t", "key").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > CAP).select("t", "key"))
        n = heavy.count()
        small = F.broadcast(heavy) if n <= 10_000 else heavy
        light = keyed.join(small, ["t", "key"], "left_anti").select("t", "key", "_fp") if n else keyed.select("t", "key", "_fp")
        out = light if out is None else out.unionByName(light)
        if not n:
            return out
        finer = [finer_masks(m, radius) for m in masks]
        table = F.array(*[F.array(*[F.lit(signed(m)) for m in x]) for x in finer])
        dense = keyed.join(small, ["t", "key"], "left_semi").select("_fp", (F.col("t") - first).alias("_t"))
        first, masks = first + len(masks), [m for x in finer for m in x]
        spread = dense.select("_fp", "_t", F.posexplode(F.get(table, F.col("_t"))).alias("_j", "_m"))
        keyed = cut(spread.select("_fp", (F.lit(first) + F.col("_t") * (radius + 1) + F.col("_j")).alias("t"), F.col("_fp").bitwiseAND(F.col("_m")).alias("key")))


def linked_edges(classes: DataFrame, rows: int, radius: int) -> DataFrame:
    """Edges (a, b) between different fingerprints that keep every chain of links: a forest for each chunk, not all pairs."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, bounds in whole_groups(batches, 2):
            fps, forest = table.column("_fp").to_numpy().view(np.uint64), Forest(len(table))
            s = 0
            while s < len(bounds) - 1:
                # Several whole buckets fill a block: any close pair in it is a link. A larger bucket is compared in tiles.
                e = max(s + 1, int(np.searchsorted(bounds, bounds[s] + BLOCK, side="right")) - 1)
                at = np.arange(bounds[s], bounds[e])
                if len(at) > 1:
                    for a, b, same in tiles(at, at[:0], BLOCK):
                        roots = forest.roots()
                        if not ((roots[a] == roots[a[0]]).all() and (roots[b] == roots[a[0]]).all()):
                            i, j = within_radius(fps[a], fps[b], radius, same)
                            if len(i):
                                forest.join(a[i], b[j])
                s = e
            roots = forest.roots()
            child = np.flatnonzero(roots != np.arange(len(roots)))
            if len(child):
                edges = np.unique(np.stack([fps[child], fps[roots[child]]], axis=1), axis=0).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(edges[:, 0]), pa.array(edges[:, 1])], ["a", "b"])

    return buckets(classes, rows, radius).repartition("t", "key").sortWithinPartitions("t", "key").mapInArrow(run, "a long, b long")


def labelled(fps: DataFrame, radius: int) -> DataFrame:
    """fps (_id, _h, _fp) with _component, a fingerprint that stands for all that links reach, and component_id, the smallest id there."""
    classes = cut(fps.groupBy("_fp").agg(F.min("_id").alias("_least")))
    # An id with several texts is one node, so it links their fingerprints.
    several = fps.where("_id is not null").groupBy("_id").agg(F.min("_fp").alias("a"), F.max("_fp").alias("_most")).where("a <> _most")
    same_id = fps.join(several, "_id").select("a", F.col("_fp").alias("b"))
    joined = components(linked_edges(classes, classes.count(), radius).unionByName(same_id), "a", "b")
    linked = classes.join(joined, F.col("_fp") == F.col("node")).select("_fp", "component", "_least")
    least = linked.groupBy("component").agg(F.min("_least").alias("_id_of_all"))
    reached = linked.join(least, "component").select("_fp", F.col("component").alias("_component"), "_id_of_all")
    label = (classes.join(reached, "_fp", "left")
             .select("_fp", F.coalesce("_component", "_fp").alias("_component"), F.coalesce("_id_of_all", "_least").alias("component_id")))
    return fps.join(label, "_fp")


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 3) -> DataFrame:
    """One row per input row: id, fingerprint (16 hex digits), component_id (smallest id that links reach).

    Fingerprints link at `radius` or fewer differing bits. Rows with equal fingerprints form a class that
    is compared once. Null and empty texts have fingerprint zero, linked like any other; very long texts
    are read whole. Ids are integers; rows that repeat an id are one node, so that their texts are in one
    component. A row with a null id links like any other; its component_id is null if no id is reached.
    Columns other than the two named are not read. An empty table gives an empty result.
    """
    kind = docs.select(id_col).schema[0].dataType
    found = labelled(cut(fingerprints(docs, id_col, text_col, shingle)), radius)
    return found.select(F.col("_id").cast(kind).alias(id_col), F.lower(F.lpad(F.hex("_fp"), 16, "0")).alias("fingerprint"), "component_id")


def simhash_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 3) -> DataFrame:
    """The rows of docs that stay, one of each component, with all their columns.

    The row with the smallest id stays, and one without an id only where the component has none. If rows
    repeat that id, the one with the least fingerprint stays; of rows with one text, the least by its
    columns. Nulls and long texts are as in simhash_groups, columns of any name are kept.
    """
    found = labelled(cut(fingerprints(docs, id_col, text_col, shingle)), radius).where(F.col("_id").eqNullSafe(F.col("component_id")))
    counted = found.groupBy("_component", "_id", "_fp", "_h").agg(F.count(F.lit(1)).alias("_n"))
    stay = counted.groupBy("_component").agg(F.min(F.struct("_fp", "_h", "_n", "_id")).alias("_s")).select("_s._id", "_s._h", "_s._n")
    return rows_that_stay(docs, stay, id_col, text_hash(docs[text_col]))
