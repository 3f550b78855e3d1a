"""Best-fit packing planned on the histogram of lengths, not on documents."""

from __future__ import annotations

import base64
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordloom.llm.common import cut, gapless_rank

#: The special token of the vocabulary, which its file of ranks does not hold, and its id.
SPECIAL, SPECIAL_ID = "<|endoftext|>", 50256

#: White space as the pattern takes it, in runs near which the library's matcher runs out of stack (at 1,000,000 characters).
LONG_RUN = 100_000
SPACES = "[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
LONG_SPACES = re.compile(f"(?<!{SPACES}){SPACES}{{{LONG_RUN},}}")

ENCODERS: dict[tuple[str, str], tiktoken.Encoding] = {}


def encoder(ranks_path: str, pattern: str) -> tiktoken.Encoding:
    """The byte-level vocabulary without its special token. One for each worker process."""
    if (ranks_path, pattern) not in ENCODERS:
        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        ENCODERS[ranks_path, pattern] = tiktoken.Encoding("bytes", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return ENCODERS[ranks_path, pattern]


def encode_plain(encoding: tiktoken.Encoding, text: str) -> list[int]:
    """Ids of a text without special tokens.

    A long run of white space is one match of the pattern, less its last character if text follows: that
    one goes with the text. Such a match is encoded without the matcher.
    """
    if len(text) < LONG_RUN:
        return encoding.encode_ordinary(text)
    ids, at = [], 0
    for run in LONG_SPACES.finditer(text):
        stop = run.end() - (run.end() < len(text))
        ids += encoding.encode_ordinary(text[at:run.start()])
        ids += encoding._encode_single_piece(text[run.start():stop])
        at = stop
    return ids + encoding.encode_ordinary(text[at:])


def encode(encoding: tiktoken.Encoding, text: str) -> list[int]:
    """Ids of a whole text; the special token's string is one id, and no piece reaches across it."""
    first, *others = text.split(SPECIAL)
    ids = encode_plain(encoding, first)
    for part in others:
        ids.append(SPECIAL_ID)
        ids += encode_plain(encoding, part)
    return ids


def pieces(docs: DataFrame, ranks_path: str, pattern: str, capacity: int, end_id: int, id_col: str, text_col: str, keep_ids: bool) -> DataFrame:
    """(_id, piece, start, length, ids_crc32[, ids]) of each document's ids; longer ones are cut so that only the first piece is shorter."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = encoder(ranks_path, pattern)
        for b in batches:
            rows: list[list] = [[], [], [], [], [], []]
            for i, text in enumerate(b.column(1)):
                ids = np.array([*encode(encoding, text.as_py() or ""), end_id], dtype="<u4")
                start, stop, piece = 0, len(ids) % capacity or capacity, 0
                while start < len(ids):
                    for column, x in zip(rows, (i, piece, start, stop - start, zlib.crc32(ids[start:stop].tobytes()), ids[start:stop] if keep_ids else None), strict=True):
                        column.append(x)
                    start, stop, piece = stop, stop + capacity, piece + 1
            out = [b.column(0).take(pa.array(rows[0], pa.int64())), pa.array(rows[1], pa.int32()), *[pa.array(x, pa.int64()) for x in rows[2:5]]]
            names = ["_id", "piece", "start", "length", "ids_crc32"]
            if keep_ids:
                out, names = [*out, pa.array(rows[5], pa.list_(pa.int64()))], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(out, names)

    kind = docs.select(id_col).schema[0].dataType.simpleString()
    schema = f"_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<long>" * keep_ids
    return docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).mapInArrow(run, schema)


def best_fit(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Best fit, longest first, on counts: (length, first rank, pieces, first sequence, offset).

    The pieces of a length with ranks from the first one go to consecutive sequences, all at the same
    offset. The size of the plan depends on the number of different lengths, not on the counts.
    """
    plan, sequences = [], 0
    room: dict[int, list[tuple[int, int]]] = {}  # free places: ranges of sequences
    sizes: list[int] = []  # keys of room in order

    def add(free: int, first: int, n: int) -> None:
        if free and n:
            if free not in room:
                insort(sizes, free)
            room.setdefault(free, []).append((first, n))

    for length in sorted(histogram, reverse=True):
        rank, todo = 0, histogram[length]
        while todo:
            at = bisect_left(sizes, length)
            if at == len(sizes):
                each = capacity // length
                full, rest = divmod(todo, each)
                for j in range(each):
                    n = full + (j < rest)
                    if n:
                        plan.append((length, rank, n, sequences, j * length))
                        rank += n
                add(capacity - each * length, sequences, full)
                if rest:
                    add(capacity - rest * length, sequences + full, 1)
                sequences, todo = sequences + full + bool(rest), 0
                continue
            free = sizes[at]
            first, n = room[free].pop()
            taken = min(n, todo)
            plan.append((length, rank, taken, first, capacity - free))
            if not room[free]:
                del room[free], sizes[at]
            add(free - length, first, taken)
            add(free, first + taken, n - taken)
            rank, todo = rank + taken, todo - taken
    return plan


def pack(docs: DataFrame, ranks_path: str, pattern: str, capacity: int = 1024, end_id: int = 2,
         id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32[, ids], sequence_id, offset.

    A document is its ids and end_id, so a null or empty text is end_id alone. Documents take planned slots
    by a join on the rank of a piece within its length. Rows that repeat an id, and null ids, are
    documents of their own. A very long text is encoded whole; columns other than the two named are not
    read. An empty table gives an empty result.
    """
    cuts = cut(pieces(docs, ranks_path, pattern, capacity, end_id, id_col, text_col, keep_ids))
    histogram = {r["length"]: r["n"] for r in cuts.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most `capacity` rows
    plan = docs.sparkSession.createDataFrame(best_fit(histogram, capacity), "length long, _from long, _n long, _sequence long, offset long")
    buckets = 256 + sum(histogram.values()) // 50_000
    ranked = gapless_rank(cuts, ["length"], ["_id", "piece", "ids_crc32"], "_rank", buckets)
    fits = (ranked["length"] == F.col("p.length")) & F.col("_rank").between(F.col("p._from"), F.col("p._from") + F.col("p._n") - 1)
    placed = ranked.join(F.broadcast(plan.alias("p")), fits)  # the plan's size is bounded by the number of lengths
    return placed.select(
        F.col("_id").alias(id_col), "piece", "start", ranked["length"], "ids_crc32", *(["ids"] if keep_ids else []),
        (F.col("_sequence") + F.col("_rank") - F.col("_from")).alias("sequence_id"), "offset")
