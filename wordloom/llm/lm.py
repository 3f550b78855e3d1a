"""Language-model scoring by cross-entropy difference of a target and a background bigram model.

Both models share one vocabulary of words and bigrams, which grows with the corpus: no model is held
by the driver or by one task. Documents are gathered in blocks; each block sends the counts of its own
n-grams to the ranges they fall in, and gets the counts over all documents back. Where blocks times ranges
would be too many rows, blocks send to teams first, by wider ranges, and the teams to the ranges, so that
no row becomes small: rows then grow with the power 1.5 of the corpus, and bytes in proportion to it.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordloom.llm.common import cut

#: An n-gram is an even (bigram) or odd (word) number of so many bits, made from 64-bit hashes.
GRAM_BITS = 44
#: Text of one block, and text whose n-grams one range is to hold, in bytes.
BLOCK_BYTES, RANGE_BYTES = 8 << 20, 16 << 20
#: Target ids up to this number are sent to all executors; more are joined by an exchange.
MOST_SENT_IDS = 1_000_000
#: Rows of blocks and ranges up to which blocks ask the ranges themselves.
MOST_ROWS = 20_000_000
SMOOTHING = 100.0
#: Stands before the first word and after the last one.
EDGE = b""


class WordIds(dict):
    """Word to its hash; forgets all when it holds too many."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        out = self[word] = xxhash.xxh64_intdigest(word)
        return out


IDS = WordIds()


def word_ids(text: bytes) -> np.ndarray:
    """Hashes of the words with an edge at both ends; nothing for a text without words."""
    words = text.lower().split()
    return np.fromiter(map(IDS.__getitem__, [EDGE, *words, EDGE]), np.uint64, len(words) + 2) if words else np.empty(0, np.uint64)


def word_grams(ids: np.ndarray) -> np.ndarray:
    return ((ids >> np.uint64(64 - GRAM_BITS)) | np.uint64(1)).astype(np.int64)


def pair_grams(before: np.ndarray, ids: np.ndarray) -> np.ndarray:
    mixed = (before * np.uint64(0x9E3779B97F4A7C15)) ^ (ids * np.uint64(0xC2B2AE3D27D4EB4F))
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0x165667B19E3779F9)
    return (mixed >> np.uint64(65 - GRAM_BITS) << np.uint64(1)).astype(np.int64)


class Block:
    """N-grams of some texts: each word, and the edge after the last one, is predicted from what stands before it."""

    def __init__(self, texts: list[bytes]):
        ids = [word_ids(t) for t in texts]
        self.predictions = np.array([max(len(x) - 1, 0) for x in ids], np.int64)
        every = np.concatenate([*ids, np.empty(0, np.uint64)])
        first = np.zeros(len(every), bool)
        starts = np.cumsum([0, *map(len, ids)])[:-1]
        first[starts[self.predictions > 0]] = True
        at = np.flatnonzero(~first)
        self.doc = np.repeat(np.arange(len(texts)), self.predictions)
        words = word_grams(every)
        # Contexts are words or edges, all of which are predicted somewhere, so that their counts are among the words'.
        grams = np.concatenate([words[at], pair_grams(every[at - 1], every[at])])
        self.grams, place = np.unique(grams, return_inverse=True)
        self.word, self.pair = place[:len(at)], place[len(at):]
        self.before = np.searchsorted(self.grams, words[at - 1])

    def counts(self, in_target: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Count of each n-gram in all texts and in those of the target."""
        chosen = in_target[self.doc]
        own = np.concatenate([self.word[chosen], self.pair[chosen]])
        size = len(self.grams)
        return np.bincount(np.concatenate([self.word, self.pair]), minlength=size), np.bincount(own, minlength=size)

    def losses(self, counts: np.ndarray, total: float, scale: float, vocabulary: int) -> np.ndarray:
        """Nats per prediction of each text under the model of these counts; 0 for a text without words."""
        counts = counts * scale
        single = (counts[self.word] + 1) / (total * scale + vocabulary)
        nats = -np.log((counts[self.pair] + SMOOTHING * single) / (counts[self.before] + SMOOTHING))
        return np.bincount(self.doc, nats, len(self.predictions)) / np.maximum(self.predictions, 1)


def packed(numbers: np.ndarray) -> bytes:
    """Bytes of equal weight next to each other, as most of the high ones are zero."""
    return zlib.compress(numbers.astype("<i8").view(np.uint8).reshape(-1, 8).T.tobytes(), 1)


def unpacked(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zlib.decompress(data), np.uint8).reshape(8, -1).T).view("<i8").ravel()


def gathered(docs: DataFrame) -> DataFrame:
    """(block, docs): rows of docs (_id, _text, _target) in blocks of about BLOCK_BYTES of text, each block as one compressed Arrow stream."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number = TaskContext.get().partitionId() << 32, 0

        def finish(held: list[pa.RecordBatch]) -> pa.RecordBatch:
            out = pa.BufferOutputStream()
            with pa.ipc.new_stream(out, held[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
                stream.write_table(pa.Table.from_batches(held).combine_chunks())
            return pa.RecordBatch.from_arrays([pa.array([task + number]), pa.array([out.getvalue().to_pybytes()], pa.binary())], ["block", "docs"])

        held, size = [], 0
        for b in batches:
            lengths = np.cumsum([len(t) if t is not None else 0 for t in b.column(1).cast(pa.binary()).to_pylist()])
            start = 0
            while start < len(b):
                before = int(lengths[start - 1]) if start else 0
                end = min(len(b), int(np.searchsorted(lengths, BLOCK_BYTES - size + before)) + 1)
                held.append(b.slice(start, end - start))
                size += int(lengths[end - 1]) - before
                start = end
                if size >= BLOCK_BYTES:
                    yield finish(held)
                    held, size, number = [], 0, number + 1
        if held:
            yield finish(held)

    return docs.select("_id", "_text", "_target").mapInArrow(run, "block long, docs binary")


def documents_of(block: bytes) -> tuple[pa.Table, Block]:
    docs = pa.ipc.open_stream(block).read_all()
    return docs, Block([t or b"" for t in docs.column("_text").cast(pa.binary()).to_pylist()])


def requests(blocks: DataFrame, ranges: int) -> DataFrame:
    """For each block and each range that it has n-grams in: those n-grams and their counts in the block."""
    shift = GRAM_BITS - (ranges.bit_length() - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for number, data in zip(b.column(0), b.column(1), strict=True):
                docs, block = documents_of(data.as_buffer())
                all_, own = block.counts(np.array(docs.column("_target").to_pylist(), bool))
                parts = block.grams >> shift
                edges = np.flatnonzero(np.diff(parts, prepend=-1, append=ranges + 1))
                spans = [slice(s, e) for s, e in pairwise(edges)]
                yield pa.RecordBatch.from_arrays([
                    pa.array([number.as_py()] * len(spans), pa.int64()), pa.array(parts[edges[:-1]].astype(np.int32)),
                    pa.array([packed(np.diff(block.grams[x], prepend=0)) for x in spans], pa.binary()),
                    *[pa.array([packed(counts[x]) for x in spans], pa.binary()) for counts in (all_, own)]],
                    ["block", "part", "grams", "in_all", "in_target"])

    return blocks.mapInArrow(run, "block long, part int, grams binary, in_all binary, in_target binary")


def merged(tables: list[pa.Array]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], np.ndarray]:
    """Of packed (n-grams, counts, counts in the target): the different n-grams, each one's place there, their counts, and the bounds of the parts."""
    grams = [np.cumsum(unpacked(g)) for g in tables[0].to_pylist()]
    union, place = np.unique(np.concatenate(grams), return_inverse=True)
    sums = [np.bincount(place, np.concatenate([unpacked(x) for x in t.to_pylist()]), len(union)).astype(np.int64) for t in tables[1:]]
    return union, place, sums, np.cumsum([0, *map(len, grams)])


def totals(asked: DataFrame) -> DataFrame:
    """For each block and range the counts over all blocks, in the block's order; once for each range (block null) its words and their counts."""
    def run(range_: pa.Table) -> pa.Table:
        grams, place, sums, bounds = merged([range_.column(c) for c in ("grams", "in_all", "in_target")])
        spans = [place[s:e] for s, e in pairwise(bounds)]
        words = grams % 2 == 1
        m = len(spans)
        return pa.table([
            pa.concat_arrays([*range_.column("block").chunks, pa.nulls(1, pa.int64())]),
            pa.concat_arrays([*range_.column("part").chunks, pa.nulls(1, pa.int32())]),
            *[pa.array([*[packed(x[s]) for s in spans], None], pa.binary()) for x in sums],
            *[pa.array([0] * m + [int(x)]) for x in (words.sum(), sums[0][words].sum(), sums[1][words].sum())]],
            ["block", "part", "in_all", "in_target", "words", "all", "target"])

    return asked.groupBy("part").applyInArrow(run, "block long, part int, in_all binary, in_target binary, words long, all long, target long")


def team_totals(blocks: DataFrame, n_blocks: int, ranges: int) -> DataFrame:
    """What totals returns, by wide ranges. Blocks are dealt to teams; a team merges what its blocks ask of a wide range, and asks the ranges in it once."""
    bits = ranges.bit_length() - 1
    wide = bits // 2
    shift = GRAM_BITS - bits
    teams = -(-n_blocks // (1 << wide))
    team = F.pmod(F.xxhash64("block"), F.lit(teams)).alias("team")
    asked = cut(requests(blocks, 1 << wide).select(team, "part", "block", "grams", "in_all", "in_target"))

    def ask(page: pa.Table) -> pa.Table:
        grams, _, sums, _ = merged([page.column(c) for c in ("grams", "in_all", "in_target")])
        parts = grams >> shift
        edges = np.flatnonzero(np.diff(parts, prepend=-1, append=ranges + 1))
        spans = [slice(s, e) for s, e in pairwise(edges)]
        return pa.table([
            pa.array([page.column("team")[0].as_py()] * len(spans), pa.int64()), pa.array(parts[edges[:-1]].astype(np.int32)), pa.array([packed(np.diff(grams[x], prepend=0)) for x in spans], pa.binary()),
            *[pa.array([packed(c[x]) for x in spans], pa.binary()) for c in sums]], ["block", "part", "grams", "in_all", "in_target"])

    found = cut(totals(asked.groupBy("team", "part").applyInArrow(ask, "block long, part int, grams binary, in_all binary, in_target binary")))

    def answer(page: pa.Table, counts: pa.Table) -> pa.Table:
        _, place, _, bounds = merged([page.column("grams")])
        counts = counts.sort_by("range")
        sums = [np.concatenate(list(map(unpacked, counts.column(c).to_pylist()))) for c in ("in_all", "in_target")]
        return pa.table([page.column("block"), page.column("part"), *[pa.array([packed(x[place[s:e]]) for s, e in pairwise(bounds)], pa.binary()) for x in sums]],
                        ["block", "part", "in_all", "in_target"])

    to_teams = found.where("block is not null").select(F.col("block").alias("team"), F.shiftright("part", bits - wide).alias("part"), F.col("part").alias("range"), "in_all", "in_target")
    answered = (asked.groupBy("team", "part").cogroup(to_teams.groupBy("team", "part"))
                .applyInArrow(answer, "block long, part int, in_all binary, in_target binary"))
    return answered.unionByName(found.where("block is null"), allowMissingColumns=True)


def cross_entropy_difference(docs: DataFrame, target_ids: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_tokens, target_loss, background_loss, score (their difference; lower: more like the target).

    Words are maximal runs without white space after lower-casing A-Z; the end of a text is predicted
    like a word. The target is the documents whose id is in target_ids (one column); the background is
    all documents, its counts scaled to the target's size so that smoothing acts alike. A document's own words are in
    the models that score it: those of the background always, those of the target if it is of the target, which makes it
    score lower there than an unseen document would. A text without words, or a null one, has losses and score zero;
    a very long one is read whole. A null id is never in the target; repeated rows are counted each. Columns other
    than the two named are not read. Without a target its model is uniform. An empty table gives an empty result.
    """
    ids = target_ids.select(F.col(target_ids.columns[0]).alias("_wl_id")).where("_wl_id is not null").distinct().withColumn("_wl_in", F.lit(True))
    ids = F.broadcast(ids) if ids.count() <= MOST_SENT_IDS else ids.hint("shuffle_hash")
    own = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    size = own.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
    ranges = 1 << max(3, (size // RANGE_BYTES).bit_length())
    in_target: Column = F.coalesce("_wl_in", F.lit(False)).alias("_target")
    blocks = cut(gathered(own.join(ids, F.col("_id") == F.col("_wl_id"), "left").select("_id", "_text", in_target)))
    ranges, n_blocks = min(ranges, 1 << 30), blocks.count()
    answers = cut(totals(requests(blocks, ranges)) if n_blocks * ranges <= MOST_ROWS else team_totals(blocks, n_blocks, ranges))
    sums = answers.where("block is null").agg(*[F.sum(c) for c in ("words", "all", "target")]).first()
    vocabulary, total, target = (int(x or 0) for x in sums)
    scale = target / total if target else 1.0

    def run(held: pa.Table, counts: pa.Table) -> pa.Table:
        docs, block = documents_of(held.column("docs")[0].as_buffer())
        counts = counts.sort_by("part")
        all_, own = (np.concatenate([np.empty(0, np.int64), *map(unpacked, counts.column(c).to_pylist())]) for c in ("in_all", "in_target"))
        t, a = block.losses(own, target, 1.0, vocabulary), block.losses(all_, total, scale, vocabulary)
        return pa.table([docs.column("_id"), pa.array(np.maximum(block.predictions - 1, 0)), pa.array(t), pa.array(a), pa.array(t - a)],
                        ["_id", "n_tokens", "target_loss", "background_loss", "score"])

    kind = own.schema["_id"].dataType.simpleString()
    return (blocks.groupBy("block").cogroup(answers.where("block is not null").select("block", "part", "in_all", "in_target").groupBy("block"))
            .applyInArrow(run, f"_id {kind}, n_tokens long, target_loss double, background_loss double, score double").withColumnRenamed("_id", id_col))
