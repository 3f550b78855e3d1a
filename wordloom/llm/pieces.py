"""SentencePiece encoding and decoding of merge-type vocabularies by a score-ordered agenda of symbol pairs."""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator
from functools import cached_property
from itertools import pairwise

import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: Chunks that a worker remembers, and the length up to which it does.
REMEMBERED, REMEMBERED_CHARS = 800_000, 64


class MergeVocabulary:
    """A byte-fallback merge vocabulary without text normalisation, as read from a model file."""

    def __init__(self, model_path: str):
        model = sentencepiece_model_pb2.ModelProto()
        with open(model_path, "rb") as f:
            model.ParseFromString(f.read())
        spec, kinds = model.normalizer_spec, {p.type for p in model.pieces}
        if (model.trainer_spec.model_type != 2 or spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.add_dummy_prefix
                or not spec.escape_whitespaces or model.trainer_spec.treat_whitespace_as_suffix or not model.trainer_spec.byte_fallback or kinds & {USER, UNUSED}):
            raise ValueError("only merge vocabularies with byte fallback, a leading space and no normalisation are supported")
        self.path, self.pieces = model_path, [p.piece for p in model.pieces]
        self.ids = {p.piece: i for i, p in enumerate(model.pieces) if p.type == NORMAL}
        self.scores = {p.piece: p.score for p in model.pieces if p.type == NORMAL}
        self.bytes = {int(p.piece[1:-1], 16): i for i, p in enumerate(model.pieces) if p.type == BYTE}
        self.end = next(i for i, p in enumerate(model.pieces) if p.piece == (model.trainer_spec.eos_piece or "</s>"))
        self.decoded = [b"" if p.type in (CONTROL, UNKNOWN) else bytes([int(p.piece[1:-1], 16)]) if p.type == BYTE else p.piece.replace(SPACE, " ").encode() for p in model.pieces]
        self.shown = [b"%d" % i for i in range(len(self.pieces))]
        self.known: dict[str, tuple[bytes, bytes]] = {}
        self.parts: dict[str, list[int]] = {}

    @cached_property
    def chunks(self) -> re.Pattern:
        """Splits a text where no merge can reach across: before a space mark, around characters that no longer piece has, after a word if the next character follows no letter in a piece."""
        if any(SPACE in p.lstrip(SPACE) for p in self.ids):
            return re.compile(r"(?s).+")
        inner = {c for p in self.ids if len(p) > 1 for c in p} - {SPACE}
        letters = {c for c in inner if c.isalpha()}
        ends_word = {c for c in inner - letters if not any((a, c) in self.neighbours for a in letters)}
        one_of = lambda chars: re.escape("".join(sorted(chars)))
        return re.compile(f"{SPACE}*[{one_of(letters)}]+(?![{one_of(inner - ends_word)}])|{SPACE}*[{one_of(inner)}]+|{SPACE}+|(?s:.)")

    @cached_property
    def library(self) -> sentencepiece.SentencePieceProcessor:
        return sentencepiece.SentencePieceProcessor(model_file=self.path)

    @cached_property
    def ranks(self) -> dict[str, int]:
        """Place of each piece's score among all scores, the highest first."""
        place = {x: i for i, x in enumerate(sorted(set(self.scores.values()), reverse=True))}
        return {p: place[x] for p, x in self.scores.items()}

    @cached_property
    def neighbours(self) -> frozenset[tuple[str, str]]:
        """Characters next to each other in some piece; no merge reaches across any others."""
        return frozenset(pair for p in self.ids for pair in pairwise(p))

    def merge(self, chunk: str) -> list[int]:
        """Merges adjacent symbols, highest score first and leftmost among equals; what remains unknown becomes bytes.

        An entry of the agenda is the rank of a pair and the place of its left symbol in one number. It
        is stale if the symbols at that place no longer make a piece of that rank.
        """
        symbols: list[str] = list(chunk)
        n, rank = len(symbols), self.ranks.get
        shift = n.bit_length()
        agenda = [r << shift | i for i, pair in enumerate(pairwise(chunk)) if (r := rank(pair[0] + pair[1])) is not None]
        if agenda:
            before, behind, low = list(range(-1, n - 1)), [*range(1, n), -1], (1 << shift) - 1
            heapq.heapify(agenda)
            while agenda:
                entry = heapq.heappop(agenda)
                left = entry & low
                right = behind[left]
                if right < 0 or not symbols[left] or rank(piece := symbols[left] + symbols[right]) != entry >> shift:
                    continue
                symbols[left], symbols[right] = piece, ""
                follow = behind[left] = behind[right]
                if follow >= 0:
                    before[follow] = left
                    if (r := rank(piece + symbols[follow])) is not None:
                        heapq.heappush(agenda, r << shift | left)
                if (lead := before[left]) >= 0 and (r := rank(symbols[lead] + piece)) is not None:
                    heapq.heappush(agenda, r << shift | lead)
        out: list[int] = []
        for s in symbols:
            if s:
                if (i := self.ids.get(s)) is not None:
                    out.append(i)
                else:
                    out += [self.bytes[b] for b in s.encode()]
        return out

    @cached_property
    def apart(self) -> str:
        """A character that no piece holds, so that no merge crosses it."""
        taken = {c for p in self.ids for c in p}
        return next(c for c in map(chr, range(1, 0x300)) if c not in taken and not c.isprintable())

    def learn(self, chunks: list[str], new: set[str]) -> dict[str, tuple[bytes, bytes]]:
        """Ids and decoded bytes of the new ones among a text's chunks, after comparing with the library.

        A chunk is cut once more where its characters are never neighbours in a piece, so that a word
        is merged once, whatever marks surround it. What is compared is all between the space marks
        before and after a new chunk, whatever it holds, in one call.
        """
        pairs, parts_of, merged = self.neighbours, {}, {}
        for c in new:
            cuts = [i for i, pair in enumerate(pairwise(c), 1) if pair not in pairs]
            parts = [c[i:j] for i, j in pairwise([0, *cuts, len(c)])] if cuts else [c]
            for p in parts:
                if p not in self.parts and p not in merged:
                    merged[p] = self.merge(p)
            parts_of[c] = [i for p in parts for i in (merged.get(p) or self.parts[p])]
        if len(self.parts) > REMEMBERED:
            self.parts.clear()
        self.parts.update((p, x) for p, x in merged.items() if len(p) <= REMEMBERED_CHARS)
        shown, decoded = self.shown, self.decoded
        learnt = {c: (b" ".join([shown[i] for i in x]), b"".join([decoded[i] for i in x])) for c, x in parts_of.items()}
        self.compare(chunks, new, learnt)
        return learnt

    def compare(self, chunks: list[str], new: set[str], learnt: dict[str, tuple[bytes, bytes]]) -> None:
        """Raises if the library gives other ids to a stretch between space marks that holds a new chunk. No merge crosses into a space mark."""
        stretches, end = {}, 0
        for i in [i for i, c in enumerate(chunks) if c in new]:
            if i >= end:
                first, end = i, i + 1
                while chunks[first][0] != SPACE:
                    first -= 1
                while end < len(chunks) and chunks[end][0] != SPACE:
                    end += 1
                stretches["".join(chunks[first:end])] = b" ".join([(learnt.get(c) or self.known[c])[0] for c in chunks[first:end]])
        between = b" ".join([self.shown[self.bytes[b]] for b in self.apart.encode()])
        # The library adds the first space mark itself.
        if b" ".join(map(self.shown.__getitem__, self.library.encode(self.apart.join(stretches)[1:]))) != (b" %b " % between).join(stretches.values()):
            for s, own in stretches.items():
                if (theirs := self.library.encode(s[1:])) != list(map(int, own.split())):
                    raise ValueError(f"the library encodes {s!r} as {theirs}, not {own.decode()}")
            raise ValueError("the library merges across space marks")

    def split(self, text: str) -> list[str]:
        return self.chunks.findall(SPACE + text.replace(" ", SPACE)) if text else []

    def encode_batch(self, texts: list[str]) -> Iterator[tuple[bytes, bytes]]:
        """(decimal ids joined by spaces, end id included; decoded text in UTF-8) of each text."""
        end = b"%d" % self.end
        for text in texts:
            chunks = self.split(text)
            new = set(chunks).difference(self.known)
            long = {}
            if new:
                if len(self.known) > REMEMBERED:
                    self.known.clear()
                    new = set(chunks)
                learnt = self.learn(chunks, new)
                long = {c: x for c, x in learnt.items() if len(c) > REMEMBERED_CHARS}
                self.known.update((c, x) for c, x in learnt.items() if c not in long)
            found = [self.known.get(c) or long[c] for c in chunks] if long else list(map(self.known.__getitem__, chunks))
            decoded = b"".join([x[1] for x in found])
            yield b" ".join([*[x[0] for x in found], end]), decoded.removeprefix(b" ")

    def decode(self, ids: list[int]) -> str:
        return b"".join(self.decoded[i] for i in ids).removeprefix(b" ").decode(errors="replace")


VOCABULARIES: dict[str, MergeVocabulary] = {}


def vocabulary(model_path: str) -> MergeVocabulary:
    """One for each worker process."""
    if model_path not in VOCABULARIES:
        VOCABULARIES[model_path] = MergeVocabulary(model_path)
    return VOCABULARIES[model_path]


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id and ids, array<int>, with an end id and no start id.

    A null or empty text is the end id alone. Ids of rows may be null or repeat; each row is encoded on its
    own, whole. An empty table gives an empty result. Columns other
    than the two named are not read. A worker compares all between two spaces with the library where it holds a
    chunk that the worker has not met, and raises if the two differ.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = [list(map(int, x.split())) for x, _ in vocabulary(model_path).encode_batch([t.as_py() or "" for t in b.column(1)])]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32()))], ["_id", "ids"])

    kind = docs.select(id_col).schema[0].dataType.simpleString()
    return (docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
            .mapInArrow(run, f"_id {kind}, ids array<int>").withColumnRenamed("_id", id_col))


def decode(encoded: DataFrame, model_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """One row per input row: id and text. Null or no ids give an empty text; a null id inside counts as none."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [vocabulary(model_path).decode([i for i in x.as_py() or [] if i is not None]) for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["_id", "text"])

    kind = encoded.select(id_col).schema[0].dataType.simpleString()
    return (encoded.select(F.col(id_col).alias("_id"), F.col(ids_col).alias("_ids"))
            .mapInArrow(run, f"_id {kind}, text string").withColumnRenamed("_id", id_col))


def piece_digest(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens, and the hashes of the ids and of the text decoded from them; nothing wider leaves the worker."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts, ids, texts = [], [], []
            for x, text in vocabulary(model_path).encode_batch([t.as_py() or "" for t in b.column(1)]):
                counts.append(x.count(b" ") + 1)
                ids.append(hashlib.sha256(x).hexdigest())
                texts.append(hashlib.sha256(text).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(counts, pa.int64()), pa.array(ids, pa.string()), pa.array(texts, pa.string())],
                                             ["_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.select(id_col).schema[0].dataType.simpleString()
    return (docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
            .mapInArrow(run, f"_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("_id", id_col))
