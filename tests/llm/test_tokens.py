import hashlib
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tests.llm.helpers import HARD_ROWS, hard_docs
from wordloom.llm import packing, pieces, queries

MODEL = public_tokenizers.path("piece_bpe_32k.model")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=MODEL)


def test_piece_digest(spark, sf_dir):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in queries.op6_sentencepiece(spark, sf_dir).collect():
        ids = LIBRARY.encode(texts[r["doc_id"]], add_eos=True)
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(LIBRARY.decode(ids).encode()).hexdigest()


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.text(max_size=40), st.text(alphabet="abeinstö ▁\n.,'-1", max_size=60)))
def test_pieces_match_the_library(text):
    own, ids = pieces.vocabulary(MODEL), LIBRARY.encode(text, add_eos=True)
    [(shown, decoded)] = own.encode_batch([text])
    assert shown.decode() == " ".join(map(str, ids))
    assert own.decode(ids) == LIBRARY.decode(ids) == decoded.decode()


@pytest.mark.parametrize("text", ["plain words here", "one\nwords", "say (words) now", "a  words", "日本words語", "x ▁▁words"])
def test_a_wrong_chunk_is_found(monkeypatch, text):
    """Whatever stands before or after it, a chunk with other ids than the library's ends the task."""
    own = pieces.MergeVocabulary(MODEL)
    right = own.merge
    monkeypatch.setattr(own, "merge", lambda part: [5, *right(part)] if "words" in part else right(part))
    list(own.encode_batch(["a b c", "x one say (now)"]))
    with pytest.raises(ValueError, match="the library encodes"):
        list(own.encode_batch([text]))


def test_pieces_hard_rows(spark):
    docs = hard_docs(spark)
    encoded = pieces.encode(docs, MODEL)
    got = sorted(((r["doc_id"], r["ids"]) for r in encoded.collect()), key=repr)
    assert got == sorted(((i, LIBRARY.encode(t or "", add_eos=True)) for i, t in HARD_ROWS), key=repr)
    back = {r["doc_id"]: r["text"] for r in pieces.decode(encoded, MODEL).collect()}
    assert all(back[i] == LIBRARY.decode(LIBRARY.encode(t or "", add_eos=True)) for i, t in HARD_ROWS)
    assert pieces.encode(docs.limit(0), MODEL).count() == 0


def check_packing(rows, texts, capacity=1024):
    """Whole ids of every document, cut as laid down, and sequences without gaps or overlap."""
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert set(by_doc) == set(texts)
    for i, text in texts.items():
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        found = sorted(by_doc[i], key=lambda r: r["piece"])
        assert [r["piece"] for r in found] == list(range(-(-len(ids) // capacity)))
        assert all(r["length"] == capacity for r in found[1:])
        at = 0
        for r in found:
            assert r["start"] == at and r["ids_crc32"] == zlib.crc32(ids[at:at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by_sequence), sum(r["length"] for r in rows)


def test_packing(spark, sf_dir):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    sequences, tokens = check_packing(queries.op8_packing(spark, sf_dir).collect(), texts)
    assert sequences <= -(-tokens // 1024) + 2


def test_packing_hard_rows(spark):
    docs = hard_docs(spark).where("doc_id is not null and doc_id <> 4")
    args = (public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    check_packing(packing.pack(docs, *args).collect(), {i: t for i, t in HARD_ROWS if i not in (None, 4)})
    assert packing.pack(hard_docs(spark), *args).where("doc_id = 4").count() == 2
    assert packing.pack(docs.limit(0), *args).count() == 0


def test_packing_special_token(spark):
    """The special token's string is one id, wherever it stands."""
    end = "<|endoftext|>"
    texts = dict(enumerate([f"a {end} b", end, end * 3, f"a  {end}  b\n", f"{end}\n\n x{end}", f"x<|endoftext{end}|>", f"'{end}s 1{end}2", "<|endoftext>", f"word {end} " * 2_000]))
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    check_packing(packing.pack(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).collect(), texts)


def test_packing_long_white_space(spark):
    """Runs at which the matcher of tiktoken runs out of stack."""
    n = 1_000_001
    texts = dict(enumerate([" " * n + "a", "\n" * n + "a", "x" + "\u3000" * n, f"a{' ' * n}\n<|endoftext|>{chr(9) * n} 1 b", "x \n" * 4 + "\n " * n + "'s"]))
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    check_packing(packing.pack(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).collect(), texts)


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="ab1!'s \n\t\xa0\x1c\u3000\u200b\x85ß", max_size=60))
def test_white_space_in_parts(text):
    """Cut at runs of two characters already, the ids are those of the whole text."""
    encoding = packing.encoder(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(packing, "LONG_RUN", 0)
        patch.setattr(packing, "LONG_SPACES", re.compile(packing.LONG_SPACES.pattern.replace("100000", "2")))
        assert packing.encode_plain(encoding, text) == encoding.encode_ordinary(text)


@pytest.mark.parametrize("seed", range(5))
def test_best_fit_plan(seed):
    """On counts it needs no more sequences than best fit, longest first, on single items."""
    rng = np.random.default_rng(seed)
    lengths = np.minimum(rng.geometric(0.03, 500), 100)
    plan = packing.best_fit({int(x): int(n) for x, n in zip(*np.unique(lengths, return_counts=True))}, 100)
    assert sum(n for _, _, n, _, _ in plan) == 500
    rooms = []
    for x in sorted(lengths, reverse=True):
        fits = [k for k, r in enumerate(rooms) if r >= x]
        best = min(fits, key=lambda k: rooms[k], default=None)
        if best is None:
            rooms.append(100 - x)
        else:
            rooms[best] -= x
    used = max(first + n for _, _, n, first, _ in plan)
    assert used <= len(rooms)
