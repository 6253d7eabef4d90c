"""Byte pairs against the public library, text by text, and against merging by hand."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tallyhouse.llm import byte_pairs
from tallyhouse.llm.queries import op13_bpe_round_trip

PATH = public_tokenizers.path("byte_bpe_50k.json")
KNOWN = byte_pairs.vocabulary(PATH)
LIBRARY = Tokenizer.from_file(PATH)
PARTS = ["a", "the", "xe", " ", "  ", "\n", "\t", "'s", "'LL", "1", "23", ".", "!!", "é", "ß", "日本", "　", "\xa0", "<|endoftext|>", "𝒳", "\x00", "\x1c", "\x85"]


def by_library(text: str | None) -> list[int]:
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


def encoded(texts: list[str | None]) -> list[list[int]]:
    ids, at = byte_pairs.encode(pa.array(texts, pa.string()), KNOWN)
    return [ids[low:high].tolist() for low, high in zip(at, at[1:], strict=False)]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=30), st.lists(st.sampled_from(PARTS), max_size=30).map("".join)), max_size=6))
def test_ids_are_those_of_the_library(texts):
    assert encoded(texts) == [by_library(t) for t in texts]


def test_every_code_point():
    """A character alone, after a blank, before a letter: white space, letters and digits are told apart as the library does."""
    for low in [*range(0, 0x20000, 4096), 0x20000, 0x2F000, 0x30000, 0xE0000, 0x10F000]:
        signs = [chr(c) for c in range(low, low + 4096) if not 0xD800 <= c < 0xE000]
        texts = [f"a {c}1 {c} {c}b" for c in signs]
        assert encoded(texts) == [e.ids for e in LIBRARY.encode_batch_fast(texts, add_special_tokens=False)]


def by_hand(piece: bytes) -> list[int]:
    tokens = [int(KNOWN.of_byte[b]) for b in piece]
    rank = {(int(p) // KNOWN.size, int(p) % KNOWN.size): int(r) for p, r in zip(KNOWN.pairs, KNOWN.ranks, strict=True)}
    while True:
        found = min(((rank[p], k) for k, p in enumerate(zip(tokens, tokens[1:], strict=False)) if p in rank), default=None)
        if found is None:
            return tokens
        tokens[found[1] : found[1] + 2] = [int(KNOWN.made[found[0]])]


def test_trees_merge_the_leftmost_pair_of_lowest_rank():
    draw = random.Random(3)
    pieces = [bytes(draw.choice(b"aetnrsh ") for _ in range(draw.randint(0, 40))) for _ in range(60)]
    ids, at = byte_pairs.encode_pieces(pa.array(pieces, pa.large_binary()), KNOWN)
    assert [ids[low:high].tolist() for low, high in zip(at, at[1:], strict=False)] == [by_hand(p) for p in pieces]


@pytest.mark.parametrize("text", ["a" * 30_000, "ab" * 9_000, "=" * 5_000 + "x", " " * 4_000, "word " * 6_000])
def test_long_pieces(text):
    assert encoded([text]) == [by_library(text)]


def test_decoding_is_the_librarys():
    draw = random.Random(9)
    lists = [[draw.randrange(KNOWN.size) for _ in range(draw.randint(0, 25))] for _ in range(500)]
    flat = np.array([i for one in lists for i in one], np.int32)
    at = np.concatenate([[0], np.cumsum([len(one) for one in lists])])
    assert byte_pairs.decode(flat, at, KNOWN).to_pylist() == [LIBRARY.decode(one, skip_special_tokens=False) for one in lists]
    assert byte_pairs.decode(np.array([-1, KNOWN.size, 64]), np.array([0, 3]), KNOWN).to_pylist() == ["a"]


def test_documents(spark, docs, corpus, tmp_path):
    rows = [*corpus, (900, "end <|endoftext|> and<|endoftext|>"), (901, "x" * 70_000), (902, "naïve\r\n\r\n  ’quote’")]
    docs(rows).write.parquet(str(tmp_path / "documents.parquet"))
    found = op13_bpe_round_trip(spark, str(tmp_path))
    assert found.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    expected = [(i, len(ids := by_library(t)), digest(",".join(map(str, ids))), digest(t or "")) for i, t in rows]
    assert sorted(map(repr, map(tuple, found.collect()))) == sorted(map(repr, expected))


def test_lists_with_nulls(spark):
    lists = spark.createDataFrame([(1, None), (2, []), (3, [64, None, 65]), (None, [50256])], "id bigint, ids array<int>")
    found = {r["id"]: r["text"] for r in byte_pairs.decode_documents(lists, PATH).collect()}
    assert found == {1: "", 2: "", 3: "ab", None: "<|endoftext|>"}
    assert byte_pairs.encode_documents(spark.createDataFrame([], "doc_id bigint, text string"), PATH).count() == 0


def test_other_vocabularies_are_refused():
    with pytest.raises(ValueError, match="byte-level"):
        byte_pairs.Vocabulary(public_tokenizers.path("word_bpe_49k.json"))
