from __future__ import annotations

import random
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tallyhouse.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["a b  c", "x\ny", "", " lead", "trail ", "a \n b", "a   b", "it's Bob's 'll", "word\n", "  ", "é à", "<|endoftext|> x", "日本 語 ½ 😀"]


def test_ids_are_those_of_the_tokenizer(corpus):
    rows = ODD + [t or "" for _, t in corpus]
    ids, at = packing.encode(pa.array(rows), PATH)
    plain = Tokenizer.from_file(PATH)
    for k, text in enumerate(rows):
        assert ids[at[k] : at[k + 1]].tolist() == plain.encode(text, add_special_tokens=False).ids


@pytest.fixture
def cut(monkeypatch):
    """What a task does with its batches, run here."""

    class Rows:
        def mapInArrow(self, function, schema):
            return function

    monkeypatch.setattr(packing, "texts", lambda docs: Rows())

    def run(texts):
        batch = pa.RecordBatch.from_pydict({"id": pa.array(range(len(texts)), pa.int64()), "text": pa.array(texts)})
        return packing.token_pieces(None, PATH, capacity=50)(iter([batch]))

    return run


def test_parts_of_a_slice_give_the_same_pieces(cut, corpus, monkeypatch):
    rows = [*ODD, *[t or "" for _, t in corpus]]
    whole = [r for b in cut(rows) for r in b.to_pylist()]
    monkeypatch.setattr(packing, "PART_BYTES", 64)
    assert [r for b in cut(rows) for r in b.to_pylist()] == whole


def test_a_slice_takes_little_memory_beside_its_text(cut):
    draw = random.Random(3)
    words = ["".join(draw.choice("abcdefghij") for _ in range(6)) for _ in range(3000)]
    rows = [" ".join(draw.choices(words, k=200)) for _ in range(8000)]
    list(cut(rows[:10]))
    tracemalloc.start()
    for _ in cut(rows):
        pass
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 5 * sum(map(len, rows))


@pytest.mark.parametrize("capacity", [1024, 50])
def test_every_piece_has_a_place(docs, corpus, capacity):
    rows = docs(corpus)
    placed = packing.pack_documents(rows, PATH, capacity=capacity).collect()
    plain = Tokenizer.from_file(PATH)
    want = Counter()
    for i, text in corpus:
        own = np.array(plain.encode(text or "", add_special_tokens=False).ids + [2], "<u4")
        first = len(own) % capacity or capacity
        cuts = [0, *range(first, len(own) + 1, capacity)]
        for n, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            want[i, n, a, b - a, zlib.crc32(own[a:b].tobytes())] += 1
    no_id = packing.texts.__globals__["NO_ID"]
    have = Counter((None if r["id"] == no_id else r["id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in placed)
    assert have == want
    fill = {}
    for r in sorted(placed, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == fill.get(r["sequence_id"], 0)
        fill[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(fill.values()) <= capacity


def test_sequences_hold_the_ids(docs):
    rows = docs([(1, "some words"), (2, "other words here"), (3, None)])
    packed = packing.sequences(rows, packing.pack_documents(rows, PATH), PATH).collect()
    assert len(packed) == 1 and sorted(packed[0]["ids"]).count(2) == 3


def test_no_documents(docs):
    assert packing.pack_documents(docs([]), PATH).count() == 0


def best(items, capacity):
    """Fewest bins by trying everything."""
    items = sorted(items, reverse=True)
    found = [len(items)]

    def place(k, bins):
        if len(bins) >= found[0]:
            return
        if k == len(items):
            found[0] = len(bins)
            return
        for b in range(len(bins)):
            if bins[b] + items[k] <= capacity and bins[b] not in bins[:b]:
                place(k + 1, [*bins[:b], bins[b] + items[k], *bins[b + 1 :]])
        place(k + 1, [*bins, items[k]])

    place(0, [])
    return found[0]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=9))
def test_reduction_keeps_a_best_packing(items):
    fixed, rest = packing.reduce_instance(dict(Counter(items)), 20)
    left = [n for n, c in rest.items() for _ in range(c)]
    used = Counter({n: 0 for n in items})
    for times, bin_ in fixed:
        assert sum(bin_) <= 20
        for n in bin_:
            used[n] += times
    used.update(left)
    assert +used == Counter(items)
    assert sum(t for t, _ in fixed) + best(left, 20) == best(items, 20)


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 100), st.integers(1, 5000), max_size=30))
def test_plans_hold_all_items(counts):
    runs = packing.plan(dict(counts), 100)
    have = Counter()
    for times, items in runs:
        assert sum(items) <= 100
        for n in items:
            have[n] += times
    assert have == Counter(counts)
    # At most one sequence of a best-fit packing is less than half full.
    assert sum(t for t, _ in runs) <= 1 + 2 * sum(n * c for n, c in counts.items()) / 100
