"""Passages and strings that repeat, against brute force."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import numpy as np
import pytest

from tallyhouse.llm import induced, superkmers, suffix_dedup
from tallyhouse.llm.common import NO_ID

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_words_made_to_collide_are_told_apart(docs, twins):
    """Windows that differ in one such word, before and behind common ones."""
    common = " ".join(f"w{k}" for k in range(49))
    rows = [(1, f"{common} {twins[0]}"), (2, f"{common} {twins[1]}"), (3, f"{twins[1]} {common}"), (4, f"x {common} {twins[0]}")]
    got = Counter((r["id"], r["text"], r["n_words"], r["n_removed"]) for r in superkmers.remove_repeats(docs(rows), 50).collect())
    assert got == Counter(kept_words(rows, 50))


def test_strings_made_to_collide_are_told_apart(docs, twins):
    """Two long texts without a common string of 1,000 bytes."""
    rows = [(1, twins[0]), (2, twins[1]), (3, "z" + twins[0])]
    got = {r["id"]: (r["n_bytes"], r["n_removed"]) for r in suffix_dedup.remove_strings(docs(rows), 1000).collect()}
    assert got[3] == (2049, 2048)
    first = twins[0]
    covered = [False] * 2048
    for k in range(2048 - 1000 + 1):
        here = twins[1][k : k + 1000]
        if here in first or twins[1].find(here) < k:
            covered[k : k + 1000] = [True] * 1000
    assert got[2] == (2048, sum(covered))


def kept_words(rows, size):
    first = {}
    key = lambda i: NO_ID if i is None else i
    for i, text in rows:
        words = WORD.findall(text or "")
        for k in range(len(words) - size + 1):
            w = tuple(words[k : k + size])
            first[w] = min(first.get(w, key(i)), key(i))
    for i, text in rows:
        words = WORD.findall(text or "")
        gone = [False] * len(words)
        for k in range(len(words) - size + 1):
            if first[tuple(words[k : k + size])] < key(i):
                gone[k : k + size] = [True] * size
        yield key(i), " ".join(w for w, g in zip(words, gone, strict=True) if not g), len(words), sum(gone)


@pytest.mark.parametrize("size", [50, 7])
def test_passages(docs, corpus, size):
    got = Counter((r["id"], r["text"], r["n_words"], r["n_removed"]) for r in superkmers.remove_repeats(docs(corpus), size).collect())
    assert got == Counter(kept_words(corpus, size))


def test_frequent_grams_change_the_buckets_only(docs, corpus, monkeypatch):
    plain = Counter(map(tuple, superkmers.remove_repeats(docs(corpus), 12).collect()))
    level = np.random.default_rng(1).integers(0, 8, superkmers.CELLS).astype(np.uint8)
    monkeypatch.setattr(superkmers, "frequent_cells", lambda *_: level)
    assert Counter(map(tuple, superkmers.remove_repeats(docs(corpus), 12).collect())) == plain


def kept_bytes(rows, size):
    key = lambda i: NO_ID if i is None else i
    places = {}
    for i, text in dict.fromkeys(rows):
        data = (text or "").encode()
        for k in range(len(data) - size + 1):
            places.setdefault(data[k : k + size], []).append((key(i), data, k))
    least = {w: (min(p[0] for p in found), min((p[1], p[2]) for p in found)) for w, found in places.items()}
    start = {}
    for w, found in places.items():
        for i, data, k in found:
            start[w, i, data] = min(start.get((w, i, data), k), k)
    for i, text in rows:
        data = (text or "").encode()
        gone = [False] * len(data)
        for k in range(len(data) - size + 1):
            w = data[k : k + size]
            if least[w][0] < key(i) or start[w, key(i), data] < k:
                gone[k : k + size] = [True] * size
        spans = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        yield key(i), bytes(b for b, g in zip(data, gone, strict=True) if not g), len(data), sum(gone), spans


@pytest.mark.parametrize(("size", "gram"), [(100, 20), (30, 5)])
def test_strings(docs, corpus, size, gram):
    got = suffix_dedup.remove_strings(docs(corpus), size, gram).collect()
    have = Counter((r["id"], bytes(r["kept"]), r["n_bytes"], r["n_removed"], r["n_spans"]) for r in got)
    assert have == Counter(kept_bytes(corpus, size))


def test_texts_are_shuffled_once(docs, corpus, spark):
    """Rows of one id and different texts are told apart, though both joins go by the id."""
    rows = [*corpus, *[(i, f"{t} and more of it") for i, t in corpus[:20] if t]]
    settings = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        left = suffix_dedup.remove_strings(docs(rows), 30, 5)
        assert "ReusedExchange" in left._jdf.queryExecution().executedPlan().toString()
        have = Counter((r["id"], bytes(r["kept"]), r["n_bytes"], r["n_removed"], r["n_spans"]) for r in left.collect())
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert have == Counter(kept_bytes(rows, 30))


def test_empty_tables(docs):
    assert superkmers.remove_repeats(docs([])).count() == 0
    assert suffix_dedup.remove_strings(docs([])).count() == 0


def brute_order(text):
    zeros = np.flatnonzero(text == 0)[::-1]
    plain = text + len(zeros) - 1
    plain[zeros] = np.arange(len(zeros))
    plain = plain.tolist()
    return sorted(range(len(plain)), key=lambda k: plain[k:])


def test_suffixes_by_induction(monkeypatch):
    monkeypatch.setattr(induced, "SMALL", 3)
    draw = np.random.default_rng(3)
    for n in range(300):
        text = draw.integers(n % 2, int(draw.integers(2, 6)) + 1, int(draw.integers(1, 60)))
        if n % 3 == 0:
            text = np.tile(text[:5], 7)
        text = np.append(text, 0)
        assert induced.sort_suffixes(text, int(text.max()) + 1).tolist() == brute_order(text)


def test_the_text_is_induced_and_short_rows_of_names_are_doubled(monkeypatch):
    """Two rounds of two passes sort the text; names, however many letters they need, take no more of them."""
    text = np.append(np.tile(np.random.default_rng(5).integers(1, 9, 900), 4), 0)
    real, passes = induced._induce, []
    monkeypatch.setattr(induced, "_induce", lambda text, *more: passes.append(len(text)) or real(text, *more))
    plain = induced.sort_suffixes(text, 9)
    assert passes == [len(text)] * 4
    assert plain.tolist() == brute_order(text)
    monkeypatch.setattr(induced, "SMALL_NAMES", 3)
    assert (induced.sort_suffixes(text, 9) == plain).all() and len(passes) > 8


def test_queues_spill_to_disk(monkeypatch):
    text = np.append(np.random.default_rng(4).integers(1, 9, 4000), 0)
    plain = induced.sort_suffixes(text, 9)
    real = induced.DiskQueue
    monkeypatch.setattr(induced, "DiskQueue", lambda bins: real(bins, memory=500))
    assert (induced.sort_suffixes(text, 9) == plain).all()
    assert hashlib.sha256(plain.tobytes()).digest() == hashlib.sha256(np.array(brute_order(text)).tobytes()).digest()
