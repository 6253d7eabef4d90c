"""Collocations against brute force and SQL; the automata against plain dictionaries."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from checks.compare import difference, oracle_connection
from tallyhouse.llm import collocations as co
from tallyhouse.llm.queries import SQL, op12_collocations
from tests.conftest import MIDDLE, SMALL


def brute_force(rows, least=3, top=2000):
    """Whole counting in dictionaries; scores in whole numbers of any size."""
    counts, total = {}, Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        own = counts.setdefault(lang, Counter())
        for piece in re.split(r"[.,;:!?\n\x0b\x0c\r]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            words = re.findall(r"[^ \t]+", piece)
            total[lang] += len(words)
            for k in range(len(words)):
                own.update(tuple(words[k : k + n]) for n in range(1, 5) if k + n <= len(words))
    out = []
    for lang, own in counts.items():
        held = {p: a for p, a in own.items() if len(p) > 1 and a >= least}
        gone = {
            q[i : i + n] for q, f in held.items() for n in range(2, len(q)) for i in range(len(q) - n + 1) if 100 * f >= 80 * own[q[i : i + n]]
        }
        found = []
        for p, a in held.items():
            if p not in gone:
                score, k = min((2_000_000 * a // (own[p[:k]] + own[p[k:]]), k) for k in range(1, len(p)))
                found.append((-score, -a, " ".join(p).encode(), own[p[:k]], own[p[k:]]))
        out += [(lang, rank, p.decode(), -a, left, right, total[lang], -s) for rank, (s, a, p, left, right) in enumerate(sorted(found)[:top], 1)]
    return sorted(out)


def run(table, **settings):
    found = co.collocations(table, **{"least": 3, **settings})
    assert found.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    return sorted(tuple(r) for r in found.collect())


def made(draw, number=60):
    vocabulary = [*"abcdefg", "Über", "ümlaut", "the", "The", "x\xa0y", "日本", "o'clock"]
    glue = [" ", " ", " ", " ", "\t", "  ", ". ", ",", "\n", "?!"]
    text = lambda: "".join(draw.choice(vocabulary) + draw.choice(glue) for _ in range(draw.randint(0, 60)))
    return [(k, text(), draw.choice(["en", "de", None, "und", ""])) for k in range(number)]


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, docs, monkeypatch, seed):
    """With small ranges, so that phrases go on over their ends."""
    monkeypatch.setattr(co, "RANGE_BYTES", 300)
    rows = made(random.Random(seed))
    rows += [(100, None, "en"), (101, "", "en"), (102, " \t.,", "fr"), rows[0], rows[0], (None, rows[1][1], "de"), (103, "one", "it")]
    assert run(docs(rows)) == brute_force(rows)


def test_one_phrase_in_most_rows(spark, docs, monkeypatch):
    monkeypatch.setattr(co, "RANGE_BYTES", 500)
    rows = [(k, "hot pair here now " * 20 + f"tail {k % 7}", "en") for k in range(40)] + made(random.Random(5), 20)
    assert run(docs(rows)) == brute_force(rows)


def test_one_range_and_a_long_text(spark, docs):
    rows = [(1, " ".join(random.Random(6).choice("abcdefghij") for _ in range(20_000)), "en"), (2, "w" * 100_000 + " end", "en")]
    assert run(docs(rows), least=50) == brute_force(rows, least=50)


def test_only_the_first_rows_are_returned(spark, docs):
    rows = made(random.Random(7), 80)
    assert run(docs(rows), top=4) == brute_force(rows, top=4)


def test_empty_tables(spark, docs):
    assert run(docs([])) == []
    assert run(docs([(1, None, None), (2, "", "en")])) == []


PATHS = st.dictionaries(st.tuples(*[st.integers(0, 4)] * 4), st.integers(1, 300), max_size=60)


@settings(max_examples=150, deadline=None)
@given(PATHS, st.lists(st.tuples(*[st.integers(-1, 6)] * 4), max_size=20))
def test_automata_hold_their_paths(held, wanted):
    keys = sorted(held)
    paths = np.array(keys, np.int64).reshape(-1, 4)
    one = co.CountTransducer.from_sorted(paths, np.array([held[k] for k in keys], np.int64))
    again = co.CountTransducer.unpack(one.pack())
    found, weights = again.paths()
    assert found.tolist() == paths.tolist() and weights.tolist() == [held[k] for k in keys]
    assert again.compose(np.array(wanted, np.int64).reshape(-1, 4)).tolist() == [held.get(w, 0) for w in wanted]


def test_states_with_one_way_on_are_shared():
    paths = np.array([(a, b, 1, 2) for a in range(20) for b in range(20)], np.int64)
    one = co.CountTransducer.from_sorted(paths, np.ones(len(paths), np.int64))
    assert [len(d) for d in one.degree] == [1, 20, 1, 1]


@settings(max_examples=50, deadline=None)
@given(st.lists(PATHS, max_size=4))
def test_union_adds_weights(many):
    total = Counter()
    for one in many:
        total.update(one)
    rows = [(k, w) for one in many for k, w in one.items()]
    paths, weights = co.unite(np.array([k for k, _ in rows], np.int64).reshape(-1, 4), np.array([w for _, w in rows], np.int64))
    assert list(zip(map(tuple, paths.tolist()), weights.tolist(), strict=True)) == sorted(total.items())


def test_scores_beyond_64_bits(spark, monkeypatch):
    """Counts so large that scale times count passes 64 bits."""
    counts = [("en", 0, "", 2**60), ("en", 1, "a", 2**55), ("en", 1, "b", 2**54), ("en", 2, "a b", 2**53 + 1)]
    monkeypatch.setattr(co, "frequent_phrases", lambda docs, longest, least: spark.createDataFrame(counts, co._COUNTS))
    assert run(spark.createDataFrame([], "text string, lang string")) == [
        ("en", 1, "a b", 2**53 + 1, 2**55, 2**54, 2**60, 2_000_000 * (2**53 + 1) // (2**55 + 2**54))
    ]


def test_windows_of_a_slice():
    batch = pa.RecordBatch.from_pydict({"text": ["A b c. D", "a b"], "lang": ["en", "en"]})
    symbols, paths, counts, _ = co.windows(batch, 3)
    words = [[symbols[i].as_py().decode() for i in p] for p in paths]
    assert list(zip(words, counts.tolist(), strict=True)) == [
        (["en", "a", "b", ""], 1), (["en", "a", "b", "c"], 1), (["en", "b", "", ""], 1), (["en", "b", "c", ""], 1), (["en", "c", "", ""], 1), (["en", "d", "", ""], 1)
    ]


@pytest.mark.parametrize("sf_dir", [SMALL, MIDDLE])
def test_equals_sql(spark, sf_dir):
    found = op12_collocations(spark, sf_dir)
    theirs = oracle_connection(sf_dir).sql(SQL["op12_collocations"])
    assert difference(found.columns, [tuple(r) for r in found.collect()], list(theirs.columns), theirs.fetchall()) is None
