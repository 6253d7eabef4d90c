"""Hard negatives against brute force, and the intervals against exact scores."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from checks.compare import difference, oracle_connection
from tallyhouse.llm import hard_negatives as hn
from tallyhouse.llm.queries import SQL, op11_hard_negatives
from tests.conftest import MIDDLE, SMALL

SCHEMA = "vec_id bigint, label int, embedding array<float>, score string, block string, at string, rank string"


def table(spark, rows):
    return spark.createDataFrame([(*r, *["x"] * 4) for r in rows], SCHEMA)


def brute_force(rows, every=3, positives=5, negatives=3):
    """Rows as a set by id and score, all scores in whole numbers."""
    whole = []
    for i, label, v in rows:
        if label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        whole.append((i, label, [math.floor(256 * float(np.float32(x))) for x in v]))
    out = set()
    order = lambda found: sorted(found, key=lambda f: (-f[0], math.inf if f[1] is None else f[1]))
    for i, label, v in whole:
        if i is None or i % every:
            continue
        scores = lambda same: {
            (sum(a * b for a, b in zip(v, w, strict=False)), j) for j, other, w in whole if (other == label) == same and (j != i or not same)
        }
        ranked = order(scores(False))
        for score, positive in order(scores(True))[:positives]:
            fitting = [n for n in ranked if 50 * score <= 100 * n[0] <= 95 * score][:negatives]
            out |= {(i, positive, rank, n, score, s) for rank, (s, n) in enumerate(fitting, 1)}
    return out


def made(draw, number, size, labels=3):
    centres = [[draw.gauss(0, 1) for _ in range(size)] for _ in range(4)]
    return [(i, draw.randrange(labels), [c + draw.gauss(0, 0.5) for c in draw.choice(centres)]) for i in range(number)]


def run(spark, rows, every=3):
    found = hn.hard_negatives(table(spark, rows), F.col("vec_id") % every == 0)
    assert found.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    rows = [tuple(r) for r in found.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.mark.parametrize("size", [1, 64, 70])
def test_equals_brute_force(spark, monkeypatch, size):
    monkeypatch.setattr(hn, "BLOCK_ROWS", 40)
    monkeypatch.setattr(hn, "BLOCK_ANCHORS", 16)
    draw = random.Random(size)
    rows = made(draw, 160, size)
    assert run(spark, rows) == brute_force(rows)


def test_many_anchor_blocks_are_dealt(spark, monkeypatch):
    """Beyond the bound for a broadcast both sides are shuffled; the rows are the same."""
    monkeypatch.setattr(hn, "BLOCK_ANCHORS", 2)
    monkeypatch.setattr(hn, "BROADCAST_BLOCKS", 3)
    rows = made(random.Random(4), 90, 8)
    assert run(spark, rows) == brute_force(rows)


def test_odd_rows(spark):
    """Nulls, non-finite numbers, ties, repeated rows, equal vectors, ids given twice, a null id, empty and short vectors, huge numbers."""
    nan, inf = float("nan"), float("inf")
    rows = made(random.Random(8), 40, 4)
    rows += [(50, None, [1.0] * 4), (51, 1, None), (54, 1, [1.0, None, 1.0, 1.0]), (57, 1, [nan] * 4), (60, 2, [inf, 0.0, 0.0, 0.0])]
    rows += [rows[3], rows[3], (3, 1, [0.5, 0.5, 0.5, 0.5]), (None, 1, [1.0, 1.0, 1.0, 1.0]), (66, 0, []), (69, 1, [2.0]), (72, 1, [0.0] * 4)]
    rows += [(100 + k, k % 3, [1.0, 1.0, 1.0, 1.0]) for k in range(12)]
    assert run(spark, rows) == brute_force(rows)
    assert run(spark, [(i, label, v and [None if x is None else x * 1e6 for x in v]) for i, label, v in rows]) == brute_force(
        [(i, label, v and [None if x is None else x * 1e6 for x in v]) for i, label, v in rows]
    )


def test_scores_beyond_64_bits_are_cut():
    one = np.full((1, 4), 1 << 62, np.int64)
    assert hn.exact_scores(one, one)[0, 0] == (1 << 63) - 1 and hn.exact_scores(one, -one)[0, 0] == -(1 << 63)


def test_empty_table(spark):
    assert run(spark, []) == set()
    assert run(spark, [(1, 1, [1.0]), (2, None, None)]) == set()


@pytest.mark.parametrize("size", [2, 64, 100])
def test_intervals_hold_every_score(size):
    draw = np.random.default_rng(size)
    rows, anchors = (np.floor(draw.standard_normal((n, size)) * draw.choice([1, 300, 10_000], (n, 1))).astype(np.int64) for n in (400, 30))
    rows[:20], anchors[0], rows[20] = 0, 0, anchors[1]
    turn = hn.rotation(size)
    low, high = hn.intervals(anchors, turn, *hn.encode_rows(rows, turn))
    exact = hn.exact_scores(anchors, rows)
    assert (low <= exact).all() and (exact <= high).all()
    if size > 2:
        bound = np.linalg.norm(anchors, axis=1)[:, None] * np.linalg.norm(rows, axis=1)[None, :]
        assert np.median((high - low)[2:, 21:] / (2 * bound[2:, 21:])) < 0.6


@pytest.mark.parametrize("sf_dir", [SMALL, MIDDLE])
def test_equals_sql(spark, sf_dir):
    found = op11_hard_negatives(spark, sf_dir)
    theirs = oracle_connection(sf_dir).sql(SQL["op11_hard_negatives"])
    assert difference(found.columns, [tuple(r) for r in found.collect()], list(theirs.columns), theirs.fetchall()) is None
