from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tallyhouse.operators.quality import (
    multi_dob_names,
    multi_dob_people,
    similar_full_names,
    similar_name_pairs,
    sound_key,
)
from tallyhouse.schemas import PERSON


def people(spark, rows):
    return spark.createDataFrame(
        [(i, None, None, None, first, last, dob, *[None] * 6) for i, first, last, dob in rows], PERSON
    )


DAY, OTHER_DAY = dt.date(1980, 1, 1), dt.date(1981, 1, 1)


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        previous, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            previous, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, previous + (x != y))
    return row[-1]


def ratio(a, b):
    return 1 - edit_distance(a, b) / max(len(a), len(b))


@pytest.fixture(scope="module")
def crowd(spark):
    """Short names over few letters: many near pairs of all kinds."""
    draw = random.Random(5)
    name = lambda: "".join(draw.choice("abn") for _ in range(draw.randint(1, 9)))
    rows = [(i, name(), name(), draw.choice([DAY, OTHER_DAY, None])) for i in range(160)]
    base = [(r[1], r[2]) for r in rows[:60]]
    for i, (first, last) in enumerate(base):
        at = draw.randrange(len(last))
        rows.append((1000 + i, first, last[:at] + draw.choice("abn") + last[at + 1 :] + draw.choice(["", "a"]), DAY))
        rows.append((2000 + i, first.upper() + " ", last, draw.choice([DAY, OTHER_DAY])))
    return rows, people(spark, rows).cache()


@pytest.mark.parametrize("same_dob", [True, False])
@pytest.mark.parametrize(("min_first", "min_last"), [(0.9, 0.9), (0.75, 0.6), (0.5, 0.8), (0.4, 0.5), (0.0, 0.85)])
def test_pairs_against_brute_force(spark, crowd, same_dob, min_first, min_last):
    rows, person = crowd
    groups = {}
    for i, first, last, dob in rows:
        if dob is not None or not same_dob:
            groups.setdefault((last.strip().lower(), first.strip().lower(), dob if same_dob else None), []).append(i)
    expected = {}
    keys = sorted(groups, key=lambda g: (g[0], g[1], str(g[2])))
    for x, a in enumerate(keys):
        n = len(groups[a])
        if n > 1:
            expected[a[1], a[0], a[1], a[0], a[2]] = n * (n - 1) // 2
        for b in keys[x + 1 :]:
            if a[2] == b[2] and ratio(a[1], b[1]) >= min_first and ratio(a[0], b[0]) >= min_last:
                expected[a[1], a[0], b[1], b[0], a[2]] = n * len(groups[b])
    got = similar_name_pairs(person, min_first, min_last, same_dob, use_soundex=False).collect()
    found = {
        (r["first_name_a"], r["last_name_a"], r["first_name_b"], r["last_name_b"], r["dob"] if same_dob else None): r["person_pairs"]
        for r in got
    }
    assert len(found) == len(got)
    assert found == expected


def test_sound_is_a_filter(spark):
    person = people(spark, [(1, "Jon", "Smith", DAY), (2, "John", "Smyth", DAY), (3, "Jan", "Smitz", DAY), (4, "Tom", "Smith", DAY)])
    both = lambda sound: {
        (r["first_name_a"], r["first_name_b"]) for r in similar_name_pairs(person, 0.6, 0.6, True, sound).collect()
    }
    assert both(True) == {("jon", "john")}
    assert both(False) == {("jon", "john"), ("jon", "jan")}


def test_accents_are_folded_for_sound(spark):
    df = spark.createDataFrame([("Núñez",), ("nunez",), ("Óscar",), ("Oscar",)], "x string").select(sound_key(F.col("x")))
    codes = [r[0] for r in df.collect()]
    assert codes[0] == codes[1] and codes[2] == codes[3]


def test_many_bearers_of_one_name_make_one_row(spark):
    person = people(spark, [(i, "Unknown", "Unknown", DAY) for i in range(1000)] + [(5000, "Unknown", "Unknow", DAY)])
    rows = similar_full_names(person, 0.8, 0.8, True, True).collect()
    assert [(r["person_id_a"], r["person_id_b"], r["person_pairs"]) for r in rows] == [(0, 999, 499500), (5000, 0, 1000)]


def test_best_pairs_come_first_and_limits_hold(spark, crowd):
    _, person = crowd
    rows = similar_full_names(person, 0.5, 0.5, False, False, limit=7).collect()
    scores = [r["ratio_first"] + r["ratio_last"] for r in rows]
    assert len(rows) == 7 and scores == sorted(scores, reverse=True)
    with pytest.raises(ValueError, match="finite"):
        similar_full_names(person, float("nan"))
    with pytest.raises(ValueError, match="every name is alike"):
        similar_full_names(person, 0, 0, False, False)
    assert similar_name_pairs(person, 1.5, 0.5).count() == 0


@pytest.mark.parametrize("limit", [5, 2000])
def test_best_pairs_with_a_low_minimum(spark, crowd, limit):
    """Enough good pairs (5), or not (2000): the answer is the top of all pairs either way."""
    _, person = crowd
    pairs = similar_name_pairs(person, 0.5, 0.4, True, False).collect()
    expected = sorted(
        ((-(r["ratio_first"] + r["ratio_last"]), r["last_name_a"], r["first_name_a"], r["last_name_b"], r["first_name_b"], r["dob"]) for r in pairs)
    )[:limit]
    got = similar_full_names(person, 0.5, 0.4, True, False, limit).collect()
    assert [(r["last_name_a"], r["first_name_a"], r["last_name_b"], r["first_name_b"], r["dob"]) for r in got] == [e[1:] for e in expected]


def test_names_with_several_dates(spark, hot_keys_from):
    person = people(
        spark,
        [(1, "Ann", "Lee", DAY), (2, " ann", "LEE ", OTHER_DAY), (3, "Ann", "Lee", None), (4, "Bob", "Lee", DAY), (5, "Bob", "Lee", DAY)]
        + [(6, "", "Lee", DAY), (7, "", "Lee", OTHER_DAY)],
    )
    expected = [(1, 2), (2, 2), (3, 2)]
    assert sorted((r["person_id"], r["dob_count"]) for r in multi_dob_people(person).collect()) == expected
    hot_keys_from(2)
    assert sorted((r["person_id"], r["dob_count"]) for r in multi_dob_people(person).collect()) == expected
    assert [r["person_id"] for r in multi_dob_names(person, 2).collect()] == [3, 1]


def test_the_top_list_compares_fewer_names(spark, monkeypatch):
    """Many similar names, of which the best are nearly equal: the list is found at a high ratio, where fewer pairs meet, and is the same."""
    from tallyhouse.operators import quality

    draw = random.Random(3)
    last = ["".join(draw.choice("abcdef") for _ in range(20)) for _ in range(60)]
    rows = [(k, None, None, None, "Lee", last[k % 60] + "xyz"[k // 60 % 3] * (k >= 60), None, *[None] * 6) for k in range(200)]
    people = spark.createDataFrame(rows, PERSON)
    key = lambda df: [tuple(r) for r in df.collect()]
    compared = []
    real = quality.name_candidates

    def counting(*args):
        names, met = real(*args)
        compared.append((args[1], met.count()))
        return names, met

    monkeypatch.setattr(quality, "name_candidates", counting)
    stepwise = key(similar_full_names(people, 0.5, 0.5, False, False, limit=40))
    steps = list(compared)
    monkeypatch.setattr(quality, "STEPS", ())
    compared.clear()
    assert key(similar_full_names(people, 0.5, 0.5, False, False, limit=40)) == stepwise and len(stepwise) == 40
    # One step, at a high ratio.
    assert len(steps) == 1 and steps[0][0] > 0.9 and steps[0][1] < compared[0][1] / 3
