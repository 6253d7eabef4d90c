from __future__ import annotations

import datetime as dt
import io
import re
from contextlib import redirect_stdout

from checks import fixtures as fx
from tallyhouse.plans.demographics import (
    CATEGORIES,
    category_counts,
    completeness_snapshot,
    demographics_profile,
    total_persons,
)
from tallyhouse.schemas import PERSON
from tests.conftest import MIDDLE


def people(spark, *rows):
    names = PERSON.fieldNames()
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], PERSON)


def test_nobody_gives_five_quality_rows(spark):
    rows = [tuple(r) for r in demographics_profile(people(spark), "2024-01-01").collect()]
    assert rows == [
        ("data_quality", f"Missing {x}", 0, 0.0) for x in ("DOB", "Ethnicity", "Gender Identity", "Race", "Sex at Birth")
    ]


def test_each_category_adds_up_to_all_persons(spark):
    person = fx.person(spark, MIDDLE)
    total = total_persons(person).first()["total_persons"]
    sums = {}
    for r in demographics_profile(person, fx.AS_OF).collect():
        sums[r["category"]] = sums.get(r["category"], 0) + r["count"]
    assert all(sums[c] == total for c in CATEGORIES)


def test_profile_of_a_few(spark):
    person = people(
        spark,
        {"person_id": 1, "dob": dt.date(2010, 1, 1), "race": "Caucasian", "primary_language": " English "},
        {"person_id": 2, "dob": dt.date(1950, 1, 1), "race": "white", "primary_language": "English"},
        {"person_id": 3, "dob": None, "race": " ", "primary_language": "english"},
    )
    got = {(r[0], r[1]): (r[2], r[3]) for r in demographics_profile(person, "2024-01-01").collect()}
    assert got["age_group", "Under 18"] == got["age_group", "65+"] == (1, 33.33)
    assert got["race_grouped", "Asian"] == got["race_grouped", "White"] == (1, 33.33)
    assert got["race_raw", "Unknown/Blank"] == (1, 33.33)
    assert got["primary_language", "English"] == (2, 66.67)
    assert got["primary_language", "english"] == (1, 33.33)
    assert got["data_quality", "Missing DOB"] == got["data_quality", "Missing Race"] == (1, 33.33)
    assert got["data_quality", "Missing Ethnicity"] == (3, 100.0)


def test_collation_joins_case(spark):
    person = people(spark, *[{"person_id": n, "primary_language": x} for n, x in enumerate(["english", "English", "ENGLISH"])])
    rows = category_counts(person, categories=("primary_language",), completeness=False, collation="UTF8_LCASE").collect()
    assert [tuple(r) for r in rows] == [("primary_language", "ENGLISH", 3)]


def test_persons_are_scanned_once(spark):
    df = demographics_profile(fx.person(spark, MIDDLE), fx.AS_OF)
    df.collect()
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain()
    # Only what ran is in generated code; the rest of the text is the plan before AQE.
    assert len(re.findall(r"\*\(\d+\) ColumnarToRow", out.getvalue())) == 1
    assert "ReusedExchange" in out.getvalue()
    assert "NestedLoop" not in out.getvalue() and "Cartesian" not in out.getvalue()


def test_completeness(spark):
    person = people(spark, {"person_id": 1, "sex_at_birth": "M"}, {"person_id": 2, "sex_at_birth": ""})
    got = {r["value"]: r["count"] for r in completeness_snapshot(person).collect()}
    assert got == {
        "Missing DOB": 2, "Missing Race": 2, "Missing Ethnicity": 2, "Missing Gender Identity": 2, "Missing Sex at Birth": 1,
    }
