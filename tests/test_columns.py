from __future__ import annotations

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from tallyhouse import functions as fn


def values(spark, texts, column):
    """`column` of each text, in order."""
    rows = spark.createDataFrame(list(enumerate(texts)), "n int, x string").select("n", column.alias("y")).collect()
    return [r["y"] for r in sorted(rows, key=lambda r: r["n"])]


@pytest.mark.parametrize(
    ("day", "texts"),
    [
        ("2024-01-15", ["2024-01-15", "2024-01-15 10:00", "2024-01-15T10:00Z", "2024-01-15junk", "  2024-01-15 "]),
        ("2024-01-02", ["1/2/2024", "01/02/2024", "1/2/24", " 1/2/24 ", "1/2/2024\n", "1/2/24\n"]),
        ("1975-01-02", ["1/2/75"]),
        ("1970-12-31", ["12/31/70"]),
        ("2069-12-31", ["12/31/69"]),
        (None, ["1/2/2024 10:00", "n/a", "", "   ", None, "2024-02-30", "4/31/2024", "1/2/124", "2024-1-5", "2024", "20240115"]),
    ],
)
def test_mixed_dates(spark, day, texts):
    expected = None if day is None else dt.date.fromisoformat(day)
    assert values(spark, texts, fn.parse_mixed_date(F.col("x"))) == [expected] * len(texts)


def test_ids(spark):
    texts = [" 007 ", "7", "X1", "", None, "1.5", "-3", "9" * 24, str(2**63 - 1), str(2**63)]
    assert values(spark, texts, fn.numeric_id(F.col("x"))) == [7, 7, *[None] * 6, 2**63 - 1, 2**63]
    wide = ["0", str(2**63), str(2**64 - 1), "00" + str(2**64 - 1), str(2**64), "9" * 24, " 0000000000000000000000012 ", "-1", None]
    numbers = [0, 2**63, 2**64 - 1, 2**64 - 1, None, None, 12, None, None]
    assert values(spark, wide, fn.numeric_id(F.col("x"))) == numbers
    keys = fn.id_key(F.col("x"))
    assert values(spark, wide, keys) == [n if n is None or n < 2**63 else n - 2**64 for n in numbers]
    assert values(spark, wide, fn.id_of_key(keys)) == numbers
    assert values(spark, texts[:5], fn.is_numeric_id(F.col("x"))) == [True, True, False, False, False]


def test_blanks(spark):
    texts = ["a", " a ", "", "  ", None, "\t"]
    assert values(spark, texts, fn.is_blank(F.col("x"))) == [False, False, True, True, True, False]
    assert values(spark, texts, fn.or_unknown(F.col("x"))) == ["a", "a", *["Unknown/Blank"] * 4]
    assert values(spark, ["\t a\u00a0b \n", "\u3000", "\ufeffx"], fn.or_unknown(F.col("x"))) == ["a\u00a0b", "Unknown/Blank", "x"]


def test_age(spark):
    born = F.lit("2004-02-29").cast("date")
    row = spark.range(1).select(
        fn.age_years(born, F.lit("2022-02-28").cast("date")).alias("a"),
        fn.age_years(born, F.lit("2022-03-01").cast("date")).alias("b"),
        fn.age_group(born, F.lit("2003-01-01").cast("date")).alias("c"),
    ).first()
    assert (row["a"], row["b"], row["c"]) == (17, 18, "Invalid (DOB in future)")


def test_age_bands(spark):
    day = F.lit("2022-06-15").cast("date")
    born = ["2004-06-16", "2004-06-15", "1957-06-16", "1957-06-15", "2022-06-15", "2022-06-16", None]
    assert values(spark, born, fn.age_group(F.col("x").cast("date"), day)) == [
        "Under 18", "18-64", "18-64", "65+", "Under 18", "Invalid (DOB in future)", "Unknown/Blank",
    ]


def test_percents(spark):
    df = spark.createDataFrame([(1, 3), (5, 0), (0, 7), (1, 800), (None, 4)], "n bigint, d bigint")
    rows = df.select(fn.safe_pct(F.col("n"), F.col("d")).alias("a"), fn.pct2(F.col("n"), F.col("d")).alias("b")).collect()
    assert [r["a"] for r in rows[:4]] == [100 / 3, 0.0, 0.0, 0.125]
    assert [r["b"] for r in rows[:4]] == [33.33, 0.0, 0.0, 0.13]


def test_plain_numbers(spark):
    numbers = [100.0, 0.0, 12.5, 100 / 3, 0.0001234, 1e-7, 12345678.0, 1e18, 123456789e13, 1e21, 1.5e-25, -2.5e300, 1e-6, 4.5e-10]
    numbers += [float("nan"), float("inf"), float("-inf"), -0.0, -3.0, 1234567890123456.8, None]
    df = spark.createDataFrame([(n,) for n in numbers], "x double")
    got = [r[0] for r in df.select(fn.plain_number(F.col("x"))).collect()]
    assert got == ["100", "0", "12.5", "33.333333333333336", "0.0001234", "1e-7", "12345678"] + [
        *["1000000000000000000", "1.23456789e+21", "1e+21", "1.5e-25", "-2.5e+300", "0.000001", "4.5e-10"],
        *["NaN", "Infinity", "-Infinity", "0", "-3", "1234567890123456.8", None],
    ]


def test_months(spark):
    row = spark.sql("SELECT date'2024-03-31' AS d").select(fn.month_start(F.col("d")), fn.month_label(F.col("d"))).first()
    assert tuple(row) == (dt.date(2024, 3, 1), "2024-03")


@pytest.mark.parametrize(
    ("given", "limit"),
    [(10.9, 10), (0, 1), (-5, 1), (5000, 2000), (200000, 2000), ("77", 77), ("x", 200), (math.nan, 200), (math.inf, 200), (None, 1)],
)
def test_limits(given, limit):
    assert fn.clamp_limit(given) == limit


GENDER = {
    "Male": ["Male", "Cis man", "Man/Woman"],
    "Female": ["Woman", "woman (cis)", "Female"],
    "Transgender": ["Trans man", "Transgender female"],
    "Non-binary / Genderqueer": ["Non-Binary", "enby", "Genderqueer"],
    "Other/Unmapped": [" male ", "F", "human", "Mankind", "non binary"],
    "Unknown/Blank": ["  ", None],
}
RACE = {
    "Asian": ["Caucasian", "Asian"],
    "White": ["White"],
    "Black/African American": ["Black", "African American", "Middle Eastern/North African", "Multiracial: Black/White"],
    "Native Hawaiian/Pacific Islander": ["Native Hawaiian", "Other Pacific"],
    "American Indian/Alaska Native": ["American Indian", "Native American"],
    "Middle Eastern/North African": ["Middle Eastern"],
    "Multiracial/Two+": ["Two or more"],
    "Other/Unmapped": ["MENA", "Declined"],
}
ETHNICITY = {
    "Latino/Hispanic": ["Hispanic", "Latina", "Not Hispanic or Latino", "Non-Hispanic", "Platinum"],
    "Not Latino/Hispanic": ["Declined"],
    "Unknown/Blank": [None],
}
SEX = {"M": ["M"], "F": ["F"], "X": ["X"], "U": ["U"], "Other/Unmapped": ["m", "Intersex", " M"], "Unknown/Blank": ["", None]}


@pytest.mark.parametrize(
    ("name", "expected"),
    [("gender_identity", GENDER), ("race", RACE), ("ethnicity", ETHNICITY), ("sex_at_birth", SEX)],
)
def test_classes(spark, name, expected):
    texts = [t for group in expected.values() for t in group]
    labels = [label for label, group in expected.items() for _ in group]
    assert values(spark, texts, fn.classify(F.col("x"), fn.DEFAULT_RULES[name])) == labels


def test_once_evaluates_before_filters(spark):
    df = fn.once(spark.range(5), (F.col("id") * 2).alias("twice")).filter("twice > 4")
    assert sorted(r["twice"] for r in df.collect()) == [6, 8]
