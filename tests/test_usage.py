from __future__ import annotations

import datetime as dt
import io
from contextlib import redirect_stdout

import pytest
from pyspark.sql import functions as F

from checks import fixtures as fx
from tallyhouse.operators import events
from tallyhouse.operators.overlap import MEASURES
from tallyhouse.operators.windows import month_spine, report_window
from tallyhouse.plans.metrics import cross_service_monthly
from tallyhouse.schemas import CLINIC_EXPORT, HOUSEHOLD, PANTRY_EXPORT, PERSON, PHARMACY_EXPORT
from tests.conftest import MIDDLE, SMALL

# Pantry, clinic and pharmacy served; pharmacy with pantry, with household pantry; clinic with household pantry, with pharmacy.
GOLDEN = {
    SMALL: {
        "2000-07": (12, 3, 4, 1, 1, 0, 0), "2000-08": (3, 1, 3, 0, 0, 0, 0), "2000-09": (4, 5, 1, 0, 0, 0, 0),
        "2000-10": (9, 5, 0, 0, 0, 0, 0), "2000-11": (20, 4, 0, 0, 0, 2, 0), "2000-12": (17, 2, 3, 0, 0, 0, 0),
        "2001-01": (9, 0, 5, 0, 1, 0, 0), "2001-02": (8, 1, 2, 0, 0, 0, 0), "2001-03": (3, 2, 3, 0, 0, 0, 0),
        "2001-04": (16, 5, 2, 0, 0, 2, 0), "2001-05": (11, 3, 2, 0, 1, 0, 0), "2001-06": (8, 3, 3, 0, 1, 0, 0),
        "ANNUAL": (74, 32, 24, 8, 14, 17, 3),
    },
    MIDDLE: {
        "2000-07": (75, 32, 28, 0, 1, 0, 2), "2000-08": (101, 37, 28, 2, 4, 3, 2), "2000-09": (67, 33, 33, 1, 3, 0, 1),
        "2000-10": (102, 58, 39, 3, 4, 6, 0), "2000-11": (109, 43, 35, 2, 3, 7, 1), "2000-12": (102, 47, 33, 0, 2, 5, 1),
        "2001-01": (77, 36, 43, 0, 6, 3, 1), "2001-02": (88, 36, 28, 1, 1, 2, 0), "2001-03": (66, 43, 32, 1, 2, 1, 3),
        "2001-04": (85, 42, 28, 0, 1, 4, 2), "2001-05": (95, 35, 33, 2, 3, 2, 5), "2001-06": (87, 39, 36, 0, 1, 1, 0),
        "ANNUAL": (752, 412, 336, 80, 178, 203, 103),
    },
}


def numbers(df):
    return {r["period"]: tuple(r[m] for m in MEASURES) for r in df.collect()}


def usage(spark, sf_dir, **kwargs):
    return cross_service_monthly(
        fx.exports(spark, sf_dir), fx.person(spark, sf_dir), fx.household(spark, sf_dir), fx.AS_OF, **kwargs
    )


@pytest.mark.parametrize("sf_dir", [SMALL, MIDDLE])
def test_golden_numbers(spark, sf_dir):
    df = usage(spark, sf_dir)
    assert numbers(df) == GOLDEN[sf_dir]
    assert [r["period"] for r in df.collect()] == list(GOLDEN[sf_dir])
    assert all(r[f"{m}_pct"] is not None for r in df.collect() for m in list(MEASURES)[3:])


def test_hot_keys_do_not_change_the_numbers(spark, hot_keys_from):
    hot_keys_from(2)
    assert numbers(usage(spark, SMALL)) == GOLDEN[SMALL]


def test_repeated_rows_do_not_change_the_numbers(spark):
    twice = {s: df.unionByName(df) for s, df in fx.exports(spark, SMALL).items()}
    df = cross_service_monthly(twice, fx.person(spark, SMALL), fx.household(spark, SMALL), fx.AS_OF)
    assert numbers(df) == GOLDEN[SMALL]


def test_every_export_is_scanned_once(spark):
    df = usage(spark, MIDDLE)
    df.collect()
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain()
    final = out.getvalue().split("\n+- == Initial Plan ==")[0]  # of the whole, not of a subquery
    scans = [line for line in final.splitlines() if "FileScan" in line and "orders.parquet" in line]
    assert len(scans) == 3
    assert "ReusedExchange" in final
    assert "CartesianProduct" not in final and "NestedLoop" not in final


def test_bounds_hold(spark):
    rows = {r["period"]: r for r in usage(spark, MIDDLE).collect()}
    months = [r for p, r in rows.items() if p != "ANNUAL"]
    for row in rows.values():
        assert row["pharmacy_and_pantry"] <= row["pharmacy_and_household_pantry"] <= row["pharmacy_served_total"]
        assert row["clinic_and_household_pantry"] <= row["clinic_served_total"]
    for total in list(MEASURES)[:3]:
        assert max(r[total] for r in months) <= rows["ANNUAL"][total] <= sum(r[total] for r in months)


def frames(spark, pantry=(), pharmacy=(), clinic=(), person=(), household=()):
    exports = {
        "pantry": spark.createDataFrame(list(pantry), PANTRY_EXPORT),
        "pharmacy": spark.createDataFrame(list(pharmacy), PHARMACY_EXPORT),
        "clinic": spark.createDataFrame(list(clinic), CLINIC_EXPORT),
    }
    people = [(*ids, *[None] * (len(PERSON) - 4)) for ids in person]
    return exports, spark.createDataFrame(people, PERSON), spark.createDataFrame(list(household), HOUSEHOLD)


def test_nothing_at_all_gives_thirteen_rows_of_zero(spark):
    df = cross_service_monthly(*frames(spark), as_of=dt.date(2024, 3, 31))
    rows = df.collect()
    assert [r["period"] for r in rows] == [f"2023-{m:02d}" for m in range(4, 13)] + ["2024-01", "2024-02", "2024-03", "ANNUAL"]
    assert all(value == 0 for r in rows for value in tuple(r)[1:])


def test_shared_ids_households_and_other_months(spark):
    exports, person, household = frames(
        spark,
        pantry=[("1", "2024-02-29"), (" 001 ", "2/3/24"), ("1", "2023-02-28"), ("1", "2024-03-01")],
        pharmacy=[("5", "2024-01-10"), ("6", "2024-02-01")],
        clinic=[("9", "2024-02-10 08:00")],
        # Two persons share the pantry id; 12 lives with 10, 13 in a second household of 12.
        person=[(10, 1, None, None), (11, 1, 5, None), (12, None, 6, None), (13, None, None, 9)],
        household=[(100, 10), (100, 12), (200, 12), (200, 13)],
    )
    rows = numbers(cross_service_monthly(exports, person, household, as_of="2024-02-29"))
    assert rows["2024-02"] == (3, 1, 1, 0, 1, 0, 0)
    assert rows["2024-01"] == (0, 0, 1, 0, 0, 0, 0)
    assert rows["2023-03"] == (0,) * 7
    # Person 11 went to both, in different months.
    assert rows["ANNUAL"] == (3, 1, 2, 1, 2, 0, 0)


def test_other_window_lengths(spark):
    longest = numbers(usage(spark, SMALL, months=15))
    assert len(longest) == 16
    assert {p: longest[p] for p in GOLDEN[SMALL] if p != "ANNUAL"} == {p: n for p, n in GOLDEN[SMALL].items() if p != "ANNUAL"}
    assert numbers(usage(spark, SMALL, months=1))["2001-06"] == GOLDEN[SMALL]["2001-06"]
    assert {p: n for p, n in numbers(usage(spark, SMALL, months=40)).items() if p in longest and p != "ANNUAL"} == {p: n for p, n in longest.items() if p != "ANNUAL"}
    with pytest.raises(ValueError, match="one month or more"):
        usage(spark, SMALL, months=0)


@pytest.mark.parametrize(
    ("as_of", "start", "end"),
    [("2024-02-29", (2023, 3, 1), (2024, 3, 1)), ("2024-12-31", (2024, 1, 1), (2025, 1, 1)), ("2024-01-01", (2023, 2, 1), (2024, 2, 1))],
)
def test_window(spark, as_of, start, end):
    row = spark.range(1).select(*report_window(as_of)).first()
    assert tuple(row) == (dt.date(*start), dt.date(*end))
    spine = month_spine(spark, as_of).collect()
    assert [r["month_index"] for r in spine] == list(range(12))
    assert spine[0]["month"] == dt.date(*start)


def test_window_ends_today_unless_told_otherwise(spark):
    row = spark.range(1).select(*report_window()).first()
    assert row[0] <= dt.date.today() < row[1] + dt.timedelta(days=1)


def test_store_prunes_months(spark, tmp_path):
    path = str(tmp_path / "events")
    start, end = report_window(fx.AS_OF)
    events.save_typed_events(events.typed_events(fx.exports(spark, SMALL)), path)
    stored = events.load_typed_events(spark, path, start, end)
    fresh = events.typed_events(fx.exports(spark, SMALL))
    for service, df in stored.items():
        assert df.count() == fresh[service].filter((F.col("event_date") >= start) & (F.col("event_date") < end)).count()
    out = io.StringIO()
    with redirect_stdout(out):
        stored["pantry"].explain("formatted")
    assert "PartitionFilters: [isnotnull(month" in out.getvalue()
    assert "EqualTo(service,pantry)" in out.getvalue()


def test_rejected_events(spark):
    exports, *_ = frames(
        spark,
        pantry=[("x", "n/a"), (None, "2024-01-01"), ("1", ""), ("1", "1/2/2024 10:00"), ("1", "2024-01-01")],
        clinic=[("  ", None)],
    )
    got = {(r["source"], r["reason"]): r["count"] for r in events.rejected_events(exports).collect()}
    assert got == {
        ("pantry_export", "id is not numeric"): 1,
        ("pantry_export", "blank id"): 1,
        ("pantry_export", "blank date"): 1,
        ("pantry_export", "date not understood"): 1,
        ("clinic_dob_export", "blank id"): 1,
    }


def test_unknown_service_is_refused(spark):
    with pytest.raises(ValueError, match="unknown"):
        events.typed_events({"dentist": spark.range(1)})
