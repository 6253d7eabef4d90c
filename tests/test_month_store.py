"""Months as bits: windows of any length, and the store of all months, against plain sets of months."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tallyhouse.operators import month_store
from tallyhouse.operators.events import key_months, person_month_events
from tallyhouse.operators.windows import WORD_MONTHS, check_months, report_window, words
from tallyhouse.plans import metrics
from tallyhouse.schemas import HOUSEHOLD, PERSON

AS_OF = "2012-02-29"


def number(d):
    return d.year * 12 + d.month - 1


@pytest.fixture(scope="module")
def days():
    """(service, key, date) over forty years, some days twice, all around the ends of windows and stored words."""
    draw = random.Random(2)
    first = dt.date(1979, 12, 31)
    found = [(draw.choice(["pantry", "clinic", "pharmacy"]), draw.randrange(12), first + dt.timedelta(draw.randrange(15_000))) for _ in range(900)]
    edges = [dt.date(y, m, d) for y in (1999, 2000, 2004, 2005, 2010) for m, d in ((1, 1), (1, 31), (12, 1), (12, 31))]
    return [*found, *found[:50], *[("pantry", 20, d) for d in edges]]


def typed(spark, days):
    frame = spark.createDataFrame(days, "service string, key bigint, event_date date")
    return {s: frame.where(F.col("service") == s).select("key", "event_date") for s in ("pantry", "pharmacy", "clinic")}


def months_of(rows, months):
    """(service, key) and its set of month indexes from rows of words."""
    found = {}
    for r in rows.collect():
        bits = {k * WORD_MONTHS + b for k, w in enumerate(words("months", months)) for b in range(WORD_MONTHS) if r[w] >> b & 1}
        found.setdefault((r["service"], r["key"]), set()).update(bits)
    return {k: v for k, v in found.items() if v}


def expected(days, months):
    last = 2012 * 12 + 1
    found = {}
    for service, key, d in days:
        if last - months < number(d) <= last:
            found.setdefault((service, key), set()).add(number(d) - (last - months + 1))
    return found


@pytest.fixture(scope="module")
def store(spark, days, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("bits") / "store")
    for part in (days[::2], days[1::2], days[1::2]):
        month_store.add_month_bits(month_store.month_bits(typed(spark, part)), path)
    return path


@pytest.mark.parametrize("months", [1, 12, 15, 16, 36, 60, 61, 130, 400])
def test_any_window(spark, days, store, months):
    start, end = report_window(AS_OF, months)
    assert months_of(key_months(typed(spark, days), start, end, months), months) == expected(days, months)
    assert months_of(month_store.load_month_bits(spark, store, start, months), months) == expected(days, months)


def test_only_the_words_of_the_window_are_read(spark, store):
    start, _ = report_window(AS_OF, 12)
    plan = month_store.load_month_bits(spark, store, start, 12)._jdf.queryExecution().executedPlan().toString()
    pruned = plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "word" in pruned and "event_date" not in plan


def test_uniting_a_store_changes_no_report(spark, store, days, tmp_path):
    once = str(tmp_path / "once")
    month_store.add_month_bits(month_store.united_bits(spark, store), once)
    start, _ = report_window(AS_OF, 70)
    assert months_of(month_store.load_month_bits(spark, once, start, 70), 70) == expected(days, 70)
    assert spark.read.parquet(once).count() == len({(s, k, number(d) // 60) for s, k, d in days})


def test_person_months_of_three_years(spark):
    person = spark.createDataFrame([(1, 5, None, 7, *[None] * 9), (2, 5, None, None, *[None] * 9)], PERSON)
    exports = {
        "pantry": spark.createDataFrame([("5", d) for d in ("2009-02-28", "2009-03-01", "2012-02-29", "2012-03-01")], "`Client ID` string, `Visit Date` string"),
        "clinic": spark.createDataFrame([("7", "2010-06-15")], "patientid string, apptcheckindate string"),
    }
    found = person_month_events(exports, person, *report_window(AS_OF, 36), 36)
    assert {(r["service"], r["person_id"], str(r["month"])) for r in found.collect()} == {
        ("pantry", p, m) for p in (1, 2) for m in ("2009-03-01", "2012-02-01")
    } | {("clinic", 1, "2010-06-01")}
    household = spark.createDataFrame([(9, 1), (9, 3)], HOUSEHOLD)
    report = {r["period"]: r for r in metrics.cross_service_monthly(exports, person, household, AS_OF, 36).collect()}
    assert len(report) == 37 and report["ANNUAL"]["pantry_served_total"] == 3 and report["2012-02"]["pantry_served_total"] == 3
    # The overlap lies in different months, and in different words.
    assert report["ANNUAL"]["clinic_and_household_pantry"] == 1 and report["2010-06"]["clinic_and_household_pantry"] == 0


def test_windows_have_a_month_or_more():
    with pytest.raises(ValueError, match="one month or more"):
        check_months(0)


def test_an_empty_store(spark, tmp_path):
    path = str(tmp_path / "empty")
    month_store.add_month_bits(month_store.month_bits(typed(spark, [])), path)
    start, _ = report_window(AS_OF, 12)
    assert month_store.load_month_bits(spark, path, start, 12).count() == 0
