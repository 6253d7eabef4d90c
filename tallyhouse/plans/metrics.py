"""Cross-service usage: one row a month of the window and one for the window as a whole."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyhouse.functions import month_label, safe_pct
from tallyhouse.operators.events import Exports, key_months, months_of_persons, typed_events
from tallyhouse.operators.month_store import load_month_bits
from tallyhouse.operators.overlap import MEASURES, count_measures, period_flags, service_months, spine_flags
from tallyhouse.operators.windows import AsOf, report_window

ANNUAL = "ANNUAL"
# Overlap -> the total it is a percentage of.
BASES = {
    "pharmacy_and_pantry": "pharmacy_served_total",
    "pharmacy_and_household_pantry": "pharmacy_served_total",
    "clinic_and_household_pantry": "clinic_served_total",
    "clinic_and_pharmacy": "clinic_served_total",
}


def monthly_from_months(
    found: DataFrame, person: DataFrame, household: DataFrame, as_of: AsOf = None, months: int = 12
) -> DataFrame:
    """The report from (service, key, words of months); an id may have several rows."""
    start, _ = report_window(as_of, months)
    sets = service_months(months_of_persons(found, person), household, months)
    # Zero rows for all periods take the place of a left join of the month spine to the counts.
    flags = period_flags(sets, months).unionByName(spine_flags(person.sparkSession, months))
    period = F.col("period")
    label = F.when(period < months, month_label(F.add_months(start, period))).otherwise(F.lit(ANNUAL))
    columns = [label.alias("period")]
    for name in MEASURES:
        columns.append(F.col(name))
        if name in BASES:
            columns.append(safe_pct(F.col(name), F.col(BASES[name])).alias(f"{name}_pct"))
    # One row a month and one more: one task sorts them, which saves the sampling and the shuffle of a global sort.
    return count_measures(flags).coalesce(1).sortWithinPartitions(period).select(*columns)


def monthly_from_events(
    events: Mapping[str, DataFrame], person: DataFrame, household: DataFrame, as_of: AsOf = None, months: int = 12
) -> DataFrame:
    """The report from parsed events, one (key, event_date) frame a service; see `load_typed_events`."""
    found = key_months(events, *report_window(as_of, months), months)
    return monthly_from_months(found, person, household, as_of, months)


def monthly_from_bits(
    spark: SparkSession,
    path: str,
    person: DataFrame,
    household: DataFrame,
    as_of: AsOf = None,
    months: int = 12,
    more: Exports | None = None,
) -> DataFrame:
    """The report from stored month bits (`operators.month_store`) and, if given, export rows that are not in them yet.

    Raw rows behind the store are not read, and of the store only the words of years that the window touches.
    """
    start, end = report_window(as_of, months)
    found = load_month_bits(spark, path, start, months)
    if more:
        found = found.unionByName(key_months(typed_events(more), start, end, months))
    return monthly_from_months(found, person, household, as_of, months)


def cross_service_monthly(
    exports: Exports, person: DataFrame, household: DataFrame, as_of: AsOf = None, months: int = 12
) -> DataFrame:
    """Distinct persons by service and by overlap, for every month of the window and for all of it ('ANNUAL').

    The annual row counts persons once for the whole window; its overlaps need not fall into the same month.
    """
    return monthly_from_events(typed_events(exports), person, household, as_of, months)
