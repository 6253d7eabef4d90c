"""Household attribution: whoever shares a household with a pantry visitor counts as served."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyhouse.operators.skew import spread_join
from tallyhouse.operators.windows import collect_months, explode_months, month_index, unite_months


def member_months(visits: DataFrame, household: DataFrame) -> DataFrame:
    """(person_id, words of months) for all members of visiting households; a person in several has several rows.

    One household (a shelter under one id) may hold a large share of all persons: its months are one row by the time they go
    back to the members, and `spread_join` cuts the members into pieces.
    """
    columns = [c for c in visits.columns if c != "person_id"]
    links = (
        household.select("household_id", "person_id")
        .filter(F.col("household_id").isNotNull() & F.col("person_id").isNotNull())
        .distinct()
    )
    by_household = (
        spread_join(links, visits, ["person_id"])
        .groupBy("household_id")
        .agg(*unite_months(columns))
    )
    return spread_join(links, by_household, ["household_id"]).select("person_id", *columns)


def pantry_served_months(visits: DataFrame, household: DataFrame) -> DataFrame:
    """(person_id, words of months), one row a person: members of visiting households and the visitors themselves."""
    columns = [c for c in visits.columns if c != "person_id"]
    return member_months(visits, household).unionByName(visits).groupBy("person_id").agg(*unite_months(columns))


def pantry_served(events: DataFrame, household: DataFrame, start: Column, months: int = 12) -> DataFrame:
    """Distinct (person_id, month) served by the pantry, from `events` (service, person_id, month)."""
    visits = (
        events.filter(F.col("service") == "pantry")
        .groupBy("person_id")
        .agg(*collect_months(month_index(F.col("month"), start), months))
    )
    return explode_months(pantry_served_months(visits, household), "months", start, months)
