"""Demographics profile: counts by class and by raw value, completeness, each as a share of all persons."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyhouse.functions import DEFAULT_RULES, RuleSet, age_group, as_of_date, classify, is_blank, or_unknown, pct2
from tallyhouse.operators.windows import AsOf

# Completeness rows and the column each looks at.
COMPLETENESS = {
    "Missing DOB": "dob",
    "Missing Race": "race",
    "Missing Ethnicity": "ethnicity",
    "Missing Gender Identity": "gender_identity",
    "Missing Sex at Birth": "sex_at_birth",
}
QUALITY = "data_quality"
# Category -> (kind, column); every person falls into exactly one class of each.
CATEGORIES = {
    "age_group": ("age", "dob"),
    "sex_at_birth": ("rules", "sex_at_birth"),
    "gender_identity_grouped": ("rules", "gender_identity"),
    "gender_identity_raw": ("raw", "gender_identity"),
    "ethnicity_grouped": ("rules", "ethnicity"),
    "ethnicity_raw": ("raw", "ethnicity"),
    "race_grouped": ("rules", "race"),
    "race_raw": ("raw", "race"),
    "primary_language": ("raw", "primary_language"),
    "marital_status": ("raw", "marital_status"),
}


def _value(kind: str, column: str, as_of: Column, rules: Mapping[str, RuleSet]) -> Column:
    if kind == "age":
        return age_group(F.col(column), as_of)
    if kind == "rules":
        return classify(F.col(column), rules[column])
    return or_unknown(F.col(column))


def _missing(column: str) -> Column:
    blank = F.col(column).isNull() if column == "dob" else is_blank(F.col(column))
    return F.when(blank, F.lit(1)).otherwise(F.lit(0)).cast("bigint")


def category_counts(
    person: DataFrame,
    as_of: AsOf = None,
    rules: Mapping[str, RuleSet] = DEFAULT_RULES,
    collation: str | None = None,
    categories: tuple[str, ...] = tuple(CATEGORIES),
    completeness: bool = True,
) -> DataFrame:
    """(category, value, count) in one scan and one aggregation that combines map-side.

    Each person is turned into one row a category. The completeness rows carry 0 or 1 as their count, and five rows of 0 stand
    beside the persons, so that they come out for an empty table too. With a `collation` (e.g. UTF8_LCASE) raw values that it
    holds equal fall into one group, shown by the smallest of them.
    """
    day = as_of_date(as_of)
    one = F.lit(1).cast("bigint")
    rows = [
        F.struct(F.lit(name).alias("category"), _value(*CATEGORIES[name], day, rules).alias("value"), one.alias("n"))
        for name in categories
    ]
    if completeness:
        rows += [
            F.struct(F.lit(QUALITY).alias("category"), F.lit(value).alias("value"), _missing(column).alias("n"))
            for value, column in COMPLETENESS.items()
        ]
    exploded = person.select(F.inline(F.array(*rows)))
    if completeness:
        labels = F.explode(F.array(*[F.lit(value) for value in COMPLETENESS]))
        zeros = person.sparkSession.range(0, 1, 1, 1).select(
            F.lit(QUALITY).alias("category"), labels.alias("value"), F.lit(0).cast("bigint").alias("n")
        )
        exploded = exploded.unionByName(zeros)
    if collation is None:
        return exploded.groupBy("category", "value").agg(F.sum("n").alias("count"))
    # Exact values first: a sum needs no sort, and few groups are left for the collation.
    exact = exploded.groupBy("category", "value").agg(F.sum("n").alias("n"))
    return (
        exact.groupBy("category", F.collate("value", collation).alias("_same"))
        .agg(F.min("value").alias("value"), F.sum("n").alias("count"))
        .select("category", "value", "count")
    )


def demographics_profile(
    person: DataFrame,
    as_of: AsOf = None,
    rules: Mapping[str, RuleSet] = DEFAULT_RULES,
    collation: str | None = None,
) -> DataFrame:
    """(category, value, count, percent_of_total_persons), sorted by category and value.

    The number of persons is the sum over a category that every person falls into once. It comes from the same counts, not from
    a second scan: the sum is conditional rather than filtered, so both sides share one shuffle.
    """
    counts = category_counts(person, as_of, rules, collation)
    everyone = next(iter(CATEGORIES))
    total = counts.agg(
        F.coalesce(F.sum(F.when(F.col("category") == everyone, F.col("count"))), F.lit(0)).alias("total")
    )
    share = pct2(F.col("count"), total.scalar()).alias("percent_of_total_persons")
    return counts.select("category", "value", "count", share).orderBy("category", "value")


def completeness_snapshot(person: DataFrame) -> DataFrame:
    """(value, count): persons without a birth date, race, ethnicity, gender identity, sex at birth."""
    return category_counts(person, categories=()).select("value", "count")


def total_persons(person: DataFrame) -> DataFrame:
    return person.agg(F.count(F.lit(1)).alias("total_persons"))
