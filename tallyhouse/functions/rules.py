"""Ordered classifiers: the first rule that matches names the class.

Rules are data. The default sets keep the known quirks of the existing reports (`Caucasian` holds `asian`, `Not Hispanic`
holds `hisp`, ...): results must stay comparable. A corrected set belongs beside them under another name.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyhouse.functions.columns import UNKNOWN, age_years, is_blank


@dataclass(frozen=True)
class Rule:
    """Matches where the text holds one of `contains`, one of `words` between non-letters, or equals one of `equals`."""

    label: str
    contains: tuple[str, ...] = ()
    words: tuple[str, ...] = ()
    equals: tuple[str, ...] = ()

    def matches(self, text: Column) -> Column:
        tests = [text.contains(part) for part in self.contains]
        tests += [text.rlike(f"(^|[^a-z]){word}([^a-z]|$)") for word in self.words]
        tests += [text == value for value in self.equals]
        return reduce(or_, tests)


@dataclass(frozen=True)
class RuleSet:
    rules: tuple[Rule, ...]
    otherwise: str
    fold_case: bool = True
    blank: str = field(default=UNKNOWN)


OTHER = "Other/Unmapped"

# Class names and the text that leads to them, in order.
SEX_AT_BIRTH = RuleSet(
    fold_case=False,
    rules=(Rule("M", equals=("M",)), Rule("F", equals=("F",)), Rule("X", equals=("X",)), Rule("U", equals=("U",))),
    otherwise=OTHER,
)
GENDER_IDENTITY = RuleSet(
    rules=(
        Rule("Transgender", contains=("trans",)),
        Rule("Non-binary / Genderqueer", contains=("nonbinary", "non-binary", "genderqueer", "enby")),
        Rule("Male", words=("man",), equals=("male",)),
        Rule("Female", words=("woman",), equals=("female",)),
    ),
    otherwise=OTHER,
)
ETHNICITY = RuleSet(
    rules=(Rule("Latino/Hispanic", contains=("hisp", "lat")),),
    otherwise="Not Latino/Hispanic",
)
RACE = RuleSet(
    rules=(
        Rule("Black/African American", contains=("black", "african")),
        Rule("White", contains=("white",)),
        Rule("Asian", contains=("asian",)),
        Rule("Native Hawaiian/Pacific Islander", contains=("hawai", "pacific")),
        Rule("American Indian/Alaska Native", contains=("american indian", "alaska", "native american")),
        Rule("Middle Eastern/North African", contains=("middle eastern", "north african", "mene")),
        Rule("Multiracial/Two+", contains=("multi", "two", "multiple")),
    ),
    otherwise=OTHER,
)
# Upper age (exclusive) and class.
AGE_BANDS = ((18, "Under 18"), (65, "18-64"), (None, "65+"))
FUTURE_DOB = "Invalid (DOB in future)"

DEFAULT_RULES = {
    "sex_at_birth": SEX_AT_BIRTH,
    "gender_identity": GENDER_IDENTITY,
    "ethnicity": ETHNICITY,
    "race": RACE,
}


def classify(c: Column, rules: RuleSet) -> Column:
    """Fold a rule set into one CASE expression."""
    text = F.lower(c) if rules.fold_case else c
    chain = F.when(is_blank(c), F.lit(rules.blank))
    for rule in rules.rules:
        chain = chain.when(rule.matches(text), F.lit(rule.label))
    return chain.otherwise(F.lit(rules.otherwise))


def age_group(dob: Column, as_of: Column) -> Column:
    """Age band on the day `as_of`."""
    age = age_years(dob, as_of)
    chain = F.when(dob.isNull(), F.lit(UNKNOWN)).when(dob > as_of, F.lit(FUTURE_DOB))
    for below, label in AGE_BANDS:
        chain = chain.otherwise(F.lit(label)) if below is None else chain.when(age < below, F.lit(label))
    return chain
