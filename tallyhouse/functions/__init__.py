"""Column functions: built-in expressions only, so that they stay inside whole-stage code generation."""

from tallyhouse.functions.columns import (
    age_years,
    as_of_date,
    clamp_limit,
    in_range,
    is_blank,
    is_numeric_id,
    month_label,
    month_start,
    numeric_id,
    once,
    id_key,
    id_of_key,
    or_unknown,
    parse_mixed_date,
    pct2,
    plain_number,
    safe_pct,
)
from tallyhouse.functions.rules import DEFAULT_RULES, Rule, RuleSet, age_group, classify

__all__ = [
    "DEFAULT_RULES",
    "Rule",
    "RuleSet",
    "age_group",
    "age_years",
    "as_of_date",
    "clamp_limit",
    "classify",
    "in_range",
    "is_blank",
    "is_numeric_id",
    "month_label",
    "month_start",
    "numeric_id",
    "once",
    "id_key",
    "id_of_key",
    "or_unknown",
    "parse_mixed_date",
    "pct2",
    "plain_number",
    "safe_pct",
]
