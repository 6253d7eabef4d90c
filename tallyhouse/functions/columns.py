"""Scalar helpers, Column to Column."""

from __future__ import annotations

import datetime as dt
import math
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# They decide whether results equal those of existing reports.
UNKNOWN = "Unknown/Blank"
NUMERIC_ID = "^[0-9]+$"
ISO_DATE_START = "^[0-9]{4}-[0-9]{2}-[0-9]{2}"
SLASH_DATE = "^[0-9]{1,2}/[0-9]{1,2}/[0-9]{2,4}$"
SLASH_TO_ISO = (
    ("^([0-9]{1,2})/([0-9]{1,2})/([0-9]{4})$", "$3-$1-$2"),
    ("^([0-9]{1,2})/([0-9]{1,2})/([7-9][0-9])$", "19$3-$1-$2"),
    ("^([0-9]{1,2})/([0-9]{1,2})/([0-6][0-9])$", "20$3-$1-$2"),
)
MAX_LIMIT = 2000
# What the text functions of existing reports take off at both ends of a label.
WHITE_SPACE = r"[\t\n\x0B\f\r \u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF]"
# Ids are unsigned numbers of 64 bits.
MAX_ID = Decimal((1 << 64) - 1)
ID_TYPE = "decimal(20,0)"


def once(df: DataFrame, *columns: Column) -> DataFrame:
    """Add `columns` so that each is worked out once a row, whatever refers to it later.

    Catalyst copies a projected expression into every filter on it. It does not look through a generator, so the values are
    passed through a one-element one, which stays inside the generated code.
    """
    return df.select("*", F.inline(F.array(F.struct(*columns))))


def is_blank(c: Column) -> Column:
    """NULL, empty, or blanks only."""
    return c.isNull() | (F.trim(c) == "")


def trimmed(c: Column) -> Column:
    """Text without white space of any kind at both ends."""
    return F.regexp_replace(c, f"^{WHITE_SPACE}++|{WHITE_SPACE}++$", "")


def or_unknown(c: Column) -> Column:
    """Trimmed text, or 'Unknown/Blank'."""
    return F.coalesce(F.nullif(trimmed(c), F.lit("")), F.lit(UNKNOWN))


def is_numeric_id(c: Column) -> Column:
    """True where the trimmed text is digits only; never NULL."""
    return F.coalesce(F.trim(c).rlike(NUMERIC_ID), F.lit(False))


def numeric_id(c: Column) -> Column:
    """Id as a decimal(20,0), NULL if the text is not digits only or the number is beyond unsigned 64 bits."""
    number = F.trim(c).try_cast(ID_TYPE)
    return F.when(is_numeric_id(c) & (number <= F.lit(MAX_ID)), number)


def id_key(c: Column) -> Column:
    """Id as a join key of eight bytes: the unsigned number in the bits of a bigint, one to one over all 64 bits.

    Takes the text of an export as well as a number column of any integral type. NULL where `numeric_id` is.
    """
    text = F.trim(c.cast("string"))
    above = numeric_id(text) - F.lit(MAX_ID + 1)
    # The usual case needs no decimal: what fits a bigint is its own key.
    return F.when(is_numeric_id(text), F.coalesce(text.try_cast("bigint"), above.cast("bigint")))


def id_of_key(key: Column) -> Column:
    """The number behind an `id_key`, as a decimal(20,0)."""
    number = key.cast(ID_TYPE)
    return F.when(key < 0, number + F.lit(MAX_ID + 1)).otherwise(number).cast(ID_TYPE)


def parse_mixed_date(c: Column) -> Column:
    """Date from export text.

    Text that starts with yyyy-MM-dd gives that day, whatever follows. m/d/yy and m/d/yyyy must be the whole text; two
    digits of the year turn at 70. All else, and days that do not exist, give NULL.
    """
    text = F.trim(c)
    slashed = text
    for pattern, iso in SLASH_TO_ISO:
        slashed = F.regexp_replace(slashed, pattern, iso)
    # The cast takes yyyy-[M]M-[d]d and, unlike a format pattern, needs no formatter object per row.
    return F.when(text.rlike(ISO_DATE_START), F.substring(text, 1, 10).try_cast("date")).when(
        text.rlike(SLASH_DATE), slashed.try_cast("date")
    )


def as_of_date(as_of: dt.date | str | Column | None) -> Column:
    """The day a report is made for; today where none is given."""
    if as_of is None:
        return F.current_date()
    if isinstance(as_of, Column):
        return as_of
    return F.lit(as_of).cast("date")


def month_start(d: Column) -> Column:
    return F.trunc(d, "MM").cast("date")


def month_label(d: Column) -> Column:
    return F.date_format(d, "yyyy-MM")


def in_range(d: Column, start: Column, end: Column) -> Column:
    """Half open: start <= d < end."""
    return (d >= start) & (d < end)


def age_years(dob: Column, as_of: Column) -> Column:
    """Full years; a birthday on 29 February counts from 1 March in other years."""
    return F.timestamp_diff("YEAR", dob.cast("timestamp_ntz"), as_of.cast("timestamp_ntz"))


def safe_pct(n: Column, denominator: Column) -> Column:
    """Unrounded percent, 0 where there is nothing to divide by."""
    return F.when(denominator > 0, n.cast("double") * 100 / denominator).otherwise(F.lit(0.0))


def pct2(n: Column, total: Column) -> Column:
    """Percent with two decimals, halves rounded up."""
    return F.when(total > 0, F.floor(n.cast("double") * 10000 / total + 0.5) / F.lit(100.0)).otherwise(F.lit(0.0))


def plain_number(c: Column) -> Column:
    """A double as report text: the shortest digits that give it back, no trailing '.0', `NaN`, `Infinity`.

    From 1e21 on and below 1e-6 with an exponent (`1e+21`, `1.5e-7`), as existing reports print numbers.
    """
    shortest = c.cast("double").cast("string")
    digits = F.regexp_replace(F.regexp_replace(F.regexp_extract(shortest, "^-?([0-9.]+)", 1), r"\.0$", ""), r"\.", "")
    sign = F.when(shortest.startswith("-"), "-").otherwise("")
    # Value = 0.d1d2d3... * 10^point, from the digits as Java writes them: d.ddd or d.dddE±n, or ddd.ddd without exponent.
    whole = F.length(F.regexp_extract(shortest, "^-?([0-9]+)", 1))
    exponent = F.coalesce(F.regexp_extract(shortest, "E(-?[0-9]+)$", 1).try_cast("int"), F.lit(0))
    lead = F.length(F.regexp_extract(digits, "^(0*)", 1))
    kept = F.regexp_replace(F.regexp_replace(digits, "^0+", ""), "0+$", "")
    point = whole + exponent - lead
    size = F.length(kept)
    plain = (
        F.when(point >= size, F.concat(kept, F.repeat(F.lit("0"), F.greatest(point - size, F.lit(0)))))
        .when(point > 0, F.concat(F.left(kept, point), F.lit("."), F.substr(kept, point + 1)))
        .otherwise(F.concat(F.lit("0."), F.repeat(F.lit("0"), F.greatest(-point, F.lit(0))), kept))
    )
    power = point - 1
    mantissa = F.when(size == 1, kept).otherwise(F.concat(F.left(kept, F.lit(1)), F.lit("."), F.substr(kept, F.lit(2))))
    scientific = F.concat(mantissa, F.lit("e"), F.when(power > 0, "+").otherwise(""), power.cast("string"))
    number = F.when((point > 21) | (point < -5), scientific).otherwise(plain)
    return (
        F.when(F.isnan(c) | shortest.contains("Infinity"), shortest).when(c == 0, F.lit("0")).otherwise(F.concat(sign, number))
    )


def clamp_limit(value: object, default: int = 200) -> int:
    """A row limit between 1 and 2000.

    Numbers and number-like text are floored; None counts as 0 and so gives 1; all else gives `default`.
    """
    if value is None or value == "":
        number = 0.0
    else:
        try:
            number = float(value)  # type: ignore[arg-type]
        except (TypeError, ValueError):
            number = math.nan
    if not math.isfinite(number):
        return default
    return max(1, min(MAX_LIMIT, math.floor(number)))
