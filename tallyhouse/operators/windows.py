"""The rolling report window and its months."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyhouse.functions import as_of_date, month_start

# A set of months travels as bits, and four such sets share one bigint: a longer window takes several words, columns of their own.
WORD_MONTHS = 15

AsOf = dt.date | str | Column | None


def check_months(months: int) -> int:
    if months < 1:
        raise ValueError(f"a window has one month or more, not {months}")
    return months


def words(name: str, months: int) -> list[str]:
    """The columns that hold a set of months: `name` for the first fifteen, `name_1` for the next, and so on."""
    return [name, *[f"{name}_{k}" for k in range(1, -(-check_months(months) // WORD_MONTHS))]]


def word_sizes(months: int) -> list[int]:
    """How many months each word holds."""
    return [min(WORD_MONTHS, months - low) for low in range(0, months, WORD_MONTHS)]


def report_window(as_of: AsOf = None, months: int = 12) -> tuple[Column, Column]:
    """First day of the window, and the first day after it; the month of `as_of` is the last one inside."""
    this_month = month_start(as_of_date(as_of))
    return F.add_months(this_month, 1 - check_months(months)), F.add_months(this_month, 1)


def month_spine(spark: SparkSession, as_of: AsOf = None, months: int = 12) -> DataFrame:
    """One row a month of the window: (month_index, month)."""
    start, _ = report_window(as_of, months)
    return spark.range(0, months, 1, 1).select(
        F.col("id").cast("int").alias("month_index"), F.add_months(start, F.col("id").cast("int")).alias("month")
    )


def month_index(d: Column, start: Column) -> Column:
    """How many months `d` lies after the month of `start`."""
    return (F.year(d) - F.year(start)) * 12 + F.month(d) - F.month(start)


def month_bit(index: Column) -> Column:
    """The bit that stands for a month in a month set."""
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), index.cast("int"))


def collect_months(index: Column, months: int, name: str = "months") -> list[Column]:
    """Aggregates that gather month indexes into a set, one a word."""
    found = []
    for k, word in enumerate(words(name, months)):
        low = k * WORD_MONTHS
        here = (index >= low) & (index < low + WORD_MONTHS)
        found.append(F.coalesce(F.bit_or(F.when(here, month_bit(index - low))), F.lit(0).cast("bigint")).alias(word))
    return found


def unite_months(columns: list[str]) -> list[Column]:
    """Aggregates that unite sets, word by word."""
    return [F.bit_or(c).alias(c) for c in columns]


def word_at(columns: list[str], index: Column) -> Column:
    """The word that holds month `index`."""
    if len(columns) == 1:
        return F.col(columns[0])
    return F.element_at(F.array(*columns), F.floor(index / WORD_MONTHS).cast("int") + 1)


def explode_months(df: DataFrame, bits: str, start: Column, months: int) -> DataFrame:
    """One row a month in the set `bits`, with `month` in the place of its words."""
    columns, index = words(bits, months), F.col("_index")
    return (
        df.withColumn("_index", F.explode(F.sequence(F.lit(0), F.lit(months - 1))))
        .filter(word_at(columns, index).bitwiseAND(month_bit(index % WORD_MONTHS)) != 0)
        .select(*[c for c in df.columns if c not in columns], F.add_months(start, index).alias("month"))
    )
