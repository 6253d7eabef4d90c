"""For every id the months in which it was seen, since ever: what all reports of use need, kept once.

Months are counted from year 0 and parted into words of five years; a row is (service, key, word, bits). New exports add rows of their own,
which are simply united with the old ones when they are read, so adding twice changes nothing. Files lie by word: a report on a window reads
the one or two words that it touches, shifted to its first month.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyhouse.operators.overlap import any_month
from tallyhouse.operators.windows import WORD_MONTHS, month_bit, word_sizes, words

STORE_MONTHS = 60
_SCHEMA = "service string, key bigint, bits bigint, word int"


def month_number(d: Column) -> Column:
    """Months since January of year 0."""
    return F.year(d) * 12 + F.month(d) - 1


def month_bits(events: Mapping[str, DataFrame]) -> DataFrame:
    """(service, key, bits, word) from parsed events, one (key, event_date) frame a service. Combines map-side, before anything is sent."""
    month = month_number(F.col("event_date"))
    parts = [
        df.groupBy("key", F.floor(month / STORE_MONTHS).cast("int").alias("word"))
        .agg(F.bit_or(month_bit(F.pmod(month, F.lit(STORE_MONTHS)))).alias("bits"))
        .select(F.lit(service).alias("service"), "key", "bits", "word")
        for service, df in events.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def add_month_bits(bits: DataFrame, path: str) -> None:
    """Add rows to a store. Rows that are there already do no harm, so a load that failed may run again."""
    bits.hint("rebalance", "word").write.mode("append").partitionBy("word").parquet(path)


def united_bits(spark: SparkSession, path: str) -> DataFrame:
    """A store with one row a (service, key, word): write it to another path, and read that from then on, when many loads have piled up."""
    stored = spark.read.schema(_SCHEMA).parquet(path)
    return stored.groupBy("service", "key", "word").agg(F.bit_or("bits").alias("bits")).select("service", "key", "bits", "word")


def load_month_bits(spark: SparkSession, path: str, start: Column, months: int) -> DataFrame:
    """(service, key, words of months) of one window; an id has a row for each load and word that saw it."""
    first = month_number(start)
    word_of = lambda month: F.floor(month / STORE_MONTHS).cast("int")
    stored = spark.read.schema(_SCHEMA).parquet(path).filter(F.col("word").between(word_of(first), word_of(first + (months - 1))))
    columns, found = words("months", months), []
    for k, (name, size) in enumerate(zip(columns, word_sizes(months), strict=True)):
        # The stored bit that is the first of this word; negative: the word begins before the stored one.
        at = (first + k * WORD_MONTHS - F.col("word") * STORE_MONTHS).cast("int")
        right, left = F.call_function("shiftright", F.col("bits"), at), F.call_function("shiftleft", F.col("bits"), -at)
        bits = F.when(at.between(0, STORE_MONTHS - 1), right).when(at.between(1 - WORD_MONTHS, -1), left).otherwise(0)
        found.append(bits.bitwiseAND(F.lit((1 << size) - 1)).cast("bigint").alias(name))
    return stored.select("service", "key", *found).filter(any_month(columns))
