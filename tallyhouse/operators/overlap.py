"""Which services the same person used, for whole windows and month by month."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyhouse.operators.household import member_months
from tallyhouse.operators.windows import WORD_MONTHS, month_bit, unite_months, word_at, word_sizes, words

# Report column -> the use flags that must hold at once.
MEASURES = {
    "pantry_served_total": ("pantry_served",),
    "clinic_served_total": ("clinic",),
    "pharmacy_served_total": ("pharmacy",),
    "pharmacy_and_pantry": ("pharmacy", "pantry"),
    "pharmacy_and_household_pantry": ("pharmacy", "pantry_served"),
    "clinic_and_household_pantry": ("clinic", "pantry_served"),
    "clinic_and_pharmacy": ("clinic", "pharmacy"),
}
FLAGS = ("pantry", "pantry_served", "pharmacy", "clinic")


def service_months(found: DataFrame, household: DataFrame, months: int) -> DataFrame:
    """One row a person with four month sets, from `found` (service, person_id, words of months).

    Until the end all four travel as lanes of one bigint a word, `uses`: a person is 16 bytes in every shuffle of a window of up to 15
    months, and 8 more for every 15 months beyond. With the same value columns the two readers of `own` also need the same plan below
    them, so that Spark runs the raw scans, the join to persons and this aggregation once (ReusedExchange).
    """
    sizes, sets, uses = word_sizes(months), words("months", months), words("uses", months)

    def at(word: int, flag: str) -> int:
        return FLAGS.index(flag) * sizes[word]

    def lane(word: int, flag: str) -> Column:
        return F.shiftright(uses[word], at(word, flag)).bitwiseAND(F.lit((1 << sizes[word]) - 1))

    packed = []
    for k, (bits, name) in enumerate(zip(sets, uses, strict=True)):
        value = F.lit(0).cast("bigint")
        for service in ("pantry", "pharmacy", "clinic"):
            value = F.when(F.col("service") == service, F.shiftleft(bits, at(k, service))).otherwise(value)
        packed.append(value.alias(name))
    own = found.select("person_id", *packed).groupBy("person_id").agg(*unite_months(uses))
    visits = own.select("person_id", *[lane(k, "pantry").alias(bits) for k, bits in enumerate(sets)]).filter(any_month(sets))
    members = member_months(visits, household)
    served = [F.shiftleft(lane(k, "pantry"), at(k, "pantry_served")) for k in range(len(uses))]
    return (
        own.select("person_id", *[F.col(u).bitwiseOR(s).alias(u) for u, s in zip(uses, served, strict=True)])
        .unionByName(members.select("person_id", *[F.shiftleft(b, at(k, "pantry_served")).alias(uses[k]) for k, b in enumerate(sets)]))
        .groupBy("person_id")
        .agg(*unite_months(uses))
        .select("person_id", *[lane(k, f).alias(words(f, months)[k]) for f in FLAGS for k in range(len(uses))])
    )


def any_month(columns: list[str]) -> Column:
    """Does a set hold any month?"""
    return reduce(Column.bitwiseOR, [F.col(c) for c in columns]) != 0


def period_flags(sets: DataFrame, months: int, whole_window: bool = True) -> DataFrame:
    """(person_id, period, flags): one row a month index with any use; period `months` stands for the whole window."""
    periods = F.sequence(F.lit(0), F.lit(months if whole_window else months - 1))
    month, bit = F.col("period") < months, month_bit(F.col("period") % WORD_MONTHS)
    # One month looks at its bit of its word, the whole window at all bits of all words.
    columns = {f: words(f, months) for f in FLAGS}
    flags = {
        f: F.when(month, word_at(cs, F.least(F.col("period"), F.lit(months - 1))).bitwiseAND(bit) != 0).otherwise(any_month(cs))
        for f, cs in columns.items()
    }
    used = flags["pantry_served"] | flags["pharmacy"] | flags["clinic"]
    return sets.withColumn("period", F.explode(periods)).filter(used).select("person_id", "period", *[v.alias(f) for f, v in flags.items()])


def service_flags(found: DataFrame, household: DataFrame, start: Column, months: int = 12) -> DataFrame:
    """(person_id, month, pantry, pantry_served, pharmacy, clinic): a row for every month with any use."""
    flags = period_flags(service_months(found, household, months), months, whole_window=False)
    return flags.select("person_id", F.add_months(start, F.col("period")).alias("month"), *FLAGS)


def spine_flags(spark: SparkSession, months: int) -> DataFrame:
    """One row a period with no person and no use, so that a period without any events is counted as zero."""
    return spark.range(0, months + 1, 1, 1).select(
        F.lit(None).cast("bigint").alias("person_id"),
        F.col("id").cast("int").alias("period"),
        *[F.lit(False).alias(f) for f in FLAGS],
    )


def count_measures(flags: DataFrame) -> DataFrame:
    """Person counts by period. (person_id, period) is unique, so plain conditional counts are exact distinct counts."""
    counts = []
    for name, needed in MEASURES.items():
        together = F.col(needed[0])
        for other in needed[1:]:
            together = together & F.col(other)
        counts.append(F.count_if(together).alias(name))
    return flags.groupBy("period").agg(*counts)
