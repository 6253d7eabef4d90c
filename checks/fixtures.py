"""Domain tables derived from the given tables (rules in FIXTURES.md); `fixtures_sql` states the same rules in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from checks import lists
from tallyhouse.functions import once
from tallyhouse.schemas import SERVICES

AS_OF = "2001-06-15"
ID_BASE = {"pantry": 100000, "clinic": 200000, "pharmacy": 300000}
NULL_EVERY = {"pantry": 11, "clinic": 13, "pharmacy": 5}
SERVICE_DIGIT = {"pantry": 0, "pharmacy": 1, "clinic": 2}


_schemas: dict[str, T.StructType] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table; its schema is read from the files once."""
    path = f"{sf_dir}/{name}.parquet"
    if path not in _schemas:
        _schemas[path] = spark.read.parquet(path).schema
    return spark.read.schema(_schemas[path]).parquet(path)


def pick(values: tuple[str | None, ...], number: str) -> Column:
    """Deterministic choice from a list."""
    items = ", ".join("NULL" if v is None else "'" + v.replace("'", "\\'") + "'" for v in values)
    return F.expr(f"element_at(array({items}), cast(({number}) % {len(values)} + 1 as int))")


def birth_date(key: str) -> Column:
    """Neighbours share a date; 400 dates, some after `AS_OF`."""
    return F.expr(f"if({key} % 19 <> 0, date_add(date'1930-01-01', cast((({key} div 3) * 7919) % 400 * 72 as int)), null)")


def person_fields(key: str) -> list[Column]:
    return [
        pick(lists.FIRST_NAMES, key).alias("first_name"),
        pick(lists.LAST_NAMES, f"{key} div 5").alias("last_name"),
        birth_date(key).alias("dob"),
        *[pick(values, f"{key} * {factor}").alias(name) for name, (values, factor) in lists.DEMOGRAPHICS.items()],
    ]


def person(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    ids = [
        F.when(key % NULL_EVERY[s.service] != 0, key + ID_BASE[s.service]).alias(s.person_key) for s in SERVICES
    ]
    return table(spark, sf_dir, "customer").select(key.alias("person_id"), *ids, *person_fields("c_custkey"))


def household(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    return (
        table(spark, sf_dir, "customer")
        .filter(key % 7 != 0)
        .select(F.expr("c_custkey div 3").alias("household_id"), key.alias("person_id"))
    )


def date_text() -> Column:
    """The ten ways an export writes a date, by the last digit of the order key."""
    return F.expr(
        """CASE o_orderkey % 10
        WHEN 0 THEN concat(string(date(o_orderdate)), ' 10:15:00')
        WHEN 1 THEN concat(string(date(o_orderdate)), 'T09:00:00Z')
        WHEN 2 THEN date_format(date(o_orderdate), 'MM/dd/yyyy')
        WHEN 3 THEN date_format(date(o_orderdate), 'M/d/yy')
        WHEN 4 THEN concat('  ', string(date(o_orderdate)), ' ')
        WHEN 5 THEN ''
        WHEN 6 THEN concat(date_format(date(o_orderdate), 'MM/dd/yyyy'), ' 10:15')
        WHEN 7 THEN 'n/a'
        ELSE string(date(o_orderdate)) END"""
    )


def id_text(service: str) -> Column:
    """Most ids are those of persons. Of every 17th row in turn: no number, too long, blank, and beyond a signed 64-bit number."""
    return F.expr(
        f"""CASE WHEN o_orderkey % 17 <> 0 THEN concat(' 00', o_custkey + {ID_BASE[service]}, ' ')
        WHEN o_orderkey div 17 % 4 = 0 THEN concat('X', o_custkey)
        WHEN o_orderkey div 17 % 4 = 1 THEN '123456789012345678901234'
        WHEN o_orderkey div 17 % 4 = 2 THEN '  '
        ELSE string(18446744073709551615BD - o_custkey) END"""
    )


def exports(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The three exports as the reports need them: id and date as text."""
    orders = table(spark, sf_dir, "orders")
    return {
        s.service: once(
            orders.filter(F.col("o_orderkey") % 3 == SERVICE_DIGIT[s.service]),
            id_text(s.service).alias(s.id_column),
            date_text().alias(s.date_column),
        ).select(s.id_column, s.date_column)
        for s in SERVICES
    }


def merge_exports(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The exports with names, demographics and (pantry) a household, as the merges need them."""
    orders = table(spark, sf_dir, "orders")
    facts = [
        pick(lists.FIRST_NAMES, "o_custkey").alias("first_name"),
        pick(lists.LAST_NAMES, "o_custkey div 5").alias("last_name"),
        F.when(F.col("o_orderkey") % 4 != 0, birth_date("o_custkey").cast("string")).otherwise(F.lit("")).alias("dob"),
        *[
            pick(values, f"o_custkey * {factor} + o_orderkey % 3 + o_orderkey % 5").alias(name)
            for name, (values, factor) in lists.DEMOGRAPHICS.items()
        ],
    ]
    household_text = F.when(
        F.col("o_orderkey") % 13 != 0, F.concat(F.lit(" "), F.expr("o_custkey div 3").cast("string"))
    ).otherwise(F.lit(""))
    frames = {}
    for s in SERVICES:
        extra = [household_text.alias("Household ID")] if s.service == "pantry" else []
        columns = [id_text(s.service).alias(s.id_column), date_text().alias(s.date_column), *facts, *extra]
        rows = once(orders.filter(F.col("o_orderkey") % 3 == SERVICE_DIGIT[s.service]), *columns)
        frames[s.service] = rows.drop(*orders.columns)
    return frames
