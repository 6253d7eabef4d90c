"""From raw service exports to person-month events.

The months in which somebody used a service fit into the bits of one bigint, so the first aggregation takes raw rows straight
to one row an id. It combines map-side, before any join: an id that owns a third of all rows leaves each task as one row.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyhouse.functions import id_key, in_range, is_blank, is_numeric_id, month_start, once, parse_mixed_date
from tallyhouse.operators.skew import spread_join
from tallyhouse.operators.windows import collect_months, explode_months, month_index, unite_months, words
from tallyhouse.schemas import SERVICES, ServiceExport

Exports = Mapping[str, DataFrame]


def known_exports(exports: Exports) -> list[tuple[ServiceExport, DataFrame]]:
    """Exports paired with their description; the mapping is keyed by service name."""
    unknown = set(exports) - {s.service for s in SERVICES}
    if unknown or not exports:
        raise ValueError(f"unknown or no services: {sorted(unknown)}")
    return [(s, exports[s.service]) for s in SERVICES if s.service in exports]


def parse_export(spec: ServiceExport, export: DataFrame) -> DataFrame:
    """(key, event_date) of one export; rows with an unusable id or date are left out (see `rejected_events`)."""
    id_text, date_text = F.col(f"`{spec.id_column}`"), F.col(f"`{spec.date_column}`")
    parsed = once(
        export.filter(is_numeric_id(id_text)),
        id_key(id_text).alias("key"),
        parse_mixed_date(date_text).alias("event_date"),
    )
    return parsed.select("key", "event_date").filter(F.col("key").isNotNull() & F.col("event_date").isNotNull())


def typed_events(exports: Exports) -> dict[str, DataFrame]:
    """(key, event_date) for every service."""
    return {spec.service: parse_export(spec, df) for spec, df in known_exports(exports)}


def save_typed_events(events: Mapping[str, DataFrame], path: str, mode: str = "error") -> None:
    """Store parsed events by month, so that later reports read only the months of their window.

    The rebalance hint lets AQE gather small months into one task and cut large ones into several. Files are sorted by service
    and key, so that their statistics tell services apart.
    """
    parts = [df.select(F.lit(service).alias("service"), "key", "event_date") for service, df in events.items()]
    (
        reduce(DataFrame.unionByName, parts)
        .withColumn("month", month_start(F.col("event_date")))
        .hint("rebalance", "month")
        .sortWithinPartitions("month", "service", "key")
        .write.mode(mode)
        .partitionBy("month")
        .parquet(path)
    )


def load_typed_events(spark: SparkSession, path: str, start: Column, end: Column) -> dict[str, DataFrame]:
    """Read stored events of one window; the month filter prunes partitions."""
    schema = "service string, key bigint, event_date date, month date"
    stored = spark.read.schema(schema).parquet(path).filter(in_range(F.col("month"), start, end))
    return {s.service: stored.filter(F.col("service") == s.service).select("key", "event_date") for s in SERVICES}


def key_months(events: Mapping[str, DataFrame], start: Column, end: Column, months: int = 12) -> DataFrame:
    """(service, key, words of months): one row an id, with the set of months it was seen in."""
    parts = [
        df.filter(in_range(F.col("event_date"), start, end))
        .groupBy("key")
        .agg(*collect_months(month_index(F.col("event_date"), start), months))
        .select(F.lit(service).alias("service"), "key", *words("months", months))
        for service, df in events.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def person_keys(person: DataFrame) -> DataFrame:
    """(service, key, person_id): the foreign ids of `person`, one row each, in one scan.

    Filtering NULL persons here, and not where a later join would infer it, keeps all uses of this plan alike.
    """
    ids = F.inline(
        F.array(
            *[
                F.struct(F.lit(s.service).alias("service"), id_key(F.col(s.person_key)).alias("key"))
                for s in SERVICES
            ]
        )
    )
    return person.filter(F.col("person_id").isNotNull()).select("person_id", ids).filter(F.col("key").isNotNull())


def months_of_persons(found: DataFrame, person: DataFrame) -> DataFrame:
    """(service, person_id, words of months) from (service, key, words). An id that several persons share counts for each of them."""
    return spread_join(person_keys(person), found, ["service", "key"]).drop("key").select(
        "service", "person_id", *[c for c in found.columns if c not in ("service", "key")]
    )


def person_months(events: Mapping[str, DataFrame], person: DataFrame, start: Column, end: Column, months: int = 12) -> DataFrame:
    """(service, person_id, words of months) from parsed events."""
    return months_of_persons(key_months(events, start, end, months), person)


def person_month_events(
    exports: Exports, person: DataFrame, start: Column, end: Column, months: int = 12
) -> DataFrame:
    """Distinct (service, person_id, month) inside the window."""
    found = (
        person_months(typed_events(exports), person, start, end, months)
        .groupBy("service", "person_id")
        .agg(*unite_months(words("months", months)))
    )
    return explode_months(found, "months", start, months)


def rejected_events(exports: Exports) -> DataFrame:
    """(source, reason, count) of export rows that no report can use; the id is looked at first.

    With the rows that `parse_export` keeps these are all rows of an export.
    """
    parts = []
    for spec, df in known_exports(exports):
        id_text, date_text = F.col(f"`{spec.id_column}`"), F.col(f"`{spec.date_column}`")
        reason = (
            F.when(is_blank(id_text), F.lit("blank id"))
            .when(~is_numeric_id(id_text), F.lit("id is not numeric"))
            .when(id_key(id_text).isNull(), F.lit("id out of range"))
            .when(is_blank(date_text), F.lit("blank date"))
            .when(parse_mixed_date(date_text).isNull(), F.lit("date not understood"))
        )
        parts.append(once(df, reason.alias("reason")).select(F.lit(spec.table).alias("source"), "reason"))
    return (
        reduce(DataFrame.unionByName, parts)
        .filter(F.col("reason").isNotNull())
        .groupBy("source", "reason")
        .agg(F.count(F.lit(1)).alias("count"))
    )
