"""Named queries over the given tables; `checks.oracle` has the SQL for each."""

from __future__ import annotations

import contextlib
import datetime as dt
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import fixtures as fx
from tallyhouse.functions import numeric_id, parse_mixed_date
from tallyhouse.operators import events, merge, month_store, quality
from tallyhouse.operators.household import pantry_served
from tallyhouse.operators.overlap import MEASURES, count_measures, period_flags, service_flags, service_months
from tallyhouse.operators.windows import month_spine, report_window
from tallyhouse.plans import demographics, ingest, metrics
from tallyhouse.schemas import SERVICES
from tallyhouse.session import checkpointed, scratch_path
from tallyhouse.sources import csv_export, sinks, tables
from tallyhouse.streaming.ingest import BATCH, stream_exports
from tallyhouse.streaming.ingest import stream_and_merge as merge_stream

Query = Callable[[SparkSession, str], DataFrame]
MONTHS = 12
GENERATED_AT = dt.datetime(2001, 6, 15, 12, 30, 0, 250000, dt.timezone.utc)
SERVED = [m for m, flags in MEASURES.items() if len(flags) == 1]
OVERLAPS = [m for m, flags in MEASURES.items() if len(flags) > 1]


def window():
    return report_window(fx.AS_OF, MONTHS)


def raw_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(service, id_text, date_text) of all exports."""
    found = fx.exports(spark, sf_dir)
    return reduce(
        DataFrame.unionByName,
        [
            found[s.service].select(
                F.lit(s.service).alias("service"),
                F.col(f"`{s.id_column}`").alias("id_text"),
                F.col(f"`{s.date_column}`").alias("date_text"),
            )
            for s in SERVICES
        ],
    )


def parse_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = raw_texts(spark, sf_dir).groupBy("service", "date_text").agg(F.count(F.lit(1)).alias("rows"))
    return counts.select("service", "date_text", parse_mixed_date(F.col("date_text")).alias("event_date"), "rows")


def normalise_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = raw_texts(spark, sf_dir).groupBy("service", "id_text").agg(F.count(F.lit(1)).alias("rows"))
    return counts.select("service", "id_text", numeric_id(F.col("id_text")).alias("key"), "rows")


def events_person_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.person_month_events(fx.exports(spark, sf_dir), fx.person(spark, sf_dir), *window())


def month_spine_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Usable export rows in each month of the window, months without any included."""
    start, end = window()
    rows = reduce(DataFrame.unionByName, events.typed_events(fx.exports(spark, sf_dir)).values())
    counts = (
        rows.filter((F.col("event_date") >= start) & (F.col("event_date") < end))
        .groupBy(F.trunc("event_date", "MM").alias("month"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    spine = month_spine(spark, fx.AS_OF, MONTHS)
    return spine.join(counts, "month", "left").select(
        "month_index", "month", F.coalesce(F.col("n"), F.lit(0)).alias("rows")
    )


def pantry_served_person_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pantry_served(events_person_month(spark, sf_dir), fx.household(spark, sf_dir), window()[0])


def _found(spark: SparkSession, sf_dir: str) -> DataFrame:
    typed = events.typed_events(fx.exports(spark, sf_dir))
    return events.person_months(typed, fx.person(spark, sf_dir), *window())


def service_flags_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return service_flags(_found(spark, sf_dir), fx.household(spark, sf_dir), window()[0])


def _counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    sets = service_months(_found(spark, sf_dir), fx.household(spark, sf_dir), MONTHS)
    return count_measures(period_flags(sets, MONTHS))


def served_by_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    month = F.add_months(window()[0], F.col("period")).alias("month")
    return _counts(spark, sf_dir).filter(F.col("period") < MONTHS).select(month, *SERVED)


def overlap_by_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    month = F.add_months(window()[0], F.col("period")).alias("month")
    return _counts(spark, sf_dir).filter(F.col("period") < MONTHS).select(month, *OVERLAPS)


def annual_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _counts(spark, sf_dir).filter(F.col("period") == MONTHS).select(*OVERLAPS)


def cross_service_monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.cross_service_monthly(
        fx.exports(spark, sf_dir), fx.person(spark, sf_dir), fx.household(spark, sf_dir), fx.AS_OF
    )


def cross_service_from_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same report from stored events, of which only the months of the window are read."""
    path = scratch_path(spark, "typed-events")
    events.save_typed_events(events.typed_events(fx.exports(spark, sf_dir)), path)
    typed = events.load_typed_events(spark, path, *window())
    return metrics.monthly_from_events(typed, fx.person(spark, sf_dir), fx.household(spark, sf_dir), fx.AS_OF)


def cross_service_from_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from month bits: half of the exports was stored in two loads, a quarter of them twice; the other half comes as new files."""
    path, exports = scratch_path(spark, "month-bits"), fx.exports(spark, sf_dir)
    for number in (0, 1, 1):
        old = {s: _part(df, number, 4) for s, df in exports.items()}
        month_store.add_month_bits(month_store.month_bits(events.typed_events(old)), path)
    new = {s: _part(df, 2, 4).unionByName(_part(df, 3, 4)) for s, df in exports.items()}
    return metrics.monthly_from_bits(spark, path, fx.person(spark, sf_dir), fx.household(spark, sf_dir), fx.AS_OF, more=new)


def cross_service_of(months: int) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return metrics.cross_service_monthly(
            fx.exports(spark, sf_dir), fx.person(spark, sf_dir), fx.household(spark, sf_dir), fx.AS_OF, months
        )

    return run


def cross_service_70_months_from_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "month-bits")
    month_store.add_month_bits(month_store.month_bits(events.typed_events(fx.exports(spark, sf_dir))), path)
    return metrics.monthly_from_bits(spark, path, fx.person(spark, sf_dir), fx.household(spark, sf_dir), fx.AS_OF, 70)


def metrics_report_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "metrics-report")
    sinks.write_metrics_report(cross_service_monthly(spark, sf_dir), path, MONTHS, GENERATED_AT)
    return spark.read.text(path)


def demographics_report_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "demographics-report")
    person = fx.person(spark, sf_dir)
    total = demographics.total_persons(person).first()["total_persons"]
    sinks.write_demographics_report(demographics.demographics_profile(person, fx.AS_OF), path, total)
    return spark.read.text(path)


def category(name: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return demographics.category_counts(
            fx.person(spark, sf_dir), fx.AS_OF, categories=(name,), completeness=False
        )

    return run


RAW = tuple(name for name, (kind, _) in demographics.CATEGORIES.items() if kind == "raw")


def raw_value_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return demographics.category_counts(fx.person(spark, sf_dir), fx.AS_OF, categories=RAW, completeness=False)


def raw_value_counts_any_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    return demographics.category_counts(
        fx.person(spark, sf_dir), fx.AS_OF, categories=RAW, completeness=False, collation="UTF8_LCASE"
    )


def similar_names(same_dob: bool, use_soundex: bool, ratio: float) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return quality.similar_name_pairs(fx.person(spark, sf_dir), ratio, ratio, same_dob, use_soundex)

    return run


def _merged(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    records = checkpointed(merge.source_records(fx.merge_exports(spark, sf_dir)))
    return merge.merge_person(fx.person(spark, sf_dir), records)


def _linked(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """New ids go to the people there who have their name and birth date."""
    records = checkpointed(merge.source_records(fx.merge_exports(spark, sf_dir)))
    return merge.merge_person(fx.person(spark, sf_dir), records, link_by_name=True)


def household_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    pantry = fx.merge_exports(spark, sf_dir)["pantry"]
    return merge.merge_households(fx.household(spark, sf_dir), pantry, fx.person(spark, sf_dir))


def latest_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = merge.source_records(fx.merge_exports(spark, sf_dir))
    return merge.sweep_latest(fx.person(spark, sf_dir), records)


def cross_service_after_rebuild(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The usage report on persons and households that were rebuilt from the exports."""
    built = ingest.rebuild_all(spark, fx.merge_exports(spark, sf_dir))
    return metrics.cross_service_monthly(fx.exports(spark, sf_dir), checkpointed(built.person), built.household, fx.AS_OF)


def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows of the three exports written as CSV and read back."""
    parts = []
    for spec in SERVICES:
        export = fx.merge_exports(spark, sf_dir)[spec.service]
        path = scratch_path(spark, "csv")
        sinks.write_csv(export, path)
        back = csv_export.read_export_csv(spark, path, export.schema, has_header=True)
        named = back.withColumnsRenamed({spec.id_column: "id_text", spec.date_column: "date_text", "Household ID": "household_text"})
        parts.append(named.select(F.lit(spec.service).alias("service"), *named.columns))
    return reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), parts)


def csv_width_reject(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Widths of export lines for a table of three columns, some short and some too wide."""
    digit = F.col("o_orderkey") % 17
    key, day = F.col("o_custkey").cast("string"), F.col("o_orderdate").cast("date").cast("string")
    line = (
        F.when(digit == 0, F.concat_ws(",", key, day, F.lit('"quoted, once"'), F.lit("surplus")))
        .when(digit == 1, key)
        .when(digit == 2, F.lit(",,"))
        .when(digit == 3, F.concat(key, F.lit(",")))
        .otherwise(F.concat_ws(",", key, day, F.lit('"a ""b"", c"')))
    )
    path = scratch_path(spark, "lines")
    fx.table(spark, sf_dir, "orders").select(line.alias("value")).write.text(path)
    columns = ["Client ID", "Visit Date", "note"]
    rows = csv_export.scan_export(spark, path, columns, multi_line=False)
    return (
        rows.withColumn("verdict", F.when(F.col("_width") > len(columns), "reject").otherwise("accept"))
        .groupBy("verdict", F.col("_width").alias("width"), "note")
        .agg(F.count(F.lit(1)).alias("rows"))
    )


def stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows of each export arrive as files beside one with a row that is too wide; the stream takes the good files once."""
    parts = []
    for spec in SERVICES:
        export = fx.exports(spark, sf_dir)[spec.service]
        base = scratch_path(spark, "stream")
        incoming = f"{base}/in"
        export.write.options(**{**sinks.WRITER_OPTIONS, "header": "false"}).csv(incoming)
        spark.range(1).select(F.lit("1,2001-01-01,too wide").alias("value")).write.mode("append").text(incoming)
        for _ in range(2):
            stream_exports(
                spark, incoming, export.columns, f"{base}/out", f"{base}/rejects", f"{base}/checkpoint"
            ).awaitTermination()
        back = spark.read.parquet(f"{base}/out").drop(BATCH)
        parts.append(back.toDF("id_text", "date_text").withColumn("service", F.lit(spec.service)))
    return reduce(DataFrame.unionByName, parts)


@contextlib.contextmanager
def _database(spark: SparkSession):
    """A database of its own as the current one; it stays, since the result is read from it."""
    before, name = spark.catalog.currentDatabase(), f"merge_{uuid.uuid4().hex}"
    spark.sql(f"CREATE DATABASE {name}")
    spark.catalog.setCurrentDatabase(name)
    try:
        yield
    finally:
        spark.catalog.setCurrentDatabase(before)


def _part(export: DataFrame, number: int, parts: int = 2) -> DataFrame:
    return export.where(F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in export.columns]), F.lit(parts)) == number)


def append_and_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of each export is appended from CSV files and merged, then the other half; only new rows are read by the second merge."""
    exports = fx.merge_exports(spark, sf_dir)
    with _database(spark):
        fx.person(spark, sf_dir).write.saveAsTable("person")
        for number in range(2):
            for at, (service, export) in enumerate(exports.items()):
                table, path = ingest.create_export_table(spark, service, export.columns), scratch_path(spark, "append")
                sinks.write_csv(_part(export, number), path)
                append = ingest.append_and_merge if at == len(exports) - 1 else csv_export.append_export
                append(spark, path, table, has_header=True, batch=f"load-{number}")
        return ingest.current_state(spark)[0]


def stream_and_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clinic files arrive in two lots beside a refused one; each lot is appended and merged once, though the stream runs again."""
    export = fx.merge_exports(spark, sf_dir)["clinic"]
    base = scratch_path(spark, "stream")
    with _database(spark):
        fx.person(spark, sf_dir).write.saveAsTable("person")
        table = ingest.create_export_table(spark, "clinic", export.columns)
        spark.range(1).select(F.lit("," * len(export.columns) + "too wide").alias("value")).write.text(f"{base}/in")
        for number in range(2):
            lot = _part(export, number).write.mode("append")
            lot.options(**{**sinks.WRITER_OPTIONS, "header": "false"}).csv(f"{base}/in")
            for _ in range(2):
                merge_stream(spark, f"{base}/in", table, f"{base}/rejects", f"{base}/checkpoint").awaitTermination()
        return ingest.current_state(spark)[0]


def table_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    fx.table(spark, sf_dir, "customer").createOrReplaceTempView("preview_customer")
    return tables.preview(spark, "preview_customer", 200, order_by=("c_custkey",))


def all_queries() -> dict[str, Query]:
    def on_person(run: Callable[[DataFrame], DataFrame]) -> Query:
        return lambda spark, sf_dir: run(fx.person(spark, sf_dir))

    return {
        "parse_dates": parse_dates,
        "normalise_ids": normalise_ids,
        "events_person_month": events_person_month,
        "month_spine": month_spine_rows,
        "pantry_served_person_month": pantry_served_person_month,
        "service_flags": service_flags_rows,
        "served_by_month": served_by_month,
        "overlap_by_month": overlap_by_month,
        "annual_overlap": annual_overlap,
        "cross_service_monthly": cross_service_monthly,
        "cross_service_from_store": cross_service_from_store,
        "cross_service_from_bits": cross_service_from_bits,
        "cross_service_36_months": cross_service_of(36),
        "cross_service_70_months_from_bits": cross_service_70_months_from_bits,
        "metrics_report_lines": metrics_report_lines,
        "age_group_counts": category("age_group"),
        "sex_counts": category("sex_at_birth"),
        "gender_grouped_counts": category("gender_identity_grouped"),
        "ethnicity_grouped_counts": category("ethnicity_grouped"),
        "race_grouped_counts": category("race_grouped"),
        "raw_value_counts": raw_value_counts,
        "raw_value_counts_any_case": raw_value_counts_any_case,
        "total_persons": on_person(demographics.total_persons),
        "completeness_snapshot": on_person(demographics.completeness_snapshot),
        "demographics_profile": on_person(lambda p: demographics.demographics_profile(p, fx.AS_OF)),
        "demographics_report_lines": demographics_report_lines,
        "rejected_events": lambda spark, sf_dir: events.rejected_events(fx.exports(spark, sf_dir)),
        "multi_dob_people": on_person(quality.multi_dob_people),
        "multi_dob_names": on_person(quality.multi_dob_names),
        "similar_names": similar_names(same_dob=True, use_soundex=False, ratio=0.75),
        "similar_names_loose": similar_names(same_dob=True, use_soundex=False, ratio=0.4),
        "similar_names_by_sound": similar_names(same_dob=False, use_soundex=True, ratio=0.7),
        "similar_names_any_block": similar_names(same_dob=False, use_soundex=False, ratio=0.8),
        "similar_names_top": on_person(lambda p: quality.similar_full_names(p, 0.75, 0.75, True, False)),
        "person_merge": lambda spark, sf_dir: _merged(spark, sf_dir)[0],
        "person_merge_audit": lambda spark, sf_dir: _merged(spark, sf_dir)[1],
        "person_merge_linked": lambda spark, sf_dir: _linked(spark, sf_dir)[0],
        "person_merge_linked_audit": lambda spark, sf_dir: _linked(spark, sf_dir)[1].where("field LIKE '%\\_id' OR field LIKE '%\\_key' OR field LIKE '%patientid'"),
        "household_merge": household_merge,
        "latest_fields": latest_fields,
        "rebuild_all": lambda spark, sf_dir: ingest.rebuild_all(spark, fx.merge_exports(spark, sf_dir)).person,
        "rebuild_households": lambda spark, sf_dir: ingest.rebuild_all(spark, fx.merge_exports(spark, sf_dir)).household,
        "cross_service_after_rebuild": cross_service_after_rebuild,
        "csv_round_trip": csv_round_trip,
        "csv_width_reject": csv_width_reject,
        "stream_ingest": stream_ingest,
        "append_and_merge": append_and_merge,
        "stream_and_merge": stream_and_merge,
        "table_preview": table_preview,
    }


