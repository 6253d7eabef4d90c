"""Append exports, then bring `person` and `household` up to date.

What all exports so far boil down to is kept: one row a (service, key) with the latest value of each field and its date. Two such
tables combine by the greater (date, value) of a field, so new rows are folded in without reading old ones. An append is a batch, a
partition of its own of the export table; the state of every version names the batches it holds. A merge takes the batches that are
not in yet, touches only the people behind their ids, and publishes the result. Append and merge may fail or be run again
anywhere: a batch that is written again replaces itself, and one that was folded in is not folded in again.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyhouse.operators.events import Exports
from tallyhouse.operators.merge import (
    HOUSEHOLD_COLUMN,
    affected_records,
    empty_records,
    empty_state,
    fold_records,
    latest_by_person,
    merge_households,
    merge_person,
    source_records,
    sweep_latest,
    touched_people,
)
from tallyhouse.plans import versions
from tallyhouse.plans.versions import CURRENT, ConcurrentPublishError, Version, current_version, remove_old_versions
from tallyhouse.schemas import SERVICES
from tallyhouse.session import checkpointed
from tallyhouse.sources.csv_export import BATCH, AppendResult, append_export

__all__ = [
    "ConcurrentPublishError",
    "Merged",
    "append_and_merge",
    "create_export_table",
    "current_state",
    "load_exports",
    "merge_new_batches",
    "merge_tables",
    "rebuild_all",
    "remove_old_versions",
    "run_merges",
]

STATE = ("person", "household")
RECORDS = "export_records"
BATCHES = "folded_batches"
_BATCH_ROWS = "service string, batch_id string"


@dataclass(frozen=True)
class Merged:
    person: DataFrame
    household: DataFrame
    audit: DataFrame
    records: DataFrame | None = None


def fold_merges(
    person: DataFrame,
    household: DataFrame,
    records: DataFrame,
    exports: Exports,
    household_column: str = HOUSEHOLD_COLUMN,
    link_by_name: bool = False,
) -> Merged:
    """Fold new export rows into `records` and merge what they touch; `exports` holds the new rows alone.

    People, then households, then latest fields. Nothing is dropped. Merging batch after batch gives what merging them at once gives; with
    `link_by_name` it depends on who is there when a new id comes.
    """
    delta = checkpointed(source_records(exports))
    folded = checkpointed(fold_records(records, delta))
    if link_by_name:
        # Whoever may own a new id is only known from all names.
        people, touched = None, folded
    else:
        people = checkpointed(touched_people(person, delta))
        touched = checkpointed(affected_records(person, people, folded, delta))
    latest = _latest(person, touched, link_by_name, people)
    merged, audit = merge_person(person, touched, link_by_name, people, latest)
    merged = checkpointed(merged)
    pantry = exports.get("pantry")
    if pantry is not None and household_column in pantry.columns:
        household = merge_households(household, pantry, merged, household_column)
    return Merged(sweep_latest(merged, touched, people, latest), household, audit, folded)


def _latest(person: DataFrame, records: DataFrame, link_by_name: bool, people: DataFrame | None = None) -> DataFrame | None:
    """`latest_by_person`, worked out once for the merged persons, the audit and the sweep; None where linking may give people there new ids."""
    if link_by_name and not person.isEmpty():
        return None
    return checkpointed(latest_by_person(person, records, people))


def run_merges(
    person: DataFrame, household: DataFrame, exports: Exports, household_column: str = HOUSEHOLD_COLUMN, link_by_name: bool = False
) -> Merged:
    """People, then households, then latest fields, from all export rows. Nothing is dropped.

    The records an export boils down to, and the merged persons, are checkpointed: each feeds several later steps, and raw
    exports are parsed for them only once.
    """
    records = checkpointed(source_records(exports))
    latest = _latest(person, records, link_by_name)
    merged, audit = merge_person(person, records, link_by_name, latest=latest)
    merged = checkpointed(merged)
    pantry = exports.get("pantry")
    if pantry is not None and household_column in pantry.columns:
        household = merge_households(household, pantry, merged, household_column)
    return Merged(sweep_latest(merged, records, latest=latest), household, audit, records)


def rebuild_all(spark: SparkSession, exports: Exports, household_column: str = HOUSEHOLD_COLUMN) -> Merged:
    """The same from an empty state. No table says any more which ids belong to one human, so names and birth dates do."""
    person, household, _ = empty_state(spark)
    return run_merges(person, household, exports, household_column, link_by_name=True)


def create_export_table(spark: SparkSession, service: str, columns: list[str] | None = None) -> str:
    """An export table whose rows are partitioned by batch, unless it is there; gives its name."""
    spec = next(s for s in SERVICES if s.service == service)
    fields = ", ".join(f"`{c}` STRING" for c in columns or [spec.id_column, spec.date_column])
    spark.sql(f"CREATE TABLE IF NOT EXISTS {spec.table} ({fields}, {BATCH} STRING) USING parquet PARTITIONED BY ({BATCH})")
    return spec.table


def load_exports(spark: SparkSession) -> dict[str, DataFrame]:
    """The export tables the catalog holds, by service."""
    return {s.service: spark.table(s.table) for s in SERVICES if spark.catalog.tableExists(s.table)}


def new_batches(spark: SparkSession, version: Version) -> tuple[dict[str, DataFrame], DataFrame]:
    """The export rows that a version does not hold, by service, and the batches a version with them holds.

    Only partitions of new batches are read; their names, like the names of files, are known to the driver. A table that is not
    partitioned by batch is read whole: folding rows in again changes nothing.
    """
    held = versions.table_at(spark, BATCHES, version) if version.attempt else spark.createDataFrame([], _BATCH_ROWS)
    known: dict[str, set[str]] = {}
    for row in held.collect():
        known.setdefault(row["service"], set()).add(row["batch_id"])
    fresh, added = {}, []
    for spec in SERVICES:
        if not spark.catalog.tableExists(spec.table):
            continue
        # Another session, such as that of a stream, may have replaced files that this one has listed.
        spark.catalog.refreshTable(spec.table)
        rows = spark.table(spec.table)
        if BATCH not in rows.columns:
            fresh[spec.service] = rows
            continue
        there = {r[0].partition("=")[2] for r in spark.sql(f"SHOW PARTITIONS {spec.table}").collect()}
        if names := sorted(there - known.get(spec.service, set())):
            fresh[spec.service] = rows.where(F.col(BATCH).isin(names)).drop(BATCH)
            added += [(spec.service, name) for name in names]
    return fresh, held.unionByName(spark.createDataFrame(added, _BATCH_ROWS))


def state_at(spark: SparkSession, version: Version) -> dict[str, DataFrame]:
    """person, household and records of a version; before the first one the catalog's own tables or views `person` and `household`."""
    if version.attempt:
        return {name: versions.table_at(spark, name, version) for name in (*STATE, RECORDS)}
    empty = dict(zip(STATE, empty_state(spark)[:2], strict=True))
    return {n: spark.table(n) if spark.catalog.tableExists(n) else empty[n] for n in STATE} | {RECORDS: empty_records(spark)}


def current_state(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """`person` and `household` of one and the same version, the one in force."""
    found = state_at(spark, current_version(spark))
    return found["person"], found["household"]


def published_version(spark: SparkSession) -> int:
    """The number of the version that is in force; 0 before the first one."""
    return current_version(spark).number


def _published(merged: Merged, batches: DataFrame, base: Version) -> Merged:
    spark = merged.person.sparkSession
    tables = {"person": merged.person, "household": merged.household, RECORDS: merged.records, BATCHES: batches, versions.AUDIT: merged.audit}
    done = versions.publish(tables, base)
    return Merged(*(versions.table_at(spark, n, done) for n in STATE), spark.table(versions.AUDIT + CURRENT), versions.table_at(spark, RECORDS, done))


def merge_tables(spark: SparkSession, rebuild: bool = False, link_by_name: bool = False) -> Merged:
    """Fold what is new in the export tables into the state in force and publish the result; with `rebuild`, everything into an empty state."""
    base = current_version(spark)
    if rebuild:
        exports, batches = new_batches(spark, versions.NOTHING)
        return _published(rebuild_all(spark, exports), batches, base)
    exports, batches = new_batches(spark, base)
    if not exports:
        exports = {s: df.limit(0) for s, df in load_exports(spark).items()}
    state = state_at(spark, base)
    return _published(fold_merges(state["person"], state["household"], state[RECORDS], exports, link_by_name=link_by_name), batches, base)


def merge_new_batches(spark: SparkSession, tries: int = 5) -> int:
    """Publish a version with all batches that are not in yet, if there are any; gives the version in force.

    Where another publisher is faster, the batches that are still missing are merged into its version.
    """
    for left in range(tries - 1, -1, -1):
        base = current_version(spark)
        exports, batches = new_batches(spark, base)
        if base.attempt and not exports:
            return base.number
        state = state_at(spark, base)
        try:
            _published(fold_merges(state["person"], state["household"], state[RECORDS], exports), batches, base)
        except ConcurrentPublishError:
            if not left:
                raise
        else:
            return base.number + 1
    raise AssertionError("unreachable")


def append_and_merge(
    spark: SparkSession,
    path: str | list[str],
    table: str,
    has_header: bool = False,
    multi_line: bool = True,
    batch: str | None = None,
) -> AppendResult:
    """Append a CSV export to its table and merge. Appended rows stay if a merge fails; merging again makes up for it.

    In a table that is partitioned by batch the rows become the partition `batch` (by default a new name). Give a load a name of its own,
    and loading it again after a failure replaces the rows it left instead of adding them a second time.
    """
    result = append_export(spark, path, table, has_header, multi_line, batch=batch or uuid.uuid4().hex)
    merge_new_batches(spark)
    return result
