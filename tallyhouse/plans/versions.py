"""Versions of the merged state: tables partitioned by attempt, and one small file a version that says which attempt is in force.

A publish first writes its rows into a partition of its own, named by a random attempt, in every table of the state. Only then does it put
down the manifest of the next version, by a rename that fails if that version is there already. So a version is all there or not at all,
however a publish fails; of two publishers that started from the same version one succeeds and the other is told to merge again. Readers take
the attempt from the newest manifest once and read every table at that attempt. Rows of attempts that never came into force are not seen
and go with `remove_old_versions`.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ATTEMPT = "attempt"
SUFFIX = "_versions"
CURRENT = "_current"
AUDIT = "person_audit"
FOLDER = "_merge_manifest"


class ConcurrentPublishError(RuntimeError):
    """Another publisher brought its version into force first; nothing of this one is visible."""


@dataclass(frozen=True)
class Version:
    number: int
    attempt: str | None


NOTHING = Version(0, None)


def manifest_folder(spark: SparkSession) -> str:
    """Beside the tables of the current database."""
    return f"{spark.catalog.getDatabase(spark.catalog.currentDatabase()).locationUri.rstrip('/')}/{FOLDER}"


def _hadoop(spark: SparkSession):
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    folder = jvm.org.apache.hadoop.fs.Path(manifest_folder(spark))
    return jvm, folder, folder.getFileSystem(conf), conf


def versions(spark: SparkSession) -> list[Version]:
    """All versions, oldest first. The manifests are as many as publishes, some 80 bytes each."""
    _, folder, files, _ = _hadoop(spark)
    if not files.exists(folder):
        return []
    rows = spark.read.text(manifest_folder(spark)).collect()
    return sorted((Version(m["version"], m["attempt"]) for m in (json.loads(r[0]) for r in rows)), key=lambda v: v.number)


def current_version(spark: SparkSession) -> Version:
    """The version in force; number 0 before the first one."""
    return max(versions(spark), key=lambda v: v.number, default=NOTHING)


def _commit(spark: SparkSession, number: int, attempt: str) -> None:
    """Put down the manifest of version `number`, unless it is there."""
    jvm, folder, files, conf = _hadoop(spark)
    files.mkdirs(folder)
    target = jvm.org.apache.hadoop.fs.Path(folder, f"{number:012d}.json")
    draft = jvm.org.apache.hadoop.fs.Path(folder, f".{attempt}")
    out = files.create(draft, True)
    out.write(bytearray((json.dumps({"version": number, ATTEMPT: attempt}) + "\n").encode()))
    out.close()
    options = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
    try:
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), conf).rename(draft, target, options)
    except Py4JJavaError as error:
        files.delete(draft, False)
        if "FileAlreadyExistsException" in error.java_exception.getClass().getName():
            raise ConcurrentPublishError(f"version {number} was published by another writer: merge again") from None
        raise
    # Where a file system's rename is not exclusive, the attempt that is left in the manifest has won.
    if next(v.attempt for v in versions(spark) if v.number == number) != attempt:
        raise ConcurrentPublishError(f"version {number} was published by another writer: merge again")


def publish(tables: Mapping[str, DataFrame], base: Version) -> Version:
    """Write the tables of a state and bring them into force as the successor of `base`, which they were made from."""
    spark = next(iter(tables.values())).sparkSession
    attempt = uuid.uuid4().hex
    for name, df in tables.items():
        stamped = df.withColumn(ATTEMPT, F.lit(attempt))
        if spark.catalog.tableExists(name + SUFFIX):
            stamped.select(*spark.table(name + SUFFIX).columns).write.insertInto(name + SUFFIX)
        else:
            stamped.write.partitionBy(ATTEMPT).format("parquet").mode("append").saveAsTable(name + SUFFIX)
    _commit(spark, base.number + 1, attempt)
    _views(spark, tables)
    return Version(base.number + 1, attempt)


def _views(spark: SparkSession, names: Mapping[str, DataFrame]) -> None:
    """Views that follow the newest manifest by themselves; they are made once. The audit shows all versions, by one join."""
    rows = f"(SELECT get_json_object(value, '$.attempt') AS {ATTEMPT}, CAST(get_json_object(value, '$.version') AS BIGINT) AS version FROM text.`{manifest_folder(spark)}`)"
    for name, df in names.items():
        if spark.catalog.tableExists(name + CURRENT):
            continue
        columns = ", ".join(f"v.`{c}`" for c in df.columns)
        if name == AUDIT:
            text = f"SELECT m.version, {columns} FROM {name}{SUFFIX} v JOIN {rows} m ON v.{ATTEMPT} = m.{ATTEMPT}"
        else:
            text = f"SELECT {columns} FROM {name}{SUFFIX} v WHERE v.{ATTEMPT} = (SELECT max_by(m.{ATTEMPT}, m.version) FROM {rows} m)"
        spark.sql(f"CREATE OR REPLACE VIEW {name}{CURRENT} AS {text}")


def table_at(spark: SparkSession, name: str, version: Version) -> DataFrame:
    """A table of the state as of a version, whichever session published it."""
    spark.catalog.refreshTable(name + SUFFIX)
    return spark.table(name + SUFFIX).where(F.col(ATTEMPT) == version.attempt).drop(ATTEMPT)


def remove_old_versions(spark: SparkSession, keep: int = 1) -> int:
    """Drop the rows of all but the last `keep` versions, and of attempts that never came into force; audits of versions stay.

    Not while a publish is running: its attempt is not in force yet. Gives the number of partitions dropped.
    """
    known = versions(spark)
    kept, all_attempts, dropped = {v.attempt for v in known[-max(1, keep) :]}, {v.attempt for v in known}, 0
    for table in spark.catalog.listTables():
        if table.isTemporary or not table.name.endswith(SUFFIX):
            continue
        stay = all_attempts if table.name == AUDIT + SUFFIX else kept
        for row in spark.sql(f"SHOW PARTITIONS {table.name}").collect():
            attempt = row[0].partition("=")[2]
            if attempt not in stay:
                spark.sql(f"ALTER TABLE {table.name} DROP PARTITION ({ATTEMPT} = '{attempt}')")
                dropped += 1
    return dropped
