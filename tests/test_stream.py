from __future__ import annotations

import pytest
from pyspark.errors import StreamingQueryException

from tallyhouse.plans import ingest
from tallyhouse.streaming import ingest as ingest_stream
from tallyhouse.streaming.ingest import stream_and_merge, stream_exports

COLUMNS = ["patientid", "apptcheckindate"]


def test_files_are_taken_once_and_wide_ones_refused(spark, tmp_path):
    incoming = tmp_path / "in"
    incoming.mkdir()
    calls = []

    def run():
        stream_exports(
            spark,
            str(incoming),
            COLUMNS,
            str(tmp_path / "out"),
            str(tmp_path / "rejects"),
            str(tmp_path / "state"),
            after_batch=lambda session: calls.append(session),
        ).awaitTermination()
        rows = spark.read.schema("patientid string, apptcheckindate string").parquet(str(tmp_path / "out"))
        return sorted((tuple(r) for r in rows.select(*COLUMNS).collect()), key=str)

    (incoming / "a.csv").write_text('1,2024-01-01\n2,"multi\nline"\n,\n')
    (incoming / "wide.csv").write_text("3,2024-01-01\n4,2024-01-01,surplus\n")
    first = [("1", "2024-01-01"), ("2", "multi\nline")]
    assert run() == first
    assert run() == first
    (incoming / "b.csv").write_text("5\n")
    assert run() == [*first, ("5", None)]
    refused = spark.read.parquet(str(tmp_path / "rejects")).collect()
    assert [(r["_file"].rsplit("/", 1)[1], r["wide_rows"]) for r in refused] == [("wide.csv", 1)]
    assert len(calls) == 2


@pytest.fixture
def table(spark):
    spark.sql("CREATE DATABASE IF NOT EXISTS streamed")
    spark.catalog.setCurrentDatabase("streamed")
    yield ingest.create_export_table(spark, "clinic", [*COLUMNS, "first_name"])
    spark.catalog.setCurrentDatabase("default")
    spark.sql("DROP DATABASE streamed CASCADE")


def test_arrived_files_are_parsed_once(spark, table, tmp_path, monkeypatch):
    plans, real = [], ingest_stream.replace_batch
    monkeypatch.setattr(ingest_stream, "replace_batch", lambda rows, *more: plans.append(rows._jdf.queryExecution().toString()) or real(rows, *more))
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text("1,2024-01-01,Ann\n2,2024-01-02,Bob\n")
    stream_and_merge(spark, str(tmp_path / "in"), table, str(tmp_path / "rejects"), str(tmp_path / "state")).awaitTermination()
    assert len(plans) == 1 and "FileScan csv" not in plans[0]
    assert ingest.current_state(spark)[0].count() == 2


@pytest.mark.parametrize("point", ["before the merge", "after the merge"])
def test_a_failure_adds_nothing_twice(spark, table, tmp_path, point):
    """The batch dies between append and merge, or after the merge; the restart ends with the same table and one version a batch."""
    (tmp_path / "in").mkdir()
    failing = [True]

    def merge(session):
        if point == "after the merge":
            ingest.merge_new_batches(session)
        if failing:
            raise RuntimeError(point)
        ingest.merge_new_batches(session)

    def rows():
        spark.catalog.refreshTable(table)
        return spark.table(table).count()

    def run():
        stream_and_merge(
            spark, str(tmp_path / "in"), table, str(tmp_path / "rejects"), str(tmp_path / "state"), merge=merge
        ).awaitTermination()

    (tmp_path / "in" / "a.csv").write_text("1,2024-01-01,Ann\n2,2024-01-02,Bob\n")
    with pytest.raises(StreamingQueryException, match=point):
        run()
    assert rows() == 2
    failing.clear()
    run()
    assert rows() == 2 and ingest.published_version(spark) == 1
    names = lambda: {r["clinic_patientid"]: r["first_name"] for r in ingest.current_state(spark)[0].collect()}
    assert names() == {1: "Ann", 2: "Bob"}
    (tmp_path / "in" / "b.csv").write_text("2,2024-02-02,Robert\n3,2024-02-02,Cy\n")
    (tmp_path / "in" / "wide.csv").write_text("9,2024-02-02,Dee,surplus\n")
    run()
    run()
    assert rows() == 4 and ingest.published_version(spark) == 2
    assert names() == {1: "Ann", 2: "Robert", 3: "Cy"}
    assert spark.table("person_audit_current").where("action = 'insert'").count() == 3


def test_cut_records_stop_a_stream(spark, table, tmp_path):
    """Without multi_line a quoted line break would make two records of one."""
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text('1,2024-01-01,"An\nn"\n')
    with pytest.raises(StreamingQueryException, match="quoted field"):
        stream_and_merge(
            spark, str(tmp_path / "in"), table, str(tmp_path / "r"), str(tmp_path / "s"), multi_line=False
        ).awaitTermination()
    assert spark.table(table).count() == 0
    with pytest.raises(ValueError, match="max_files"):
        stream_exports(spark, str(tmp_path / "in"), COLUMNS, "t", "r", "c", max_files=0)
    with pytest.raises(ValueError, match="partitioned"):
        spark.range(1).write.saveAsTable("plain_export")
        stream_and_merge(spark, str(tmp_path / "in"), "plain_export", "r", "c")
