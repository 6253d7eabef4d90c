from __future__ import annotations

import datetime as dt

import pytest

from tallyhouse.operators import merge
from tallyhouse.operators.merge import merge_households, merge_person, new_person_id, source_records, sweep_latest
from tallyhouse.plans import ingest, versions
from tallyhouse.schemas import HOUSEHOLD, PERSON, PERSON_FIELDS
from tallyhouse.session import checkpointed
from tallyhouse.sources import csv_export
from pyspark.sql import functions as F

PANTRY = "`Client ID` string, `Visit Date` string, first_name string, last_name string, dob string, race string, `Household ID` string"
CLINIC = "patientid string, apptcheckindate string, first_name string, last_name string, dob string, race string"
DAY = dt.date(1980, 5, 17)


@pytest.fixture
def exports(spark):
    return {
        "pantry": spark.createDataFrame(
            [
                (" 01 ", "2024-01-05", "Ann", "Lee", "5/17/1980", "White", "77"),
                ("1", "2024-03-01", "", " ", "n/a", "Asian", "77"),
                ("1", "bad date", "Old", "Old", None, "Old", None),
                ("2", "2024-02-01", "Bob", "Lee", None, " ", "77"),
                ("x", "2024-02-01", "No", "Body", None, None, "77"),
            ],
            PANTRY,
        ),
        "clinic": spark.createDataFrame([("9", "2024-03-01", "Anne", "Lee", "1980-05-17", "Black")], CLINIC),
    }


@pytest.fixture
def person(spark):
    row = (5, 1, None, 9, "", None, None, "F", None, None, "Unset", None, None)
    return spark.createDataFrame([row], PERSON)


def by_id(df):
    return {r["person_id"]: r.asDict() for r in df.collect()}


def test_records_hold_the_latest_values(exports):
    got = {(r["service"], r["key"]): r for r in source_records(exports).collect()}
    assert set(got) == {("pantry", 1), ("pantry", 2), ("clinic", 9)}
    one = got["pantry", 1]
    assert (one["first_name"]["value"], one["dob"]["value"], one["race"]["value"]) == ("Ann", DAY, "Asian")
    assert one["race"]["seen"] == dt.date(2024, 3, 1)
    assert got["pantry", 2]["race"] is None


def test_a_task_holds_one_partition_of_all_exports(exports):
    """United after their aggregations, the exports' partitions would lie in one task, and their records in as many shuffles."""
    plan = source_records(exports)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2
    assert plan.index("Union") > plan.rindex("Exchange hashpartitioning")


def test_people_are_added_and_blanks_filled(spark, exports, person):
    merged, audit = merge_person(person, source_records(exports))
    rows = by_id(merged)
    known, new = rows.pop(5), rows.popitem()[1]
    # Of two names, the later one is taken; what was set stays.
    assert (known["first_name"], known["dob"], known["race"], known["sex_at_birth"]) == ("Anne", DAY, "Unset", "F")
    assert not rows and (new["pantry_client_id"], new["first_name"], new["clinic_patientid"]) == (2, "Bob", None)
    entries = sorted((r["person_id"], r["source"], r["action"], r["field"], r["old_value"], r["new_value"]) for r in audit.collect() if r["field"])
    assert entries == [
        (5, "clinic", "update", "dob", None, "1980-05-17"),
        (5, "clinic", "update", "first_name", "", "Anne"),
        (5, "clinic", "update", "last_name", None, "Lee"),
    ]
    inserts = [r for r in audit.collect() if r["action"] == "insert"]
    assert [(r["person_id"], r["source"], r["new_value"]) for r in inserts] == [(new["person_id"], "pantry", "2")]


def test_latest_values_win(spark, exports, person):
    swept = by_id(sweep_latest(person, source_records(exports)))[5]
    # Same day: pantry comes after clinic by name.
    assert (swept["first_name"], swept["race"], swept["sex_at_birth"]) == ("Anne", "Asian", "F")


def test_households(spark, exports, person):
    household = spark.createDataFrame([(3, 5)], HOUSEHOLD)
    merged, _ = merge_person(person, source_records(exports))
    got = {tuple(r) for r in merge_households(household, exports["pantry"], merged).collect()}
    bob = next(i for i, r in by_id(merged).items() if r["pantry_client_id"] == 2)
    assert got == {(3, 5), (77, 5), (77, bob)}


def state(merged):
    ordered = lambda df: sorted(map(str, (tuple(r) for r in df.collect())))
    return ordered(merged.person), ordered(merged.household)


def test_running_again_changes_nothing(spark, exports, person):
    first = ingest.run_merges(person, spark.createDataFrame([], HOUSEHOLD), exports)
    second = ingest.run_merges(first.person, first.household, exports)
    assert state(first) == state(second)
    assert first.audit.count() > 0 and second.audit.count() == 0


def test_latest_values_are_worked_out_once(spark, exports, person, monkeypatch):
    """For the merged persons, the audit and the sweep; a sweep of everybody gives the same."""
    ordered = lambda df: sorted(str(tuple(r)) for r in df.collect())
    records = checkpointed(source_records(exports))
    household, nobody = spark.createDataFrame([], HOUSEHOLD), spark.createDataFrame([], PERSON)
    merged, rebuilt = checkpointed(merge_person(person, records)[0]), checkpointed(merge_person(nobody, records, link_by_name=True)[0])
    plain = [ordered(sweep_latest(merged, records)), ordered(sweep_latest(rebuilt, records))]
    real, calls = merge.latest_by_person, []
    for module in (merge, ingest):
        monkeypatch.setattr(module, "latest_by_person", lambda *given: calls.append(1) or real(*given), raising=False)
    assert ordered(ingest.run_merges(person, household, exports).person) == plain[0] and len(calls) == 1
    assert ordered(ingest.rebuild_all(spark, exports).person) == plain[1] and len(calls) == 2


def test_rebuild(spark, exports, hot_keys_from):
    plain = state(ingest.rebuild_all(spark, exports))
    hot_keys_from(1)
    assert state(ingest.rebuild_all(spark, exports)) == plain
    assert len(plain[0]) == 3 and len(plain[1]) == 2


def test_new_ids_are_distinct_and_negative(spark):
    keys = [0, 1, 2, 3, 4, 5, 2**60 - 1, 2**60, 2**63 - 1, -(2**63), -1]  # the last two stand for 2^63 and 2^64 - 1
    df = spark.createDataFrame([(s, k) for s in ("pantry", "pharmacy", "clinic") for k in keys], "service string, key bigint")
    ids = [r[0] for r in df.select(new_person_id(F.col("service"), F.col("key"))).collect()]
    assert len(set(ids)) == len(ids) and max(ids) < 0


def test_append_and_merge_through_the_catalog(spark, tmp_path):
    spark.sql("CREATE DATABASE IF NOT EXISTS flow")
    spark.catalog.setCurrentDatabase("flow")
    try:
        spark.createDataFrame([], PANTRY).write.saveAsTable("pantry_export")
        file = tmp_path / "a.csv"
        file.write_text("1,2024-01-05,Ann,Lee,5/17/1980,White,77\n2,2024-01-06,Bob,Lee,,,77\n")
        result = ingest.append_and_merge(spark, str(file), "pantry_export")
        assert result.rows_inserted == 2
        person, household, audit = (lambda n=n: spark.table(f"{n}_current") for n in ("person", "household", "person_audit"))
        assert {r["first_name"] for r in person().collect()} == {"Ann", "Bob"}
        assert household().count() == 2 and audit().count() == 2
        file.write_text("2,2024-02-06,Robert,Lee,,,78\n")
        ingest.append_and_merge(spark, str(file), "pantry_export")
        assert {r["first_name"] for r in person().collect()} == {"Ann", "Robert"}
        assert household().count() == 3 and audit().count() == 2
        assert set(person().columns) == {"person_id", "pantry_client_id", "pharmacy_pat_key", "clinic_patientid", *PERSON_FIELDS}
        ingest.merge_tables(spark, rebuild=True)
        assert person().count() == 2 and ingest.published_version(spark) == 3
        # person, household and records of two versions
        assert ingest.remove_old_versions(spark) == 6 and person().count() == 2 and household().count() == 3
    finally:
        spark.catalog.setCurrentDatabase("default")
        spark.sql("DROP DATABASE flow CASCADE")


@pytest.fixture
def database(spark):
    """A database of its own, which is the current one during a test."""
    spark.sql("CREATE DATABASE IF NOT EXISTS there")
    spark.catalog.setCurrentDatabase("there")
    yield
    spark.catalog.setCurrentDatabase("default")
    spark.sql("DROP DATABASE there CASCADE")


@pytest.mark.parametrize("kind", ["table", "view"])
def test_publishing_over_what_is_there_survives_failures(spark, database, exports, person, monkeypatch, kind):
    exports["pantry"].write.saveAsTable("pantry_export")
    person.write.saveAsTable("person" if kind == "table" else "base_person")
    if kind == "view":
        spark.sql("CREATE VIEW person AS SELECT * FROM base_person")
    before = sorted(map(str, spark.table("person").collect()))
    real = versions._commit

    def fail(*_):
        raise RuntimeError("before the manifest")

    monkeypatch.setattr(versions, "_commit", fail)
    with pytest.raises(RuntimeError):
        ingest.merge_tables(spark)
    assert ingest.published_version(spark) == 0
    monkeypatch.setattr(versions, "_commit", real)
    merged = ingest.merge_tables(spark)
    first = merged.audit.count()
    assert first > 0 and ingest.published_version(spark) == 1
    assert ingest.merge_tables(spark).audit.count() == first
    assert sorted(map(str, spark.table("person").collect())) == before
    # The tables of the failed attempt, and the first version but for its audit.
    assert ingest.remove_old_versions(spark) > 3
    assert spark.table("person_audit_current").count() == first


def test_of_two_publishers_one_succeeds(spark, database, exports):
    """Both start from the same version; the second is told so, and merges into the version of the first."""
    for service in ("pantry", "clinic"):
        ingest.create_export_table(spark, service, exports[service].columns)
    csv_export.replace_batch(exports["pantry"], "pantry_export", "a")
    slow = ingest.current_version(spark)
    rows, batches = ingest.new_batches(spark, slow)
    state = ingest.state_at(spark, slow)
    held_up = ingest.fold_merges(state["person"], state["household"], state[ingest.RECORDS], rows)
    assert ingest.merge_new_batches(spark) == 1
    seen = sorted(map(str, ingest.current_state(spark)[0].collect()))
    with pytest.raises(ingest.ConcurrentPublishError):
        ingest._published(held_up, batches, slow)
    assert ingest.published_version(spark) == 1 and sorted(map(str, ingest.current_state(spark)[0].collect())) == seen
    csv_export.replace_batch(exports["clinic"], "clinic_dob_export", "b")
    real, lost = versions._commit, []

    def first_time_too_late(spark, number, attempt):
        if not lost:
            lost.append(number)
            real(spark, number, "0" * 32)
        real(spark, number, attempt)

    versions._commit = first_time_too_late
    try:
        # The other version, an empty one, is the base of the second try.
        assert ingest.merge_new_batches(spark) == 3
    finally:
        versions._commit = real
    assert {r["clinic_patientid"] for r in ingest.current_state(spark)[0].collect()} == {None, 9} and lost == [2]


def test_readers_see_one_version(spark, database, exports, monkeypatch):
    """A publisher that dies after its manifest: persons and households of the new version, in the views too."""
    ingest.create_export_table(spark, "pantry", exports["pantry"].columns)
    rows = exports["pantry"].collect()
    for batch, part in (("a", rows[:3]), ("b", rows[3:])):
        csv_export.replace_batch(spark.createDataFrame(part, PANTRY), "pantry_export", batch)
        if batch == "b":
            monkeypatch.setattr(versions, "_views", lambda *_: 1 / 0)
            with pytest.raises(ZeroDivisionError):
                ingest.merge_new_batches(spark)
        else:
            ingest.merge_new_batches(spark)
    person, household = ingest.current_state(spark)
    assert ingest.published_version(spark) == 2
    assert person.count() == 2 == spark.table("person_current").count()
    assert household.count() == 2 == spark.table("household_current").count()


def test_batches_give_what_one_merge_gives(spark, exports):
    """Also where people share an id: the one who gains no row keeps the latest value of all of theirs."""
    shared = spark.createDataFrame(
        [(5, 1, None, 9, "", None, None, "F", None, None, "Unset", None, None), (6, 2, None, 9, None, None, None, None, None, None, None, None, None)], PERSON
    )
    empty = spark.createDataFrame([], HOUSEHOLD)
    once = ingest.run_merges(shared, empty, exports)
    pantry = exports["pantry"].collect()
    for cuts in ([0, 1, 4, 5], [0, 0, 5]):
        person, household, records = shared, empty, ingest.empty_records(spark)
        for low, high in zip(cuts, cuts[1:], strict=False):
            part = {"pantry": spark.createDataFrame(pantry[low:high], PANTRY)}
            step = ingest.fold_merges(person, household, records, part)
            person, household, records = checkpointed(step.person), checkpointed(step.household), step.records
        step = ingest.fold_merges(person, household, records, {"clinic": exports["clinic"]})
        assert state(step) == state(once)
        key = lambda df: sorted(map(str, df.collect()))
        assert key(step.records) == key(once.records)


def test_old_batches_are_not_read(spark, database, exports):
    ingest.create_export_table(spark, "pantry", exports["pantry"].columns)
    csv_export.replace_batch(exports["pantry"], "pantry_export", "old")
    ingest.merge_new_batches(spark)
    csv_export.replace_batch(exports["pantry"].limit(1), "pantry_export", "new")
    rows, _ = ingest.new_batches(spark, ingest.current_version(spark))
    assert {f.split("batch_id=")[1].split("/")[0] for f in rows["pantry"].inputFiles()} == {"new"}
    ingest.merge_new_batches(spark)
    assert ingest.new_batches(spark, ingest.current_version(spark))[0] == {}
    assert ingest.merge_new_batches(spark) == 2


def test_the_audit_view_stays_small(spark, database, exports):
    """Its plan does not grow with the number of versions."""
    ingest.create_export_table(spark, "pantry", exports["pantry"].columns)
    sizes = []
    for k in range(2):
        csv_export.replace_batch(exports["pantry"].limit(k + 1), "pantry_export", f"b{k}")
        ingest.merge_new_batches(spark)
        view = spark.table("person_audit_current")
        sizes.append(len(view._jdf.queryExecution().analyzed().treeString().splitlines()))
        assert view.select("version").distinct().count() <= k + 1
    assert len(set(sizes)) == 1


def test_a_load_that_runs_again_adds_nothing(spark, database, tmp_path):
    ingest.create_export_table(spark, "pantry", ["Client ID", "Visit Date"])
    file = tmp_path / "a.csv"
    file.write_text("1,2024-01-05\n2,2024-01-06\n")
    for _ in range(2):
        assert ingest.append_and_merge(spark, str(file), "pantry_export", batch="load-1").rows_inserted == 2
    assert spark.table("pantry_export").count() == 2 and ingest.published_version(spark) == 1
    with pytest.raises(ValueError, match="named by"):
        ingest.append_and_merge(spark, str(file), "pantry_export", batch="a'b")
    with pytest.raises(ValueError, match="name the batch"):
        csv_export.append_export(spark, str(file), "pantry_export")
