"""New ids of known people: the graph of names and people against walking it by hand."""

from __future__ import annotations

import datetime as dt
import random

import pytest

from tallyhouse.operators.linking import connected, link_known
from tallyhouse.operators.merge import source_records
from tallyhouse.plans import ingest
from tallyhouse.schemas import HOUSEHOLD, PERSON

BORN = dt.date(1980, 5, 17)
COLUMNS = "first_name string, last_name string, dob string"
KINDS = {
    "pantry": f"`Client ID` string, `Visit Date` string, {COLUMNS}",
    "pharmacy": f"`PAT KEY` string, `RX PICKED UP` string, {COLUMNS}",
    "clinic": f"patientid string, apptcheckindate string, {COLUMNS}",
}


def person(spark, *rows):
    """(person_id, pantry, pharmacy, clinic, first, last) with one birth date."""
    return spark.createDataFrame([(*r, BORN, *[None] * 6) for r in rows], PERSON)


def records(spark, **rows):
    """(id, first, last) by service."""
    return source_records(
        {s: spark.createDataFrame([(str(i), "2024-01-01", f, n, "1980-05-17") for i, f, n in rows.get(s, [])], k) for s, k in KINDS.items()}
    )


def outcome(person, records):
    linked, links, apart = link_known(person, records)
    ids = {r["person_id"]: (r["pantry_client_id"], r["pharmacy_pat_key"], r["clinic_patientid"]) for r in linked.collect()}
    return {int(k): tuple(None if i is None else int(i) for i in v) for k, v in ids.items()}, links.count(), {tuple(r) for r in apart.collect()}


def test_a_new_pharmacy_id_joins_a_known_patient(spark):
    there = person(spark, (1, None, None, 9, " Ann", "LEE"), (2, 4, None, None, "Bob", "Lee"))
    new = records(spark, pharmacy=[(7, "ann", "Lee "), (8, "Cy", "Lee")], clinic=[(9, "Ann", "Lee")])
    assert outcome(there, new) == ({1: (None, 7, 9), 2: (4, None, None)}, 1, set())


def test_a_service_cannot_have_two_ids(spark):
    there = person(spark, (1, None, 5, 9, "Ann", "Lee"), (2, None, None, 3, "Bob", "Lee"))
    new = records(spark, pharmacy=[(7, "Ann", "Lee"), (10, "Bob", "Lee"), (11, "Bob", "Lee")])
    assert outcome(there, new) == ({1: (None, 5, 9), 2: (None, None, 3)}, 0, {("pharmacy", 7), ("pharmacy", 10), ("pharmacy", 11)})


def test_names_reach_over_people(spark):
    """A patient known under two names by two exports takes ids under either; two people under one name take none."""
    there = person(spark, (1, None, None, 9, "Ann", "Lee"), (2, None, None, 20, "Dee", "Fox"), (3, None, None, 21, "Dee", "Fox"))
    known = {"clinic": [(9, "Anne", "Leigh"), (20, "Dee", "Fox"), (21, "Dee", "Fox")]}
    both = records(spark, pharmacy=[(7, "Ann", "Lee")], pantry=[(8, "Anne", "Leigh"), (30, "Dee", "Fox")], **known)
    assert outcome(there, both) == ({1: (8, 7, 9), 2: (None, None, 20), 3: (None, None, 21)}, 2, {("pantry", 30)})
    # Under her two names there are now two ids of one service.
    clash = records(spark, pharmacy=[(7, "Ann", "Lee"), (70, "Anne", "Leigh")], **known)
    assert outcome(there, clash)[1:] == (0, {("pharmacy", 7), ("pharmacy", 70)})


def test_blank_names_and_missing_dates_link_nobody(spark):
    there = spark.createDataFrame([(1, None, None, 9, "Ann", "Lee", None, *[None] * 6), (2, None, None, 8, " ", "Lee", BORN, *[None] * 6)], PERSON)
    new = records(spark, pharmacy=[(7, "Ann", "Lee"), (5, "", "Lee")])
    assert outcome(there, new)[1:] == (0, set())


def test_links_in_a_merge(spark):
    """The patient's row gets the id and the audit says so; the same again changes nothing; new people are still put together by name."""
    there = person(spark, (1, None, None, 9, "Ann", "Lee"))
    empty = spark.createDataFrame([], HOUSEHOLD)
    day = "2024-01-01"
    exports = {
        "pharmacy": spark.createDataFrame([("7", day, "Ann", "Lee", "1980-05-17"), ("8", day, "Cy", "Lee", "1980-05-17")], KINDS["pharmacy"]),
        "pantry": spark.createDataFrame([("6", day, "Cy", "Lee", "1980-05-17")], KINDS["pantry"]),
    }
    first = ingest.fold_merges(there, empty, ingest.empty_records(spark), exports, link_by_name=True)
    ids = {(r["pantry_client_id"], r["pharmacy_pat_key"], r["clinic_patientid"]) for r in first.person.collect()}
    assert ids == {(None, 7, 9), (6, 8, None)}
    audit = {(r["person_id"], r["action"], r["field"], r["new_value"]) for r in first.audit.collect()}
    assert (1, "update", "pharmacy_pat_key", "7") in audit and len(audit) == 3
    second = ingest.fold_merges(first.person, empty, first.records, exports, link_by_name=True)
    assert sorted(map(str, second.person.collect())) == sorted(map(str, first.person.collect())) and second.audit.isEmpty()


@pytest.mark.parametrize("seed", [1])
def test_components(spark, seed, hot_keys_from):
    hot_keys_from(10)
    draw = random.Random(seed)
    edges = [(draw.randrange(150), draw.randrange(150)) for _ in range(90)] + [(200 + k, 201 + k) for k in range(40)] + [(300, 301 + k) for k in range(60)]
    root = {}
    for a, b in edges:
        if a != b:
            root.setdefault(a, a)
            root.setdefault(b, b)
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            if a != b and root[a] != root[b]:
                root[a] = root[b] = min(root[a], root[b])
                changed = True
    found = {r["node"]: r["root"] for r in connected(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert found == root
    assert connected(spark.createDataFrame([], "a bigint, b bigint")).isEmpty()
