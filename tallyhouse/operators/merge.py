"""Merging export rows into `person` and `household`.

The existing procedures are known by name, order and purpose only: add new people without dropping any and keep an audit, add
household links from the pantry, take the latest fields. The rules below are our reading. Every function returns new frames
and gives the same again when it is run on its own result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyhouse.functions import id_key, id_of_key, is_blank, is_numeric_id, numeric_id, once, parse_mixed_date
from tallyhouse.operators.events import Exports, known_exports, person_keys
from tallyhouse.operators.linking import link_known
from tallyhouse.operators.skew import spread_join
from tallyhouse.schemas import HOUSEHOLD, ID, PERSON, PERSON_AUDIT, PERSON_FIELDS, SERVICES
from tallyhouse.session import checkpointed

HOUSEHOLD_COLUMN = "Household ID"


def new_person_id(service: Column, key: Column) -> Column:
    """A person id from the service and its key: the same on every run, and found without a global count.

    Ids made here are negative, so they meet none that a database handed out. (service, key) maps to its id one to one.
    """
    code = F.lit(0)
    for at, spec in enumerate(SERVICES):
        code = F.when(service == spec.service, at).otherwise(code)
    return (-(id_of_key(key) * 4 + code + 1)).cast(ID)


def source_records(exports: Exports) -> DataFrame:
    """(service, key, one struct a person field): for every export id its latest non-blank values and their dates.

    Rows without a usable date count as oldest; of two values of one day the greater is taken. The first aggregation has only a
    date in its buffer, so it is a hash aggregation that combines map-side and takes raw rows down to the few variants of an id;
    the second works on those. All exports go through the same two shuffles: aggregated one by one and united, Spark would give a task the
    equal partitions of all of them, which is as many times the size that AQE aims at.
    """
    names = [f"_{name}" for name in PERSON_FIELDS]
    parts = []
    for spec, df in known_exports(exports):
        id_text, date_text = F.col(f"`{spec.id_column}`"), F.col(f"`{spec.date_column}`")
        fields = []
        for name in PERSON_FIELDS:
            if name not in df.columns:
                value = F.lit(None).cast(PERSON[name].dataType)
            elif name == "dob":
                value = parse_mixed_date(F.col(name))
            else:
                value = F.nullif(F.trim(F.col(name)), F.lit(""))
            fields.append(value.alias(f"_{name}"))
        parsed = once(
            df.filter(is_numeric_id(id_text)),
            id_key(id_text).alias("_key"),
            parse_mixed_date(date_text).alias("_seen"),
            *fields,
        )
        parts.append(parsed.filter(F.col("_key").isNotNull()).select(F.lit(spec.service).alias("service"), "_key", "_seen", *names))
    variants = reduce(DataFrame.unionByName, parts).groupBy("_key", "service", *names).agg(F.max("_seen").alias("_seen"))
    latest = [
        F.max(
            F.when(F.col(f"_{name}").isNotNull(), F.struct(F.col("_seen").alias("seen"), F.col(f"_{name}").alias("value")))
        ).alias(name)
        for name in PERSON_FIELDS
    ]
    # The key comes first wherever rows are sorted by both: it is what tells them apart.
    return variants.groupBy(F.col("_key").alias("key"), "service").agg(*latest).select("service", "key", *PERSON_FIELDS)


def fold_records(records: DataFrame, delta: DataFrame) -> DataFrame:
    """Records of two sets of export rows together: of each field the greater (date, value), as if all rows had been read at once."""
    both = records.unionByName(delta.select(*records.columns))
    return both.groupBy("key", "service").agg(*[F.max(name).alias(name) for name in PERSON_FIELDS]).select("service", "key", *PERSON_FIELDS)


def touched_people(person: DataFrame, delta: DataFrame) -> DataFrame:
    """(person_id): whoever holds one of the ids in `delta`."""
    return spread_join(person_keys(person), delta.select("service", "key"), ["key", "service"], "left_semi").select("person_id").distinct()


def affected_records(person: DataFrame, people: DataFrame, records: DataFrame, delta: DataFrame) -> DataFrame:
    """The records of all ids of `people`, and of the ids in `delta` that nobody has yet. A merge need not look at any other."""
    owned = spread_join(person_keys(person), people, ["person_id"], "left_semi")
    keys = owned.select("service", "key").unionByName(delta.select("service", "key")).distinct()
    return records.join(keys, ["key", "service"], "left_semi")


def latest_by_person(person: DataFrame, records: DataFrame, people: DataFrame | None = None) -> DataFrame:
    """(person_id, one struct a field): the latest value over all services of a person; of one day, the last service by name.

    Only of `people`, if given: others may share an id with them without having all their records here.
    """
    owned = person_keys(person)
    if people is not None:
        owned = spread_join(owned, people, ["person_id"], "left_semi").select("service", "key", "person_id")
    found = spread_join(owned, records, ["key", "service"])
    latest = [
        F.max(
            F.when(
                F.col(name).isNotNull(),
                F.struct(
                    F.col(f"{name}.seen").alias("seen"),
                    F.col("service").alias("service"),
                    F.col(f"{name}.value").alias("value"),
                ),
            )
        ).alias(f"_{name}")
        for name in PERSON_FIELDS
    ]
    return found.groupBy("person_id").agg(*latest)


def _unset(name: str) -> Column:
    return F.col(name).isNull() if name == "dob" else is_blank(F.col(name))


def _ids() -> list[Column]:
    """The id columns of `person`, whatever integral type they come in."""
    return [F.col(f.name).cast(ID).alias(f.name) for f in PERSON if f.name not in PERSON_FIELDS]


def _persons_by_id(fresh: DataFrame) -> DataFrame:
    """One person an export id."""
    return fresh.select(
        new_person_id(F.col("service"), F.col("key")).alias("person_id"),
        *[F.when(F.col("service") == s.service, F.col("key")).alias(s.person_key) for s in SERVICES],
        *[F.col(f"{name}.value").alias(name) for name in PERSON_FIELDS],
    )


def _persons_by_name(fresh: DataFrame) -> DataFrame:
    """One person for the ids of several services that name the same one.

    Our reading of how a person comes to hold ids of several services: first name, last name (trimmed, lower case) and birth date are
    equal and none is blank, and no service has more than one id under them; else every id stays a person of its own. A field is its
    latest value over the services, as in `latest_by_person`. Names that many ids share (placeholders) are only counted, map-side.
    """
    named = fresh.select(
        "*",
        F.lower(F.trim("first_name.value")).alias("_first"),
        F.lower(F.trim("last_name.value")).alias("_last"),
        F.col("dob.value").alias("_born"),
    )
    names = ["_first", "_last", "_born"]
    whole = F.coalesce((F.col("_first") != "") & (F.col("_last") != "") & F.col("_born").isNotNull(), F.lit(False))
    groups = named.filter(whole).groupBy(*names)
    one_each = F.lit(True)
    for s in SERVICES:
        one_each = one_each & (F.count_if(F.col("service") == s.service) <= 1)
    latest = [
        F.max(
            F.when(
                F.col(name).isNotNull(),
                F.struct(F.col(f"{name}.seen").alias("seen"), F.col("service").alias("service"), F.col(f"{name}.value").alias("value")),
            )
        ).alias(name)
        for name in PERSON_FIELDS
    ]
    keys = [F.max(F.when(F.col("service") == s.service, F.col("key"))).alias(s.person_key) for s in SERVICES]
    joined = groups.agg(one_each.alias("_one"), *keys, *latest)
    ids = F.coalesce(
        *[F.when(F.col(s.person_key).isNotNull(), new_person_id(F.lit(s.service), F.col(s.person_key))) for s in SERVICES]
    )
    together = joined.filter("_one").select(
        ids.alias("person_id"), *[s.person_key for s in SERVICES], *[F.col(f"{name}.value").alias(name) for name in PERSON_FIELDS]
    )
    apart = spread_join(named.filter(whole), joined.filter("not _one").select(*names), names, "left_semi").select(*fresh.columns)
    rest = named.filter(~whole).select(*fresh.columns)
    return together.unionByName(_persons_by_id(apart.unionByName(rest)))


def merge_person(
    person: DataFrame, records: DataFrame, link_by_name: bool = False, people: DataFrame | None = None, latest: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """New persons for export ids that `person` does not hold, and blank fields filled; with an audit of both.

    With `link_by_name` new ids first go to the people there whose name and birth date they have (see `linking.link_known`; the audit
    has an `update` of the id's column for each), and those of several services under one name and birth date become one new person
    (see `_persons_by_name`).

    The audit has one row a new person (`insert`, the new value is its export id) and one a filled field (`update`).
    `latest` is `latest_by_person` of the same arguments, for callers that have it; new ids that go to people there change it, so it is not
    used then. `records` is read on several branches, which the optimizer pushes different filters into: pass it checkpointed, so that the
    raw exports behind it are read once (`plans.ingest.run_merges` does).
    """
    links, apart = None, None
    if link_by_name and not person.isEmpty():
        person, links, apart = link_known(person, records)
        person, latest = checkpointed(person), None
    known = person_keys(person).select("service", "key").distinct()
    fresh = records.join(known, ["key", "service"], "left_anti")
    if apart is not None:
        alone = fresh.join(apart, ["key", "service"], "left_semi")
        new = _persons_by_name(fresh.join(apart, ["key", "service"], "left_anti")).unionByName(_persons_by_id(alone))
    else:
        new = _persons_by_name(fresh) if link_by_name else _persons_by_id(fresh)
    inserts = new.select("person_id", *[id_of_key(F.col(s.person_key)).alias(s.person_key) for s in SERVICES], *PERSON_FIELDS)
    joined = person.join(latest_by_person(person, records, people) if latest is None else latest, "person_id", "left")
    filled = {name: _unset(name) & F.col(f"_{name}.value").isNotNull() for name in PERSON_FIELDS}
    existing = joined.select(
        *_ids(),
        *[F.when(filled[n], F.col(f"_{n}.value")).otherwise(F.col(n)).alias(n) for n in PERSON_FIELDS],
    )
    changes = F.array(
        *[
            F.when(
                filled[n],
                F.struct(
                    F.col(f"_{n}.service").alias("source"),
                    F.lit("update").alias("action"),
                    F.lit(n).alias("field"),
                    F.col(n).cast("string").alias("old_value"),
                    F.col(f"_{n}.value").cast("string").alias("new_value"),
                ),
            )
            for n in PERSON_FIELDS
        ]
    )
    updates = joined.select(F.col("person_id").cast(ID).alias("person_id"), F.inline(F.filter(changes, lambda c: c.isNotNull())))
    ids = F.array(*[F.struct(F.lit(s.service).alias("service"), F.col(s.person_key).alias("key")) for s in SERVICES])
    added = new.select("person_id", F.inline(ids)).filter(F.col("key").isNotNull()).select(
        "person_id",
        F.col("service").alias("source"),
        F.lit("insert").alias("action"),
        F.lit(None).cast("string").alias("field"),
        F.lit(None).cast("string").alias("old_value"),
        id_of_key(F.col("key")).cast("string").alias("new_value"),
    )
    audit = added.unionByName(updates)
    if links is not None:
        column = F.lit(None).cast("string")
        for s in SERVICES:
            column = F.when(F.col("service") == s.service, s.person_key).otherwise(column)
        joined_ids = links.select(
            "person_id",
            F.col("service").alias("source"),
            F.lit("update").alias("action"),
            column.alias("field"),
            F.lit(None).cast("string").alias("old_value"),
            id_of_key(F.col("key")).cast("string").alias("new_value"),
        )
        audit = audit.unionByName(joined_ids)
    return existing.unionByName(inserts), audit


def merge_households(
    household: DataFrame, pantry: DataFrame, person: DataFrame, household_column: str = HOUSEHOLD_COLUMN
) -> DataFrame:
    """Existing links, and those that pantry rows add: the person behind the client id belongs to the named household."""
    spec = next(s for s in SERVICES if s.service == "pantry")
    id_text, household_text = F.col(f"`{spec.id_column}`"), F.col(f"`{household_column}`")
    named = (
        once(
            pantry.filter(is_numeric_id(id_text) & is_numeric_id(household_text)),
            numeric_id(household_text).alias("household_id"),
            id_key(id_text).alias("key"),
        )
        .select("household_id", "key")
        .filter(F.col("household_id").isNotNull() & F.col("key").isNotNull())
        .distinct()
    )
    clients = person.select(F.col("person_id").cast(ID).alias("person_id"), id_key(F.col(spec.person_key)).alias("key"))
    clients = clients.filter(F.col("key").isNotNull())
    links = spread_join(clients, named, ["key"]).select("household_id", "person_id").distinct()
    old = household.select(F.col("household_id").cast(ID).alias("household_id"), F.col("person_id").cast(ID).alias("person_id"))
    return old.unionByName(links.join(old, ["household_id", "person_id"], "left_anti"))


def rejected_households(pantry: DataFrame, household_column: str = HOUSEHOLD_COLUMN) -> DataFrame:
    """(reason, count) of pantry rows that add no household link although they name a household, or name none."""
    spec = next(s for s in SERVICES if s.service == "pantry")
    id_text, household_text = F.col(f"`{spec.id_column}`"), F.col(f"`{household_column}`")
    reason = (
        F.when(is_blank(household_text), F.lit("blank household"))
        .when(~is_numeric_id(household_text), F.lit("household is not numeric"))
        .when(numeric_id(household_text).isNull(), F.lit("household out of range"))
        .when(id_key(id_text).isNull(), F.lit("unusable id"))
    )
    return pantry.select(reason.alias("reason")).filter(F.col("reason").isNotNull()).groupBy("reason").agg(F.count(F.lit(1)).alias("count"))


def sweep_latest(person: DataFrame, records: DataFrame, people: DataFrame | None = None, latest: DataFrame | None = None) -> DataFrame:
    """Every field set to its latest non-blank export value; what no export names stays. With `people`, theirs alone.

    `latest` is `latest_by_person` of the same arguments, for callers that have it. People whom a merge has just made from `records`
    need not be in it: their fields are the latest values.
    """
    joined = person.join(latest_by_person(person, records, people) if latest is None else latest, "person_id", "left")
    return joined.select(
        *_ids(),
        *[F.coalesce(F.col(f"_{n}.value"), F.col(n)).alias(n) for n in PERSON_FIELDS],
    )


def empty_records(spark: SparkSession) -> DataFrame:
    """The records of no export rows."""
    fields = [f"{name} struct<seen: date, value: {PERSON[name].dataType.simpleString()}>" for name in PERSON_FIELDS]
    return spark.createDataFrame([], f"service string, key bigint, {', '.join(fields)}")


def empty_state(spark: SparkSession) -> tuple[DataFrame, DataFrame, DataFrame]:
    """`person`, `household` and audit without rows."""
    return tuple(spark.createDataFrame([], schema) for schema in (PERSON, HOUSEHOLD, PERSON_AUDIT))
