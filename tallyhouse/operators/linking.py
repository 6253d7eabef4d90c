"""New ids of people who are there already, found by name and birth date.

A person may be known under several names (the table's, and those that its exports give), so names and people form a graph, and the people
and new ids that belong together are a connected component of it. The ids of a component become those of one human only where that is
beyond doubt: at most one person is there already, and no service has two ids. Else every new id stays a person of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyhouse.functions import id_of_key
from tallyhouse.operators.events import person_keys
from tallyhouse.operators.skew import spread_join
from tallyhouse.schemas import ID, PERSON, SERVICES
from tallyhouse.session import checkpointed


def full_name(first: Column, last: Column, born: Column) -> Column:
    """First name, last name and birth date as one key; NULL if one is blank."""
    names = [F.lower(F.trim(first)), F.lower(F.trim(last))]
    whole = (names[0] != "") & (names[1] != "") & born.isNotNull()
    return F.when(whole, F.struct(names[0].alias("first"), names[1].alias("last"), born.alias("born")))


def connected(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node that each node of undirected edges (a, b) is connected with.

    Each round every node takes the smallest root among its neighbours and then the root of that root, so the rounds grow with the logarithm of a
    path's length in most graphs. Lineage is cut every round; a node with very many edges is only a minimum, combined map-side.
    """
    both = checkpointed(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct())
    roots = checkpointed(both.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())
    while True:
        near = spread_join(both, roots.select(F.col("node").alias("b"), "root"), ["b"]).groupBy("a").agg(F.min("root").alias("_near"))
        nearer = roots.join(near, roots["node"] == near["a"], "left").select("node", F.col("root").alias("_old"), F.least("root", "_near").alias("root"))
        jumps = roots.select(F.col("node").alias("root"), F.col("root").alias("_next"))
        moved = checkpointed(spread_join(nearer, jumps, ["root"], "left").select("node", "_old", F.least("root", "_next").alias("root")))
        roots = moved.select("node", "root")
        if moved.where("root <> _old").isEmpty():
            return roots


def known_names(person: DataFrame, records: DataFrame) -> DataFrame:
    """(person_id, name): all names that people are known under."""
    own = person.select("person_id", full_name(F.col("first_name"), F.col("last_name"), F.col("dob")).alias("name"))
    given = spread_join(person_keys(person), records, ["service", "key"]).select("person_id", record_name().alias("name"))
    return own.unionByName(given).where(F.col("person_id").isNotNull() & F.col("name").isNotNull()).distinct()


def record_name() -> Column:
    return full_name(F.col("first_name.value"), F.col("last_name.value"), F.col("dob.value"))


def link_known(person: DataFrame, records: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """`person` with the new ids that belong to somebody there; those links as (person_id, service, key); and the new ids (service, key)
    that must stay apart, since somebody there has their name but it is open who. All other new ids concern nobody there."""
    held = person_keys(person).select("service", "key").distinct()
    fresh = checkpointed(records.join(held, ["service", "key"], "left_anti").select("service", "key", record_name().alias("name")).where("name IS NOT NULL"))
    known = checkpointed(known_names(person, records))
    # Only people with several names join names together.
    first = known.groupBy("person_id").agg(F.min("name").alias("a"), F.max("name").alias("_last")).where("a <> _last").drop("_last")
    roots = connected(spread_join(known, first, ["person_id"]).select("a", F.col("name").alias("b")))
    roots = roots.select(F.col("node").alias("name"), "root")

    def rooted(df: DataFrame) -> DataFrame:
        return spread_join(df, roots, ["name"], "left").withColumn("root", F.coalesce("root", "name")).drop("name")

    people = rooted(known).select("root", "person_id").distinct()
    wanted = checkpointed(rooted(fresh))
    near = checkpointed(spread_join(people, wanted.select("root").distinct(), ["root"], "left_semi"))
    ids = spread_join(near, person_keys(person), ["person_id"]).select("root", "service", "key", F.lit(None).cast(ID).alias("person_id"))
    members = (
        wanted.select("root", "service", "key", F.lit(None).cast(ID).alias("person_id"))
        .unionByName(ids)
        .unionByName(near.select("root", F.lit(None).cast("string").alias("service"), F.lit(None).cast("bigint").alias("key"), F.col("person_id").cast(ID).alias("person_id")))
    )
    one_each = F.lit(True)
    for s in SERVICES:
        one_each = one_each & (F.count_if(F.col("service") == s.service) <= 1)
    judged = members.groupBy("root").agg(F.count("person_id").alias("_people"), F.max("person_id").alias("person_id"), one_each.alias("_one"))
    judged = judged.where("_people > 0").withColumn("_linked", (F.col("_people") == 1) & F.col("_one"))
    met = checkpointed(spread_join(wanted, judged, ["root"]).select("service", "key", "person_id", "_linked"))
    links = met.where("_linked").select("person_id", "service", "key")
    keys = links.groupBy("person_id").agg(*[F.max(F.when(F.col("service") == s.service, F.col("key"))).alias(f"_{s.service}") for s in SERVICES])
    stored = person.withColumn("_id", F.col("person_id").cast(ID)).join(keys.withColumnRenamed("person_id", "_id"), "_id", "left")
    added = {s.person_key: F.coalesce(F.col(s.person_key).cast(ID), id_of_key(F.col(f"_{s.service}")).cast(ID)).alias(s.person_key) for s in SERVICES}
    columns = [added.get(f.name, F.col(f.name)) for f in PERSON]
    return stored.select(*columns), links, met.where("NOT _linked").select("service", "key")
