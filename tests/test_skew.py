from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tallyhouse.operators.skew import hot_keys, spread_join


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def found(df, keys):
    """Hot keys and their pieces; hashes are turned back into keys."""
    named = df.select(*keys, F.xxhash64(*keys).alias("_item")).distinct()
    return {r[0]: r["_pieces"] for r in named.join(hot_keys(df, keys), "_item").select(*keys, "_pieces").collect()}


@pytest.fixture
def sides(spark):
    # A third of the rows on one key, some keys without partner, a NULL key.
    many = spark.range(300).select(
        F.when(F.col("id") % 3 == 0, 7).when(F.col("id") == 1, None).otherwise(F.col("id") % 50).cast("int").alias("k"), "id"
    )
    one = spark.createDataFrame([(7, "a"), (7, "b"), (3, "c"), (4, "d"), (99, "e")], "k int, v string")
    return many, one


@pytest.mark.parametrize("how", ["inner", "left", "left_semi"])
@pytest.mark.parametrize("bound", [1, 10, 1000])
def test_same_as_a_plain_join(sides, hot_keys_from, how, bound):
    many, one = sides
    hot_keys_from(bound)
    plain = many.join(one, ["k"], how)
    spread = spread_join(many, one, ["k"], how)
    assert spread.columns == plain.columns
    key = lambda t: tuple(str(x) for x in t)  # noqa: E731 - NULLs do not sort
    assert sorted(map(key, spread.collect())) == sorted(map(key, plain.collect()))


def test_pieces_have_about_the_size_of_the_bound(sides, hot_keys_from):
    hot_keys_from(25)
    # 300 rows in 4 partitions: an average of 75, above the bound.
    assert found(sides[0], ["k"]) == {7: 2}


def test_no_more_hot_keys_than_partitions(spark, hot_keys_from):
    hot_keys_from(1)
    many = spark.range(10_000).select((F.col("id") % 1000).alias("k"), "id")
    assert hot_keys(many, ["k"]).count() == 0
    assert found(many.where("id < 4"), ["k"]) == dict.fromkeys(range(4), 1)


def test_keys_are_not_shuffled_to_find_the_hot_ones(spark, sides, hot_keys_from):
    """Only sketches travel: the one exchange is that of a row a task to a single one, and no hash partitioning by key."""
    hot_keys_from(1)
    plan = hot_keys(sides[0], ["k"])._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and plan.count("Exchange") == 1
    joined = spread_join(*sides, ["k"])._jdf.queryExecution().executedPlan().toString()
    assert "approx_top_k" in joined and joined.count("hashpartitioning(_item") == 0


def test_a_hot_key_among_very_many(spark, hot_keys_from):
    """A third of the rows on one key, the rest all different: more keys than the sketch keeps."""
    hot_keys_from(1000)
    many = spark.range(120_000, numPartitions=4).select(F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id")).alias("k"), "id")
    hot = found(many, ["k"])
    assert set(hot) == {-1}


def test_building_a_join_runs_no_job(spark, sides, hot_keys_from):
    hot_keys_from(1)
    spark.sparkContext.setJobGroup("building", "")
    try:
        joined = spread_join(*sides, ["k"])
        assert not spark.sparkContext.statusTracker().getJobIdsForGroup("building")
        joined.count()
        assert spark.sparkContext.statusTracker().getJobIdsForGroup("building")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_repeated_links_do_not_pile_up(spark, hot_keys_from):
    from tallyhouse.operators.household import member_months

    hot_keys_from(10)
    links = spark.createDataFrame([(1, 5)] * 2000 + [(1, 6)], "household_id bigint, person_id bigint")
    visits = spark.createDataFrame([(5, 3)], "person_id bigint, months bigint")
    assert rows(member_months(visits, links)) == [(5, 3), (6, 3)]
