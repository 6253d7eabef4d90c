"""Joins that hold up when one key owns a large share of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HOT_KEY_ROWS_CONF = "spark.tallyhouse.hotKeyRows"
HOT_KEY_ROWS = 1_000_000
#: Keys that a sketch keeps track of.
TRACKED, MOST_TRACKED = 10_000, 1_000_000


def hot_key_rows(spark: SparkSession) -> int:
    """From how many rows on a key counts as hot."""
    return int(spark.conf.get(HOT_KEY_ROWS_CONF, str(HOT_KEY_ROWS)))


def hot_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """(_item, _pieces): hashes of the keys with an outsize share of the rows, and into how many pieces each should be cut.

    Hot is a key with at least `hot_key_rows` rows and at least the rows of an average shuffle partition. By the latter there are no more
    hot keys than shuffle partitions, whatever the size of the data. They are found by a frequent-items sketch of bounded size (Spark's
    `approx_top_k`): every task sends one, and keys are never shuffled. A count may be short by some ten-thousandths of all rows, so a key
    that is barely hot may be missed, which leaves its rows together; two keys with one hash are both dealt, which is harmless. Lazy.
    """
    spark = df.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    tracked = min(max(TRACKED, 8 * partitions), MOST_TRACKED)
    found = df.select(F.xxhash64(*keys).alias("_item")).agg(
        F.call_function("approx_top_k", F.col("_item"), F.lit(min(partitions, tracked)), F.lit(tracked)).alias("_top"), F.count(F.lit(1)).alias("_all")
    )
    least = F.greatest(F.lit(float(hot_key_rows(spark))), F.col("_all") / partitions)
    return (
        found.select(F.inline("_top"), least.alias("_least"))
        .filter(F.col("count") >= F.col("_least"))
        .select(F.col("item").alias("_item"), F.ceil(F.col("count") / F.col("_least")).cast("int").alias("_pieces"))
    )


def spread_join(many: DataFrame, one: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join of `many` (any number of rows on a key) with `one` (few rows on a key); `how` is inner, left or left_semi.

    Rows of `many` on a hot key are dealt to several pieces by a hash of the row, and only the rows of `one` on a hot key are repeated,
    once a piece. Every row of `many` still meets every partner exactly once. The dealing is a pure function of the row, so a task that
    runs again deals the same; equal rows stay together, so make `many` distinct first where repeats mean nothing. The list of hot keys
    is broadcast, which its bound allows, and nothing is run while the plan is built.
    """
    hot, item = F.broadcast(hot_keys(many, keys)), F.xxhash64(*keys)
    pieces = F.coalesce(F.col("_pieces"), F.lit(1))
    dealt = (
        many.withColumn("_item", item)
        .join(hot, "_item", "left")
        .withColumn("_piece", F.pmod(F.xxhash64(*[F.col(c) for c in many.columns]), pieces).cast("int"))
        .drop("_pieces", "_item")
    )
    repeated = (
        one.withColumn("_item", item)
        .join(hot, "_item", "left")
        .withColumn("_piece", F.explode(F.sequence(F.lit(0), pieces - 1)))
        .drop("_pieces", "_item")
    )
    return dealt.join(repeated, [*keys, "_piece"], how).drop("_piece")
