"""Connected components of an edge list, as Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyhouse.llm.common import stored


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """node, root (the smallest node of its component; the root itself has no row) for edges with columns a and b of one type.

    Large-star and small-star steps: in the first every node hands its larger neighbours to its smallest one, in the second its smaller
    ones. The number of edges never grows; the steps end after about log n rounds. Each round is written to the shared folder.
    """
    now = _stored(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), label)
    mark = _mark(now)
    while True:
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = large.join(least, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = _stored(moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), label)
        new = _mark(now)
        if new == mark:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        mark = new


def _stored(edges: DataFrame, label: str) -> DataFrame:
    return stored(edges, label)


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
