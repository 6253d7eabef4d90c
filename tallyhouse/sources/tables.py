"""Catalog look-ups and table previews."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyhouse.functions import clamp_limit


def list_tables(spark: SparkSession) -> list[str]:
    """Names of all tables and views of the current database, ascending."""
    return sorted(t.name for t in spark.catalog.listTables())


def list_export_tables(spark: SparkSession) -> list[str]:
    """Names that end in `_export`, ascending."""
    return [name for name in list_tables(spark) if name.endswith("_export")]


def preview(spark: SparkSession, table: str, limit: object = 200, order_by: tuple[str, ...] = ()) -> DataFrame:
    """Some rows of a table (1 to 2000); with `order_by` always the same ones."""
    name = table.strip()
    if not name:
        raise ValueError("no table selected")
    if not spark.catalog.tableExists(name):
        raise ValueError(f"table not found: {name}")
    rows = spark.table(name)
    return (rows.orderBy(*order_by) if order_by else rows).limit(clamp_limit(limit, 200))
