from __future__ import annotations

import pytest

from tallyhouse.sources.csv_export import insertable_columns
from tallyhouse.sources.jdbc import DatabaseSettings, jdbc_options
from tallyhouse.sources.tables import list_export_tables, list_tables, preview


@pytest.fixture
def tables(spark):
    names = ["b_export", "a_export", "axexport", "other"]
    for name in names:
        spark.range(3).createOrReplaceTempView(name)
    yield names
    for name in names:
        spark.catalog.dropTempView(name)


def test_lists(spark, tables):
    assert [t for t in list_tables(spark) if t in tables] == sorted(tables)
    assert [t for t in list_export_tables(spark) if t in tables] == ["a_export", "b_export"]


def test_preview(spark, tables):
    assert preview(spark, " other ", 2, order_by=("id",)).collect() == [(0,), (1,)]
    assert preview(spark, "other", 0).count() == 1
    for name in ("", "missing"):
        with pytest.raises(ValueError, match="no table|not found"):
            preview(spark, name)


def test_columns(spark, tables):
    spark.sql("SELECT 1 AS id, 2 AS `a b`, 3 AS c").createOrReplaceTempView("other")
    assert insertable_columns(spark, "other", ("id",)) == ["a b", "c"]


def test_connection_options():
    options = jdbc_options(DatabaseSettings("db.example", 3307, "me", "secret", "services", ssl=True))
    assert options["url"] == (
        "jdbc:mysql://db.example:3307/services?connectTimeout=5000&sslMode=REQUIRED"
    )
    assert (options["user"], options["password"]) == ("me", "secret")
    assert "sslMode=DISABLED" in jdbc_options(DatabaseSettings())["url"]
