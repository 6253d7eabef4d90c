from __future__ import annotations

import sys
import tempfile
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from tallyhouse.session import build_session  # noqa: E402

SMALL = "/root/testdata/sf0.001"
MIDDLE = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests",
        "local[4]",
        spark__sql__shuffle__partitions="4",
        spark__ui__enabled="false",
        spark__sql__warehouse__dir=tempfile.mkdtemp(prefix="tallyhouse-warehouse-"),
        spark__checkpoint__dir=tempfile.mkdtemp(prefix="tallyhouse-checkpoint-"),
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def hot_keys_from(spark):
    """Lower the bound for hot keys, so that small data takes the path of large data."""

    def lower(rows: int) -> None:
        spark.conf.set("spark.tallyhouse.hotKeyRows", str(rows))

    yield lower
    spark.conf.unset("spark.tallyhouse.hotKeyRows")
