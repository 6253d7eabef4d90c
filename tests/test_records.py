"""CSV records read by many tasks, against Spark's own reader of whole files."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyhouse.sources import csv_export, records

COLUMNS = ["a", "b", "c"]


@pytest.fixture
def tiny_splits(spark):
    """Splits of a few bytes, so that records lie across several."""

    def set_to(size):
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        spark.conf.set("spark.sql.files.minPartitionNum", "1")

    yield set_to
    for name in ("maxPartitionBytes", "openCostInBytes", "minPartitionNum"):
        spark.conf.unset(f"spark.sql.files.{name}")


def by_tasks(spark, path, header=False):
    rows = csv_export.scan_export(spark, path, COLUMNS, header)
    return sorted(map(repr, (tuple(r) for r in rows.collect())))


def by_files(spark, path, header=False):
    parsed = spark.read.schema(csv_export.reader_schema(COLUMNS)).options(**csv_export.reader_options(header, True)).csv(path)
    return sorted(map(repr, (tuple(r) for r in csv_export.with_width(parsed, COLUMNS).collect())))


def made(draw, number):
    plain = lambda: "".join(draw.choice(["x", "7", " ", "é", "'"]) for _ in range(draw.randint(0, 5)))
    quoted = lambda: '"' + "".join(draw.choice(["x", "\n", "\r\n", ",", '""', "\n\n", "ü"]) for _ in range(draw.randint(0, 9))) + '"'
    stray = lambda: draw.choice(['5" pipe', 'm"id"dle', 'a"'])
    field = lambda: draw.choices([plain, quoted, stray], [5, 4, 1])[0]()
    return "".join(",".join(field() for _ in range(draw.choice([3, 3, 3, 1, 2, 4]))) + draw.choice(["\n", "\n", "\r\n"]) for _ in range(number))


@pytest.mark.parametrize("size", [7, 200])
def test_same_rows_as_a_reader_of_whole_files(spark, tmp_path, tiny_splits, size):
    draw = random.Random(size)
    for k in range(3):
        (tmp_path / f"{k}.csv").write_text(made(draw, 40), newline="")
    expected = {header: by_files(spark, str(tmp_path), header) for header in (False, True)}
    tiny_splits(size)
    for header in (False, True):
        assert by_tasks(spark, str(tmp_path), header) == expected[header]


def test_a_large_file_is_read_by_many_tasks(spark, tmp_path, tiny_splits):
    text = "".join(f'{k},"line {k}\nmore, of ""it""",{k % 7}\n' for k in range(5000))
    (tmp_path / "big.csv").write_text(text)
    tiny_splits(10_000)
    found = csv_export.read_export_csv(spark, str(tmp_path), COLUMNS)
    assert found.rdd.getNumPartitions() >= 15
    assert spark.read.text(str(tmp_path), lineSep="\n").rdd.getNumPartitions() >= 15
    rows = {r["a"]: (r["b"], r["c"]) for r in found.collect()}
    assert len(rows) == 5000 and rows["4321"] == ('line 4321\nmore, of "it"', str(4321 % 7))
    assert found.where("c IS NULL").count() == 0


def test_a_record_is_read_and_parsed_once(spark, tmp_path, tiny_splits):
    (tmp_path / "a.csv").write_text("".join(f'{k},"b, {k}",c\n' for k in range(200)))
    tiny_splits(500)
    plan = csv_export.scan_export(spark, str(tmp_path), COLUMNS)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan text") == 1
    assert plan.count("from_csv") == 1


def test_a_field_over_many_splits(spark, tmp_path, tiny_splits):
    long = "\n".join(f"line {k}, and so on" for k in range(300))
    (tmp_path / "a.csv").write_text(f'1,"{long}",x\n2,b,c\n')
    (tmp_path / "b.csv").write_text("3,b,c")
    tiny_splits(64)
    assert {tuple(r) for r in csv_export.read_export_csv(spark, str(tmp_path), COLUMNS).collect()} == {("1", long, "x"), ("2", "b", "c"), ("3", "b", "c")}


@pytest.mark.parametrize("text", ["", "\n", '1,"never closed\n2,b\n3,c\n', '"a\nb",c,d', "h1,h2,h3\n", '\n\n"h\n1",h2,h3\n1,2,3\n'])
@pytest.mark.parametrize("header", [False, True])
def test_odd_files(spark, tmp_path, tiny_splits, text, header):
    (tmp_path / "a.csv").write_text(text)
    expected = by_files(spark, str(tmp_path), header)
    tiny_splits(6)
    found = by_tasks(spark, str(tmp_path), header)
    # A field that is never closed takes the rest of its file, but for the last line break.
    assert found == [row.replace("3,c\\n'", "3,c'") for row in expected]


def test_beyond_the_bound_a_file_is_read_by_one_task(spark, tmp_path, tiny_splits, monkeypatch):
    (tmp_path / "a.csv").write_text('1,"a\nb\nc\nd\ne",x\n' * 20)
    tiny_splits(5)
    expected = by_tasks(spark, str(tmp_path))
    monkeypatch.setattr(records, "MOST_OPEN_SPLITS", 3)
    assert records.read_records(spark, str(tmp_path)) is None
    assert by_tasks(spark, str(tmp_path)) == expected


def test_states_are_the_composition_of_lines():
    draw = np.random.default_rng(1)
    for _ in range(200):
        outside, inside = draw.random((2, draw.integers(1, 12))) < 0.5
        for begins in (False, True):
            state, found = begins, []
            for a, b in zip(outside, inside, strict=True):
                state = bool(b if state else a)
                found.append(state)
            assert records._states(outside, inside, begins).tolist() == found


def test_reading_line_by_line_refuses_cut_records(spark, tmp_path):
    (tmp_path / "a.csv").write_text('1,"a\nb",c\n')
    with pytest.raises(csv_export.OpenQuoteError):
        csv_export.read_export_csv(spark, str(tmp_path), COLUMNS, multi_line=False)
    (tmp_path / "a.csv").write_text("1,b,c\n")
    assert csv_export.read_export_csv(spark, str(tmp_path), COLUMNS, multi_line=False).select(F.count("*")).first()[0] == 1
